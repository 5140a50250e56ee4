"""Transitive closure and what rests on it. Edges are rows (sub, pred, obj); obj is the parent."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def with_relations(edges: DataFrame, relations: Sequence[str] | None) -> DataFrame:
    return edges if relations is None else edges.filter(F.col("pred").isin(*relations))


def closure(edges: DataFrame, relations: Sequence[str] | None = None) -> DataFrame:
    """(term, anc): proper ancestors, without self even on cycles (ONT-15, ONT-16).

    Path doubling: a pair at distance d in (2^k, 2^(k+1)] is a pair at distance 2^k, found in the last round, joined with
    one at 2^k at most. So the rounds grow with the logarithm of the depth, and each joins only the last round's news.
    """
    total = with_relations(edges, relations).filter("sub <> obj").select(F.col("sub").alias("term"), F.col("obj").alias("anc")).distinct()
    total = cut(total)
    news = total
    while news.limit(1).count():
        left, right = news.select(F.col("term"), F.col("anc").alias("mid")), total.select(F.col("term").alias("mid"), "anc")
        found = left.join(right, "mid").select("term", "anc").filter("term <> anc").distinct()
        news = cut(found.join(total, ["term", "anc"], "left_anti"))
        total = total.unionAll(news)
    return cut(total)  # one scan for every later use, instead of a union of rounds


def reflexive(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """closed and each node (id) as its own ancestor."""
    return closed.unionAll(nodes.select(F.col("id").alias("term"), F.col("id").alias("anc")).distinct())


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("sub").alias("id")).unionAll(edges.select(F.col("obj").alias("id"))).distinct()


def walk(edges: DataFrame, seeds: DataFrame, up: bool = True, depth: int | None = None, relations: Sequence[str] | None = None) -> DataFrame:
    """(seed, id, depth): what seeds (id) reach within ``depth`` steps, with the least distance; the seed itself at 0 (SRC-13).

    Relations are filtered before walking, which equals walking inside the ancestors over all relations (ONT-35).
    """
    e = with_relations(edges, relations).filter("sub <> obj")
    step = e.select(F.col("sub" if up else "obj").alias("at"), F.col("obj" if up else "sub").alias("to"))  # what is found is made distinct
    now = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)))
    total = now
    k = 0
    while depth is None or k < depth:
        k += 1
        found = now.join(step, F.col("id") == F.col("at")).select("seed", F.col("to").alias("id")).distinct()
        now = cut(found.join(total, ["seed", "id"], "left_anti").withColumn("depth", F.lit(k)))
        if not now.limit(1).count():
            break
        total = total.unionAll(now)
    return total


def in_cycles(edges: DataFrame) -> DataFrame:
    """(id): nodes that reach themselves (ONT-37), from the pairs that reach each other."""
    closed = closure(edges)
    back = closed.select(F.col("term").alias("anc"), F.col("anc").alias("term"))
    loops = edges.filter("sub = obj").select(F.col("sub").alias("id"))
    return closed.intersect(back.select("term", "anc")).select(F.col("term").alias("id")).unionAll(loops).distinct()


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id that a node reaches and is reached from (LEX-16)."""
    closed = closure(edges)
    mutual = closed.intersect(closed.select(F.col("anc").alias("term"), F.col("term").alias("anc")))
    least = mutual.groupBy("term").agg(F.min("anc").alias("m"))
    return nodes.join(least, F.col("id") == F.col("term"), "left").select("id", F.least("id", F.coalesce("m", F.col("id"))).alias("component"))


def topological(edges: DataFrame, nodes: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, depth): the longest path from a root, which orders an acyclic graph (ONT-21); fails on a cycle."""
    e = edges.filter("sub <> obj").select("sub", "obj").distinct()
    now = cut(nodes.select("id").distinct().withColumn("depth", F.lit(0)))
    for _ in range(most):
        got = e.join(now, F.col("obj") == F.col("id")).groupBy("sub").agg((F.max("depth") + 1).alias("d"))
        nxt = cut(now.join(got, F.col("id") == F.col("sub"), "left").select("id", F.coalesce("d", F.lit(0)).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("grew")))
        grew = nxt.filter("grew").limit(1).count()
        now = nxt.select("id", "depth")
        if not grew:
            return now
    raise ValueError("the graph has a cycle")


def simple_paths(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(path): all simple upward paths from start (id) to nodes without parents (ONT-38), or those of up to ``most`` nodes."""
    e = edges.select("sub", "obj").distinct()
    now, done = start.select(F.array("id").alias("path")), None
    for _ in count() if most is None else range(most):
        last = F.element_at("path", -1)
        more = now.join(e, last == F.col("sub"), "left").filter("obj is null or not array_contains(path, obj)")
        ends = more.filter("obj is null").select("path")
        done = ends if done is None else done.unionAll(ends)
        now = cut(more.filter("obj is not null").select(F.concat("path", F.array("obj")).alias("path")))
        if not now.limit(1).count():
            break
    return done


def path_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_paths, longest): how many paths lead from each node to roots, and the longest, without listing them; for acyclic graphs."""
    depth = topological(edges, nodes)
    order = depth.agg(F.max("depth")).first()[0] or 0
    e = edges.select("sub", "obj").distinct()
    now = cut(depth.filter("depth = 0").select("id", F.lit(1).cast("long").alias("n_paths"), F.col("depth").alias("longest")))
    for k in range(1, order + 1):
        layer = depth.filter(F.col("depth") == k).join(e, F.col("id") == F.col("sub")).select("id", "obj", "depth")
        got = layer.join(now.select(F.col("id").alias("obj"), "n_paths"), "obj").groupBy("id").agg(F.sum("n_paths").alias("n_paths"), F.first("depth").alias("longest"))
        now = cut(now.unionByName(got))
    return now


def simple_cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(path): simple cycles of up to ``longest`` nodes, each once, beginning at its least node (ONT-46)."""
    e = edges.select("sub", "obj").distinct()
    now = e.select(F.array("sub").alias("path"), F.col("obj").alias("nxt"))
    done = now.filter("nxt = path[0]").select("path")
    for _ in range(longest - 1):
        now = now.filter("nxt > path[0] and not array_contains(path, nxt)").select(F.concat("path", F.array("nxt")).alias("path"))
        now = now.join(e, F.element_at("path", -1) == F.col("sub")).select("path", F.col("obj").alias("nxt"))
        done = done.unionAll(now.filter("nxt = path[0]").select("path"))
    return done
