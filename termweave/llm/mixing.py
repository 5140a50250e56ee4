"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1 and must be taken at most ``limit`` times. Among all rates under that bound which meet each
source's token target, those nearest to 1 in relative entropy are min(limit, exp(lambda_s * z)), z the document's size over
the mean size, and lambda_s solves a convex dual in one variable per source. Newton iterations on that dual are aggregations
over the (source, size) histogram, which is exact and far smaller than the documents. Rates become whole copies: sizes of a
source are passed from large to small and the rounding error in words is carried on, so that a source ends within half of
its smallest sizes of its target; which documents of one size get the extra copy is settled by a hash of the id.

Defined results: null texts have size 0; null sources are one source, ordered last; a document of size 0 has rate 1 and
takes 0 words; an empty table gives an empty result; repeated rows are separate documents with the same id; which of
documents with equal ids and sizes takes the extra copy is settled by a hash of the text, so only rows equal in both cannot be
told apart; a very long text is a size like any other. Extra columns are carried along; columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged, text_of

#: Buckets by hash inside a (source, size) group, so that a large group is ranked by many tasks.
SALTS = 256
NEWTON_STEPS, TOLERANCE = 60, 1e-7


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target: sources by code point, null last, weigh as the cycle of weights says and share budget times all
    sizes; none gets over limit times its size, and the excess goes to the others by weight. One row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered by a range sort and the counts of its partitions, so no task sees all sources
    ranged = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = staged(ranged.withColumn("p", F.spark_partition_id()), "mix-sources")
    before, firsts = 0, []
    for r in ranged.groupBy("p").count().orderBy("p").collect():  # a row for each partition
        firsts.append((r.p, before))
        before += r["count"]
    firsts = sizes.sparkSession.createDataFrame(firsts, "p int, first long")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    k = F.col("first") + F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    per = staged(ranged.join(F.broadcast(firsts), "p").select("source", "source_size", F.get(cycle, k % len(weights)).alias("w"), (limit * F.col("source_size")).alias("cap")), "mix-weights")
    # the level that a weight of 1 gets: it rises as sources are stopped at their cap, until none more is
    whole, stopped, level = budget * (per.agg(F.sum("source_size")).first()[0] or 0), -1, 0.0
    while True:
        at = F.col("cap") <= F.lit(level) * F.col("w")
        got = per.agg(F.count_if(at).alias("n"), F.sum(F.when(at, F.col("cap"))).alias("capped"), F.sum(F.when(~at, F.col("w"))).alias("open")).first()
        if got.n == stopped or not got.open:
            break
        stopped, level = got.n, (whole - (got.capped or 0.0)) / got.open
    share = F.col("cap") if not got.open else F.least("cap", F.lit(level) * F.col("w"))
    return per.select("source", "source_size", share.cast("double").alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, limit: float = 2.0) -> DataFrame:
    """source, lam, mean: the dual's solution for each source. lam is null where every document is taken at the limit.

    A step that leaves the bracket [lo, hi] is replaced by bisection; the bracket shrinks at every step, so the loop ends.
    """
    joined = histogram.join(targets, histogram.source.eqNullSafe(targets.source)).drop(targets.source)
    mean = joined.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    mean = mean.withColumn("mean", F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")))
    state = mean.select(
        "source", "target", "mean",
        F.lit(0.0).alias("lam"),
        F.lit(-1e6).alias("lo"),
        (F.log(F.lit(limit)) * F.col("mean") / F.coalesce("least", F.lit(1)) + 1e-9).alias("hi"),
        ((F.col("source_size") == 0) | (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12))).alias("done"),
        (F.col("source_size") > 0).alias("full"),
    )
    state = state.withColumn("full", F.col("done") & F.col("full"))
    state, hist = staged(state, "mix-state"), staged(histogram, "mix-sizes")
    for _ in range(NEWTON_STEPS):
        now = state.filter(~F.col("done")).select(F.col("source").alias("s"), "lam", "mean", "target")
        z = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * z, F.log(F.lit(limit))))
        at = hist.join(now, hist.source.eqNullSafe(now.s)).groupBy("s").agg(
            (F.sum(F.col("n") * F.col("size") * tilt) - F.first("target")).alias("f"),
            F.sum(F.when(F.col("lam") * z < F.log(F.lit(limit)), F.col("n") * F.col("size") * z * tilt).otherwise(0.0)).alias("df"),
        )
        nxt = state.join(at, state.source.eqNullSafe(at.s), "left").drop("s")
        nxt = nxt.withColumn("hi", F.when(F.col("f") > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("f") < 0, F.col("lam")).otherwise(F.col("lo")))
        step = F.col("lam") - F.col("f") / F.when(F.col("df") > 0, F.col("df"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        nxt = nxt.withColumn("done", F.col("done") | F.coalesce(F.abs(F.col("f")) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)), F.lit(False)))
        nxt = nxt.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
        before, state = state, staged(nxt.select(state.columns), "mix-state")
        release(before)
        if state.filter(~F.col("done")).limit(1).count() == 0:
            break
    return state.select("source", "mean", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def _carry(pdf: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Copies for each size of one source, large sizes first, with the error in words carried on. Its rows are the source's distinct sizes."""
    pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
    total, owed = np.zeros(len(pdf), dtype=np.int64), 0.0
    for i, (size, n, rate) in enumerate(zip(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy())):
        if size == 0:
            total[i] = n
            continue
        owed += rate * n * size
        total[i] = min(max(round(owed / size), 0), int(limit) * n)
        owed -= total[i] * size
    return pdf.assign(total=total)[["source", "size", "n", "total"]]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, limit: int = 2) -> DataFrame:
    """docs with size, source_size, target and copies (0 to limit): how often each document is taken."""
    own = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c not in own]
    rows = docs.select(*keep, F.col(source_col).cast("string").alias("__s"), word_count(text_col).alias("__z"), F.xxhash64(F.col(id_col), F.lit("mix")).alias("__h"), F.xxhash64(text_of(text_col)).alias("__th"))
    rows = rows.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int"))
    salted = staged(rows.groupBy(F.col("__s").alias("source"), F.col("__z").alias("size"), F.col("__salt").alias("salt")).agg(F.count("*").alias("m")), "mix-groups")
    histogram = salted.groupBy("source", "size").agg(F.sum("m").alias("n"))
    targets = staged(source_targets(histogram.select("source", (F.col("size") * F.col("n")).alias("size")), weights, budget, limit), "mix-targets")
    lam = tilts(histogram, targets, limit)
    rated = histogram.join(lam, histogram.source.eqNullSafe(lam.source)).drop(lam.source)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), F.lit(float(limit))).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(limit))))))
    rated = rated.select("source", "size", "n", rate.alias("rate"))
    copies = rated.groupBy("source").applyInPandas(lambda pdf: _carry(pdf, limit), "source string, size long, n long, total long")
    copies = copies.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "total")
    # where each bucket's ranks begin inside its (source, size) group: at most SALTS rows in a group
    offset = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = salted.withColumn("offset", offset).join(copies, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    buckets = buckets.join(targets.select(F.col("source").alias("t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t")))
    # one key without nulls for the ranks and the join on them, so that texts are shuffled once
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    buckets = staged(buckets.select(named(F.col("source")).alias("__k"), F.col("size").alias("__z"), F.col("salt").alias("__salt"), *(F.col(c).alias(f"__b_{c}") for c in ("offset", "n", "total", "source_size", "target"))), "mix-buckets")
    ranked = rows.withColumn("__k", named(F.col("__s"))).withColumn("__rank", F.row_number().over(Window.partitionBy("__k", "__z", "__salt").orderBy("__h", id_col, "__th")) - 1)
    out = ranked.join(buckets, ["__k", "__z", "__salt"])
    extra = F.expr("__b_total div __b_n") + (F.col("__b_offset") + F.col("__rank") < F.expr("__b_total % __b_n")).cast("long")
    return out.select(*keep, F.col("__z").alias("size"), F.col("__b_source_size").alias("source_size"), F.col("__b_target").alias("target"), extra.cast("int").alias("copies"))
