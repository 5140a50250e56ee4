"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one point, with the smallest ids that hold it, so large groups of copies cannot cut a graph apart. Points
are dealt to shards by a hash; a shard holds as many as SHARD_BYTES of doubles allow, or fewer, SPREAD_ROWS at least, where
there are tasks for more shards. Each shard's graph is built in one task and stored as flat neighbour arrays, one row per
shard. Every query goes to every shard, in blocks of QUERY_BYTES, so that an index row is copied once for a block of many
thousand searches; each task holds one shard and one block. Shards return their k best with exact distances, and a partial
top-k merges them. Work thus grows with queries times shards.

A graph is searched over its points moved to their centre and scaled to 1, in single precision where a sample of them shows
that it tells neighbours apart, else in double. What a beam finds is measured and cut in double precision on the original
vectors. Points are inserted in batches: a batch finds its candidates among the earlier ones at once, by a matrix product
while those are PRODUCT_ROWS at most and by searching their graph beyond, and its members are candidates of each other. As
points are ordered by level, a layer is the first rows of one array.

Defined results: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do null ids; of
rows that repeat an id, the least vector counts; only vectors of equal length are compared; equal distances go to the smaller
id; an empty table gives an empty result, and a query with fewer candidates than k gets them all. Extra columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged

#: Bytes of double-precision points in a shard at most, rows that are spread over more shards than that, bytes of queries in a block.
SHARD_BYTES, SPREAD_ROWS, QUERY_BYTES = 64 << 20, 16_384, 16 << 20
#: Links of a point in an upper layer (twice that in the lowest), beam width of building, and of searching SPREAD_ROWS points
#: or fewer (it grows with the square root of a shard's points beyond), points inserted or searched for at once.
LINKS, EF_BUILD, EF_SEARCH, BATCH = 12, 40, 128, 256
#: Points of a beam whose neighbours are looked at in one go.
OPEN_AT_ONCE = 8
#: Candidates that a point's links are chosen from, and lists of links that are chosen anew at once.
CANDIDATES, LISTS_AT_ONCE = 32, 1_024
#: Earlier points among which the candidates of a batch are found by one matrix product; among more, by searching the graph.
PRODUCT_ROWS = 32_768
#: Points whose neighbours tell whether single precision will do, and how far from the true ones those may be.
PROBES, SLACK = 16, 1e-3


def _squared(points: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of x (B, d) to points[at] (B, C)."""
    diff = points[at]
    diff -= x[:, None, :]
    return np.einsum("bcd,bcd->bc", diff, diff)


def _nearest(dist: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` least of each row, in no order."""
    return np.argpartition(dist, count - 1, axis=1)[:, :count] if count < dist.shape[1] else np.broadcast_to(np.arange(dist.shape[1]), dist.shape)


def search_layer(points: np.ndarray, links: np.ndarray, x: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the ``width`` nearest found from its entry points: (ids, squared distances), nearest first, -1 and inf beyond."""
    b = len(x)
    ids = np.full((b, width), -1, dtype=np.int64)
    dist = np.full((b, width), np.inf, dtype=points.dtype)
    opened = np.ones((b, width), dtype=bool)
    mark = np.zeros((b, len(links)), dtype=np.int16)  # not 0: seen; else the column that it was found in last
    entry = entry[:, :width]
    m = entry.shape[1]
    there = entry >= 0
    ids[:, :m], dist[:, :m], opened[:, :m] = entry, np.where(there, _squared(points, entry, x), np.inf), ~there
    row, col = np.nonzero(there)
    mark[row, entry[row, col]] = 1
    several = min(OPEN_AT_ONCE, width)
    live = np.arange(b)
    while True:
        waiting = np.where(opened[live], np.inf, dist[live])
        on = np.isfinite(waiting).any(axis=1)
        live, waiting = live[on], waiting[on]
        if not len(live):
            break
        at = _nearest(waiting, several)
        real = np.isfinite(np.take_along_axis(waiting, at, 1))
        opened[live[:, None], at] = True
        near = np.where(real[:, :, None], links[ids[live[:, None], at]], -1).reshape(len(live), -1)
        row, col = np.nonzero((near >= 0) & (mark[live[:, None], near] == 0))
        to = near[row, col]
        mark[live[row], to] = col + 1
        once = mark[live[row], to] == col + 1  # a neighbour of two of them counts once
        row, col = row[once], col[once]
        fresh = np.zeros(near.shape, dtype=bool)
        fresh[row, col] = True
        # only what is fresh is compared, packed to the left
        count = np.bincount(row, minlength=len(live))
        wide = int(count.max(initial=0))
        if not wide:
            continue
        packed = np.argsort(~fresh, axis=1, kind="stable")[:, :wide]
        got = np.where(np.arange(wide) < count[:, None], np.take_along_axis(near, packed, 1), -1)
        d = np.where(got >= 0, _squared(points, np.maximum(got, 0), x[live]), np.inf)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = _nearest(all_d, width)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], got], axis=1), best, 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], got < 0], axis=1), best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _diverse(points: np.ndarray, x: np.ndarray, ids: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates for the points x, nearest first, those nearer to x than to any chosen one; places left go to the nearest others."""
    b, c = ids.shape
    v = points[np.maximum(ids, 0)]
    v -= x[:, None, :]  # from x, so that little is lost where neighbours are far nearer than the centre
    norm = np.einsum("bcd,bcd->bc", v, v)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen, count = np.zeros((b, c), dtype=bool), np.zeros(b, dtype=np.int64)
    closest = np.full((b, c), np.inf, dtype=points.dtype)
    for k in range(c):
        take = (ids[:, k] >= 0) & (count < keep) & (dist[:, k] < closest[:, k])
        chosen[take, k] = True
        count += take
        closest[take] = np.minimum(closest[take], between[take, k])
    rank = np.where(ids < 0, 3 * c, np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, 1)
    if c < keep:
        out = np.pad(out, ((0, 0), (0, keep - c)), constant_values=-1)
    return out


def _link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, targets: np.ndarray) -> None:
    """Adds new[i] to the lists of targets[i, :]; lists that overflow are chosen anew."""
    cap = links.shape[1]
    src, dst = np.repeat(new, targets.shape[1]), targets.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
    for width in (4, 32, BATCH):
        part = np.flatnonzero((count <= width) & (count > {4: 0, 32: 4, BATCH: 32}[width]))
        at_once = LISTS_AT_ONCE * 4 // max(4, width)
        for i in range(0, len(part), at_once):
            p = part[i : i + at_once]
            at = start[p, None] + np.arange(width)
            add = np.where(np.arange(width) < count[p, None], src[np.minimum(at, len(src) - 1)], -1)
            cand = np.concatenate([links[nodes[p]], add], axis=1)
            ordered = np.sort(cand, axis=1)
            twice = np.zeros(cand.shape, dtype=bool)
            twice[:, 1:] = (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)
            cand = np.where(twice, -1, ordered)
            d = np.where(cand >= 0, _squared(points, np.maximum(cand, 0), points[nodes[p]]), np.inf)
            order = np.argsort(d, axis=1, kind="stable")[:, : cap + 24]
            links[nodes[p]] = _diverse(points, points[nodes[p]], np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), cap)


def _among(points: np.ndarray, norms: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the ``count`` nearest points, as found by their products, and their distances, nearest first."""
    at = _nearest(norms - 2 * (x @ points.T), count)
    dist = _squared(points, at, x)
    by = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(at, by, 1), np.take_along_axis(dist, by, 1)


def build(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers): points in order of insertion, and for each layer, lowest first, the neighbour array of its first rows."""
    n = len(points)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(np.int64), 6)
    order = np.argsort(-levels, kind="stable")
    levels, points = levels[order], points[order]
    layers = [np.full((int((levels >= k).sum()), LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(int(levels[0]) + 1)]
    done, norms = 0, np.einsum("nd,nd->n", points, points)
    while done < n:
        level = levels[done]
        size = min(BATCH, max(LINKS, done), int(np.searchsorted(-levels, -level, side="right")) - done)
        new = np.arange(done, done + size)
        x = points[new]
        diff = x[:, None, :] - x[None, :, :]
        within = np.einsum("abd,abd->ab", diff, diff)
        np.fill_diagonal(within, np.inf)
        peers = np.argsort(within, axis=1, kind="stable")[:, :LINKS]
        peer_d = np.take_along_axis(within, peers, 1)
        peers = np.where(np.isfinite(peer_d), peers + done, -1)
        entry = np.zeros((size, 1), dtype=np.int64)
        few = _among(points[:done], norms[:done], x, EF_BUILD) if 0 < done <= PRODUCT_ROWS else None
        for k in reversed(range(len(layers))):
            if done and few is None and k > level:
                entry = search_layer(points, layers[k][: min(done, len(layers[k]))], x, entry, 1)[0]
            elif k <= level:  # all earlier points are in this layer
                ids, dist = few or (search_layer(points, layers[k][:done], x, entry, EF_BUILD) if done else (peers[:, :0], peer_d[:, :0]))
                entry = ids[:, :4] if done else entry
                ids, dist = np.concatenate([ids, peers], axis=1), np.concatenate([dist, peer_d], axis=1)
                by = np.argsort(dist, axis=1, kind="stable")[:, :CANDIDATES]
                got = _diverse(points, x, np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1), LINKS)
                layers[k][new, :LINKS] = got
                _link_back(points, layers[k], new, got)
        done += size
    return order, layers


def search(points: np.ndarray, layers: list[np.ndarray], x: np.ndarray, k: int, width: int = EF_SEARCH) -> np.ndarray:
    """Rows of the whole beam, ``width`` or k points, for each row of x, -1 where there are fewer; in the order of float32 distances."""
    width = max(width, k)
    out = np.full((len(x), width), -1, dtype=np.int64)
    for a in range(0, len(x), BATCH):
        part = x[a : a + BATCH]
        entry = np.zeros((len(part), 1), dtype=np.int64)
        for links in reversed(layers[1:]):
            entry = search_layer(points, links, part, entry, 1)[0]
        out[a : a + len(part)] = search_layer(points, layers[0], part, entry, width)[0]
    return out


INDEX = "dim int, shard int, ids array<array<bigint>>, points binary, layer_rows array<int>, neighbours binary, single boolean"


def frame(points: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(unit, centre, spread): points / unit lies within 1; less its centre, the medians, which few points far off don't move, it is at most spread."""
    unit = float(np.abs(points).max())
    scaled = points / unit
    centre = np.median(scaled, axis=0)
    return unit, centre, float(np.abs(scaled - centre).max()) or 1.0


def framed(x: np.ndarray, how: tuple[float, np.ndarray, float]) -> np.ndarray:
    unit, centre, spread = how
    with np.errstate(over="ignore"):
        return np.clip((x / unit - centre) / spread, -1e150, 1e150)


def single_will_do(points: np.ndarray, k: int = 10) -> bool:
    """Whether the k nearest of a few points by single precision are, within SLACK, as near as the true ones. points are framed."""
    short, n = points.astype(np.float32), len(points)
    k = min(k, n - 1)
    for i in np.linspace(0, n - 1, min(n, PROBES)).astype(int) if k else ():
        true, found = (((p - p[i]) ** 2).sum(axis=1) for p in (points, short))
        true[i], found[i] = np.inf, np.inf
        if true[np.argpartition(found, k - 1)[:k]].max() > np.partition(true, k - 1)[k - 1] * (1 + SLACK):
            return False
    return True


def distances(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares would overflow or vanish."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        diff = points - x
        square = (diff**2).sum(axis=1)
        out = np.sqrt(square)
        odd = np.flatnonzero(~((square > 1e-290) & (square < np.inf)))
        if len(odd):
            most = np.abs(diff[odd]).max(axis=1)
            scale = np.where((most > 0) & np.isfinite(most), most, 1.0)
            out[odd] = np.where(np.isfinite(most), scale * np.sqrt(((diff[odd] / scale[:, None]) ** 2).sum(axis=1)), np.inf)
    return out


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep", ignore_index=True)
    points = np.array(pdf.vector.tolist(), dtype=np.float64)
    moved = framed(points, frame(points))
    single = single_will_do(moved)
    order, layers = build(moved.astype(np.float32) if single else moved, seed=int(pdf.shard.iloc[0]))
    flat = np.concatenate([x.ravel() for x in layers]).astype(np.int32)
    row = {"dim": int(pdf.dim.iloc[0]), "shard": int(pdf.shard.iloc[0]), "ids": [list(map(int, pdf.ids.iloc[i])) for i in order], "points": points[order].tobytes(), "layer_rows": [len(x) for x in layers], "neighbours": flat.tobytes(), "single": single}
    return pd.DataFrame([row])


def _search_shard(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(index) and len(queries):
        row = index.iloc[0]
        points = np.frombuffer(row.points, dtype=np.float64).reshape(-1, int(row.dim))
        flat, layers, at = np.frombuffer(row.neighbours, dtype=np.int32), [], 0
        for i, n in enumerate(row.layer_rows):
            cap = LINKS * (2 if i == 0 else 1)
            layers.append(flat[at : at + n * cap].reshape(n, cap))
            at += n * cap
        x, how = np.array(queries.vector.tolist(), dtype=np.float64), frame(points)
        moved, sought = framed(points, how), framed(x, how)
        width = max(k + 1, round(EF_SEARCH * math.sqrt(max(1.0, len(points) / SPREAD_ROWS))))
        near = np.empty((len(x), width), dtype=np.int64)
        # a query far outside the shard is as far from all its points in single precision
        short = (np.abs(sought).max(axis=1) < 1e3) if row.single else np.zeros(len(x), dtype=bool)
        for part, kind in ((short, np.float32), (~short, np.float64)):
            if part.any():
                near[part] = search(moved.astype(kind), layers, sought[part].astype(kind), k + 1, width)
        for q, v, ids in zip(queries.query_id, x, near):
            ids = ids[ids >= 0]
            d = distances(points[ids], v)
            if len(ids) > k + 1:  # as each point but the query's has an id, none of the k best lies beyond the k + 1 nearest; ties stay
                near_enough = d <= np.partition(d, k)[k]
                ids, d = ids[near_enough], d[near_enough]
            best = sorted((float(s), int(i)) for s, at in zip(d, ids) for i in row.ids[at] if i != q)[:k]
            found["query_id"] += [q] * len(best)
            found["score"] += [s for s, _ in best]
            found["vec_id"] += [i for _, i in best]
    return pd.DataFrame(found).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector (doubles), dim: one row for each id that takes part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def build_index(vectors: DataFrame, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """One row (INDEX) for each shard of clean vectors; ids holds the k + 1 smallest ids of each point."""
    ranked = vectors.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("n") <= k + 1)
    points = staged(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.get("ids", F.lit(0))).withColumn("dim", F.size("vector")), "hnsw-points")
    n, dim = points.agg(F.count("*"), F.max("dim")).first()
    if shard_rows is None:
        most = max(1, SHARD_BYTES // (8 * (dim or 1)))
        shards = max(math.ceil(n / most), min(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(n / SPREAD_ROWS)))
    else:
        shards = math.ceil(n / shard_rows)
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(max(1, shards))).cast("int"))
    out = staged(dealt.groupBy("dim", "shard").applyInPandas(_build_shard, INDEX), "hnsw-index")
    release(points)
    return out


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, vector, dim) its k nearest found, without itself; ties to the smaller id."""
    queries = staged(queries.select(F.col("id").alias("query_id"), "vector", "dim"), "hnsw-queries")
    n, dim = queries.agg(F.count("*"), F.max("dim")).first()
    blocks = max(1, math.ceil(n / (block or max(1, QUERY_BYTES // (8 * (dim or 1))))))
    shards = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("to_shard"))
    dealt = queries.join(shards, F.col("dim") == F.col("of_dim"))
    dealt = dealt.select("query_id", "vector", F.col("of_dim").alias("dim"), F.col("to_shard").alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "shard", "block")
    hits = held.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(lambda a, b: _search_shard(a, b, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
