"""SimHash near-dedup: fingerprints, all links within a Hamming distance, and their components.

Fingerprints within ``distance`` of each other differ by at most one bit in one of distance // 2 + 1 segments. Each distinct
fingerprint is indexed under every segment with every single bit of it left out, so linked ones share a key. The equality
join on that key is a sort-merge pass: keys are dealt by hash and sorted, and each run of equal keys is verified by XOR and
bit counts and left as a spanning forest of its links, never as pairs. The members of a run of more than ``RUN`` are indexed
again, by segments of the bits that the key leaves free, for which the same holds; so a run costs a row for each free bit of
each member, and not the square of its size. With LAST_BITS free bits or fewer a run has RUN members at most. Exact copies
are one fingerprint from the start. Components of the forests come from large-star/small-star rounds on written tables.

Defined results: null and empty texts and texts of white space have fingerprint zero and link like any other; fewer words
than a shingle needs make one shingle of all; repeated rows and repeated ids stay separate rows; a component of rows with
null ids only has a null id; very long texts are taken in blocks; ties between rows of one id go to the least
text hash, then the least other columns; an empty table gives an empty result. Extra columns are carried along by
``fingerprints``; columns of the results' names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, release, staged

SEED, BITS = 42, 64
#: Fingerprints of a run that one task compares at once, and shingles whose bits are counted at once.
RUN, SHINGLES_AT_ONCE = 2_048, 1 << 16
#: Free bits whose values are compared directly: two to this power are RUN.
LAST_BITS = 11
#: Bytes of a text whose words are held at once.
BLOCK_BYTES = 4 << 20
#: Links that a task gathers before it reduces them to a forest.
LINKS_AT_ONCE = 200_000
_space, _hash = re.compile(rb"[ \t-\r]"), xxhash.xxh64_intdigest


def _word_blocks(data: bytes, block: int) -> Iterator[list[bytes]]:
    """Words of about ``block`` bytes at a time, cut at white space."""
    at = 0
    while at < len(data):
        end = _space.search(data, at + block)
        stop = end.start() if end else len(data)
        yield data[at:stop].split()  # on ASCII white space only
        at = stop


def simhash(text: str | None, shingle: int = 4, block: int = BLOCK_BYTES) -> int:
    """As a signed 64-bit integer. Long texts are taken block by block, with the last words of a block before the next."""
    ones, n, held = np.zeros(BITS, dtype=np.int64), 0, []
    for words in _word_blocks((text or "").encode("utf-8").lower(), block):  # bytes: A-Z only
        words = held + words
        if len(words) < shingle:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        m = len(words) - shingle + 1
        starts = np.concatenate([[0], ends[: m - 1] + 1]).tolist()
        ones += _bit_counts([_hash(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
        n += m
        held = words[m:]
    if not n:
        if not held:
            return 0
        ones, n = _bit_counts([_hash(b" ".join(held), SEED)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = np.array(hashes[a : a + SHINGLES_AT_ONCE], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, out: str = "fp", keep_text: bool = False) -> DataFrame:
    """docs with the fingerprint of each text as a long, and without the text unless keep_text."""
    keep = [f for f in docs.schema if f.name != out and (keep_text or f.name != text_col)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [simhash(x, shingle) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(got, pa.int64())], [*names, out])

    return map_batches(docs.select(*names, docs[text_col].cast("string").alias("__text")), run, T.StructType([*keep, T.StructField(out, T.LongType())]))


def segments(distance: int, free: int = (1 << BITS) - 1) -> list[list[int]]:
    """The bits of ``free`` in the fewest segments of which one must differ by at most one bit."""
    bits, n = [i for i in range(BITS) if free >> i & 1], distance // 2 + 1
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in (_M1, _M2):
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def _variants(fps: np.ndarray, distance: int, free: int, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, free bits left), one column for each segment of the free bits and bit of it left out.

    A key is a hash of what it stands for and, in a run, of the run's key (salt); links are verified, so equal hashes of
    different values only cost time.
    """
    x = fps.view(np.uint64)
    base = np.zeros(len(x), dtype=np.uint64) if salt is None else _mixed(salt.view(np.uint64))
    keys, left = [], []
    for bits in segments(distance, free):
        mask = sum(1 << i for i in bits)
        for bit in bits:
            pinned = mask & ~(1 << bit)
            keys.append(_mixed((x & np.uint64(pinned)) ^ _mixed(base + np.uint64(pinned) + np.uint64(bit + 1))))
            left.append(free & ~pinned)
    return np.stack(keys, axis=1).view(np.int64), np.array(left, dtype=np.uint64).view(np.int64)


def _bit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as stars: each value but the least of its group, with the least."""
    if not len(a):
        return a, b
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[u], root[v])
        nxt = root.copy()
        np.minimum.at(nxt, root[u], low)
        np.minimum.at(nxt, root[v], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    off = np.flatnonzero(root != np.arange(len(values)))
    return values[off], values[root[off]]


def _links_within(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks, by rows of the first, as a forest."""
    found = []
    for i in range(0, len(x), 256):
        near = np.argwhere(_bit_distance(x[i : i + 256, None], y[None, :]) <= distance)
        left, right = x[i + near[:, 0]], y[near[:, 1]]
        found.append(forest(left[left != right], right[left != right]))
    return forest(*(np.concatenate(side) for side in zip(*found)))


class _Gathered:
    """Links of a task, reduced to a forest now and then."""

    def __init__(self) -> None:
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > LINKS_AT_ONCE:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, dtype=np.int64)
        a, b = forest(np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))
        self.a, self.b, self.n = [a], [b], 0
        return a, b


def _runs(batches: Iterator[pa.RecordBatch], distance: int, run: int, last: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, free) sorted by key and free -> rows (a, b, key, free): links, and with null a and b the longer runs."""
    links, large = _Gathered(), []
    held_key, held, held_n = None, [], 0  # the run that may go on in the next batch

    def compare(part: np.ndarray) -> None:
        if len(part) > 1:
            links.add(*_links_within(part, part, distance))

    def close() -> None:
        if held_n > run and held_key[1].bit_count() > last:
            large.append(held_key)
        elif held_n:
            compare(np.concatenate(held))

    for batch in batches:
        keys, fps, free = (batch.column(i).to_numpy() for i in range(3))
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(free) != 0)) + 1, [len(keys)]])
        lengths = np.diff(cuts)
        # inner runs of two at once; longer ones, and those at the ends, one by one
        pairs = cuts[:-1][lengths == 2]
        pairs = pairs[(pairs > 0) & (pairs + 2 < len(keys))]
        a, b = fps[pairs], fps[pairs + 1]
        ok = _bit_distance(a, b) <= distance
        links.add(a[ok], b[ok])
        ends = {0, len(lengths) - 1}
        for i in [0, *(j for j in np.flatnonzero(lengths > 2).tolist() if j not in ends), *({len(lengths) - 1} - {0})]:
            part, key = fps[cuts[i] : cuts[i + 1]], (int(keys[cuts[i]]), int(free[cuts[i]]) & (1 << BITS) - 1)
            if i in ends:
                if key != held_key:
                    close()
                    held_key, held, held_n = key, [], 0
                held_n += len(part)
                held = [*held, part] if held_n <= run or key[1].bit_count() <= last else []
            elif len(part) > run and key[1].bit_count() > last:
                large.append(key)
            else:
                compare(part)
    close()
    a, b = links.reduce()
    n = len(large)
    cols = [np.concatenate([a, np.zeros(n, np.int64)]), np.concatenate([b, np.zeros(n, np.int64)])]
    mask = np.arange(len(a) + n) >= len(a)
    signed = lambda v: v - (1 << BITS) if v >> (BITS - 1) else v
    rest = [pa.array([None] * len(a) + xs, pa.int64()) for xs in ([k for k, _ in large], [signed(f) for _, f in large])]
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64(), mask=mask) for c in cols), *rest], ["a", "b", "key", "free"])


def near_links(distinct: DataFrame, distance: int = 4, run: int = RUN) -> DataFrame:
    """a, b: links that connect exactly what the links within distance connect. distinct has one long column fp without repeats."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (fp) or, of large runs, (fp, free, key) -> rows (key, fp, free)."""
        for batch in batches:
            fps = batch.column(0).to_numpy()
            free = batch.column(1).to_numpy() if batch.num_columns > 1 else np.full(len(fps), -1, dtype=np.int64)
            for f in np.unique(free):
                at = np.flatnonzero(free == f)
                for i in range(0, len(at), 8_192):
                    part = fps[at[i : i + 8_192]]
                    salt = batch.column(2).to_numpy()[at[i : i + 8_192]] if batch.num_columns > 2 else None
                    keys, left = _variants(part, distance, int(f) & (1 << BITS) - 1, salt)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1])), pa.array(np.tile(left, len(part)))], ["key", "fp", "free"])

    kind, last = "key long, fp long, free long", max(LAST_BITS, 2 * (distance // 2 + 1))  # with more free bits, every segment pins some
    rows, links = map_batches(distinct.select("fp"), index, kind, None), None
    while True:
        found = staged(map_batches(rows.repartition("key").sortWithinPartitions("key", "free"), lambda x: _runs(x, distance, run, last), "a long, b long, key long, free long", None), "simhash-links")
        mine = found.filter("a is not null").select("a", "b")
        links = mine if links is None else links.unionByName(mine)
        large = found.filter("a is null").select("key", "free").distinct()
        if large.limit(1).count() == 0:
            return links
        # their members again, by the bits that the run leaves free: fewer with every round
        members = rows.join(large, ["key", "free"]).select("fp", "free", "key")
        rows = staged(map_batches(members, index, kind, None), "simhash-runs")


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of links (a, b), the least node that it is connected with."""
    pair = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "component-links")
    seen = None
    while True:
        both = pair(now, "a", "b").unionAll(pair(now, "b", "a"))
        # written first, so that the joins below shuffle both sides and a node with very many links can be split
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "component-least")
        # large star: each larger neighbour to the least one
        before = now
        now = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        now = staged(now, "component-links")
        release(before, least)
        # small star: each smaller neighbour, and the node itself, to the least one
        down = staged(now.groupBy("a").agg(F.min("b").alias("m")), "component-least")
        met, before = now.join(down, "a"), now
        now = staged(met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionAll(down.select("a", F.col("m").alias("b"))).distinct(), "component-links")
        release(before, down)
        at = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == at:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = at


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """id, fp, component_id (the least id that can be reached over links) and root (the component's least fingerprint), for each row."""
    rows = staged(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle), "fingerprints")
    least = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(least, distance)).select(F.col("node").alias("fp"), "root")
    joined = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = staged(joined, "fingerprint-roots")
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = joined.join(of_root, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """docs with one row of each component: that of the least id (null last), then of the least text hash, then the least other columns as JSON."""
    columns = docs.columns
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), th.alias("th"))
    found = near_duplicates(docs.select(key.alias("__key"), text_col), "__key", text_col, shingle, distance)
    # one string as key of the join and of the grouping, so that texts are shuffled once
    kept = found.select(F.to_json(F.struct("component_id.id", "component_id.th")).alias("__k")).distinct()
    rows = docs.withColumn("__k", F.to_json(F.struct(F.col(id_col).alias("id"), th.alias("th")))).join(kept, "__k", "left_semi")
    first = rows.groupBy("__k").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*(c for c in columns if c not in (id_col, text_col)), F.lit(0)))).alias("__row"))
    return first.select(*(F.col("__row")[c].alias(c) for c in columns))
