"""Sets of terms compared all with all, block against block: no pair of subjects is ever shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: A block's subjects and terms at most, on average; blocks are dealt by hash.
SUBJECTS, TERMS = 4096, 1_000_000
#: Pairs in a batch of results, and meetings of rarer terms that are held at once.
CELLS, MEETINGS = 1 << 18, 1 << 22
#: A meeting of two lists costs about as much as so many cells of a matrix product.
DENSE = 100

_PACKED = "block int, subjects array<string>, n binary, ids binary, by_row binary, f binary, by_term binary"


def _pack(table: pa.Table) -> pa.Table:
    """One row: the block's subjects, the number of terms of each, the distinct terms and how many have them, and the (subject,
    term) pairs twice, as positions of terms in the order of subjects and of subjects in the order of terms."""
    names = table["subject"].combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    lists = table["terms"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(names.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    ids, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    row *= max(1, len(ids))
    row += at
    row.sort()
    row, at = np.divmod(row[np.diff(row, prepend=-1) > 0], max(1, len(ids)))
    n, f = (np.bincount(x, minlength=size).astype(np.int32) for x, size in ((row, len(names.dictionary)), (at, len(ids))))
    cells = [n, ids.astype(np.int64), at.astype(np.int32), f, row[np.argsort(at, kind="stable")].astype(np.int32)]
    block = table["block"][0].as_py()
    return pa.table([pa.array([block], pa.int32()), pa.array([names.dictionary.to_pylist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=["block", "subjects", "n", "ids", "by_row", "f", "by_term"])


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges that begin at start, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _cells(x: dict, y: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, c): how many terms some rows of x and all rows of y share."""
    nx, ny = len(x["n"]), len(y["n"])
    if not len(x["ids"]) or not len(y["ids"]):
        return
    at = np.minimum(np.searchsorted(y["ids"], x["ids"]), len(y["ids"]) - 1)
    met = y["ids"][at] == x["ids"]
    fx, fy, start = np.bincount(x["by_row"], minlength=len(x["ids"])), np.where(met, y["f"][at], 0).astype(np.int64), (np.cumsum(y["f"], dtype=np.int64) - y["f"])[at]
    often = met & (fx * fy * DENSE >= nx * ny)  # what many have: a matrix product; it has at most 10 cells for each term of a subject
    column = np.where(often, np.cumsum(often) - 1, -1)
    k = np.flatnonzero(often)
    right = np.zeros((len(k), ny), np.float32)
    right[np.repeat(np.arange(len(k)), fy[k]), y["by_term"][_spread(start[k], fy[k])]] = 1
    ends = np.concatenate([[0], np.cumsum(x["n"], dtype=np.int64)])
    step = max(1, CELLS // ny)
    for low in range(0, nx, step):
        high = min(nx, low + step)
        term, row = x["by_row"][ends[low] : ends[high]], np.repeat(np.arange(high - low), x["n"][low:high])
        left = np.zeros((high - low, len(k)), np.float32)
        hit = column[term] >= 0
        left[row[hit], column[term[hit]]] = 1
        c = (left @ right).astype(np.int64)
        hit = met[term] & ~often[term]
        term, row = term[hit], row[hit]
        so_far = np.cumsum(fy[term])
        cuts = np.searchsorted(so_far, np.arange(MEETINGS, int(so_far[-1]) if len(so_far) else 0, MEETINGS))
        for t, r in zip(np.split(term, cuts), np.split(row, cuts)):
            if len(t):
                c += np.bincount(np.repeat(r * ny, fy[t]) + y["by_term"][_spread(start[t], fy[t])], minlength=c.size).reshape(c.shape)
        yield low, c


def _meet(digits: int | None):
    kinds = {"n": np.int32, "ids": np.int64, "by_row": np.int32, "f": np.int32, "by_term": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = ({c: np.frombuffer(batch[f"{side}_{c}"][k].as_buffer(), kind) for c, kind in kinds.items() if f"{side}_{c}" in batch.schema.names} for side in "xy")
                same, nx = batch["x_block"][k] == batch["y_block"][k], len(x["n"])
                names = pa.concat_arrays([batch["x_subjects"][k].values, batch["y_subjects"][k].values])
                place = np.empty(len(names), np.int64)
                place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                for low, c in _cells(x, y):
                    if same:  # each pair once
                        c[np.arange(c.shape[1]) <= (low + np.arange(len(c)))[:, None]] = 0
                    i, j = np.nonzero(c)
                    c, i = c[i, j], i + low
                    union = x["n"][i].astype(np.int64) + y["n"][j] - c
                    j += nx
                    less = place[i] < place[j]
                    # half up, as a decimal number is rounded
                    ratio = c / union if digits is None else (2 * 10**digits * c + union) // (2 * union) / 10.0**digits
                    yield pa.record_batch([names.take(pa.array(np.where(less, i, j))), names.take(pa.array(np.where(less, j, i))), pa.array(c), pa.array(ratio)], names=["a", "b", "c", "j"])

    return run


def shared_counts(lists: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, c, j), a < b: of (subject, terms), where a subject can have several rows of numbered terms, the subjects that share
    terms, how many, and their share of all that either has, rounded to ``digits`` if given.

    Subjects are dealt into blocks, each packed into one row; each task counts two blocks against each other and emits their pairs.
    Within a pair of blocks, terms that many have are counted by a matrix product, others from the list of those who have them.
    """
    spark = lists.sparkSession
    n, terms = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    few = min(n // 64 + 1, isqrt(4 * spark.sparkContext.defaultParallelism) + 1)
    blocks = max(1, few, ceil(n / SUBJECTS), ceil(terms / TERMS))
    dealt = lists.withColumn("block", F.pmod(F.xxhash64("subject"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    packed = cut(dealt.groupBy("block").applyInArrow(_pack, _PACKED))
    x = packed.select(*(F.col(c).alias(f"x_{c}") for c in ("block", "subjects", "n", "ids", "by_row")))
    y = packed.select(*(F.col(c).alias(f"y_{c}") for c in ("block", "subjects", "n", "ids", "f", "by_term")))
    return x.join(y, F.col("x_block") <= F.col("y_block")).mapInArrow(_meet(digits), "a string, b string, c long, j double")
