"""Byte-level BPE encoding and decoding by a public rank file.

Texts up to chunk_chars are encoded in one piece where they lie. Longer texts are cut into overlapping chunks, which are
pre-tokenised in parallel. In the overlap of two chunks both list their pre-token boundaries between a character that is
no white space and one that is. Every scan has such a boundary, wherever it began, as no pre-token holds white space after
another character; so where the two lists meet the text is cut, and the pieces between cuts are encoded in parallel.
An overlap without such a place (a run of many thousand characters without white space) makes no cut. Decoding
concatenates the tokens' bytes.

Defined results: a null or empty text has no ids; ids that are null decode to null, no ids to empty bytes; an id outside the
vocabulary is an error; an empty table gives an empty result. Repeated long texts are encoded once. Extra columns are
carried along; columns of the results' names are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, text_of

CHUNK_CHARS, OVERLAP = 32_768, 1_024
#: Pre-tokens whose ids a worker remembers; it then starts afresh.
REMEMBERED = 30_000
#: Bytes of a rank file at most, as it is broadcast; parts of a long text in a batch.
MOST_BYTES, PARTS_AT_ONCE = 64 << 20, 256


class Codec:
    """Ranks and pattern of one vocabulary, in a worker."""

    def __init__(self, data: bytes, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        self._piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._split = regex.compile(pattern)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._lengths = np.array([len(x) for x in tokens], dtype=np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)[:-1]])
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._known: dict[str, list[int]] = {}

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self._split.finditer(text)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self._known
        for x in self._split.findall(text):
            found = known.get(x)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[x] = self._piece(x.encode("utf-8"))
            ids += found
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0:
            raise ValueError("ids are not negative")
        n = self._lengths[ids]
        shift = np.repeat(self._starts[ids] - (np.cumsum(n) - n), n)
        return self._bytes[shift + np.arange(len(shift))].tobytes()


class Vocabulary:
    """A rank file and a pattern, sent to the executors once; its size is checked, as it is broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        data = Path(path).read_bytes()
        if len(data) > MOST_BYTES:
            raise ValueError(f"{path} has {len(data)} bytes; a vocabulary of {MOST_BYTES} at most is broadcast")
        self.key, self.pattern, self.held = hashlib.sha256(data + pattern.encode()).hexdigest(), pattern, spark.sparkContext.broadcast(data)

    def codec(self) -> Codec:
        """The worker's codec, made once in a worker."""
        if self.key not in _codecs:
            _codecs.clear()
            _codecs[self.key] = Codec(self.held.value, self.pattern)
        return _codecs[self.key]


_codecs: dict[str, Codec] = {}


def _map_column(df: DataFrame, at: str, out: T.StructField, change) -> DataFrame:
    """df without the columns ``at`` and out.name, and with out: change(list of at's values) as an Arrow array."""
    keep = [f for f in df.schema if f.name not in (at, out.name)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], change(batch.column(len(names)))], [*names, out.name])

    return map_batches(df.select(*names, at), run, T.StructType([*keep, out]))


def _encoded(df: DataFrame, text_col: str, ids_col: str, words: Vocabulary) -> DataFrame:
    def change(texts: pa.Array) -> pa.Array:
        encode = words.codec().encode
        return pa.array([np.array(encode(x) if x else [], dtype=np.int32) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return _map_column(df, text_col, T.StructField(ids_col, T.ArrayType(T.IntegerType())), change)


def _cut(texts: DataFrame, bounds, number: str, piece: str) -> DataFrame:
    """sha, number, piece of texts (sha, text, ...): parts of each text between bounds(row) = [(start, end), ...], a batch of some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = bounds(row)
                for i in range(0, len(parts), PARTS_AT_ONCE):
                    some = parts[i : i + PARTS_AT_ONCE]
                    cols = [row["sha"]] * len(some), range(i, i + len(some)), [row["text"][a:b] for a, b in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()))], ["sha", number, piece])

    return map_batches(texts, run, f"sha string, {number} int, {piece} string", 1)


def _chunk_marks(chunks: DataFrame, words: Vocabulary, chunk_chars: int, overlap: int) -> DataFrame:
    """sha, no, head, tail: boundaries where white space begins, as offsets in the text, in a chunk's first and last overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            heads, tails = [], []
            for no, text in zip(cols["no"], cols["chunk"]):
                # what the chunk's last two characters end may depend on what follows them
                marks = [p for p in words.codec().boundaries(text) if 0 < p < len(text) - 1 and text[p].isspace() and not text[p - 1].isspace()]
                heads.append([no * chunk_chars + p for p in marks if p < overlap])
                tails.append([no * chunk_chars + p for p in marks if p >= chunk_chars])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)], ["sha", "no", "head", "tail"])

    return map_batches(chunks, run, "sha string, no int, head array<long>, tail array<long>")


def _encode_long(texts: DataFrame, words: Vocabulary, chunk_chars: int, overlap: int) -> DataFrame:
    """sha, ids of texts (sha, text), which are distinct."""
    chunks = _cut(texts, lambda r: [(a, a + chunk_chars + overlap) for a in range(0, len(r["text"]), chunk_chars)], "no", "chunk")
    marks = _chunk_marks(chunks, words, chunk_chars, overlap)
    ahead = marks.select("sha", (F.col("no") + 1).alias("no"), "tail")
    met = marks.select("sha", "no", "head").join(ahead, ["sha", "no"]).select("sha", F.array_min(F.array_intersect("head", "tail")).alias("cut"))
    cuts = met.groupBy("sha").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))  # nulls stay out
    pieces = _cut(texts.join(cuts, "sha", "left"), lambda r: list(zip([0, *(r["cuts"] or [])], [*(r["cuts"] or []), len(r["text"])])), "k", "piece")
    ids = _encoded(pieces.repartition("sha", "k"), "piece", "ids", words)
    return ids.groupBy("sha").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("ids"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """docs without the text, with its token ids (array<int>), as if each match of pattern were encoded by itself."""
    words = Vocabulary(docs.sparkSession, path, pattern)
    length = F.char_length(text_of(text_col))
    docs = docs.drop(*({ids_col} - {text_col}))
    short = _encoded(docs.filter(length <= chunk_chars), text_col, ids_col, words)
    long = docs.filter(length > chunk_chars).withColumn("__sha", F.sha2(F.col(text_col), 256))
    found = _encode_long(long.select(F.col("__sha").alias("sha"), F.col(text_col).alias("text")).dropDuplicates(["sha"]), words, chunk_chars, overlap)
    found = found.select(F.col("sha").alias("__sha"), F.col("ids").alias("__ids"))
    return short.unionByName(long.drop(text_col).join(found, "__sha").drop("__sha").withColumnRenamed("__ids", ids_col))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for."""
    words = Vocabulary(df.sparkSession, path, pattern)

    def change(ids: pa.Array) -> pa.Array:
        values, read = ids.values.to_numpy(zero_copy_only=False), words.codec().decode
        at = ids.offsets.to_numpy()
        return pa.array([read(values[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist())], pa.binary())

    held = df.withColumn("__ids", F.col(ids_col))
    return _map_column(held, "__ids", T.StructField(bytes_col, T.BinaryType()), change)
