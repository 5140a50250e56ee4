"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled texts (about ``per_lang`` of each language, chosen by a hash of id and text, one
at least of every language) and are taken on the executors: a row for each language and bucket reaches the driver, never a
text. The prior is of all labelled texts, whatever the sample. Counts are broadcast sparsely, at most 2 to the BITS cells of
12 bytes a language; the matrix of log-probabilities, buckets by languages, is made for BLOCK_LANGS languages at once, so
any number of them can be learned. Batches are scored sparsely: the n-grams of many texts are hashed in one array, counted
per text and bucket, and multiplied with the matrix rows that occur. Whole texts count, in pieces, so memory does not follow
the longest.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled text every text is
``und``; equally likely languages resolve to the one first by code point; an empty table gives an empty result. Extra columns
are carried along; columns of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

UND = "und"
BITS, ORDERS = 16, (1, 2, 3)
#: Labelled texts of each language that the counts are taken from, as expected; repeated rows are taken together.
PER_LANG = 2_000
#: Languages whose matrix of log-probabilities is made at once.
BLOCK_LANGS = 64
#: Code points hashed at once.
PIECE = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_letter = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    cells: np.ndarray  # language << bits | bucket, of the n-grams that occur, ascending
    counts: np.ndarray
    prior: np.ndarray
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS
    smooth: float = 0.5

    def block(self, a: int, b: int) -> np.ndarray:
        """Log-probabilities, buckets by languages a to b; held if those are all."""
        held = self.__dict__.get("_held")
        if held is not None and held.shape[1] == b - a:
            return held
        at = slice(*np.searchsorted(self.cells, [a << self.bits, b << self.bits]))
        cells, n = self.cells[at], self.counts[at]
        lang = (cells >> self.bits) - a
        total = np.log(np.bincount(lang, n, b - a) + self.smooth * (1 << self.bits))
        out = np.empty((1 << self.bits, b - a), dtype=np.float32)  # sums over a text's n-grams are taken in double precision
        out[:] = np.log(self.smooth) - total
        out[cells & ((1 << self.bits) - 1), lang] = np.log(n + self.smooth) - total[lang]
        if b - a == len(self.langs):
            self._held = out
        return out

    @property
    def logp(self) -> np.ndarray:
        return self.block(0, len(self.langs))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_held"}


def _buckets(codes: np.ndarray, owner: np.ndarray, bits: int, orders: tuple[int, ...], lead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, owner) of every n-gram that lies in one text and not in its first ``lead`` code points, which an earlier piece had."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(orders) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = (h[:m] + codes[n - 1 :] + np.uint64(1)) * _MULT
        h ^= h >> np.uint64(29)
        if n in orders:
            at = ((h * _MULT) >> np.uint64(64 - bits)).astype(np.int64)
            own = owner[:m]
            if lead >= n:
                at, own = at[lead - n + 1 :], own[lead - n + 1 :]
            if n > 1:
                inside = own == owner[n - 1 + len(owner[:m]) - len(own) :]
                at, own = at[inside], own[inside]
            yield at, own


def _pieces(texts: list[str], context: int, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Code points, the text each belongs to, and how many of the first were in the piece before: about PIECE at a time.

    A long text goes over several pieces, each led by the ``context`` code points before it, so no n-gram is lost.
    """
    size = size or PIECE
    codes, owner, held, lead = [], [], 0, 0
    for i, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), size):
            if at:
                yield np.concatenate(codes), np.concatenate(owner), lead
                codes, owner, held, lead = [], [], 0, min(at, context)
            c = np.frombuffer(text[at - (lead if at else 0) : at + size].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            codes.append(c)
            owner.append(np.full(len(c), i, dtype=np.int64))
            held += len(c)
        if held >= size:
            yield np.concatenate(codes), np.concatenate(owner), lead
            codes, owner, held, lead = [], [], 0, 0
    if held:
        yield np.concatenate(codes), np.concatenate(owner), lead


def model_of(cells: np.ndarray, counts: np.ndarray, totals: dict[str, int], bits: int = BITS, orders: tuple[int, ...] = ORDERS, smooth: float = 0.5) -> Model:
    """cells are number of the language, by code point, << bits | bucket; the prior follows totals, the texts of each language."""
    names, by = sorted(totals), np.argsort(cells)
    texts_of = np.array([totals[x] for x in names], dtype=np.float64)
    return Model(names, cells[by], counts[by].astype(np.float32), np.log(texts_of / max(1.0, texts_of.sum())), bits, orders, smooth)


def count(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """How often each bucket occurs in the texts."""
    out = np.zeros(1 << bits, dtype=np.int64)
    for codes, owner, lead in _pieces(texts, max(orders) - 1):
        for bucket, _ in _buckets(codes, owner, bits, orders, lead):
            out += np.bincount(bucket, minlength=1 << bits)
    return out


def fit(texts: list[str], langs: list[str]) -> Model:
    """The model of texts at hand."""
    names, cells, counts = sorted(set(langs)), [], []
    for i, name in enumerate(names):
        n = count([t for t, x in zip(texts, langs) if x == name])
        cells.append(np.flatnonzero(n) + (i << BITS))
        counts.append(n[n > 0])
    return model_of(np.concatenate(cells), np.concatenate(counts), {x: langs.count(x) for x in names})


def log_likelihoods(model: Model, texts: list[str], piece: int | None = None) -> np.ndarray:
    """Texts by languages, prior included."""
    out = np.tile(model.prior, (len(texts), 1))
    for a in range(0, len(model.langs), BLOCK_LANGS):
        b = min(a + BLOCK_LANGS, len(model.langs))
        logp = model.block(a, b)
        for codes, owner, lead in _pieces(texts, max(model.orders) - 1, piece):
            for bucket, own in _buckets(codes, owner, model.bits, model.orders, lead):
                if not len(own):
                    continue
                cell, n = np.unique(own << model.bits | bucket, return_counts=True)
                row, col = cell >> model.bits, cell & ((1 << model.bits) - 1)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                out[row[starts], a:b] += np.add.reduceat(n[:, None] * logp[col], starts, axis=0)
    return out


def fit_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    """The model of about per_lang texts of each language, one at least; rows without text or language don't count."""
    spark = docs.sparkSession
    able = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    low = F.pmod(F.xxhash64("id", F.xxhash64("text"), F.lit("langid")), F.lit(1 << 30))
    per = able.groupBy("lang").agg(F.count("*").alias("n"), F.min(low).alias("least")).collect()  # a row for each language
    if not per:
        return None
    number = {x: i for i, x in enumerate(sorted(r.lang for r in per))}
    upto = spark.createDataFrame([(r.lang, number[r.lang], max(r.least, int(min(1.0, per_lang / r.n) * (1 << 30)))) for r in per], "lang string, no int, upto long")
    few = able.join(F.broadcast(upto), "lang").filter(low <= F.col("upto")).select("no", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (no, bucket, n); of BLOCK_LANGS languages at a time."""
        held: dict[int, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for i, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["no", "bucket", "n"])
            held.clear()

        for batch in batches:
            of, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in np.unique(of).tolist():
                n = count([texts[k] for k in np.flatnonzero(of == i)])
                held[i] = held[i] + n if i in held else n
                if len(held) >= BLOCK_LANGS:
                    yield from rows()
        yield from rows()

    cells = map_batches(few, counted, "no int, bucket int, n long").groupBy("no", "bucket").agg(F.sum("n").alias("n")).toArrow()
    no, bucket, n = (cells.column(c).to_numpy() for c in ("no", "bucket", "n"))
    return model_of((no.astype(np.int64) << BITS) | bucket, n, {r.lang: r.n for r in per})


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs without the text, with the likeliest language and its probability."""
    keep = [f for f in docs.schema if f.name not in (text_col, lang_out, score_out)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = [x or "" for x in batch.column(len(names)).to_pylist()]
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            able = [i for i, x in enumerate(texts) if model and _letter.search(x)]
            if able:
                ll = log_likelihoods(model, [texts[i] for i in able])
                best = ll.argmax(axis=1)
                top = ll[np.arange(len(able)), best]
                score[able] = 1 / np.exp(ll - top[:, None]).sum(axis=1)
                for i, b in zip(able, best):
                    lang[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score)], [*names, lang_out, score_out])

    return map_batches(docs.select(*names, docs[text_col].cast("string")), run, schema)
