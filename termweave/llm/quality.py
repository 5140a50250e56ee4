"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated output.

Words are runs of letters, of digits and of other marks, with a shape; each has a sparse random index vector drawn from a
hash of its name, and a word's vector is the sum of the index vectors of its neighbours in the sample. A document is the
mean of its words' context vectors beside the mean of their index vectors and a few shares of shapes and repeats. Words
beyond the ``MAX_WORDS`` most widespread of the sample, or in fewer than ``LEAST_DOCS`` documents of it, share the vectors of
RARE classes by hash for each shape: about a fifth of all words, which thus still count, but less apart. Vectors and network
are fitted on the driver on a bounded sample of labelled documents (``max_fit`` of them and ``max_bytes`` of text, chosen by a
hash of the id); a tenth of it sets the temperature that calibrates the probabilities. The fitted tables are broadcast: at
most ``MAX_WORDS`` rows. Scores are taken from whole texts, in blocks.

Defined results: a null text is an empty one, which has a score like any other; labels other than 0 and 1 are left out, a
document labelled both ways counts by its mean (0.5 and over: 1); with no usable label every score is 1, so nothing is
rejected, and with one class only every score is that class; an empty table gives an empty result. Extra columns are carried
along; columns of the results' names are replaced.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, release, staged

#: Labelled documents that the classifier is fitted on, at most.
MAX_FIT = 4_000
#: Bytes of their texts, at most; a longer text is left out of the fit, and the next by hash is looked at.
MAX_BYTES = 64 << 20
#: Classes by hash that rarer words of a shape share, and documents of the sample that a word of its own is in.
RARE, LEAST_DOCS = 512, 3
MAX_WORDS, DIM, NONZERO, WINDOW, HIDDEN = 20_000, 64, 6, 2, 24
FAR = 4.0
#: Words of a text that are held at once.
WORDS_AT_ONCE = 200_000
_word = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SHAPES = ("lower", "upper", "title", "mixed", "digit", "mark")


def shape(word: str) -> int:
    if word[0].isalpha():
        return 0 if word.islower() else 2 if word.istitle() else 1 if word.isupper() else 3
    return 4 if word[0].isdigit() else 5


def index_vector(name: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(name.encode("utf-8")))
    v = np.zeros(DIM, dtype=np.float32)
    v[rng.permutation(DIM)[:NONZERO]] = rng.choice((-1.0, 1.0), NONZERO)
    return v


@dataclass
class Model:
    words: dict[str, int]
    table: np.ndarray  # word or shape class -> context vector | index vector | shape
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float
    constant: float | None = None


def _rare(word: str) -> int:
    return shape(word) * RARE + zlib.crc32(word.encode("utf-8", "surrogatepass")) % RARE


def _ids(words: dict[str, int], found: list[str]) -> list[int]:
    """Known words by number, others by shape and hash; the rare classes come first."""
    get = words.get
    return [i if (i := get(w)) is not None else _rare(w) for w in found]


def _word_blocks(text: str, block: int) -> Iterator[list[str]]:
    """The words of a text; of a long one about ``block`` at a time."""
    if len(text) <= 4 * block:
        yield _word.findall(text)
        return
    words = (m.group() for m in _word.finditer(text))
    while part := list(islice(words, block)):
        yield part


def _pooled(table: np.ndarray, words: dict[str, int], text: str, block: int = WORDS_AT_ONCE) -> np.ndarray:
    """The mean of the words' rows, the length, and the shares of distinct words and of words that repeat the last or the one before it."""
    at, k, n, again, held = np.empty(0, dtype=np.int64), np.empty(0), 0, [0, 0], []
    for found in _word_blocks(text, block):
        n += len(found)
        more, times = np.unique(np.array(_ids(words, found), dtype=np.int64), return_counts=True)
        at, which = np.unique(np.concatenate([at, more]), return_inverse=True) if len(at) else (more, slice(None))
        k = np.bincount(which, weights=np.concatenate([k, times])) if len(k) else times
        for gap in (1, 2):
            before = held[-gap:] + found
            again[gap - 1] += sum(map(operator.eq, before, before[gap:]))
        held = (held + found)[-2:]
    if not n:
        return np.zeros(table.shape[1] + 4, dtype=np.float32)
    return np.append((k.astype(np.float32) @ table[at]) / n, (np.log1p(n) / 10, len(at) / n, again[0] / n, again[1] / n)).astype(np.float32)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Within FAR deviations, so that what lies beyond the sample, as very long texts do, isn't extrapolated."""
    return np.clip((x - mean) / scale, -FAR, FAR)


def _forward(model_layers, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = model_layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> tuple:
    """Adam on the whole sample, classes weighed alike in the middle between their shares and a half each."""
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(y > 0, np.sqrt(0.5 / max(y.mean(), 1e-6)), np.sqrt(0.5 / max(1 - y.mean(), 1e-6)))
    weight /= weight.mean()
    for t in range(1, steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
        d = weight * (out - y) / len(y)
        dh = np.outer(d, p[2]) * (1 - h * h)
        grads = [x.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of least log loss on a grid."""
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], labels: list[int]) -> Model | None:
    if not texts:
        return None
    if min(labels) == max(labels):
        return Model({}, np.zeros((1, 1), np.float32), np.zeros(1), np.ones(1), (), 1.0, float(labels[0]))
    found = [_word.findall(x) for x in texts]
    spread = Counter(w for ws in found for w in set(ws))
    rare = [f"rare {shape} {k}" for shape in SHAPES for k in range(RARE)]
    names = sorted((w for w, n in spread.items() if n >= LEAST_DOCS), key=lambda w: (-spread[w], w))[: MAX_WORDS - len(rare)]
    words = {w: i + len(rare) for i, w in enumerate(names)}
    index = np.array([index_vector(w) for w in (*rare, *names)])
    docs = [np.array(_ids(words, x), dtype=np.int64) for x in found]
    context = np.zeros_like(index)
    seen = np.zeros(len(index), dtype=np.float32)
    for ids in docs:
        for gap in range(1, WINDOW + 1):
            if len(ids) > gap:
                np.add.at(context, ids[:-gap], index[ids[gap:]])
                np.add.at(context, ids[gap:], index[ids[:-gap]])
        seen += np.bincount(ids, minlength=len(index))
    context /= np.maximum(seen, 1)[:, None]
    shapes = np.zeros((len(index), len(SHAPES)), dtype=np.float32)
    shapes[np.arange(len(index)), [*np.repeat(np.arange(len(SHAPES)), RARE), *map(shape, names)]] = 1
    table = np.hstack([context, index, shapes]).astype(np.float32)
    x = np.array([_pooled(table, words, x) for x in texts], dtype=np.float64)
    y = np.array(labels, dtype=np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = _standard(x, mean, scale)
    held = np.arange(len(y)) % 10 == 9
    if len(set(y[~held])) < 2:
        held[:] = False
    layers = _train(x[~held], y[~held])
    at = held if held.any() and len(y) >= 200 else ~held
    return Model(words, table, mean, scale, layers, _temperature(_forward(layers, x[at]), y[at]))


def scores(model: Model | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = np.array([_pooled(model.table, model.words, t) for t in texts], dtype=np.float64).reshape(len(texts), len(model.mean))
    return 1 / (1 + np.exp(-np.clip(_forward(model.layers, _standard(x, model.mean, model.scale)) / model.temperature, -30, 30)))


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit: int = MAX_FIT, max_bytes: int = MAX_BYTES) -> Model | None:
    """The model of at most max_fit labelled documents and max_bytes of their texts; labels holds those that may be learned from.
    Of documents with one id the least text counts."""
    able = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    able = able.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    picked = able.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(max_fit).select(F.col("id").alias("i"), "y")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), F.col("id") == F.col("i")).groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    found = staged(found, "quality-sample")
    sizes = found.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id", F.lit("quality")), "id").collect()  # max_fit rows
    left, small = max_bytes, []
    for r in sizes:
        if r.n <= left:
            left -= r.n
            small.append(r.id)
    whole = len(small) == len(sizes)
    rows = (found if whole else found.filter(F.col("id").isin(*small))).collect() if small else []
    release(found)
    rows.sort(key=lambda r: r.id)
    return fit([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_out: str = "score", keep_text: bool = False) -> DataFrame:
    """docs with the probability of label 1, and without the text unless keep_text."""
    keep = [f for f in docs.schema if f.name != score_out and (keep_text or f.name != text_col)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(score_out, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = scores(model, [x or "" for x in texts]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(got, pa.float64())], [*names, score_out])

    return map_batches(docs.select(*names, docs[text_col].cast("string").alias("__text")), run, schema)
