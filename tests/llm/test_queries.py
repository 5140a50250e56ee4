"""The query functions over small tables, against brute force: names, types and values of all columns."""

import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash

from termweave.llm import common, quality, queries

TYPES = {
    "op3_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}
WORDS = {"en": "the of and house water with", "de": "der und nicht über schön haus", "fr": "le de été garçon avec où"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(1, 30))) + (" %%% $$" * 9 if i % 5 == 0 else ""), lang, f"s{i % 4}", 0) for i in range(240) for lang in [list(WORDS)[i % 3]]]
    docs += [(300, None, None, None, None), (301, "", "en", None, 0), (302, "12 34", "de", "s0", 5), (303, docs[3][1], "en", "s9", 0), (304, "A b\x00c" * 9_000, "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)] + [(400, None), (500, [0.0] * 8), (600, [1.0, None] + [2.0] * 6), (700, [float("nan")] * 8), (401, None)]
    vectors += [(800 + i, vectors[100][1]) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path), docs, vectors


def _rows(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in TYPES[name]} == TYPES[name]
    return df.collect()


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_media_query(spark, folder):
    got = {r.doc_id: r for r in _rows(spark, folder[0], "op3_media_columns")}
    assert len(got) == len(folder[1])
    for i, text, *_ in folder[1]:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8_000, 0, "NONE", "NONE"))
            w.writeframes(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(out.getvalue()) and r.media_sha256 == hashlib.sha256(out.getvalue()).hexdigest()
    assert (got[303].feature, got[303].media_sha256) == (got[3].feature, got[3].media_sha256) and got[1].feature != got[2].feature


def test_mix_query(spark, folder):
    got = _rows(spark, folder[0], "op4_mix_sources")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in folder[1]:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, (5, 2, 1) * 9))
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    of = {d[0]: d for d in folder[1]}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = of[r.doc_id][3]
        assert (r.size, r.source_size) == (size(of[r.doc_id][1]), sizes[s]) and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(30, 0.02 * target[s]) for s in order if sizes[s] < 10_000)
    assert sorted(got) == sorted(_rows(spark, folder[0], "op4_mix_sources"))


def test_quality_query_and_its_scores(spark, folder):
    got = {r.doc_id: r for r in _rows(spark, folder[0], "op5_quality")}
    assert len(got) == len(folder[1])
    assert all(r.held_out == _held(i) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == int(i % 5 > 0) for i in range(240) if _held(i)]) > 0.9
    # the same by hand: one row for each word, one number at a time
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder[0]}/labels.parquet").filter(~queries.held_out())
    m = quality.fit_sample(docs.filter(~queries.held_out()), labels)
    w1, b1, w2, b2 = m.layers
    for i, text, *_ in folder[1][:40] + folder[1][240:]:
        words = quality._word.findall(text or "")
        rows = [m.table[m.words[w]] if w in m.words else m.table[quality.shape(w) * quality.RARE + zlib.crc32(w.encode()) % quality.RARE] for w in words]
        n = len(words)
        ids = [m.words.get(w, ("rare", quality.shape(w), zlib.crc32(w.encode()) % quality.RARE)) for w in words]
        x = np.zeros(m.table.shape[1] + 4)
        if n:
            again = [sum(words[k] == words[k + gap] for k in range(n - gap)) / n for gap in (1, 2)]
            x = np.array([*np.mean(rows, axis=0), np.log1p(n) / 10, len(set(ids)) / n, *again])
        z = np.clip((x - m.mean) / m.scale, -quality.FAR, quality.FAR)
        hidden = [np.tanh(sum(z[a] * w1[a, h] for a in range(len(z))) + b1[h]) for h in range(len(b1))]
        want = 1 / (1 + np.exp(-(sum(hidden[h] * w2[h] for h in range(len(b1))) + b2) / m.temperature))
        assert got[i].score == pytest.approx(want, abs=2e-3), i


def test_quality_sample_is_bounded_in_bytes(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(100), 304)], "doc_id long, quality int")
    seen = []
    real, quality.fit = quality.fit, lambda texts, labels: seen.append((len(texts), sum(len(t.encode()) for t in texts)))
    try:
        for most in (1 << 20, 3_000, 0):
            quality.fit_sample(docs, labels, max_bytes=most)
    finally:
        quality.fit = real
    assert seen[0][0] == 101 and 0 < seen[1][0] < 101 and seen[1][1] <= 3_000 and seen[2] == (0, 0)


def test_search_query(spark, folder):
    got = _rows(spark, folder[0], "op6_ann")
    able = {i: np.array(v, dtype=np.float64) for i, v in folder[2] if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    want = {(q, k + 1): pair for q in able if q % 100 == 0 for k, pair in enumerate(sorted((float(np.sqrt(((v - able[q]) ** 2).sum())), i) for i, v in able.items() if i != q)[:10])}
    assert len(got) == len(want) and np.mean([want[(r.query_id, r["rank"])][1] == r.vec_id for r in got]) >= 0.9
    assert all(r.score == pytest.approx(float(np.sqrt(((able[r.vec_id] - able[r.query_id]) ** 2).sum())), abs=1e-12) for r in got)


def test_language_query(spark, folder):
    got = {r.doc_id: r for r in _rows(spark, folder[0], "op7_langid")}
    assert len(got) == len(folder[1]) and all(r.held_out == _held(i) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[d[0]].lang_pred == d[2] for d in folder[1][:240] if _held(d[0])]) > 0.9
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (300, 301, 302))


def test_simhash_query(spark, folder):
    got = {r.doc_id: r for r in _rows(spark, folder[0], "op8_simhash")}

    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    assert all(got[i].fingerprint == f"{brute(t):016x}" for i, t, *_ in folder[1])
    assert got[303].component_id == got[3].component_id <= 3 and got[301].component_id == 300


def test_bpe_query(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers

    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(queries.RANKS, "rb"))}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in _rows(spark, folder[0], "op10_bpe")}
    for i, text, *_ in folder[1]:
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
