import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from termweave.llm import bpe, media, mixing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "a", "é" * 40, "x" * 64, "\x00\x80", "word " * 5_000, "a", "Ünï\n\n  code\t 12 'll"]


def test_media_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, payload string")
    got = {r.doc_id: r for r in media.wav_features(media.wav_column(docs)).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        want = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert bytes(got[i].payload) == want and bytes(got[i].media)[:4] == b"RIFF" and len(got[i].media) == len(want) + 44
    assert got[2].fingerprint == got[7].fingerprint and got[0].fingerprint == []
    assert media.wav_features(media.wav_column(docs.limit(0))).collect() == []
    assert media.wav_features(spark.createDataFrame([(None,)], "media binary")).first().payload is None


def test_fingerprint_finds_a_tone():
    t = np.arange(8_000)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8).tobytes()
    assert set(media.spectral_peaks(np.frombuffer(tone, dtype=np.uint8))[:-2, 0].tolist()) == {40}
    codes = media.fingerprint(tone)
    assert (np.diff(codes) > 0).all() and (1 << 32 | 40 << 20 | 40 << 8 | 1) in codes.tolist()


def test_short_payloads_have_features():
    texts = ["The quick brown fox", "jumps over the lazy dog.", "Ünï\n\n  code\t 12 'll", "word " * 60, "é" * 200, "alpha beta gamma " * 25, "lorem ipsum dolor " * 40]
    codes = [tuple(media.fingerprint(media.padded(t.encode()))) for t in texts]
    assert all(codes) and len(set(codes)) == len(texts)
    assert all(len(media.fingerprint(bytes([100]) * n)) for n in range(1, 70))  # of any length, one level that isn't silence
    assert not len(media.fingerprint(bytes(64))) and not len(media.fingerprint(bytes([128]) * 64))


def _targets(sizes, weights=(5, 2, 1), budget=1.5):
    src = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(src)}
    open_, left, out = set(src), budget * sum(sizes.values()), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2 * sizes[s]
            open_.discard(s)
        left = budget * sum(sizes.values()) - sum(v for s, v in out.items() if s not in open_)
    return out


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{min(i % 9, 5)}", "clash") for i in range(900)]
    rows += [(1000 + i, "one and the same text", "hot", "c") for i in range(600)] + [(2000, None, "s1", "c"), (2001, "", None, "c"), (None, "x y", None, None), (2002, "a b c", None, None), (1000, "one and the same text", "hot", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert 0 <= r.copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    want = _targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(5, 0.01 * want[s])
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "copies").collect()), key=repr) == sorted(((r.doc_id, r.size, r.copies) for r in got), key=repr)
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {r.target for r in mixing.mix(blank).collect()} == {0.0}


def test_rates_solve_the_dual(spark):
    hist = spark.createDataFrame([("a", s, n) for s, n in ((1, 500), (10, 200), (100, 30), (900, 2))], "source string, size long, n long")
    total = 500 + 2000 + 3000 + 1800
    targets = spark.createDataFrame([("a", total, 0.6 * total)], "source string, source_size long, target double")
    r = mixing.tilts(hist, targets).first()
    assert sum(n * s * min(2, np.exp(r.lam * s / r["mean"])) for s, n in ((1, 500), (10, 200), (100, 30), (900, 2))) == pytest.approx(0.6 * total, rel=1e-5)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, encoding):
    texts = [*TEXTS, "a" * 900, " " * 500 + "x", "x y" * 400, "é" * 300 + " " + "\n" * 200 + "don't 'll", "tab\tand space " * 40, "日本語 " * 60]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, ids int")
    for chunk, overlap in ((bpe.CHUNK_CHARS, bpe.OVERLAP), (100, 20), (64, 64)):
        got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap), PATH, public_tokenizers.PATTERN).collect()
        assert len(got) == len(texts)
        for r in got:
            assert list(r.ids) == encoding.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(none, PATH, public_tokenizers.PATTERN).collect()] == [None, b""]


def test_white_space_classes_agree(encoding):
    codec = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for cp in [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]:
        for t in (f"a{chr(cp)}b 1", f"  {chr(cp)} "):
            assert codec.encode(t) == encoding.encode_ordinary(t)


def test_digest_of_ids(spark):
    from termweave.llm.queries import digests, encoded

    r = digests(encoded(spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert r[0].n_tokens == 0 and r[0].ids_sha256 == hashlib.sha256(b"").hexdigest() == r[0].decoded_sha256
    assert r[1].ids_sha256 == hashlib.sha256(",".join(map(str, r[1].ids)).encode()).hexdigest()
