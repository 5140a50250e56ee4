import re

import numpy as np
import pytest
import xxhash

from termweave.llm import hnsw, simhash


def _brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(fps, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= distance):
            root[find(i)] = find(int(j))
    least = {}
    for i, v in enumerate(ids):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, " ".join([*t.split()[:119], "changed"])) for i, t in enumerate(base)] + [(200 + i, t.upper()) for i, t in enumerate(base[:3])]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one"), (304, "ONE"), (305, "É"), (306, "é"), (0, base[0]), (None, base[1]), (None, "alone and without an id"), (307, "long text " * 20_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = [_brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([r[0] for r in rows], fps, _components([r[0] for r in rows], fps)), key=repr)
    assert sorted(((r.id, r.fp & (2**64 - 1), r.component_id) for r in got), key=repr) == want
    assert [r.component_id for r in got if r.id in (300, 301, 302)] == [300] * 3
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len({r.root for r in got}) and sum(r.doc_id == 0 for r in kept) == 1 and not any(r.doc_id in (301, 302, 304) for r in kept)
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.one_of_each(docs.limit(0)).collect() == []


def test_fingerprints_of_blocks_are_the_same():
    text = "Ab c\td\n\ne f  g h\x0bi j k l m n é\u00a0o p " * 7
    for t in (text, "a b c", "a", " ", "", "one two three four", "one two three four five"):
        for block in (1, 3, 10, 50):
            assert simhash.simhash(t, block=block) & (2**64 - 1) == _brute_fingerprint(t)


@pytest.mark.parametrize("run", [2_048, 16])
def test_links_in_dense_balls(spark, run):
    rng = np.random.default_rng(0)
    fps = set()
    for centre in rng.integers(0, 2**63, 25, dtype=np.uint64):
        for _ in range(40):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, run)
    root = {r.node: r.root for r in simhash.components(links).collect()}
    assert [root.get(x, x) for x in signed] == _components(signed, np.array(signed, dtype=np.int64).view(np.uint64))


def test_segments_leave_at_most_one_bit():
    for distance in (1, 2, 3, 4, 7):
        parts = simhash.segments(distance)
        assert sorted(b for p in parts for b in p) == list(range(64)) and distance // len(parts) <= 1


def _nearest(vectors, k):
    out = {}
    for q, v in vectors.items():
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((np.array(u) - v) ** 2).sum())), i) for i, u in vectors.items() if i != q and len(u) == len(v))[:k]
    return out


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=16).astype(np.float32).astype(float).tolist() for i in range(2_500)}
    for i in range(2_500, 2_900):  # a large group of copies
        vectors[i] = vectors[100]
    rows = [(i, v, "clash") for i, v in vectors.items()]
    rows += [(5_000, None, ""), (5_100, [0.0] * 16, ""), (5_200, [float("nan")] * 16, ""), (5_300, [1.0, None] * 8, ""), (5_400, [float("inf")] * 16, ""), (5_500, [], ""), (None, vectors[1], ""), (7, vectors[7], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    clean = hnsw.clean_vectors(df)
    got = hnsw.nearest(hnsw.build_index(clean, shard_rows=700), clean.filter("id % 100 = 0"), k=10, block=9).collect()
    want = _nearest(vectors, 10)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(by) == set(want)
    assert np.mean([len({i for _, i in by[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.95
    assert [i for _, i in by[100]] == list(range(2_500, 2_510)) and [i for _, i in by[2_500]] == [100, *range(2_501, 2_510)]
    for q, found in by.items():
        assert found == sorted(found) and len(found) == 10
        assert all(s == pytest.approx(float(np.sqrt(((np.array(vectors[i]) - vectors[q]) ** 2).sum())), abs=1e-12) for s, i in found)


def test_search_ties_go_to_the_nearer_in_double_then_the_smaller_id(spark):
    rows = [(0, [5.0] * 8)]
    for i in range(1, 41):
        v = [5.0] * 8
        v[i % 8] += (-1) ** i * 1.0
        v[(i % 8 + 1 + i // 8) % 8] += 1.0 if i % 3 else -1.0
        rows.append((i, v))
    rows[35][1][0] += 1e-9 if rows[35][1][0] < 5 else -1e-9 if rows[35][1][0] > 5 else 0
    rows[32][1][0] += 1e-9 if rows[32][1][0] < 5 else -1e-9 if rows[32][1][0] > 5 else 0
    df = hnsw.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = hnsw.nearest(hnsw.build_index(df), df.filter("id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in _nearest(dict(rows), 10)[0]] and got[0].vec_id in (32, 35)


def test_search_small_and_ragged(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (200, [3.0, 2.0, 1.0])]
    df = hnsw.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = hnsw.nearest(hnsw.build_index(df), df.filter("id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 1), (100, 1, 200), (200, 1, 100)]
    assert hnsw.nearest(hnsw.build_index(df.limit(0)), df.limit(0)).collect() == []


@pytest.mark.parametrize("scale, offset", [(1e-25, 0.0), (1.0, 0.0), (1e25, 0.0), (1.0, 1e6), (1e-200, 0.0), (1e200, 0.0)])
def test_search_at_any_magnitude(scale, offset):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(2_000, 16)) * scale + offset
    pdf = hnsw.pd.DataFrame({"rep": range(2_000), "vector": list(vectors), "ids": [[i] for i in range(2_000)], "dim": 16, "shard": 0})
    queries = hnsw.pd.DataFrame({"query_id": range(0, 2_000, 50), "vector": list(vectors[::50])})
    got = hnsw._search_shard(hnsw._build_shard(pdf), queries, 10)
    hits = 0
    for q in range(0, 2_000, 50):
        # measured in units, as squares of the values themselves would overflow or vanish
        d = np.sqrt((((vectors - vectors[q]) / scale) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = got[got.query_id == q]
        hits += len(set(mine.vec_id) & set(np.argsort(d, kind="stable")[:10]))
        assert np.allclose(mine.score.to_numpy() / scale, d[mine.vec_id.to_numpy()], rtol=1e-9) and mine.score.is_monotonic_increasing
    assert hits / 400 >= 0.95


def test_search_with_one_vector_far_outside():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1_500, 8))
    vectors[7] *= 1e30  # in single precision, scaled to it, all others are one point
    pdf = hnsw.pd.DataFrame({"rep": range(1_500), "vector": list(vectors), "ids": [[i] for i in range(1_500)], "dim": 8, "shard": 0})
    index = hnsw._build_shard(pdf)
    got = hnsw._search_shard(index, hnsw.pd.DataFrame({"query_id": range(0, 1_500, 50), "vector": list(vectors[::50])}), 10)
    near = [np.argsort(np.where(np.arange(1_500) == q, np.inf, ((vectors - vectors[q]) ** 2).sum(axis=1)), kind="stable")[:10] for q in range(0, 1_500, 50)]
    assert np.mean([len(set(got[got.query_id == q].vec_id) & set(n)) / 10 for q, n in zip(range(0, 1_500, 50), near)]) >= 0.95


def test_one_of_each_with_map_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", {"k": 2}), (1, "a b c", {"k": 1}), (2, "A b c", None), (None, "else", {"x": 1})], "doc_id long, text string, extra map<string,int>")
    assert sorted(((r.doc_id, r.text, r.extra) for r in simhash.one_of_each(docs).collect()), key=repr) == [(1, "a b c", {"k": 1}), (None, "else", {"x": 1})]
