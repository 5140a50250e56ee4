import numpy as np

from termweave.llm import langid, quality

WORDS = {"en": "the of and house water with", "de": "der und nicht über schön haus", "fr": "le de été garçon avec où"}


def _texts(n=120):
    rng = np.random.default_rng(5)
    return [(i, lang, " ".join(rng.choice(WORDS[lang].split(), 12))) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_language(spark):
    rows = [(i, t, lang, "clash") for i, lang, t in _texts()] + [(900, None, "en", None), (901, "", "de", None), (902, "123 !!", "fr", None), (None, "der und", None, None), (903, "the of " * 90_000, None, None), (0, *_texts()[0][1:][::-1], "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit_sample(docs, per_lang=20)
    got = {r.doc_id: r for r in langid.predict(docs.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, lang, _ in _texts())
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[None].lang_pred == "de" and got[903].lang_pred == "en"
    assert langid.fit_sample(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(2 * i + j, chr(0x4E00 + i) * (5 + j), f"l{i:03}") for i in range(300) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_sample(docs, per_lang=1)
    assert model.langs == sorted({r[2] for r in rows})
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs.drop("lang"), model).collect()} == {i: lang for i, _, lang in rows}


def test_frequent_language_with_one_id_is_learned(spark):
    from pyspark.sql import functions as F

    same = lambda i, lang: spark.range(30_000).select(F.lit(i).cast("long").alias("doc_id"), F.lit("der und").alias("text"), F.lit(lang).alias("lang"))
    texts = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("le été "), F.col("id")).alias("text"), F.lit("fr").alias("lang"))
    assert langid.fit_sample(same(None, "de").union(same(7, "nl")).union(same(8, "af")).union(texts)).langs == ["af", "de", "fr", "nl"]


def test_prior_follows_all_texts(spark):
    docs = spark.createDataFrame([(i, f"the of {i}", "en") for i in range(900)] + [(900 + i, f"der und {i}", "de") for i in range(100)], "doc_id long, text string, lang string")
    model = langid.fit_sample(docs, per_lang=50)
    assert model.langs == ["de", "en"] and np.allclose(np.exp(model.prior), [0.1, 0.9])


def test_language_scores_equal_a_direct_count():
    texts, langs = [t for _, _, t in _texts(30)], [lang for _, lang, _ in _texts(30)]
    m = langid.fit(texts, langs)
    for text in ("le haus", "x", "über"):
        want = m.prior.copy()
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        for bucket, _ in langid._buckets(codes, np.zeros(len(codes), dtype=np.int64), m.bits, m.orders):
            want = want + m.logp[bucket].sum(axis=0)
        assert np.allclose(langid.log_likelihoods(m, ["le", text, ""])[1], want)


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice("the calm river ran by old mills and farms .".split(), 30)) for _ in range(150)]
    bad = [" ".join(f"{w}%%%" for w in rng.choice("the calm river ran by old mills".split(), 30)) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate(good + bad)] + [(900, None, ""), (901, "", ""), (None, "calm", ""), (902, " ".join(rng.choice("the calm river ran by old mills and farms .".split(), 100_000)), ""), (0, good[0], "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210) if i % 4] + [(900, None), (901, 7), (None, 1), (1, 1)], "doc_id long, quality int")
    model = quality.fit_sample(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 214
    held = [i for i in range(210) if i % 4 == 0]
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in held]) > 0.95
    assert got[902] > 0.5
    assert {r.score for r in quality.score(docs, quality.fit_sample(docs, labels.limit(0)), keep_text=True).collect()} == {1.0}
    one = quality.fit_sample(docs, labels.filter("quality = 1"))
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).collect() == []


def test_long_texts_in_pieces_give_the_same():
    texts, langs = [t for _, _, t in _texts(30)], [lang for _, lang, _ in _texts(30)]
    m = langid.fit(texts, langs)
    mixed = [" ".join(texts), "", texts[0], "a", " ".join(texts[:3])]
    whole = langid.log_likelihoods(m, mixed)
    for piece in (1, 2, 3, 7, 50):
        assert np.allclose(langid.log_likelihoods(m, mixed, piece), whole)
    q = quality.fit(texts + [f"{t} %%% $$" for t in texts], [1] * 30 + [0] * 30)
    long = " ".join(texts) + " the the of the of der der"
    for block in (1, 2, 3, 10):
        assert np.allclose(quality._pooled(q.table, q.words, long, block), quality._pooled(q.table, q.words, long), atol=1e-6)
