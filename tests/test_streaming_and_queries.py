import importlib.util
import math

import duckdb
import pytest

from termweave import plans
from termweave.streaming import watch

LINE = "A\tb\tS\tinvolved_in\tGO:2\tPMID:1\tIDA\t\tP\t\t\tgene\t{}\t20200102\tX"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gaf").write_text("!gaf-version: 2.2\n" + LINE.format("taxon:1") + "\n" + LINE.format("taxon:x") + "\n")
    got = []
    stream = watch.annotation_stream(spark, str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = watch.watch(stream, str(tmp_path / "cp"), lambda df, _: got.extend(r.problem for r in df.collect()), once=True)
        assert q.awaitTermination(90)
    assert sorted(got, key=str) == [None, "taxon can't be read"]


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


SAMPLE = ["ont_closure_counts", "ont_slim_map", "assoc_boolean_query", "assoc_enrichment_two_sided", "sim_mica", "lex_reciprocal", "facet_counts", "rules_results", "gaf_round_trip", "term_repair", "differ_group_delta", "triples_pattern"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert _rows(plans.QUERIES[name](spark, SF).toPandas()) == _rows(con.sql(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("side", ["greater", "less", "two_sided"])
def test_enrichment_of_all_terms(spark, side):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    name = f"assoc_enrichment_all_{side}"
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert _rows(got) == _rows(con.sql(plans.ORACLE_SQL[name]).df())
    inferred = plans.QUERIES["assoc_inferred"](spark, SF).toPandas()
    sample = set(con.sql("SELECT 'CUST:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'").df().iloc[:, 0])
    population = len(con.sql("SELECT c_custkey FROM customer").df())
    counts = inferred.assign(hit=inferred.subject.isin(sample)).groupby("term").hit.agg(["sum", "count"])
    counts = counts[(counts["sum"] > 0) & (counts["count"] > 1)]
    assert set(got.term) == set(counts.index) and {"PART", "SBAND", "THING"} <= {t.split(":")[0] for t in got.term}
    for r in got.itertuples():
        a, n = counts.loc[r.term]
        a, n, size = int(a), int(n), len(sample)
        point = {k: math.comb(n, k) * math.comb(population - n, size - k) for k in range(max(0, n + size - population), min(n, size) + 1)}
        p = sum(x for k, x in point.items() if {"greater": k >= a, "less": k <= a, "two_sided": x <= point[a]}[side]) / math.comb(population, size)
        assert (r.sample_count, r.bg_count) == (a, n) and abs(r.p - p) < 2e-6 and abs(r.p_adjusted - min(1, p * len(got))) < 2e-6


def test_every_query_has_an_oracle():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", __file__.replace("tests/test_streaming_and_queries.py", "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["subject"]


def test_only_the_entry_knows_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(plans.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
