"""Queries over documents, profiles, triples and files: GLR-*, SIM-*, RDF-*, DIF-*, SRC-* and SNK-* that are asked one by one.

Files are written to the session's scratch folder and read back by the readers, so the formats are compared and not only rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.lineage import scratch_folder
from ..operators import differ as D
from ..operators import parse as P
from ..operators import search as G
from ..operators import similarity as S
from ..operators import triples as R
from ..sources import readers as X
from ..sources import writers as W
from .assoc_queries import DOCS, TRIPLES, _docs, _fisher_all_sql, _triples
from .derived import ASSOC, CLOSURE, EDGES, INFERRED, LINES, REFLEXIVE, annotation_lines, cid, customers, product, sql, table
from .registry import query

I = sql(EDGES, CLOSURE, ASSOC, INFERRED)


def _k(c):
    return F.col(c).cast("string")


def _written(spark, lines, name: str, gzip: bool = False) -> str:
    path = scratch_folder(spark, name)
    W.save_lines(lines, path, gzip)
    return path


# --- search


@query(f"WITH {DOCS} SELECT id, subject, relation, object, evidence, quantity FROM docs")
def search_projected(spark, d):
    return G.projected(_docs(spark, d), more=["quantity", "nowhere"])


@query(f"WITH {DOCS} SELECT relation, count(*) FILTER (WHERE evidence = 'A')::BIGINT AS \"A\", count(*) FILTER (WHERE evidence = 'N')::BIGINT AS \"N\", count(*) FILTER (WHERE evidence = 'R')::BIGINT AS \"R\" FROM docs GROUP BY relation")
def facet_matrix(spark, d):
    return G.pivot_matrix(_docs(spark, d), "relation", "evidence", ["A", "N", "R"])


@query(f"WITH {DOCS} SELECT id, object, object_closure[2] AS brand FROM docs")
def search_mapped_id(spark, d):
    return _docs(spark, d).select("id", "object", G.mapped_id(F.col("object_closure"), "BRAND:").alias("brand"))


@query(f"WITH {DOCS} SELECT DISTINCT subject, object FROM docs WHERE subject IN ('CUST:1', 'CUST:2', 'CUST:3')")
def search_objects_of(spark, d):
    return G.objects_of(_docs(spark, d), ["CUST:1", "CUST:2", "CUST:3"])


@query(f"WITH {DOCS}, h AS (SELECT * FROM docs WHERE relation = '1-URGENT') SELECT subject AS id, object AS other, relation, false AS flipped FROM h WHERE subject IN ('CUST:1', 'PART:3') UNION ALL SELECT object, subject, relation, true FROM h WHERE object IN ('CUST:1', 'PART:3')")
def search_homologs(spark, d):
    return G.homologs(_docs(spark, d), ["CUST:1", "PART:3"], ["1-URGENT"])


@query(f"WITH {DOCS} SELECT subject AS value, count(*)::BIGINT AS n FROM docs GROUP BY subject")
def search_top_species(spark, d):
    return G.top_species(_docs(spark, d).withColumnRenamed("subject", "subject_taxon"))


@query(f"WITH {DOCS} SELECT subject, relation, string_agg(DISTINCT object, '|' ORDER BY object) AS objects FROM docs WHERE evidence = 'R' AND object_closure[1] = 'TYPE:MEDIUM' AND relation = '5-LOW' GROUP BY ALL")
def search_bulk(spark, d):
    docs = _docs(spark, d).withColumns({"subject_category": F.col("evidence"), "object_category": F.get("object_closure", F.lit(0)), "subject_taxon": F.col("relation")})
    return G.bulk(docs, "R", "TYPE:MEDIUM", "5-LOW").withColumn("objects", F.array_join("objects", "|"))


@query("""SELECT 'PART:' || p_partkey AS id, p_name AS label, (5.0 * (list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), 'red')::INT) + 1.0 * (list_contains(string_split_regex(lower(p_brand), '[^a-z0-9]+'), 'red')::INT) + CASE WHEN lower(p_name) = 'red' THEN 5.0 ELSE 0 END)::DOUBLE AS score FROM part WHERE list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), 'red')""")
def search_everyday(spark, d):
    p = table(spark, d, "part").select(cid("PART", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("description"))
    return G.everyday_search(p, "red", 1 << 30).select("id", "label", "score")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '-' WHEN p_size % 3 = 1 THEN 'a ' || p_name || ' b' ELSE 'xx yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy' END AS best FROM part")
def search_highlight(spark, d):
    some = F.concat(F.lit("a <em>"), "p_name", F.lit("</em> <b>b</b>"))
    longer = F.lit("<em>xx</em> <em>yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy</em>")
    k = F.col("p_size") % 3
    texts = F.when(k == 0, F.array(F.col("p_name"))).when(k == 1, F.array(some, F.lit("none <em></em>"))).otherwise(F.array(some, longer))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(text.longest_highlight(texts), F.lit("-")).alias("best"))


@query("SELECT p_partkey AS id, 'x' || p_size AS a, p_brand AS b FROM part")
def search_zipped(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("k"), F.array(F.lit("old"), F.col("p_brand"), F.concat(F.lit("x"), _k("p_size"))).alias("v"))
    return G.zipped(docs, "k", "v", "m").select("id", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"))


@query("SELECT 'SUPP:' || s_suppkey AS subject, 'in' AS predicate, 'NATION:' || s_nationkey AS object, 'ECO:1|ECO:2' AS evidence, CASE WHEN s_suppkey % 2 = 0 THEN 'PMID:' || s_suppkey ELSE '' END AS publications FROM supplier")
def evidence_table(spark, d):
    s = table(spark, d, "supplier")
    one = lambda p, o, df=s: df.select(cid("_", "s_suppkey").alias("s"), F.lit(p).alias("p"), o.alias("o"))
    made = one("OBAN:association_has_subject", cid("SUPP", "s_suppkey")).union(one("OBAN:association_has_predicate", F.lit("in"))).union(one("OBAN:association_has_object", cid("NATION", "s_nationkey")))
    made = made.union(one("RO:0002558", F.lit("ECO:1"))).union(one("RO:0002558", F.lit("ECO:2"))).union(one("dc:source", cid("PMID", "s_suppkey"), s.filter("s_suppkey % 2 = 0")))
    return G.evidence_table(made).withColumns({"evidence": F.array_join("evidence", "|"), "publications": F.array_join("publications", "|")})


@query(f"SELECT term, sample_count, bg_count, p FROM ({_fisher_all_sql('two-sided')}) WHERE sample_count >= 3")
def closure_enrichment(spark, d):
    sample = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(cid("CUST", "c_custkey").alias("subject"))
    return customers(spark, d).closure_enrichment(sample, 3, 2.0).select("term", "sample_count", "bg_count", F.round("p", 6).alias("p"))


# --- profiles

IC = "icc AS (SELECT term, -log2(count(*) / (SELECT count(*) FROM customer)) AS ic FROM i GROUP BY term)"


@query(f"""{I}, {IC}, w AS (SELECT unnest(['PART:5', 'PART:9']) AS term UNION SELECT anc FROM c WHERE term IN ('PART:5', 'PART:9')), q AS (SELECT sum(ic) AS q FROM w JOIN icc USING (term)),
  t AS (SELECT subject, sum(ic) AS t, sum(ic) FILTER (WHERE term IN (SELECT term FROM w)) AS c FROM i JOIN icc USING (term) GROUP BY subject) SELECT subject, round(c / (t + q - c), 8)::DOUBLE AS score FROM t CROSS JOIN q WHERE c > 0""")
def sim_search_profiles(spark, d):
    return S.search_profiles(customers(spark, d), ["PART:5", "PART:9"], 1 << 30).select("subject", F.round("score", 8).alias("score"))


PROFILES = "prof AS (SELECT 'P' || (p_partkey % 10) AS id, 'PART:' || p_partkey AS term FROM part WHERE p_partkey < 100)"


def _profiles(spark, d):
    return table(spark, d, "part").filter("p_partkey < 100").select(F.concat(F.lit("P"), (F.col("p_partkey") % 10).cast("string")).alias("id"), cid("PART", "p_partkey").alias("term"))


@query(f"""{sql(EDGES, CLOSURE, REFLEXIVE, ASSOC, INFERRED)}, {IC}, {PROFILES}, s AS (SELECT p.id, p.term, r.anc, ic FROM prof p JOIN r ON r.term = p.term JOIN icc ON icc.term = r.anc),
  m AS (SELECT y.id AS y, x.term AS a, y.term AS b, max(x.ic) AS ic FROM s x JOIN s y ON x.anc = y.anc WHERE x.id = 'P0' AND y.id <> 'P0' GROUP BY ALL), u AS (SELECT y, avg(k) AS m0 FROM (SELECT y, a, max(ic) AS k FROM m GROUP BY ALL) GROUP BY y), v AS (SELECT y, avg(k) AS m1 FROM (SELECT y, b, max(ic) AS k FROM m GROUP BY ALL) GROUP BY y)
  SELECT 'P0' AS x, y, round((m0 + m1) / 2, 8)::DOUBLE AS score FROM u JOIN v USING (y)""")
def sim_compare_profiles(spark, d):
    return S.compare_profiles(_profiles(spark, d), "P0", customers(spark, d)).select("x", "y", F.round("score", 8).alias("score"))


@query(f"{I}, {IC}, {PROFILES} SELECT term, round(ic, 8)::DOUBLE AS ic FROM icc WHERE term IN (SELECT term FROM prof)")
def sim_profile_content(spark, d):
    return S.profile_content(_profiles(spark, d), S.information_content(customers(spark, d))).withColumn("ic", F.round("ic", 8))


@query("SELECT 'PART:' || p_partkey AS a, 'PART:' || (p_partkey + 1) AS b, unnest(string_split(p_brand || '|' || p_type, '|')) AS lcs FROM part")
def sim_match_triples(spark, d):
    best = table(spark, d, "part").select(cid("PART", "p_partkey").alias("a"), cid("PART", F.col("p_partkey") + 1).alias("b"), F.array("p_brand", "p_type").alias("terms"))
    return S.match_triples(best)


@query("SELECT id FROM (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'HGNC:' WHEN 1 THEN 'MGI:' ELSE 'MONDO:' END || c_custkey AS id FROM customer) WHERE id LIKE 'MGI:%'")
def sim_namespace(spark, d):
    k = F.col("c_nationkey") % 3
    rows = table(spark, d, "customer").select(F.concat(F.when(k == 0, "HGNC:").when(k == 1, "MGI:").otherwise("MONDO:"), _k("c_custkey")).alias("id"))
    return S.in_namespace(rows, "id", {"10090": "MGI:", "9606": "HGNC:"}, "10090", "gene")


@query("""SELECT DISTINCT 'CUST:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'CUST:' || c_custkey ELSE 'NATION:' || c_nationkey END AS term FROM customer WHERE c_custkey % 2 = 0 OR c_acctbal > 0""")
def sim_resolved_profiles(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(cid("CUST", "c_custkey").alias("id"))
    types = c.filter("c_custkey % 3 > 0 or c_custkey % 2 = 0").select(cid("CUST", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "phenotype").otherwise("gene").alias("type"))
    said = c.filter("c_acctbal > 0").select(cid("CUST", "c_custkey").alias("subject"), cid("NATION", "c_nationkey").alias("object"))
    return S.resolve_profiles(rows, types, said)


@query("SELECT 'CUST:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'MGI:1' WHEN c_custkey % 3 = 1 THEN 'OMIM:' || c_nationkey ELSE 'HP:' || c_nationkey || '|HP:2' END AS terms FROM customer")
def sim_patient_features(spark, d):
    named = "array<struct<id:string>>"
    k = F.col("c_custkey") % 3
    feature = lambda i, seen: F.struct(i.alias("id"), F.lit(seen).alias("observed"))
    seen = F.when(k == 2, F.array(feature(cid("HP", "c_nationkey"), None), feature(F.lit("HP:1"), "no"), feature(F.lit("HP:2"), "yes"))).otherwise(F.array(feature(F.lit("HP:9"), "no")))
    rows = table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("id"), seen.alias("features"), F.when(k == 1, F.array(F.struct(cid("MIM", "c_nationkey").alias("id")))).otherwise(F.array().cast(named)).alias("disorders"), F.array(F.struct(F.struct(F.lit("MGI:1").alias("id")).alias("gene"))).alias("genomicFeatures"))
    return S.patient_features(rows).withColumn("terms", F.array_join("terms", "|"))


@query("SELECT 'PART:' || p_partkey AS id, string_agg(DISTINCT t, '|' ORDER BY t) AS types FROM (SELECT p_partkey, unnest([lower(p_type), 'gene']) AS t FROM part) GROUP BY p_partkey")
def sim_clean_types(spark, d):
    rows = table(spark, d, "part").select(cid("PART", "p_partkey").alias("id"), F.explode(F.array(F.col("p_type"), F.lit("Gene"), F.lit("Class"), F.lit("cliqueLeader"))).alias("type"))
    return S.clean_types(rows).withColumn("types", F.array_join("types", "|"))


@query(f"""{I}, {IC}, prof AS (SELECT DISTINCT subject AS id, object AS term FROM a), cat AS (SELECT 'PART:' || p_partkey AS term, p_type AS category FROM part WHERE p_type IN ('MEDIUM', 'SMALL')), g AS (SELECT id, category, avg(ic) AS m, max(ic) AS x, sum(ic) AS s FROM prof JOIN icc USING (term) JOIN cat USING (term) GROUP BY ALL),
  f AS (SELECT id, category, coalesce(m, 0) AS m, coalesce(x, 0) AS x, coalesce(s, 0) AS s FROM (SELECT DISTINCT id FROM prof) CROSS JOIN (SELECT unnest(['MEDIUM', 'SMALL']) AS category) LEFT JOIN g USING (id, category))
  SELECT id, round(avg((least(m / 10, 1) + least(x / 12, 1) + least(s / 90, 1)) / 3), 8)::DOUBLE AS categorical FROM f GROUP BY id""")
def sim_categorical_sufficiency(spark, d):
    s = customers(spark, d)
    cat = table(spark, d, "part").filter("p_type in ('MEDIUM', 'SMALL')").select(F.col("p_type").alias("category"), cid("PART", "p_partkey").alias("term"))
    statistics = spark.createDataFrame([(c, 10.0, 12.0, 90.0) for c in ("MEDIUM", "SMALL")], "category string, mean_ic double, max_ic double, sum_ic double")
    made = S.categorical_sufficiency(s.assoc.select(F.col("subject").alias("id"), F.col("object").alias("term")), S.information_content(s), cat, statistics)
    return made.withColumn("categorical", F.round("categorical", 8))


# --- triples and differences


@query("SELECT DISTINCT 'SUPP:' || l_suppkey AS s, 'r' || l_returnflag AS p, 'PART:' || l_partkey AS o FROM lineitem")
def triples_plain(spark, d):
    return R.plain(table(spark, d, "lineitem").select(cid("SUPP", "l_suppkey").alias("subject"), F.concat(F.lit("r"), "l_returnflag").alias("relation"), cid("PART", "l_partkey").alias("object")))


@query("SELECT 'PART:' || p_partkey AS subject, CASE WHEN p_size < 25 THEN 'BRAND:' || p_brand ELSE 'PART:' || p_partkey END AS gene FROM part")
def associations_by_gene(spark, d):
    p = table(spark, d, "part")
    return R.by_gene(p.select(cid("PART", "p_partkey").alias("subject")), p.filter("p_size < 25").select(cid("PART", "p_partkey").alias("id"), cid("BRAND", "p_brand").alias("parent")))


@query("SELECT 'SUPP:' || l_suppkey AS subject, strftime(max(l_shipdate), '%Y-%m-%d') AS modified, strftime(min(l_shipdate), '%Y-%m-%d') AS created, max(l_orderkey)::BIGINT AS imported FROM lineitem GROUP BY l_suppkey")
def evidence_dates(spark, d):
    rows = table(spark, d, "lineitem").select(cid("SUPP", "l_suppkey").alias("subject"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_orderkey").alias("imported"))
    return R.evidence_dates(rows, ["subject"])


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id FROM lineitem WHERE l_returnflag <> 'A' AND NOT (l_returnflag = 'R' AND l_linenumber = 3) AND l_suppkey % 5 <> 0 AND l_linestatus = 'O'""")
def lines_filtered(spark, d):
    props = F.when(F.col("l_suppkey") % 5 == 0, F.array(F.struct(F.lit("bad").alias("key")))).otherwise(F.array(F.struct(F.lit("good").alias("key"))))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_returnflag").alias("evidence"), F.concat(F.lit("ref"), _k("l_linenumber")).alias("reference"), props.alias("properties"), "l_linestatus")
    return R.filtered_lines(rows, ["A"], [("R", "ref3")], ["bad"], {"l_linestatus": ["O"]}).select("row_id")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'BFO:0000050' WHEN 1 THEN 'RO:0002331' ELSE '-' END AS relation FROM part")
def relations_named(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(F.lit("part_of"), F.lit("Involved in"), F.lit("odd")), (F.col("p_partkey") % 3).cast("int")).alias("relation"))
    return R.named_relations(rows, spark.createDataFrame([("part of", "BFO:0000050"), ("involved_in", "RO:0002331")], "label string, id string")).na.fill("-", ["relation"])


@query(f"WITH {TRIPLES} SELECT DISTINCT a.s AS sub, 'supplies_type' AS pred, b.o AS obj FROM t a JOIN t b ON b.s = a.o WHERE a.p = 'supplies' AND b.p = 'type'")
def relations_causal(spark, d):
    return R.causal_relations(_triples(spark, d), spark.createDataFrame([("supplies_type", "supplies", "type")], "pred string, first string, second string"))


@query("SELECT 'PART:' || p_partkey AS id, p_name AS label FROM part WHERE regexp_matches(lower(p_name), '^red.*t')")
def triples_label_search(spark, d):
    made = table(spark, d, "part").select(cid("PART", "p_partkey").alias("s"), F.lit("rdfs:label").alias("p"), F.col("p_name").alias("o"))
    return R.labelled_search(made.union(made.select("s", F.lit("other"), "o")), "^RED.*t")


@query(f"WITH {TRIPLES} SELECT p, count(DISTINCT s)::BIGINT AS n FROM t GROUP BY p")
def triples_sql(spark, d):
    return R.run_sql(_triples(spark, d), "SELECT p, count(DISTINCT s) AS n FROM triples GROUP BY p")


@query("SELECT DISTINCT p_brand AS source, p_type AS target FROM part")
def triples_mapped_ids(spark, d):
    p = table(spark, d, "part")
    made = p.select(cid("PART", "p_partkey").alias("s"), F.lit("brand").alias("p"), F.col("p_brand").alias("o")).union(p.select(cid("PART", "p_partkey"), F.lit("type"), "p_type"))
    return R.mapped_ids(made, "brand", "type")


@query("SELECT 'MGI:' || c_custkey AS subject, CASE c_nationkey % 3 WHEN 0 THEN 'IDA' WHEN 1 THEN 'IEA' ELSE 'ECO:9' END AS evidence FROM customer")
def differ_normalised(spark, d):
    k = F.col("c_nationkey") % 3
    rows = table(spark, d, "customer").select(F.concat(F.lit("MGI:MGI:"), _k("c_custkey")).alias("subject"), F.when(k == 0, "ECO:0000314").when(k == 1, "ECO:0000501").otherwise("ECO:9").alias("evidence"))
    return D.normalised(rows, spark.createDataFrame([("ECO:0000314", "IDA"), ("ECO:0000501", "IEA")], "cls string, code string"))


# --- files, written and read back

GAF_FIELDS = """subject, 'S' || l_suppkey AS label, qualifier LIKE 'NOT%' AS negated, CASE WHEN qualifier = '' THEN CASE aspect WHEN 'P' THEN 'involved_in' WHEN 'F' THEN 'enables' ELSE 'located_in' END ELSE replace(qualifier, 'NOT|', '') END AS relation, term, reference AS refs, evidence,
  CASE WHEN has_with THEN 'PART:' || l_partkey || '|SUPP:' || l_suppkey || ',X:1' ELSE '' END AS with_from, strftime(date, '%Y-%m-%d') AS day"""


def _fields(rows):
    return rows.select("subject", "negated", "relation", "term", F.array_join("references", "|").alias("refs"), "evidence", text.conjunctions_text(F.col("with_from")).alias("with_from"), F.date_format("date", "yyyy-MM-dd").alias("day"), *(c for c in ("label",) if c in rows.columns))


def _good(spark, d):
    return P.annotations(P.cells(annotation_lines(spark, d), "gaf", "2.2"), "gaf", "2.2").filter("problem is null")


@query(f"WITH {LINES} SELECT {GAF_FIELDS} FROM lines WHERE NOT bad_taxon")
def gaf_round_trip(spark, d):
    """All rows: parsed, written with a header as compressed files, and read again by that header."""
    path = _written(spark, W.with_header(W.gaf(_good(spark, d)), ["!gaf-version: 2.2"]), "gaf", gzip=True)
    return _fields(X.associations(spark, path).filter("problem is null"))


@query(f"WITH {LINES} SELECT * EXCLUDE (label) FROM (SELECT {GAF_FIELDS} FROM lines WHERE NOT bad_taxon)")
def gpad_round_trip(spark, d):
    path = _written(spark, W.with_header(W.gpad(_good(spark, d)), ["!gpad-version: 2.0"]), "gpad")
    return _fields(X.associations(spark, path).filter("problem is null"))


@query("SELECT 'SUPP:' || s_suppkey AS id, 'L' || s_suppkey AS label, s_name AS name, 'a|b' AS synonyms, 'NCBITaxon:' || s_nationkey AS taxon FROM supplier")
def gpi_round_trip(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "supplier").select(
        cid("SUPP", "s_suppkey").alias("id"), F.concat(F.lit("L"), _k("s_suppkey")).alias("label"), F.col("s_name").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("synonyms"), F.array(F.lit("SO:1")).alias("types"), cid("NCBITaxon", "s_nationkey").alias("taxon"),
        none.alias("encoded_by"), none.alias("parents"), none.alias("members"), none.alias("xrefs"), F.array().cast("array<struct<key:string,value:string>>").alias("properties"),
    )
    path = _written(spark, W.with_header(W.gpi(rows), ["!gpi-version: 2.0"]), "gpi")
    return X.entities(spark, path).select("id", "label", "name", F.array_join("synonyms", "|").alias("synonyms"), "taxon")


@query(f"{sql(EDGES)} SELECT sub, pred, obj FROM e")
def obo_round_trip(spark, d):
    path = _written(spark, W.obo(product(spark, d)).select("value"), "obo")
    return X.obo(spark, path).edges.withColumn("pred", F.when(F.col("pred") == "part_of", "BFO:0000050").otherwise(F.col("pred")))


@query(f"WITH {TRIPLES} SELECT s, p, o FROM t")
def ntriples_round_trip(spark, d):
    slash = lambda c: F.concat(F.lit("E:"), F.col(c)).alias(c)
    path = _written(spark, R.ntriples(_triples(spark, d).select(slash("s"), slash("p"), slash("o")), {"E": "http://e/"}), "nt")
    back = lambda c: F.regexp_replace(c, "^(E:|http://e/)", "").alias(c)
    return X.ntriples(spark, path, {"E": "http://e/"}).select(back("s"), back("p"), back("o"))


@query("SELECT 'CUST:' || c_custkey AS subject, c_name AS label FROM customer")
def table_round_trip(spark, d):
    path = scratch_folder(spark, "tsv")
    W.save_table(table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("subject"), F.col("c_name").alias("label")), path)
    return X.tab_separated(spark, path)


@query("SELECT 'C' || p_partkey AS code, CASE WHEN p_size % 2 = 0 THEN 'R:' || p_size ELSE '-' END AS ref, 'ECO:' || p_size AS cls FROM part")
def evidence_file(spark, d):
    ref = F.when(F.col("p_size") % 2 == 0, cid("R", "p_size")).otherwise("Default")
    lines = table(spark, d, "part").select(F.concat_ws("\t", F.concat(F.lit("C"), _k("p_partkey")), ref, cid("ECO", "p_size")).alias("value"))
    return X.evidence_table(spark, _written(spark, W.with_header(lines, ["# codes"]), "eco")).na.fill("-", ["ref"])


@query("SELECT 'PMID:' || p_partkey AS id FROM part")
def retracted_file(spark, d):
    lines = table(spark, d, "part").select(F.concat(cid("PMID", "p_partkey"), F.lit(" ,why, when")).alias("value"))
    return X.retracted(spark, _written(spark, W.with_header(lines, ["! list", " "]), "retracted"))
