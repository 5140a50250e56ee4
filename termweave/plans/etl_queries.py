"""Queries over lines, rules, mappings and differences: PRS-*, RUL-*, SNK-*, LEX-*, DIF-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import differ as D
from ..operators import lexmap as L
from ..operators import parse as P
from ..sources import writers as W
from .derived import LINES, annotation_lines, cid, product, table
from .registry import query


def _annotations(spark, d):
    return P.annotations(P.cells(annotation_lines(spark, d), "gaf", "2.2"), "gaf", "2.2")


@query(f"""WITH {LINES} SELECT row_id, subject, term, CASE WHEN aspect = 'P' THEN 'involved_in' WHEN aspect = 'F' THEN 'enables' ELSE 'located_in' END AS default_relation, evidence,
  CASE WHEN has_with THEN 'PART:' || l_partkey || '|SUPP:' || l_suppkey || ',X:1' ELSE '' END AS with_from, reference AS refs, strftime(date, '%Y-%m-%d') AS day,
  CASE WHEN bad_taxon THEN 'taxon can''t be read' ELSE '-' END AS problem FROM lines""")
def parse_tsv_lines(spark, d):
    rows = _annotations(spark, d)
    default = F.when(F.col("aspect") == "P", "involved_in").when(F.col("aspect") == "F", "enables").otherwise("located_in")
    return rows.select("row_id", "subject", "term", default.alias("default_relation"), "evidence", text.conjunctions_text(F.col("with_from")).alias("with_from"), F.array_join("references", "|").alias("refs"), F.date_format("date", "yyyy-MM-dd").alias("day"), F.coalesce("problem", F.lit("-")).alias("problem"))


@query(f"""WITH {LINES} SELECT row_id, qualifier LIKE 'NOT%' AS negated, CASE WHEN qualifier = '' THEN CASE aspect WHEN 'P' THEN 'involved_in' WHEN 'F' THEN 'enables' ELSE 'located_in' END ELSE replace(qualifier, 'NOT|', '') END AS relation,
  CASE WHEN qualifier = '' THEN 'one relation is needed' ELSE '-' END AS problem FROM lines""")
def parse_qualifiers(spark, d):
    cells = P.cells(annotation_lines(spark, d), "gaf", "2.2")
    q = P.qualifiers(F.col("qualifier"), F.col("aspect"))
    return cells.select("row_id", q["negated"].alias("negated"), q["relation"].alias("relation"), F.coalesce(P.qualifier_problem(F.col("qualifier"), "2.2"), F.lit("-")).alias("problem"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id, 'A:' || l_partkey || '|' || 'B:1,C:2' AS joined, 2::INT AS alternatives, 3::INT AS parts FROM lineitem""")
def parse_conjunctions(spark, d):
    cell = F.concat(cid("A", "l_partkey"), F.lit("||B:1,,C:2|"))
    parts = text.conjunctions(cell)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), text.conjunctions_text(parts).alias("joined"), F.size(parts).alias("alternatives"), F.size(F.flatten(parts)).alias("parts"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'no colon' WHEN 2 THEN 'no namespace' WHEN 3 THEN 'no identity' WHEN 4 THEN 'white space' ELSE '-' END AS error,
  CASE WHEN p_partkey % 6 = 5 THEN 'X' ELSE '-' END AS namespace, CASE WHEN p_partkey % 6 = 5 THEN p_partkey || ':b' ELSE '-' END AS identity FROM part""")
def parse_curie_errors(spark, d):
    k = F.col("p_partkey").cast("string")
    made = F.get(F.array(F.lit(""), k, F.concat(F.lit(":"), k), F.concat(k, F.lit(":")), F.concat(F.lit("X:"), k, F.lit(" y")), F.concat(F.lit("X:"), k, F.lit(":b"))), (F.col("p_partkey") % 6).cast("int"))
    c = text.curie(made)
    none = F.lit("-")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(c["error"], none).alias("error"), F.coalesce(c["namespace"], none).alias("namespace"), F.coalesce(c["identity"], none).alias("identity"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id, strftime(l_shipdate, '%Y%m%d') AS day, CASE WHEN l_linenumber = 3 THEN '-' ELSE strftime(l_shipdate, '%Y%m%d') END AS parsed FROM lineitem""")
def parse_dates(spark, d):
    n = F.col("l_linenumber")
    cell = F.when(n == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).when(n == 2, F.date_format("l_shipdate", "yyyy.MM.dd")).when(n == 3, F.lit("soon")).otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("row_id"), F.date_format("l_shipdate", "yyyyMMdd").alias("day"), F.coalesce(F.date_format(text.gaf_date(cell), "yyyyMMdd"), F.lit("-")).alias("parsed"))


@query("""SELECT p_partkey AS id, 'part_of' AS relation, 'CL:' || p_partkey AS term FROM part UNION ALL SELECT p_partkey, 'occurs_in', 'CL:2' FROM part""")
def parse_extensions(spark, d):
    cell = F.concat(F.lit("part_of(CL:"), F.col("p_partkey"), F.lit(")|occurs_in(CL:2)"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.flatten(text.extension_units(cell))).alias("u")).select("id", "u.relation", "u.term")


@query("""SELECT 'SUPP:' || l_suppkey AS subject, 'PART:' || l_partkey AS object, s.s_name AS label FROM lineitem JOIN supplier s ON s_suppkey = l_suppkey""")
def entities_join(spark, d):
    rows = table(spark, d, "lineitem").select(cid("SUPP", "l_suppkey").alias("subject"), cid("PART", "l_partkey").alias("object"))
    return P.with_entities(rows, table(spark, d, "supplier").select(cid("SUPP", "s_suppkey").alias("id"), F.col("s_name").alias("label"))).select("subject", "object", "label")


@query("""SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL OR b.label = '' THEN coalesce(a.label, '-') ELSE b.label END AS label, CASE WHEN b.id IS NULL THEN a.kind ELSE b.kind END AS kind
  FROM (SELECT p_partkey AS id, p_name AS label, p_type AS kind FROM part) a FULL JOIN (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS label, c_mktsegment AS kind FROM customer) b ON a.id = b.id""")
def entities_merge(spark, d):
    one = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"))
    two = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("label"), F.col("c_mktsegment").alias("kind"))
    return P.merged_entities(one, two).na.fill("-", ["label"])


@query("""SELECT CASE WHEN p_size < 25 THEN 'BRAND:' || p_brand ELSE 'PR:' || p_partkey END AS subject, CASE WHEN p_size < 25 THEN 'PR:' || p_partkey ELSE '-' END AS isoform FROM part""")
def isoform_replace(spark, d):
    p = table(spark, d, "part")
    rows = p.select(cid("PR", "p_partkey").alias("subject"))
    genes = F.when(F.col("p_size") < 25, F.array(cid("BRAND", "p_brand"))).otherwise(F.array().cast("array<string>"))
    ents = p.select(cid("PR", "p_partkey").alias("id"), genes.alias("encoded_by"), F.col("p_name").alias("label"))
    return P.isoforms_to_genes(rows, ents).select("subject", F.coalesce("isoform", F.lit("-")).alias("isoform"))


@query("""SELECT p_partkey AS row_id, CASE WHEN c_acctbal < 2000 AND s_suppkey IS NOT NULL THEN 'NEW:' || s_suppkey ELSE 'X:' || p_partkey END AS term,
  CASE WHEN c_custkey IS NULL THEN 27 WHEN c_acctbal < 2000 THEN 20 ELSE 0 END AS rule, CASE WHEN c_custkey IS NULL THEN 'WARNING' WHEN c_acctbal >= 2000 THEN '-' WHEN s_suppkey IS NULL THEN 'ERROR' ELSE 'WARNING' END AS level
  FROM part LEFT JOIN customer ON c_custkey = p_partkey LEFT JOIN supplier ON s_suppkey = p_partkey""")
def term_repair(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), cid("X", "p_partkey").alias("term"))
    nodes = table(spark, d, "customer").select(cid("X", "c_custkey").alias("id"), (F.col("c_acctbal") < 2000).alias("deprecated"))
    repl = table(spark, d, "supplier").select(cid("X", "s_suppkey").alias("id"), F.array(cid("NEW", "s_suppkey")).alias("replacements"))
    return P.repaired_terms(rows, nodes, repl).select("row_id", "term", F.coalesce("rule", F.lit(0)).alias("rule"), F.coalesce("level", F.lit("-")).alias("level"))


@query(f"""WITH {LINES} SELECT row_id, concat_ws(chr(9), 'SUPP:' || l_suppkey, CASE WHEN qualifier LIKE 'NOT%' THEN 'NOT' ELSE '' END, CASE WHEN qualifier = '' THEN CASE aspect WHEN 'P' THEN 'involved_in' WHEN 'F' THEN 'enables' ELSE 'located_in' END ELSE replace(qualifier, 'NOT|', '') END,
  term, reference, evidence, CASE WHEN has_with THEN 'PART:' || l_partkey || '|SUPP:' || l_suppkey || ',X:1' ELSE '' END, '', strftime(date, '%Y-%m-%d'), 'TST', 'part_of(CL:1)|occurs_in(CL:2),part_of(CL:3)', '') AS value FROM lines WHERE NOT bad_taxon""")
def gpad_lines(spark, d):
    rows = _annotations(spark, d).filter("problem is null")
    return rows.select("row_id", W.gpad_value(rows.columns, "2.0").alias("value"))


# --- differences between the lines of two states

DIFF = "a1 AS (SELECT l_suppkey AS subject, l_partkey AS object, l_returnflag AS evidence FROM lineitem WHERE l_linestatus = 'F'), a2 AS (SELECT l_suppkey AS subject, l_partkey AS object, l_returnflag AS evidence FROM lineitem WHERE l_linestatus = 'O')"


def _halves(spark, d):
    l = table(spark, d, "lineitem")
    rows = l.select("l_linestatus", F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), F.col("l_returnflag").alias("evidence"))
    return rows.filter("l_linestatus = 'F'").drop("l_linestatus"), rows.filter("l_linestatus = 'O'").drop("l_linestatus")


@query(f"WITH {DIFF} SELECT subject, object, evidence FROM a1 WHERE NOT EXISTS (SELECT 1 FROM a2 WHERE a2.subject = a1.subject AND a2.object = a1.object AND a2.evidence = a1.evidence)")
def differ_anti(spark, d):
    return D.missing(*_halves(spark, d), ["subject", "object", "evidence"])


@query(f"WITH {DIFF}, g1 AS (SELECT subject, count(*) AS n1 FROM a1 GROUP BY ALL), g2 AS (SELECT subject, count(*) AS n2 FROM a2 GROUP BY ALL) SELECT subject, coalesce(n1, 0)::BIGINT AS n1, coalesce(n2, 0)::BIGINT AS n2 FROM g1 FULL JOIN g2 USING (subject) WHERE coalesce(n1, 0) <> coalesce(n2, 0)")
def differ_group_delta(spark, d):
    return D.group_changes(*_halves(spark, d), ["subject"])


@query(f"WITH {DIFF} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM a1)::BIGINT AS n1, (SELECT count(DISTINCT {c}) FROM a2)::BIGINT AS n2" for c in ("subject", "object", "evidence")))
def differ_nunique(spark, d):
    return D.distinct_counts(*_halves(spark, d), ["subject", "object", "evidence"])


# --- lexical mapping: whole texts as labels, each source a vocabulary; copies across sources map to each other

TERMS = r"""terms AS (SELECT source || ':' || doc_id AS id, source AS ont, text AS val, CASE WHEN doc_id % 3 = 0 THEN 'exact' ELSE 'label' END AS scope FROM documents),
able AS (SELECT *, length(regexp_extract(val, '^[A-Z]+')) * 3 >= length(val) AS abbr, lower(regexp_replace(val, '([a-z])([A-Z])', '\1 \2', 'g')) AS std FROM terms WHERE regexp_matches(val, '[a-zA-Z]')),
toks AS (SELECT *, list_distinct(string_split(regexp_replace(std, '[^a-zA-Z0-9]+', ' ', 'g'), ' ')) AS ts FROM able),
syn AS (SELECT * FROM (VALUES ('i','1'),('ii','2'),('iii','3'),('iv','4'),('v','5'),('vi','6'),('vii','7'),('viii','8'),('ix','9'),('x','10'),('a',''),('of',''),('the',''),('in',''),('and',''),('or',''),('to',''),('by','')) s(f, t)),
mapped AS (SELECT id, ont, val, scope, abbr, std, coalesce(s.t, k) AS tok FROM (SELECT *, unnest(ts) AS k FROM toks) LEFT JOIN syn s ON s.f = k),
nrm AS (SELECT id, ont, val, scope, abbr, std, coalesce(string_agg(tok, ' ' ORDER BY tok) FILTER (WHERE tok <> ''), '') AS nrm FROM mapped GROUP BY ALL),
idx AS (SELECT id, ont, scope, std AS key, CASE WHEN abbr THEN 0.5 ELSE 1.0 END AS conf FROM nrm UNION ALL SELECT id, ont, scope, nrm, 0.8 FROM nrm WHERE nrm <> std AND NOT abbr AND nrm <> ''),
one AS (SELECT key, id, ont, scope, max(conf) AS conf FROM idx GROUP BY ALL),
prs AS (SELECT a.id AS a, b.id AS b, a.ont AS oa, b.ont AS ob, a.key, a.scope AS sa, b.scope AS sb, round_even(CASE WHEN a.scope = 'label' AND b.scope = 'label' THEN 100 ELSE 90 END * a.conf * b.conf, 0)::INT AS score FROM one a JOIN one b ON a.key = b.key AND a.id < b.id AND a.ont <> b.ont),
best AS (SELECT * FROM prs QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, sa DESC, sb DESC, key DESC) = 1)"""


def _terms(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.concat_ws(":", "source", "doc_id").alias("id"), F.col("source").alias("ont"), F.col("text").alias("val"), F.when(F.col("doc_id") % 3 == 0, "exact").otherwise("label").alias("scope"))


def _best(spark, d):
    return L.best_pairs(L.pairs(L.index(_terms(spark, d))).filter("oa <> ob"))


@query(f"WITH {TERMS} SELECT id, nrm FROM nrm")
def lex_normalize(spark, d):
    return _terms(spark, d).filter("val rlike '[a-zA-Z]'").select("id", text.normal_label(text.standard_label(F.col("val"))).alias("nrm"))


@query(f"WITH {TERMS} SELECT a, b, key, score FROM prs")
def lex_pairs(spark, d):
    return L.pairs(L.index(_terms(spark, d))).filter("oa <> ob").select("a", "b", "key", "score")


@query(f"WITH {TERMS} SELECT a, b, score FROM best")
def lex_best_pair(spark, d):
    return _best(spark, d).select("a", "b", "score")


@query(f"""WITH {TERMS} SELECT a, b, (CASE WHEN row_number() OVER (PARTITION BY a, ob ORDER BY score DESC, b DESC) = 1 THEN 2 ELSE 0 END * CASE WHEN row_number() OVER (PARTITION BY b, oa ORDER BY score DESC, a DESC) = 1 THEN 2 ELSE 0 END)::INT AS reciprocal_score,
  round((score / sum(score) OVER (PARTITION BY a, ob)) * (score / sum(score) OVER (PARTITION BY b, oa)), 8)::DOUBLE AS cpr FROM best""")
def lex_reciprocal(spark, d):
    return L.reciprocal(_best(spark, d)).select("a", "b", "reciprocal_score", F.round("cpr", 8).alias("cpr"))


@query(f"WITH {TERMS} SELECT id FROM terms WHERE id NOT IN (SELECT a FROM best) AND id NOT IN (SELECT b FROM best)")
def lex_unmapped(spark, d):
    return L.unmapped(_terms(spark, d).select("id"), L.reciprocal(_best(spark, d)))


@query(f"WITH RECURSIVE {TERMS}, g AS (SELECT a AS x, b AS y FROM best UNION SELECT b, a FROM best), cl AS (SELECT x, y FROM g UNION SELECT cl.x, g.y FROM cl JOIN g ON cl.y = g.x) SELECT x AS id, least(x, min(y)) AS component FROM cl GROUP BY x")
def lex_cliques(spark, d):
    return L.cliques(_best(spark, d), product(spark, d).edges.limit(0))
