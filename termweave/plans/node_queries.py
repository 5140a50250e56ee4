"""Queries over nodes, axioms and single annotations: what ONT-*, ASC-*, PRS-*, SNK-* and LEX-* look up or write one by one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assoc as A
from ..operators import closure as C
from ..operators import lexmap as L
from ..operators import parse as P
from ..operators.ontology import EQUIVALENT, IS_A, PART_OF, Ontology
from ..sources import writers as W
from .derived import ASSOC, CLOSURE, EDGES, INFERRED, ISA_CLOSURE, LINES, annotation_lines, cid, customers, product, sql, table
from .registry import query

E = sql(EDGES)
I = sql(EDGES, CLOSURE, ASSOC, INFERRED)


def _onto(spark, d, **tables) -> Ontology:
    return replace(product(spark, d), **tables)


def _k(c):
    return F.col(c).cast("string")


@query(f"{E}, q AS (SELECT DISTINCT 'PART:' || (c_custkey * 2) AS id FROM customer) SELECT q.id, n.id IS NOT NULL AS known, coalesce(n.label, q.id) AS label, CASE WHEN n.id IS NULL THEN '-' ELSE 'CLASS' END AS type FROM q LEFT JOIN nodes n ON n.id = q.id")
def ont_has_nodes(spark, d):
    ids = table(spark, d, "customer").select(cid("PART", F.col("c_custkey") * 2).alias("id"))
    return product(spark, d).has_nodes(ids).na.fill("-", ["type"])


@query(f"{E} SELECT DISTINCT pred FROM e")
def ont_relations_used(spark, d):
    return product(spark, d).relations_used()


@query(f"{sql(EDGES, ISA_CLOSURE)} SELECT 'PART:' || (s_suppkey * 3) AS id, 'PART:' || (s_suppkey * 3) AS anc FROM supplier UNION SELECT term, anc FROM ci WHERE term IN (SELECT 'PART:' || (s_suppkey * 3) FROM supplier)")
def ont_ancestors_reflexive(spark, d):
    ids = table(spark, d, "supplier").select(cid("PART", F.col("s_suppkey") * 3).alias("id"))
    return product(spark, d).ancestors(ids, [IS_A], True)


def _equivalent(spark, d):
    s = table(spark, d, "supplier")
    both = s.select(cid("SUPP", "s_suppkey").alias("sub"), F.lit(EQUIVALENT).alias("pred"), cid("CUST", "s_suppkey").alias("obj"))
    back = s.filter("s_suppkey % 2 = 0").select(cid("CUST", "s_suppkey").alias("sub"), F.lit(EQUIVALENT).alias("pred"), cid("SUPP", "s_suppkey").alias("obj"))
    return _onto(spark, d, edges=product(spark, d).edges.unionByName(both).unionByName(back))


@query("SELECT 'CUST:' || s_suppkey AS a, 'SUPP:' || s_suppkey AS b FROM supplier")
def ont_equivalents(spark, d):
    return _equivalent(spark, d).equivalents()


@query(f"{E} SELECT 'TYPE:MEDIUM' AS id UNION SELECT 'THING:0' UNION SELECT sub FROM e WHERE obj = 'TYPE:MEDIUM'")
def ont_bundle(spark, d):
    return _equivalent(spark, d).bundle("TYPE:MEDIUM")


@query("SELECT 'PART:' || p_partkey AS id, p_name AS val, 'X:' || p_size AS xrefs FROM part WHERE p_partkey IN (SELECT s_suppkey * 3 FROM supplier)")
def ont_text_definitions(spark, d):
    p = table(spark, d, "part")
    onto = _onto(spark, d, definitions=p.select(cid("PART", "p_partkey").alias("id"), F.col("p_name").alias("val"), F.array(cid("X", "p_size")).alias("xrefs")))
    return onto.text_definitions(table(spark, d, "supplier").select(cid("PART", F.col("s_suppkey") * 3).alias("id"))).withColumn("xrefs", F.array_join("xrefs", "|"))


@query("SELECT 'PART:' || p_partkey AS id, 'TYPE:' || p_type AS genus, 'part_of' AS property, 'SIZE:' || p_size AS filler FROM part WHERE p_partkey IN (SELECT s_suppkey * 3 FROM supplier)")
def ont_logical_definitions(spark, d):
    p = table(spark, d, "part")
    defs = p.select(cid("PART", "p_partkey").alias("id"), F.array(cid("TYPE", "p_type")).alias("genus"), F.array(F.struct(F.lit("part_of").alias("property"), cid("SIZE", "p_size").alias("filler"))).alias("restrictions"))
    found = _onto(spark, d, logical_defs=defs).logical_definitions(table(spark, d, "supplier").select(cid("PART", F.col("s_suppkey") * 3).alias("id")))
    return found.select("id", F.array_join("genus", "|").alias("genus"), F.explode("restrictions").alias("r")).select("id", "genus", "r.property", "r.filler")


@query("SELECT 'R:' || n_nationkey AS pred, 'R:' || n_regionkey || '>part_of' AS chain FROM nation WHERE n_nationkey IN (1, 3, 5, 7)")
def ont_property_chains(spark, d):
    n = table(spark, d, "nation")
    onto = _onto(spark, d, property_chains=n.select(cid("R", "n_nationkey").alias("pred"), F.array(cid("R", "n_regionkey"), F.lit("part_of")).alias("chain")))
    return onto.chains_of(["R:1", "R:3", "R:5", "R:7"]).withColumn("chain", F.array_join("chain", ">"))


def _with_subsets(spark, d):
    p = table(spark, d, "part")
    me = cid("PART", "p_partkey")
    return _onto(spark, d, subsets=p.select(me.alias("id"), F.concat(F.lit("http://x/y#"), "p_type").alias("subset")).union(p.select(me, "p_brand")).union(p.filter("p_size < 10").select(me, F.lit("small"))))


@query("SELECT 'PART:' || p_partkey AS id FROM part WHERE p_type = 'MEDIUM'")
def ont_subset(spark, d):
    return _with_subsets(spark, d).subset("MEDIUM")


@query("SELECT 'PART:' || p_partkey AS id FROM part WHERE (p_type = 'MEDIUM' AND p_size < 10) OR p_brand = 'Brand#2'")
def ont_subset_expression(spark, d):
    # the part of a name after its last # is the name: Brand#2 is the subset 2
    return _with_subsets(spark, d).subset_expression("MEDIUM,small|2")


@query("SELECT id, coalesce(min(leader), id) AS leader FROM (SELECT 'CUST:' || c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 'NATION:' || c_nationkey END AS leader FROM customer UNION ALL SELECT 'NATION:' || n_nationkey, NULL FROM nation) GROUP BY id")
def ont_clique_leaders(spark, d):
    c = table(spark, d, "customer")
    ids = c.select(cid("CUST", "c_custkey").alias("id")).union(table(spark, d, "nation").select(cid("NATION", "n_nationkey")))
    edges = c.filter("c_acctbal > 0").select(cid("CUST", "c_custkey").alias("sub"), F.lit("cliqueLeader").alias("pred"), cid("NATION", "c_nationkey").alias("obj"))
    return Ontology(ids.select("id", F.col("id").alias("label"), F.lit("CLASS").alias("type"), F.lit(False).alias("deprecated")), edges).clique_leaders()


@query("""WITH i AS (SELECT 'NATION:' || n_nationkey AS id FROM nation WHERE n_regionkey = 1)
  SELECT 'CUST:' || c_custkey AS id, 'TAXON:' || (c_custkey % 7) AS taxon, CASE WHEN 'NATION:' || c_nationkey IN (SELECT id FROM i) THEN 'NATION:' || c_nationkey ELSE '' END AS inheritance,
  CASE WHEN 'NATION:' || c_nationkey IN (SELECT id FROM i) THEN '' ELSE 'NATION:' || c_nationkey END AS modifiers FROM customer""")
def ont_bio_objects(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    me = cid("CUST", "c_custkey")
    edges = c.select(me.alias("sub"), F.lit("RO:0002162").alias("pred"), cid("TAXON", F.col("c_custkey") % 7).alias("obj")).union(c.select(me, F.lit("RO:0000091"), cid("NATION", "c_nationkey"))).union(n.select(cid("NATION", "n_nationkey"), F.lit(IS_A), cid("REGION", "n_regionkey")))
    made = Ontology.of_edges(edges).bio_objects(inheritance=["REGION:1"])
    return made.filter("id like 'CUST:%'").select("id", "taxon", F.array_join(F.col("inheritance.id"), "|").alias("inheritance"), F.array_join(F.col("modifiers.id"), "|").alias("modifiers"))


@query("SELECT 'PART:' || p_partkey AS id, 'SIZE:' || p_size AS targets FROM part")
def ont_termable(spark, d):
    return product(spark, d).termable(["THING:0"], PART_OF).withColumn("targets", F.array_join("targets", "|"))


@query(f"{sql(EDGES, CLOSURE)} SELECT id, CASE WHEN id = 'TYPE:MEDIUM' OR EXISTS (SELECT 1 FROM c WHERE term = id AND anc = 'TYPE:MEDIUM') THEN 'up' WHEN id = 'SBAND:2' OR EXISTS (SELECT 1 FROM c WHERE term = id AND anc = 'SBAND:2') THEN 'down' ELSE 'none' END AS bucket FROM nodes")
def ont_regulation(spark, d):
    return product(spark, d).regulation([("TYPE:MEDIUM", "up"), ("SBAND:2", "down")])


@query(f"{E} SELECT sub, pred, obj FROM e WHERE sub IN ('TYPE:MEDIUM', 'SIZE:3', 'NATION:2') OR obj IN ('TYPE:MEDIUM', 'SIZE:3', 'NATION:2')")
def ont_described(spark, d):
    return product(spark, d).described(["TYPE:MEDIUM", "SIZE:3", "NATION:2"])


@query("""SELECT 'K:' || (3 * s_suppkey) || '>K:' || (3 * s_suppkey + 1) || '>K:' || (3 * s_suppkey + 2) AS path FROM supplier WHERE s_suppkey BETWEEN 34 AND 332 UNION ALL SELECT 'K:' || (3 * s_suppkey) || '>K:' || (3 * s_suppkey + 1) FROM supplier WHERE s_suppkey BETWEEN 34 AND 332""")
def ont_simple_cycles(spark, d):
    k = table(spark, d, "supplier").filter("s_suppkey between 34 and 332").select((F.col("s_suppkey") * 3).alias("k"))  # of three digits, so that text order is number order
    link = lambda a, b: F.struct(cid("K", F.col("k") + a).alias("sub"), cid("K", F.col("k") + b).alias("obj"))
    edges = k.select(F.explode(F.array(link(0, 1), link(1, 2), link(2, 0), link(1, 0))).alias("e")).select("e.sub", F.lit("x").alias("pred"), "e.obj")
    return C.simple_cycles(edges).select(F.array_join("path", ">").alias("path"))


# --- associations


@query("SELECT DISTINCT 'SUPP:' || l_suppkey AS subject, 'PART:' || l_partkey AS object FROM lineitem WHERE l_returnflag <> 'R'")
def assoc_of_rows(spark, d):
    l = table(spark, d, "lineitem")
    return A.of_associations(l.select(cid("SUPP", "l_suppkey").alias("subject"), cid("PART", "l_partkey").alias("object"), (F.col("l_returnflag") == "R").alias("negated")))


@query(f"{I} SELECT term FROM i WHERE subject = 'CUST:7'")
def assoc_inferred_types(spark, d):
    return customers(spark, d).inferred_types("CUST:7")


@query(f"{I} SELECT subject, object FROM a WHERE object = 'PART:9'")
def assoc_between(spark, d):
    return customers(spark, d).between(obj="PART:9")


@query(f"{I}, n AS (SELECT id, label FROM nodes UNION ALL SELECT 'CUST:' || c_custkey, c_name FROM customer WHERE 'CUST:' || c_custkey NOT IN (SELECT id FROM nodes)) SELECT subject, s.label AS subject_label, object, o.label AS object_label FROM a LEFT JOIN n s ON s.id = subject LEFT JOIN n o ON o.id = object")
def assoc_labelled(spark, d):
    return customers(spark, d).labelled(table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("id"), F.col("c_name").alias("label")))


BRANDS, TYPES = [f"BRAND:Brand#{k}" for k in range(1, 4)], ["TYPE:MEDIUM", "TYPE:SMALL"]


@query(f"""{I}, x AS (SELECT unnest({BRANDS}) AS x), y AS (SELECT unnest({TYPES}) AS y), s AS (SELECT p.term AS x, q.term AS y, count(*) AS c FROM i p JOIN i q USING (subject) GROUP BY ALL), n AS (SELECT term, count(*) AS n FROM i GROUP BY term),
  j AS (SELECT x, y, round(CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c, 0) > 0 THEN coalesce(c, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c, 0)) ELSE 0 END, 8)::DOUBLE AS j FROM x CROSS JOIN y LEFT JOIN s USING (x, y) LEFT JOIN n a ON a.term = x LEFT JOIN n b ON b.term = y)
  SELECT y, {', '.join(f"max(j) FILTER (WHERE x = '{b}') AS \"{b}\"" for b in BRANDS)} FROM j GROUP BY y""".replace("FROM i p JOIN i q USING (subject) GROUP", "FROM (SELECT * FROM i WHERE term LIKE 'BRAND:%') p JOIN (SELECT * FROM i WHERE term LIKE 'TYPE:%') q USING (subject) GROUP"))
def assoc_intersection_matrix(spark, d):
    cells = customers(spark, d).intersections(BRANDS, TYPES).withColumn("j", F.round("j", 8))
    return A.pivot_intersections(cells, BRANDS)


@query(f"{I} SELECT sub, pred, obj FROM e WHERE sub IN (SELECT term FROM i) AND obj IN (SELECT term FROM i)")
def assoc_used_ontology(spark, d):
    return customers(spark, d).used_ontology().edges


@query(f"{I} SELECT DISTINCT 'PART:' || s.p_partkey AS id, subject, object FROM part s JOIN (SELECT DISTINCT 'SIZE:' || p_size AS subject, 'T:' || p_type AS object, p_size FROM part) t ON t.p_size = s.p_size WHERE s.p_partkey IN (SELECT s_suppkey FROM supplier)")
def assoc_chain_annotations(spark, d):
    said = table(spark, d, "part").select(cid("SIZE", "p_size").alias("subject"), cid("T", "p_type").alias("object")).distinct()
    return A.AssociationSet(said, product(spark, d)).chain_annotations(table(spark, d, "supplier").select(cid("PART", "s_suppkey").alias("id")), [PART_OF])


# --- cells of lines


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'too few items' WHEN p_partkey % 4 = 3 THEN 'too many items' ELSE '-' END AS problem FROM part")
def parse_cardinality(spark, d):
    cell = F.array_join(F.array_repeat(F.lit("X:1"), (F.col("p_partkey") % 4).cast("int")), "|")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(P.cardinality_problem(cell, 1, 2), F.lit("-")).alias("problem"))


@query("SELECT p_partkey AS id, 'a' AS key, 'x' || p_size || '=y' AS value FROM part UNION ALL SELECT p_partkey, 'bare', '-' FROM part")
def parse_properties(spark, d):
    cell = F.concat(F.lit("a=x"), _k("p_size"), F.lit("=y||bare"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(text.properties(cell)).alias("p")).select("id", "p.key", F.coalesce("p.value", F.lit("-")).alias("value"))


CODES = [("IEA", None, "ECO:0000501"), ("IEA", "GO_REF:0000002", "ECO:0000256"), ("IEA", "GO_REF:0000004", "ECO:0000501"), ("IDA", None, "ECO:0000314"), ("ISS", None, "ECO:0000250"), ("ISS", "GO_REF:0000011", "ECO:0000255"), ("ND", "GO_REF:0000015", "ECO:0000307")]
CODES_SQL = "codes AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in c) + ")" for c in CODES) + ") t(code, ref, cls))"
EVIDENCE_ROWS = "r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, ['IEA', 'IDA', 'ISS', 'ND', 'XX'][(l_orderkey % 5 + 1)::INT] AS evidence, ['GO_REF:0000002', 'GO_REF:0000011', 'GO_REF:0000015', 'PMID:1'][(l_partkey % 4 + 1)::INT] AS reference FROM lineitem)"


def _codes(spark):
    return spark.createDataFrame(CODES, "code string, ref string, cls string")


def _evidence_rows(spark, d):
    pick = lambda xs, c: F.get(F.array(*map(F.lit, xs)), c.cast("int"))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), pick(["IEA", "IDA", "ISS", "ND", "XX"], F.col("l_orderkey") % 5).alias("evidence"), pick(["GO_REF:0000002", "GO_REF:0000011", "GO_REF:0000015", "PMID:1"], F.col("l_partkey") % 4).alias("reference"))


@query(f"WITH {CODES_SQL}, {EVIDENCE_ROWS} SELECT row_id, r.evidence, r.reference, coalesce(a.cls, b.cls, '-') AS eco FROM r LEFT JOIN codes a ON a.code = r.evidence AND a.ref = r.reference LEFT JOIN codes b ON b.code = r.evidence AND b.ref IS NULL")
def evidence_classes(spark, d):
    return P.evidence_classes(_evidence_rows(spark, d), _codes(spark)).na.fill("-", ["eco"])


@query(f"WITH {CODES_SQL}, r AS (SELECT p_partkey AS id, ['ECO:0000501', 'ECO:0000256', 'ECO:0000314', 'ECO:0007000', 'ECO:9'][(p_partkey % 5 + 1)::INT] AS eco FROM part) SELECT id, r.eco, coalesce((SELECT min(code) FROM codes WHERE cls = r.eco), CASE WHEN r.eco = 'ECO:0007000' THEN 'HTP' END, '-') AS code FROM r")
def evidence_codes(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*map(F.lit, ("ECO:0000501", "ECO:0000256", "ECO:0000314", "ECO:0007000", "ECO:9"))), (F.col("p_partkey") % 5).cast("int")).alias("eco"))
    derived = spark.createDataFrame([("ECO:0007000", "HTP"), ("ECO:0000314", "ZZZ")], "cls string, code string")
    return P.evidence_codes(rows, _codes(spark), derived).na.fill("-", ["code"])


@query("SELECT p_partkey AS id, CASE p_type WHEN 'MEDIUM' THEN 'SO:0000704' WHEN 'SMALL' THEN 'PR:000000001' ELSE 'CHEBI:33695' END AS type FROM part")
def parse_entity_types(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.typed(F.col("p_type"), {"MEDIUM": "SO:0000704", "SMALL": "PR:000000001"}).alias("type"))


@query("SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN 'NEW:' || p_partkey ELSE 'OLD:' || p_partkey END || ',KEEP:1|KEEP:2' AS with_from FROM part")
def repaired_lists(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("row_id"), F.array(F.array(cid("OLD", "p_partkey"), F.lit("KEEP:1")), F.array(F.lit("KEEP:2"))).alias("with_from"))
    new = p.filter("p_partkey % 3 < 2").select(cid("OLD", "p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.array(cid("NEW", "p_partkey"))).otherwise(F.array(F.lit("A:1"), F.lit("A:2"))).alias("replacements"))
    return P.repaired_lists(rows, new).select("row_id", text.conjunctions_text(F.col("with_from")).alias("with_from"))


@query("SELECT 'D' || (p_partkey % 3) || ':' || p_brand AS id, CASE p_partkey % 3 WHEN 0 THEN bool_or(regexp_full_match(p_brand, 'Brand#[0-9]')) WHEN 1 THEN bool_or(regexp_full_match(p_brand, '.*1') OR regexp_full_match(p_brand, '.*2')) ELSE true END AS ok FROM part GROUP BY p_partkey % 3, p_brand")
def identifier_syntax(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("D"), (F.col("p_partkey") % 3).cast("string"), F.lit(":"), F.col("p_brand")).alias("id")).distinct()
    return P.syntax_problems(ids, spark.createDataFrame([("D0", "Brand#[0-9]"), ("D1", ".*1"), ("D1", ".*2")], "database string, id_syntax string"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE 'A:' || p_size || '|B:1' END AS ids FROM part")
def identifier_lists(spark, d):
    cell = F.concat(F.lit("B:1| A:"), _k("p_size"), F.when(F.col("p_partkey") % 3 == 0, "|bad").otherwise("|"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.array_join(P.identifier_list(cell), "|"), F.lit("-")).alias("ids"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_partkey % 5 = 4 THEN 'enables' WHEN l_partkey % 5 = 0 THEN 'involved_in' WHEN l_partkey % 5 = 1 THEN 'is_active_in' WHEN l_suppkey % 2 = 0 THEN 'part_of' ELSE ['acts_upstream_of_or_within', 'enables', 'located_in'][(l_orderkey % 3 + 1)::INT] END AS relation FROM lineitem""")
def upgraded_qualifiers(spark, d):
    l = table(spark, d, "lineitem")
    k = F.col("l_partkey") % 5
    rows = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.when(k == 0, "GO:0008150").when(k == 1, "GO:0008372").otherwise("GO:9").alias("term"), (F.col("l_suppkey") % 2 == 0).alias("in_complex"), F.get(F.array(*map(F.lit, "PFC")), (F.col("l_orderkey") % 3).cast("int")).alias("aspect"), F.when(k == 4, "enables").otherwise("").alias("relation"))
    return P.upgraded_qualifiers(rows).select("row_id", "relation")


@query("SELECT CASE c_nationkey % 3 WHEN 0 THEN 'UniProtKB:' WHEN 1 THEN 'MGI:' ELSE 'Q:' END || c_custkey AS subject, c_nationkey % 3 < 2 AS known_space FROM customer")
def canonical_spaces(spark, d):
    k = F.col("c_nationkey") % 3
    rows = table(spark, d, "customer").select(F.concat(F.when(k == 0, "UniProt:").when(k == 1, "MGI:").otherwise("Q:"), _k("c_custkey")).alias("subject"))
    return P.canonical_spaces(rows, spark.createDataFrame([("UniProt", "UniProtKB"), ("MGI", "MGI")], "prefix string, canonical string"))


def _parsed(spark, d):
    return P.annotations(P.cells(annotation_lines(spark, d), "gaf", "2.2"), "gaf", "2.2")


@query(f"WITH {LINES} SELECT row_id FROM lines WHERE NOT bad_taxon AND l_suppkey IN (1, 2, 3) AND qualifier <> 'involved_in' AND NOT (qualifier = '' AND aspect = 'P')")
def parse_allowed(spark, d):
    return P.allowed(_parsed(spark, d), [f"NCBITaxon:{k}" for k in (1, 2, 3)], None, ["involved_in"]).select("row_id")


@query(f"WITH {LINES} SELECT subject, 'S' || l_suppkey AS label, term FROM lines WHERE qualifier NOT LIKE 'NOT%' AND qualifier <> 'involved_in'")
def parse_skim(spark, d):
    return P.skim(P.cells(annotation_lines(spark, d), "gaf", "2.2"), ["involved_in"])


SUBSET = "m AS (SELECT 'PART:' || p_partkey AS id, 'TYPE:' || p_type AS slim FROM part WHERE p_size < 25 UNION ALL SELECT 'PART:' || p_partkey, 'BRAND:' || p_brand FROM part WHERE p_size < 5)"


def _subset(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_size < 25").select(cid("PART", "p_partkey").alias("id"), cid("TYPE", "p_type").alias("slim")).union(p.filter("p_size < 5").select(cid("PART", "p_partkey"), cid("BRAND", "p_brand")))


@query(f"WITH {LINES}, {SUBSET} SELECT row_id, slim AS term FROM lines JOIN m ON id = term")
def parse_subset_mapped(spark, d):
    return P.mapped_to_subset(_parsed(spark, d), _subset(spark, d))[0].select("row_id", "term")


@query(f"WITH {LINES}, {SUBSET} SELECT row_id, term FROM lines WHERE term NOT IN (SELECT id FROM m)")
def parse_subset_unmapped(spark, d):
    return P.mapped_to_subset(_parsed(spark, d), _subset(spark, d))[1].select("row_id", "term")


@query(f"WITH {LINES} SELECT DISTINCT subject AS id, 'S' || l_suppkey AS label, 'gene_product' AS type FROM lines")
def parse_entities_of(spark, d):
    return P.entities_of(_parsed(spark, d)).select("id", "label", "type")


@query("SELECT p_partkey AS id, CASE WHEN p_size < 20 THEN 'A:1,B:' || p_size || '|C:2' ELSE 'A:1,B:' || p_size || '|C:2' END AS sorted FROM part")
def parse_sorted_conjunctions(spark, d):
    cell = F.concat(F.lit("C:2|B:"), _k("p_size"), F.lit(",A:1"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.conjunctions_text(text.sorted_conjunctions(cell)).alias("sorted"))


@query(f"WITH {LINES} SELECT count(*)::BIGINT AS lines, count(*) FILTER (WHERE NOT bad_taxon)::BIGINT AS associations, count(*) FILTER (WHERE bad_taxon)::BIGINT AS skipped FROM lines")
def parse_counters(spark, d):
    return P.counters(_parsed(spark, d))


# --- writers


@query("SELECT concat_ws(chr(9), 'SUPP:' || s_suppkey, 'L' || s_suppkey, s_name, 'a|b', 'SO:1', 'NCBITaxon:' || s_nationkey, '', '', '', 'X:1', 'k=v') AS value FROM supplier UNION ALL SELECT concat_ws(chr(9), 'SUPP', s_suppkey, 'L' || s_suppkey, s_name, 'a|b', 'SO:1', 'taxon:' || s_nationkey, '', 'X:1', 'k=v') FROM supplier")
def gpi_lines(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "supplier").select(
        cid("SUPP", "s_suppkey").alias("id"), F.concat(F.lit("L"), _k("s_suppkey")).alias("label"), F.col("s_name").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("synonyms"), F.array(F.lit("SO:1")).alias("types"), cid("NCBITaxon", "s_nationkey").alias("taxon"),
        none.alias("encoded_by"), none.alias("parents"), none.alias("members"), F.array(F.lit("X:1")).alias("xrefs"), F.array(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value"))).alias("properties"),
    )
    return W.gpi(rows).union(W.gpi(rows, "1.2"))


@query("""SELECT '{"subject":"CUST:' || c_custkey || '","label":"' || c_name || '"}' AS value FROM customer""")
def json_lines(spark, d):
    return W.as_json(table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("subject"), F.col("c_name").alias("label")))


@query(f"WITH {LINES} SELECT row_id FROM lines WHERE evidence NOT IN ('IEA', 'ND')")
def lines_without_evidence(spark, d):
    return W.without_evidence(annotation_lines(spark, d), ["IEA", "ND"]).select("row_id")


@query("SELECT 0 AS part, '!head' AS value UNION ALL SELECT 1, '!more' UNION ALL SELECT 0, 'S' || s_suppkey FROM supplier UNION ALL SELECT 1, 'C' || c_custkey FROM customer")
def lines_merged(spark, d):
    one = W.with_header(table(spark, d, "supplier").select(F.concat(F.lit("S"), _k("s_suppkey")).alias("value")), ["!head"])
    two = W.with_header(table(spark, d, "customer").select(F.concat(F.lit("C"), _k("c_custkey")).alias("value")), ["!more", " "])
    return W.merged_lines(one, [two])


@query(f"{E} SELECT '\"' || id || '\" [label=\"' || label || '\"];' AS value FROM nodes UNION ALL SELECT '\"' || sub || '\" -> \"' || obj || '\" [label=\"' || pred || '\"];' FROM e")
def dot_lines(spark, d):
    return W.dot(product(spark, d))


@query(f"{E} SELECT id || ' ' || label AS value FROM nodes")
def name_lines(spark, d):
    return W.names(product(spark, d))


@query(f"""{E} SELECT 'nodes' AS list, '{{"id":"' || id || '","lbl":"' || label || '","type":"CLASS"}}' AS value FROM nodes UNION ALL SELECT 'edges', '{{"sub":"' || sub || '","pred":"' || pred || '","obj":"' || obj || '"}}' FROM e""")
def obograph_lines(spark, d):
    return W.obograph(product(spark, d))


@query(f"""{E}, s AS (SELECT sub AS id, string_agg(CASE WHEN pred = 'subClassOf' THEN 'is_a: ' || obj || ' ! ' || label END, chr(10) ORDER BY 'is_a: ' || obj || ' ! ' || label) AS isa, string_agg(CASE WHEN pred <> 'subClassOf' THEN 'relationship: ' || pred || ' ' || obj || ' ! ' || label END, chr(10) ORDER BY obj) AS rel FROM e JOIN nodes o ON o.id = obj GROUP BY sub)
  SELECT nodes.id, concat_ws(chr(10), '[Term]', 'id: ' || nodes.id, 'name: ' || label, isa, rel, '') AS value FROM nodes LEFT JOIN s ON s.id = nodes.id""")
def obo_lines(spark, d):
    return W.obo(product(spark, d))


@query(f"""{E}, n AS (SELECT * FROM e WHERE sub LIKE 'NATION:%' OR sub LIKE 'REGION:%')
  SELECT '* WORLD:0 ! WORLD:0' AS value UNION ALL SELECT '  % ' || sub || ' ! ' || sub FROM n WHERE obj = 'WORLD:0' UNION ALL SELECT '    % ' || sub || ' ! ' || sub FROM n WHERE obj LIKE 'REGION:%'""")
def tree_lines(spark, d):
    onto = product(spark, d)
    return W.tree(onto.subgraph(onto.nodes.filter("id like 'NATION:%' or id like 'REGION:%' or id = 'WORLD:0'").select("id"))).select("value")


# --- lexical mapping, beyond the pairs


@query("SELECT p_partkey AS id, round(log2(x / (1 - x)), 8)::DOUBLE AS w, round(1 / (1 + pow(2.0, -(p_size / 10.0))), 8)::DOUBLE AS p FROM (SELECT *, (p_size + 1) / 100.0 AS x FROM part)")
def lex_logit(spark, d):
    x = (F.col("p_size") + 1) / 100.0
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(text.logit(x), 8).alias("w"), F.round(text.inv_logit(F.col("p_size") / 10.0), 8).alias("p"))


@query("SELECT 'PART:' || p_partkey AS id, 'PART' AS ont, p_name AS val, 'label' AS scope FROM part WHERE p_size >= 10 UNION ALL SELECT 'PART:' || p_partkey, 'PART', p_type, 'exact' FROM part WHERE p_size >= 10")
def lex_terms(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(cid("PART", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("CLASS").alias("type"), (F.col("p_size") < 10).alias("deprecated"))
    onto = Ontology(nodes, product(spark, d).edges, synonyms=p.select(cid("PART", "p_partkey").alias("id"), F.col("p_type").alias("val"), F.lit("exact").alias("scope")))
    return L.terms_of(onto)


MAPPED = "m AS (SELECT 'CUST:' || c_custkey AS a, 'SUPP:' || (c_custkey % 40) AS b FROM customer)"


def _mapping(spark, d):
    return table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("a"), cid("SUPP", F.col("c_custkey") % 40).alias("b"), F.lit("CUST").alias("oa"), F.lit("SUPP").alias("ob"), F.lit(80).alias("score"))


@query(f"WITH {MAPPED}, u AS (SELECT a AS id, b AS t FROM m UNION SELECT b, a FROM m) SELECT id, regexp_extract(t, '^(.*):', 1) AS prefix, string_agg(t, '|' ORDER BY t) AS mapped FROM u GROUP BY ALL")
def lex_grouped(spark, d):
    return L.grouped(_mapping(spark, d)).withColumn("mapped", F.array_join("mapped", "|"))


@query(f"""WITH {MAPPED}, x AS (SELECT 'CUST:' || c_custkey AS id, 'SUPP:' || (c_custkey % 20) AS xref FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'SUPP:' || s_suppkey, 'CUST:' || s_suppkey FROM supplier)
  SELECT a, b, NOT EXISTS (SELECT 1 FROM x WHERE id = a AND xref LIKE 'SUPP:%') AS left_novel, NOT EXISTS (SELECT 1 FROM x WHERE id = a AND xref LIKE 'SUPP:%') OR EXISTS (SELECT 1 FROM x WHERE id = a AND xref = b) AS left_consistent,
  NOT EXISTS (SELECT 1 FROM x WHERE id = b AND xref LIKE 'CUST:%') AS right_novel, NOT EXISTS (SELECT 1 FROM x WHERE id = b AND xref LIKE 'CUST:%') OR EXISTS (SELECT 1 FROM x WHERE id = b AND xref = a) AS right_consistent FROM m""")
def lex_curated(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    xrefs = c.filter("c_custkey % 3 = 0").select(cid("CUST", "c_custkey").alias("id"), cid("SUPP", F.col("c_custkey") % 20).alias("xref")).union(s.select(cid("SUPP", "s_suppkey"), cid("CUST", "s_suppkey")))
    return L.curated(_mapping(spark, d).select("a", "b"), xrefs)


@query(f"""WITH {MAPPED}, k AS (SELECT a, b, CASE WHEN count(*) OVER (PARTITION BY b) > 1 THEN 'm' ELSE '1' END || CASE WHEN count(*) OVER (PARTITION BY a) > 1 THEN 'm' ELSE '1' END AS card FROM m),
  o AS (SELECT a, b, CASE card WHEN '11' THEN 0.0 WHEN '1m' THEN 0.6 WHEN 'm1' THEN 0.4 ELSE 0.2 END + (SELECT count(*) FROM m m2 WHERE m2.b = k.b AND m2.a = 'CUST:' || (split_part(k.a, ':', 2)::BIGINT + 40)) AS s1,
    CASE card WHEN '11' THEN 0.0 WHEN '1m' THEN 0.4 WHEN 'm1' THEN 0.6 ELSE 0.2 END + (SELECT count(*) FROM m m2 WHERE m2.b = k.b AND m2.a = 'CUST:' || (split_part(k.a, ':', 2)::BIGINT - 40)) AS s2, CASE card WHEN '11' THEN 2.5 ELSE 1.5 END AS s3, CASE card WHEN 'mm' THEN 0.4 ELSE -0.1 END AS s4 FROM k),
  c AS (SELECT a, b, 1 / (1 + pow(2, -s1)) AS c1, 1 / (1 + pow(2, -s2)) AS c2, 1 / (1 + pow(2, -s3)) AS c3, 1 / (1 + pow(2, -s4)) AS c4 FROM o)
  SELECT a, b, round(c1 / (c1 + c2 + c3 + c4), 8)::DOUBLE AS sub, round(c2 / (c1 + c2 + c3 + c4), 8)::DOUBLE AS super, round(c3 / (c1 + c2 + c3 + c4), 8)::DOUBLE AS equal, round(c4 / (c1 + c2 + c3 + c4), 8)::DOUBLE AS other FROM c""")
def lex_axiom_weights(spark, d):
    closed = table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("term"), cid("CUST", F.col("c_custkey") + 40).alias("anc"))
    made = L.axiom_weights(_mapping(spark, d), closed)
    return made.select("a", "b", *(F.round(F.col("pr")[i], 8).alias(n) for i, n in enumerate(("sub", "super", "equal", "other"))))


@query(f"""WITH {MAPPED}, cl AS (SELECT 'CUST:' || c_custkey AS n, 'CUST:' || (c_custkey + 40) AS m FROM customer), bl AS (SELECT n, m FROM cl UNION SELECT m, n FROM cl),
  bo AS (SELECT a, b, 'SUPP' AS ob FROM m UNION SELECT b, a, 'CUST' FROM m), re AS (SELECT DISTINCT x.a, x.b, y.b AS x FROM bo x JOIN bl ON bl.n = x.a JOIN bo y ON y.a = bl.m AND y.ob = x.ob),
  s AS (SELECT r.a, r.b, (1 + count(i.m)) / (1 + count(*)) AS s FROM re r LEFT JOIN bl i ON i.n = r.b AND i.m = r.x GROUP BY ALL)
  SELECT m.a, m.b, round(80 * (1 - (1 - coalesce(p.s, 1)) * (1 - coalesce(q.s, 1))), 8)::DOUBLE AS score FROM m LEFT JOIN s p ON p.a = m.a AND p.b = m.b LEFT JOIN s q ON q.a = m.b AND q.b = m.a""")
def lex_semantic_factor(spark, d):
    closed = table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("term"), cid("CUST", F.col("c_custkey") + 40).alias("anc"))
    return L.semantic_factor(_mapping(spark, d), closed).select("a", "b", F.round("score", 8).alias("score"))
