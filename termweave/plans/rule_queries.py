"""Queries over the quality rules (RUL-*, INF-*): annotations made from line items, over a small invented ontology.

Every rule fails and passes: terms, evidence, relations, taxa, references, with/from, extensions and types vary independently.
The SQL states what each term is, so that the closures, flags and repairs are compared and not only the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as U
from ..operators.ontology import IS_A, PART_OF, Ontology
from .derived import _once, table
from .registry import query

#: id, aspect, subsets of the terms that annotations take in turn; None: no branch. One more isn't in the ontology.
TERMS = [
    ("GO:0008150", "P", []), ("GO:0003674", "F", []), ("GO:0005575", "C", []), ("GO:0005488", "F", []), ("GO:0005515", "F", []), ("GO:0003824", "F", []),
    ("GO:1000001", "F", []), ("GO:1000002", "F", []), ("GO:1000003", "F", []), ("GO:0032840", "F", []), ("GO:1000004", "C", []), ("GO:0032991", "C", []),
    ("GO:1000006", "P", []), ("GO:1000007", "P", []), ("GO:1000008", "C", []), ("GO:1000009", "C", []), ("GO:1000010", "C", []), ("GO:1000011", "C", []),
    ("GO:1000012", "P", [U.NOT_ANNOTATE]), ("GO:1000013", "P", [U.NOT_MANUAL]), ("GO:1000014", "F", [U.CANDIDATE]), ("GO:1000015", None, []), ("GO:0042803", "F", []), ("GO:1000016", "C", []),
]
LINKS = [
    ("GO:1000001", IS_A, "GO:0003824"), ("GO:1000002", PART_OF, "GO:0003824"), ("GO:1000003", IS_A, "GO:0051260"), ("GO:1000004", IS_A, "GO:1000005"), ("GO:1000005", IS_A, "GO:0032991"),
    ("GO:1000006", PART_OF, "GO:0044419"), ("GO:1000007", IS_A, "GO:0043903"), ("GO:1000008", PART_OF, "GO:0018995"), ("GO:1000009", IS_A, "GO:0110165"), ("GO:1000010", IS_A, "GO:0044423"),
    ("GO:1000011", PART_OF, "GO:0110165"), ("GO:1000016", IS_A, "GO:0018995"), ("GO:1000007", IS_A, "GO:0008150"), ("GO:1000012", IS_A, "GO:0008150"), ("GO:1000013", IS_A, "GO:0008150"),
]
EVIDENCE = ["EXP", "IDA", "IPI", "IMP", "IEP", "HEP", "ISS", "ISO", "ISA", "ISM", "IGC", "IBA", "IKR", "RCA", "TAS", "IC", "ND", "IEA"]
RELATIONS = ["enables", "contributes_to", "involved_in", "acts_upstream_of", "part_of", "located_in", "is_active_in", "colocalizes_with", "RO:0002327", "BFO:0000050", "RO:0001025", "has_x"]
UNITS = "array<array<struct<relation:string,term:string>>>"
AS_OF = "1999-01-01"


def _ontology(spark, d) -> Ontology:
    return _once("ruled", spark, d, lambda: Ontology.of_edges(spark.createDataFrame(LINKS, "sub string, pred string, obj string")))


def _pick(values, number):
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def _annotations(spark, d):
    l = table(spark, d, "lineitem")
    ok, pk, sk, ln = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    disc, tax, qty = (F.round(F.col(c)).cast("long") for c in ("disc", "tax", "l_quantity"))
    l = l.withColumns({"disc": F.col("l_discount") * 100, "tax": F.col("l_tax") * 100})
    term = F.coalesce(_pick([t for t, _, _ in TERMS], pk % 25), F.lit("PART:0"))
    subject = F.concat(F.when(sk % 5 == 0, "ComplexPortal:").otherwise("SUPP:"), sk.cast("string"))
    lists = lambda *xs: F.array(*(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in ys)) for ys in xs))
    none = F.array().cast("array<array<string>>")
    w = (ln + F.expr("l_partkey div 25")) % 6
    with_from = F.when(w == 1, lists(["GO:1000001"])).when(w == 2, lists([subject], ["X:1"])).when(w == 3, lists(["X:1", "GO:0005488"])).when(w == 4, lists([term])).when(w == 5, lists(["X:1"], ["Y:2"])).otherwise(none)
    refs = F.get(F.array(*(F.array(*map(F.lit, r)) for r in (["PMID:1"], ["GO_REF:0000033"], ["GO_REF:0000118"], ["GO_REF:0000002"], ["PMID:5", "PMID:6"], ["GO_REF:0000104", "PMID:7"], ["PMID:8"]))), F.expr("cast(l_orderkey div 18 % 7 as int)"))
    taxa = F.get(F.array(*(F.array(*(F.lit(f"NCBITaxon:{t}") for t in ts)) for ts in ([1], [1, 1], [1, 2], [9606]))), (disc % 4).cast("int"))
    unit = lambda r, t: F.struct(F.lit(r).alias("relation"), F.lit(t).alias("term"))
    two = F.array(F.array(unit("part_of", "CL:1"), unit("part_of", "CL:2")), F.array(unit("occurs_in", "UBERON:1")))
    one = F.array(F.array(unit("part_of", "CL:1")), F.array(unit("happens_in", "CL:1")))
    ext = F.when(F.col("l_returnflag") == "A", F.array().cast(UNITS)).when(F.col("l_returnflag") == "R", two).otherwise(one)
    return l.select(
        (ok * 10 + ln).alias("row_id"), subject.alias("subject"), _pick(["gene", "protein_complex", "GO:0032991", ""], F.expr("l_suppkey div 5 % 4")).alias("subject_type"), taxa.alias("taxa"), _pick(RELATIONS, qty % 12).alias("relation"),
        term.alias("term"), _pick("PFC", tax % 3).alias("aspect"), (sk % 4 == 0).alias("negated"), _pick(EVIDENCE, ok % 18).alias("evidence"), refs.alias("references"), with_from.alias("with_from"), ext.alias("extensions"),
        _pick(["GO_Central", "GOC", "TST"], F.expr("l_suppkey div 2 % 3")).alias("assigned_by"), F.to_date("l_shipdate").alias("date"), (pk % 7 == 0).alias("taxon_problem"),
    )


def _rules(paint: bool):
    return U.standard_rules(AS_OF, ["PMID:1"], ["GO_REF:0000002"], ["NCBITaxon:9606"], {"GO_REF:0000104": ["IEA", "ISS"]}, paint)


def _patterns(spark):
    return spark.createDataFrame([("part_of", ["CL"], ["GO:0008150"], 1), ("occurs_in", ["CL", "UBERON"], ["GO:0110165"], None)], "relation string, namespaces array<string>, primary_root_terms array<string>, cardinality int")


def _checked(spark, d, paint: bool = False):
    onto = _ontology(spark, d)
    terms = spark.createDataFrame(TERMS, "id string, aspect string, subsets array<string>")
    closed, wide = onto.reflexive_closure([IS_A]), onto.reflexive_closure([IS_A, PART_OF])
    flagged = U.with_flags(_annotations(spark, d), closed, terms, wide, constraints=U.constraint_closure(_patterns(spark), closed))
    return U.run(flagged, _rules(paint), contexts=["import"])


def _messages(spark, d, paint: bool = False):
    return U.messages(_checked(spark, d, paint), _rules(paint), contexts=["import"])


def _sql(paint: bool) -> str:
    """What the rules find, from what is stated about each term's number t."""
    ids = ", ".join(f"'{t}'" for t, _, _ in TERMS)
    aspects = ", ".join("NULL" if a is None else f"'{a}'" for _, a, _ in TERMS)
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    failed = [
        (2, "t IN (3, 4) AND negated", "ERROR"), (5, "t IN (3, 4) AND ev IN ('IEA', 'ISS', 'ISO', 'ISM', 'ISA', 'IBA', 'RCA')", "WARNING"), (6, "ev IN ('IEP', 'HEP') AND assigned <> 'GOC' AND ta IS DISTINCT FROM 'P'", "ERROR"),
        (7, "ev = 'IPI' AND t IN (5, 6)", "WARNING"), (8, "t = 18 OR (t = 19 AND ev <> 'IEA')", "WARNING"), (11, "(ev = 'ND') <> (t < 3)", "ERROR"), (15, "tx IN (1, 2) AND (t NOT IN (12, 13, 23) OR tx = 1)", "WARNING"),
        (16, "ev = 'IC' AND NOT (t < 24 AND ((w = 1 AND t <> 6) OR (w = 3 AND t <> 3)))", "WARNING"), (17, "ev = 'IDA' AND w <> 0", "WARNING"), (18, "ev = 'IPI' AND w = 0", "WARNING"), (22, "ref = 0", "ERROR"),
        (26, "false" if paint else "ev = 'IBA'", "ERROR"), (28, "ta IS NOT NULL AND aspect <> ta", "WARNING"), (29, "ev = 'IEA' AND age > 365", None), (30, "ref = 3", "WARNING"),
        (37, "ev = 'IBA' AND NOT (assigned = 'GO_Central' AND ref = 1)", "ERROR"), (39, "t IN (10, 11) AND ((l_suppkey % 5 = 0 AND kind <> 3) OR kind IN (1, 2))", "ERROR"), (42, "ev = 'IKR' AND NOT negated", "ERROR"),
        (43, "ref = 5 AND ev NOT IN ('IEA', 'ISS')", "WARNING"), (46, "t IN (8, 9, 22) AND w <> 2", "WARNING"), (50, "ev IN ('ISS', 'ISA', 'ISO') AND w = 2", "WARNING"), (55, "ref = 4", "WARNING"), (58, "l_returnflag <> 'A'", "WARNING"),
        (61, "right_rel <> rel", "WARNING"), (63, "ev IN ('ISS', 'ISA', 'ISO') AND w = 0", "WARNING"), (64, "ev = 'IEA' AND ref = 2 AND tx = 3", "ERROR"), (65, "t = 20", "WARNING"), (13, "l_partkey % 7 = 0 AND NOT negated", None),
    ]
    levels = {29: "CASE WHEN age > 1095 THEN 'ERROR' ELSE 'WARNING' END", 13: "CASE WHEN ev IN ('IBA', 'IKR', 'IRD', 'IC', 'ISA', 'ISM', 'ISO', 'ISS', 'NAS', 'RCA', 'TAS', 'ND', 'IEA') THEN 'ERROR' ELSE 'WARNING' END"}
    made = ",\n    ".join(f"CASE WHEN {cond} THEN {{'k': {k}, 'rule': {rule}, 'level': {levels[rule] if level is None else repr(level)}}} END" for k, (rule, cond, level) in enumerate(failed))
    fix = lambda label, curie: f"CASE WHEN contains(rel, ':') THEN '{curie}' ELSE '{label}' END"
    return f"""WITH g AS (SELECT *, l_orderkey * 10 + l_linenumber AS row_id, (l_partkey % 25)::INT AS t, [{listed(EVIDENCE)}][(l_orderkey % 18 + 1)::INT] AS ev, l_suppkey % 4 = 0 AS negated, ((l_linenumber + l_partkey // 25) % 6)::INT AS w,
  ['P', 'F', 'C'][(round(l_tax * 100)::BIGINT % 3 + 1)::INT] AS aspect, (round(l_discount * 100)::BIGINT % 4)::INT AS tx, (l_orderkey // 18 % 7)::INT AS ref, (l_suppkey // 5 % 4)::INT AS kind,
  ['GO_Central', 'GOC', 'TST'][(l_suppkey // 2 % 3 + 1)::INT] AS assigned, [{listed(RELATIONS)}][(round(l_quantity)::BIGINT % 12 + 1)::INT] AS rel, date_diff('day', l_shipdate::DATE, DATE '{AS_OF}') AS age FROM lineitem),
  h AS (SELECT *, [{ids}, 'PART:0'][t + 1] AS term, [{aspects}, NULL][t + 1] AS ta, CASE rel WHEN 'RO:0002327' THEN 'enables' WHEN 'BFO:0000050' THEN 'part_of' WHEN 'RO:0001025' THEN 'located_in' ELSE rel END AS label FROM g),
  r AS (SELECT *, CASE WHEN t = 1 THEN CASE WHEN label = 'enables' THEN rel ELSE {fix('enables', 'RO:0002327')} END WHEN t = 0 THEN CASE WHEN label = 'involved_in' THEN rel ELSE {fix('involved_in', 'RO:0002331')} END
    WHEN t = 2 THEN CASE WHEN label = 'is_active_in' THEN rel ELSE {fix('is_active_in', 'RO:0002432')} END WHEN ta = 'F' THEN CASE WHEN label IN ('enables', 'contributes_to') THEN rel ELSE {fix('enables', 'RO:0002327')} END
    WHEN ta = 'P' THEN CASE WHEN label IN ('involved_in', 'acts_upstream_of') THEN rel ELSE {fix('acts_upstream_of_or_within', 'RO:0002264')} END WHEN t IN (10, 11) THEN CASE WHEN label = 'part_of' THEN rel ELSE {fix('part_of', 'BFO:0000050')} END
    WHEN t IN (15, 16) THEN CASE WHEN label IN ('located_in', 'is_active_in', 'colocalizes_with') THEN rel ELSE {fix('located_in', 'RO:0001025')} END ELSE rel END AS right_rel FROM h),
  f AS (SELECT *, list_filter([{made}], lambda x: x IS NOT NULL) AS found FROM r),
  s AS (SELECT *, list_min(list_transform(list_filter(found, lambda x: x.level = 'ERROR'), lambda x: x.k)) AS stop FROM f),
  kept AS (SELECT row_id, unnest(list_filter(found, lambda x: stop IS NULL OR x.k <= stop)) AS m, stop FROM s)"""


@query(f"{_sql(False)} SELECT row_id, m.rule AS rule, m.level AS level FROM kept")
def rules_results(spark, d):
    return _messages(spark, d).select("row_id", "rule", "level")


@query(f"{_sql(True)} SELECT row_id, m.rule AS rule, m.level AS level FROM kept")
def rules_results_phylogenetic(spark, d):
    return _messages(spark, d, True).select("row_id", "rule", "level")


@query(f"{_sql(False)} SELECT row_id, coalesce(list_filter(found, lambda x: x.k = stop)[1].rule, 0) AS rule FROM s")
def rules_first_error(spark, d):
    first = F.get(F.filter("results", lambda x: x["level"] == U.HARD), F.lit(0))["rule"]
    return _checked(spark, d).select("row_id", F.coalesce(first, F.lit(0)).alias("rule"))


@query(f"""{_sql(False)} SELECT row_id, coalesce(ta, aspect) AS aspect, right_rel AS relation,
  CASE WHEN l_returnflag = 'R' AND t = 15 THEN 'occurs_in(UBERON:1)' WHEN l_returnflag NOT IN ('A', 'R') AND t IN (0, 13, 18, 19) THEN 'part_of(CL:1)' ELSE '' END AS extensions FROM s""")
def rules_repair(spark, d):
    shown = F.array_join(F.transform(F.flatten("extensions"), lambda u: F.concat(u["relation"], F.lit("("), u["term"], F.lit(")"))), "|")
    return _checked(spark, d).select("row_id", "aspect", "relation", shown.alias("extensions"))


@query(f"{_sql(False)} SELECT m.rule AS rule, m.level AS level, count(*)::BIGINT AS n FROM kept GROUP BY ALL")
def report_counts(spark, d):
    return U.report_counts(_messages(spark, d))


@query(f"{_sql(False)} SELECT row_id, m.rule AS rule FROM kept QUALIFY row_number() OVER (PARTITION BY m.rule ORDER BY row_id) <= 100")
def report_capped(spark, d):
    return U.capped(_messages(spark, d), 100).select("row_id", "rule")


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id, (l_partkey % 25)::INT IN (3, 4) AND l_returnflag = 'A' AS failed FROM lineitem""")
def rule_extension_needed(spark, d):
    rows = _annotations(spark, d)
    flagged = U.with_flags(rows, _ontology(spark, d).reflexive_closure([IS_A]), spark.createDataFrame(TERMS, "id string, aspect string, subsets array<string>"))
    return U.run(flagged, [U.extension_rule()]).select("row_id", (F.col("failures") != 0).alias("failed"))


@query("""SELECT 'part_of' AS relation, 'GO:0008150|GO:1000007|GO:1000012|GO:1000013' AS terms UNION ALL SELECT 'occurs_in', 'GO:0110165|GO:1000009'""")
def rule_constraint_closure(spark, d):
    return U.constraint_closure(_patterns(spark), _ontology(spark, d).reflexive_closure([IS_A])).select("relation", F.array_join("terms", "|").alias("terms"))


#: Each annotation is a case of rule 17: those of IDA with something in with/from fail, others pass.
@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey % 18 = 1 AND (l_linenumber + l_partkey // 25) % 6 <> 0 AND NOT (l_suppkey % 4 = 0 AND l_partkey % 25 IN (3, 4)) AND l_partkey % 25 > 2 AS ok FROM lineitem""")
def rule_examples(spark, d):
    cases = U.with_flags(_annotations(spark, d), _ontology(spark, d).reflexive_closure([IS_A]), spark.createDataFrame(TERMS, "id string, aspect string, subsets array<string>"))
    return U.examples(cases.withColumns({"rule_id": F.lit(17), "kind": F.lit("fail")}), U.standard_rules(AS_OF)).select("row_id", "ok")


# --- inferences: the table says something of every third combination of term and taxon

INFERENCES = """k AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS row_id, 'SUPP:' || l_suppkey AS subject, l_partkey % 25 AS t, l_suppkey % 6 AS x, l_returnflag AS flag FROM lineitem)"""


def _inferred(spark, d):
    unit = lambda r, t: F.struct(F.lit(r).alias("relation"), F.lit(t).alias("term"))
    l = table(spark, d, "lineitem")
    ext = F.when(F.col("l_returnflag") == "A", F.array().cast(UNITS)).otherwise(F.array(F.array(unit("part_of", "CL:1"), unit("occurs_in", "CL:2")), F.array(unit("part_of", "CL:9"))))
    row_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    rows = l.select(row_id.alias("row_id"), F.concat(F.lit("SUPP:"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("involved_in").alias("relation"), F.concat(F.lit("GO:"), (F.col("l_partkey") % 25).cast("string")).alias("term"), F.array(F.concat(F.lit("T:"), (F.col("l_suppkey") % 6).cast("string"))).alias("taxa"), F.lit("IDA").alias("evidence"), ext.alias("extensions"))
    said = [(t, x) for t in range(25) for x in range(6) if (t + x) % 3 == 0]
    units = "array<struct<relation:string,term:string>>"
    # of even taxa without an extension; of the others with the two units in another order
    base = spark.createDataFrame([(f"GO:{t}", f"T:{x}", [] if x % 2 == 0 else [("occurs_in", "CL:2"), ("part_of", "CL:1")], t % 2 == 0, t % 4 == 1, [("RO:0002331", f"GO:{t + 100}")]) for t, x in said], f"term string, taxon string, units {units}, satisfiable boolean, taxon_problem boolean, inferences {units}")
    key = U.inference_key(F.lit("involved_in"), F.col("term"), F.col("taxon"), F.col("units"))
    return U.infer(rows, base.select(key.alias("key"), "satisfiable", "taxon_problem", "inferences"))


@query(f"WITH {INFERENCES} SELECT row_id, (t + x) % 3 = 0 AND ((x % 2 = 0) = (flag = 'A')) AND t % 4 = 1 AS taxon_problem FROM k")
def inference_lookup(spark, d):
    return _inferred(spark, d)[0].select("row_id", "taxon_problem")


@query(f"WITH {INFERENCES} SELECT DISTINCT row_id, subject, 'GO:' || (t + 100) AS term, 'P' AS aspect FROM k WHERE (t + x) % 3 = 0 AND ((x % 2 = 0) = (flag = 'A')) AND t % 2 = 0")
def inference_annotations(spark, d):
    return _inferred(spark, d)[1].select("row_id", "subject", "term", "aspect")
