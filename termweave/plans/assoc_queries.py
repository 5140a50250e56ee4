"""Queries over associations: ASC-*, GLR-*, SIM-*, RDF-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assoc as A
from ..operators import search as G
from ..operators import similarity as S
from ..operators import triples as R

from .derived import ASSOC, CLOSURE, DEEP, EDGES, INFERRED, REFLEXIVE, SUPPLIED, cid, customers, deep, product, sql, suppliers, table
from .registry import query

I = sql(EDGES, CLOSURE, ASSOC, INFERRED)
IR = sql(EDGES, CLOSURE, REFLEXIVE, ASSOC, INFERRED)
SUP = sql(EDGES, CLOSURE, SUPPLIED)
BRANDS = [f"BRAND:Brand#{k}" for k in range(1, 6)]
TYPES = ["TYPE:MEDIUM", "TYPE:SMALL", "TYPE:LARGE"]


def _r(c, digits: int = 8):
    return F.round(c, digits)


@query(f"{I} SELECT subject, term FROM i")
def assoc_inferred(spark, d):
    return customers(spark, d).inferred


@query(f"""{I} SELECT 'CUST:' || c_custkey AS subject FROM customer s WHERE (SELECT count(*) FROM i WHERE subject = 'CUST:' || c_custkey AND term IN ('TYPE:MEDIUM', 'BRAND:Brand#4')) = 2
  AND NOT EXISTS (SELECT 1 FROM i WHERE subject = 'CUST:' || c_custkey AND term = 'SIZE:2')""")
def assoc_boolean_query(spark, d):
    return customers(spark, d).query(["TYPE:MEDIUM", "BRAND:Brand#4"], ["SIZE:2"])


@query(f"""{I}, t AS (SELECT 'REGION:1' AS id UNION SELECT term FROM c WHERE anc = 'REGION:1') SELECT subject, object FROM a WHERE subject IN (SELECT id FROM t)""")
def assoc_query_inferred_subjects(spark, d):
    return customers(spark, d).under(["REGION:1"])


@query(f"""{I}, x AS (SELECT unnest({BRANDS}) AS x), y AS (SELECT unnest({TYPES}) AS y),
  s AS (SELECT p.term AS x, q.term AS y, count(*) AS c FROM i p JOIN i q USING (subject) WHERE p.term IN (SELECT x FROM x) AND q.term IN (SELECT y FROM y) GROUP BY ALL), n AS (SELECT term, count(*) AS n FROM i GROUP BY term)
  SELECT x, y, coalesce(c, 0)::BIGINT AS c, round(CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c, 0) > 0 THEN coalesce(c, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c, 0)) ELSE 0 END, 8)::DOUBLE AS j
  FROM x CROSS JOIN y LEFT JOIN s USING (x, y) LEFT JOIN n a ON a.term = x LEFT JOIN n b ON b.term = y""")
def assoc_intersections(spark, d):
    return customers(spark, d).intersections(BRANDS, TYPES).withColumn("j", _r("j"))


@query(f"""{I}, s AS (SELECT subject, {', '.join(f"max((term = '{t}')::INT)::INT AS \"{t}\"" for t in TYPES)} FROM i GROUP BY subject) SELECT * FROM s""")
def assoc_matrix_pivot(spark, d):
    return customers(spark, d).matrix(TYPES)


PAIRS = "pr AS (SELECT 'CUST:' || c_custkey AS a, 'CUST:' || (c_custkey + 1) AS b FROM customer)"
JACCARD = "n AS (SELECT subject, count(*) AS n FROM i GROUP BY subject), cc AS (SELECT p.a, p.b, count(*) AS c FROM (SELECT DISTINCT a, b FROM pr) p JOIN i x ON x.subject = p.a JOIN i y ON y.subject = p.b AND x.term = y.term GROUP BY ALL)"


def _pairs(spark, d):
    return table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("a"), cid("CUST", F.col("c_custkey") + 1).alias("b"))


@query(f"""{I}, {PAIRS}, {JACCARD} SELECT pr.a, pr.b, round(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c, 0) > 0 THEN coalesce(c, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c, 0)) ELSE 0 END, 8)::DOUBLE AS j
  FROM pr LEFT JOIN cc USING (a, b) LEFT JOIN n x ON x.subject = pr.a LEFT JOIN n y ON y.subject = pr.b""")
def sim_jaccard(spark, d):
    return customers(spark, d).jaccard(_pairs(spark, d)).withColumn("j", _r("j"))


@query(f"""{I}, {PAIRS}, {JACCARD} SELECT p.a, p.b, round(coalesce(c / sqrt(x.n * y.n), 0), 8)::DOUBLE AS cosine FROM (SELECT DISTINCT a, b FROM pr) p LEFT JOIN cc USING (a, b) LEFT JOIN n x ON x.subject = p.a LEFT JOIN n y ON y.subject = p.b""")
def sim_cosine_binary(spark, d):
    return S.cosine_binary(customers(spark, d), _pairs(spark, d)).withColumn("cosine", _r("cosine"))


SIMILAR = f"""{SUP}, n AS (SELECT subject, count(*) AS n FROM i2 GROUP BY subject), cc AS (SELECT x.subject AS a, y.subject AS b, count(*) AS c FROM i2 x JOIN i2 y ON x.term = y.term AND x.subject < y.subject GROUP BY ALL)
  SELECT a, b, c::BIGINT AS c, round(c / (p.n + q.n - c), 8)::DOUBLE AS j FROM cc JOIN n p ON p.subject = a JOIN n q ON q.subject = b"""


def _similar(spark, d, most_common):
    s = suppliers(spark, d)
    return s.similar_subjects(s.subjects, most_common, 8)


@query(SIMILAR)
def assoc_similarity_matrix(spark, d):
    return _similar(spark, d, 1.0)


@query(SIMILAR)
def assoc_similarity_half_common(spark, d):
    return _similar(spark, d, 0.5)


@query(SIMILAR)
def assoc_similarity_none_common(spark, d):
    return _similar(spark, d, 2.0)


def _fisher_sql(side: str) -> str:
    points = "exp(lgamma(a+b+1)+lgamma(cc+d+1)+lgamma(a+cc+1)+lgamma(b+d+1)-lgamma(a+b+cc+d+1)-lgamma(k+1)-lgamma(a+b-k+1)-lgamma(a+cc-k+1)-lgamma(d-a+k+1))"
    cond = {"greater": "k >= a", "less": "k <= a", "two-sided": "p <= p0 * (1 + 1e-7)"}[side]
    return f"""{I}, smp AS (SELECT 'CUST:' || c_custkey AS subject FROM customer WHERE c_mktsegment = 'BUILDING'), bg AS (SELECT 'CUST:' || c_custkey AS subject FROM customer),
  cnt AS (SELECT term, count(*) AS bg_count, count(*) FILTER (WHERE subject IN (SELECT subject FROM smp)) AS sample_count FROM i WHERE term LIKE 'BRAND:%' OR term LIKE 'TYPE:%' OR term LIKE 'SIZE:%' GROUP BY term),
  h AS (SELECT * FROM cnt WHERE bg_count > 1 AND sample_count > 0), sz AS (SELECT (SELECT count(*) FROM smp) AS ns, (SELECT count(*) FROM bg) AS nb, (SELECT count(*) FROM h) AS m),
  t AS (SELECT term, sample_count, bg_count, m, sample_count AS a, ns - sample_count AS b, bg_count - sample_count AS cc, nb - bg_count - ns + sample_count AS d FROM h CROSS JOIN sz),
  k AS (SELECT *, unnest(generate_series(greatest(0, a - d), least(a + b, a + cc))) AS k FROM t), pk AS (SELECT *, {points} AS p FROM k), p0 AS (SELECT term, p AS p0 FROM pk WHERE k = a)
  SELECT term, sample_count::BIGINT AS sample_count, bg_count::BIGINT AS bg_count, round(least(1, sum(p) FILTER (WHERE {cond})), 8)::DOUBLE AS p FROM pk JOIN p0 USING (term) GROUP BY term, sample_count, bg_count, m HAVING least(1, least(1, sum(p) FILTER (WHERE {cond})) * m) < 2"""


def _enrichment(spark, d, side):
    s = customers(spark, d)
    sample = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(cid("CUST", "c_custkey").alias("subject"))
    some = s.term_counts.filter("term like 'BRAND:%' or term like 'TYPE:%' or term like 'SIZE:%'").select("term")
    return s.enrichment(sample, hypotheses=some, threshold=2.0, side=side).filter("sample_count > 0").select("term", "sample_count", "bg_count", _r("p").alias("p"))


@query(_fisher_sql("greater"))
def assoc_enrichment_greater(spark, d):
    return _enrichment(spark, d, "greater")


@query(_fisher_sql("less"))
def assoc_enrichment_less(spark, d):
    return _enrichment(spark, d, "less")


@query(_fisher_sql("two-sided"))
def assoc_enrichment_two_sided(spark, d):
    return _enrichment(spark, d, "two-sided")


def _fisher_all_sql(side: str) -> str:
    """The same over every inferred term, with the Bonferroni factor of all of them."""
    some, end = " WHERE term LIKE 'BRAND:%' OR term LIKE 'TYPE:%' OR term LIKE 'SIZE:%'", " HAVING "
    head, p = _fisher_sql(side).replace(some, "").split(end)[0], "least(1, sum(p) FILTER (WHERE {}))".format({"greater": "k >= a", "less": "k <= a", "two-sided": "p <= p0 * (1 + 1e-7)"}[side])
    return head.replace(f"round({p}, 8)::DOUBLE AS p FROM", f"round({p}, 6)::DOUBLE AS p, round(least(1, {p} * m), 6)::DOUBLE AS p_adjusted FROM")


def _enrichment_all(spark, d, side):
    """Every inferred term is a hypothesis; the queries above take brands, types and sizes."""
    sample = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(cid("CUST", "c_custkey").alias("subject"))
    return customers(spark, d).enrichment(sample, threshold=2.0, side=side).select("term", "sample_count", "bg_count", _r("p", 6).alias("p"), _r("p_adjusted", 6).alias("p_adjusted"))


@query(_fisher_all_sql("greater"))
def assoc_enrichment_all_greater(spark, d):
    return _enrichment_all(spark, d, "greater")


@query(_fisher_all_sql("less"))
def assoc_enrichment_all_less(spark, d):
    return _enrichment_all(spark, d, "less")


@query(_fisher_all_sql("two-sided"))
def assoc_enrichment_all_two_sided(spark, d):
    return _enrichment_all(spark, d, "two-sided")


@query("""WITH o AS (SELECT 'CUST:' || o_custkey AS subject, 'PRIO:' || o_orderpriority AS t1, 'STAT:' || o_orderstatus AS t2 FROM orders), o1 AS (SELECT DISTINCT subject, t1 FROM o), o2 AS (SELECT DISTINCT subject, t2 FROM o),
  nn AS (SELECT count(DISTINCT subject) AS n FROM o), n1 AS (SELECT t1, count(*) AS n1 FROM o1 GROUP BY t1 HAVING count(*) >= 3), n2 AS (SELECT t2, count(*) AS n2 FROM o2 GROUP BY t2 HAVING count(*) > 1)
  SELECT t1 AS class1, t2 AS class2, count(*)::BIGINT AS c, n1::BIGINT AS n1, n2::BIGINT AS n2 FROM o1 JOIN o2 USING (subject) JOIN n1 USING (t1) JOIN n2 USING (t2) GROUP BY ALL""")
def assoc_phenolog(spark, d):
    o = table(spark, d, "orders")
    onto = product(spark, d)
    one = A.AssociationSet(o.select(cid("CUST", "o_custkey").alias("subject"), cid("PRIO", "o_orderpriority").alias("object")).distinct(), onto)
    two = A.AssociationSet(o.select(cid("CUST", "o_custkey").alias("subject"), cid("STAT", "o_orderstatus").alias("object")).distinct(), onto)
    return one.phenolog(two, threshold=2.0).select("class1", "class2", "c", "n1", "n2")


@query("SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def assoc_rollup_summary(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return customers(spark, d).summary(rows, ["flag", "status"]).na.fill("ALL", ["flag", "status"])


@query(f"""{SUP}, b AS (SELECT 'TYPE:MEDIUM' AS id UNION SELECT term FROM c WHERE anc = 'TYPE:MEDIUM'), hit AS (SELECT DISTINCT subject FROM a2 WHERE object IN (SELECT id FROM b))
  SELECT subject, round(1 / (1 + (SELECT count(*) FROM a2 WHERE a2.subject = hit.subject AND object NOT IN (SELECT id FROM b))), 8)::DOUBLE AS score FROM hit""")
def assoc_specificity(spark, d):
    return suppliers(spark, d).specificity("TYPE:MEDIUM").withColumn("score", _r("score"))


@query(f"""{IR}, s AS (SELECT unnest(['TYPE:MEDIUM', 'SBAND:1', 'SBAND:2', 'THING:0']) AS id), m AS (SELECT term AS id, anc AS slim FROM r JOIN s ON anc = s.id),
  t AS (SELECT id, slim FROM m WHERE NOT EXISTS (SELECT 1 FROM m x JOIN c ON c.term = x.slim WHERE x.id = m.id AND c.anc = m.slim)) SELECT DISTINCT subject, slim FROM a JOIN t ON a.object = t.id""")
def assoc_slimmed(spark, d):
    subset = spark.createDataFrame([("TYPE:MEDIUM",), ("SBAND:1",), ("SBAND:2",), ("THING:0",)], "id string")
    return customers(spark, d).slimmed(product(spark, d).slim_map(subset))


# --- faceted search: documents are orders with their customer and parts

DOCS = """docs AS (SELECT 'ORD:' || o_orderkey AS id, 'CUST:' || o_custkey AS subject, 'PART:' || l_partkey AS object, o_orderpriority AS relation, l_returnflag AS evidence, ['TYPE:' || p_type, 'BRAND:' || p_brand] AS object_closure, l_quantity AS quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def _docs(spark, d):
    o, l, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    j = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return j.select(cid("ORD", "o_orderkey").alias("id"), cid("CUST", "o_custkey").alias("subject"), cid("PART", "l_partkey").alias("object"), F.col("o_orderpriority").alias("relation"), F.col("l_returnflag").alias("evidence"), F.array(cid("TYPE", "p_type"), cid("BRAND", "p_brand")).alias("object_closure"), F.col("l_quantity").alias("quantity"))


@query(f"WITH {DOCS} SELECT id, subject, object FROM docs WHERE list_has_any(object_closure, ['TYPE:MEDIUM', 'BRAND:Brand#3']) AND evidence <> 'A' AND relation = '1-URGENT'")
def search_filter(spark, d):
    q = G.AssociationQuery(objects=["TYPE:MEDIUM", "BRAND:Brand#3"], evidence="-A", relation="1-URGENT")
    return q.run(_docs(spark, d)).select("id", "subject", "object")


@query(f"WITH {DOCS}, f AS (SELECT 'evidence' AS facet, evidence AS value FROM docs UNION ALL SELECT 'object_closure', unnest(object_closure) FROM docs), n AS (SELECT facet, value, count(*)::BIGINT AS n FROM f GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 25")
def facet_counts(spark, d):
    return G.facets(_docs(spark, d), ["evidence", "object_closure"])


@query(f"WITH {DOCS} SELECT evidence, relation, count(*)::BIGINT AS n FROM docs GROUP BY ALL")
def facet_pivot(spark, d):
    return G.pivot_facet(_docs(spark, d), "evidence", "relation")


@query(f"WITH {DOCS}, f AS (SELECT subject, unnest(object_closure) AS object_closure FROM docs) SELECT object_closure, count(DISTINCT subject)::BIGINT AS n FROM f GROUP BY ALL")
def facet_unique(spark, d):
    return G.unique_facet(_docs(spark, d), "object_closure", "subject")


@query(f"WITH {DOCS} SELECT 'quantity' AS field, min(quantity)::DOUBLE AS min, max(quantity)::DOUBLE AS max, round(sum(quantity), 4)::DOUBLE AS sum, round(avg(quantity), 6)::DOUBLE AS mean, count(*)::BIGINT AS n, round(stddev_samp(quantity), 6)::DOUBLE AS stddev FROM docs")
def facet_statistics(spark, d):
    return G.field_statistics(_docs(spark, d), ["quantity"]).select("field", "min", "max", _r("sum", 4).alias("sum"), _r("mean", 6).alias("mean"), "n", _r("stddev", 6).alias("stddev"))


@query(f"WITH {DOCS}, u AS (SELECT subject, relation, string_agg(DISTINCT object, '|' ORDER BY object) AS objects FROM docs GROUP BY ALL) SELECT * FROM u")
def assoc_compact(spark, d):
    return G.compact(_docs(spark, d)).withColumn("objects", F.array_join("objects", "|"))


@query(f"WITH {DOCS}, s AS (SELECT subject, object, unnest(list_intersect(object_closure, ['TYPE:MEDIUM', 'BRAND:Brand#3'])) AS slim FROM docs) SELECT subject, slim, string_agg(DISTINCT object, '|' ORDER BY object) AS objects, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def map2slim_grouped(spark, d):
    return G.slim_groups(G.with_slim(_docs(spark, d), ["TYPE:MEDIUM", "BRAND:Brand#3"])).withColumn("objects", F.array_join("objects", "|"))


@query(f"WITH {DOCS} SELECT object AS subject, subject AS object, id FROM docs WHERE object = 'PART:7'")
def assoc_invert(spark, d):
    return G.AssociationQuery(subjects=["PART:7"], subject_direct=True, invert=True).run(_docs(spark, d)).select("subject", "object", "id")


@query(f"WITH {DOCS} SELECT subject AS id, object AS other, relation, false AS flipped FROM docs WHERE subject IN ('CUST:7', 'PART:9') UNION ALL SELECT object, subject, relation, true FROM docs WHERE object IN ('CUST:7', 'PART:9')")
def assoc_either_side(spark, d):
    return G.either_side(_docs(spark, d), ["CUST:7", "PART:9"])


@query(f"WITH {DOCS}, n AS (SELECT object AS value, count(*)::BIGINT AS n FROM docs GROUP BY object) SELECT * FROM n ORDER BY n DESC, value LIMIT 20 OFFSET 5")
def assoc_page_sorted(spark, d):
    return G.page(G.distinct_values(_docs(spark, d), "object"), [F.desc("n"), "value"], 5, 20)


@query("""WITH s AS (SELECT 'PART:' || p_partkey AS id, p_name AS label, lower(p_name) AS v FROM part), w AS (SELECT id, label, v, string_split_regex(v, '[^a-z0-9]+') AS ws FROM s),
  q AS (SELECT id, label, 3.0 * ((list_contains(ws, 'red')::INT + list_contains(ws, 'part')::INT) / 2) + CASE WHEN v = 'red part' THEN 3.0 ELSE 0 END AS score FROM w)
  SELECT id, label, score::DOUBLE AS score FROM q WHERE score > 0 ORDER BY score DESC, id LIMIT 50""")
def text_search(spark, d):
    p = table(spark, d, "part").select(cid("PART", "p_partkey").alias("id"), F.col("p_name").alias("label"))
    return G.text_search(p, "red part", {"label": 3.0}, limit=50)


@query("SELECT 'PART:' || p_partkey AS id, p_name AS value FROM part WHERE list_has_any([true], list_transform(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'bl'))) ORDER BY NOT starts_with(lower(p_name), 'bl'), p_name, 'PART:' || p_partkey LIMIT 20")
def autocomplete(spark, d):
    return G.autocomplete(table(spark, d, "part").select(cid("PART", "p_partkey").alias("id"), F.col("p_name").alias("label")), "bl")


@query(f"""{SUP}, n AS (SELECT term, count(*) AS k FROM i2 GROUP BY term), x AS (SELECT term FROM n WHERE term LIKE 'BRAND:%'), y AS (SELECT term FROM n WHERE term LIKE 'TYPE:%')
  SELECT p.term AS x, q.term AS y, count(*)::BIGINT AS n FROM i2 p JOIN i2 q USING (subject) WHERE p.term IN (SELECT term FROM x) AND q.term IN (SELECT term FROM y) GROUP BY ALL""")
def term_cooccurrence(spark, d):
    s = suppliers(spark, d)
    of = lambda like, name: s.term_counts.filter(F.col("term").like(like)).select(F.col("term").alias(name))
    return G.cooccurrence(s.inferred, of("BRAND:%", "x"), of("TYPE:%", "y"), s.subjects.count()).select("x", "y", "n")


# --- similarity


@query(f"{I}, t AS (SELECT count(*) AS n FROM customer) SELECT term, count(*)::BIGINT AS freq, round(log2(any_value(t.n) / count(*)), 8)::DOUBLE AS ic FROM i CROSS JOIN t GROUP BY term")
def sim_ic(spark, d):
    return S.information_content(customers(spark, d)).withColumn("ic", _r("ic"))


DP = "dp AS (SELECT 'H:' || p_partkey AS a, 'H:' || (p_partkey + 1) AS b FROM part)"
COMMON = "ca AS (SELECT DISTINCT a, b, x.anc FROM dp JOIN hr x ON x.term = a JOIN hr y ON y.term = b AND x.anc = y.anc)"
DIC = "dn AS (SELECT anc AS term, count(*) AS n FROM hr GROUP BY anc), dic AS (SELECT term, -log2(n / (SELECT count(*) FROM hn)) AS ic FROM dn)"


def _deep_pairs(spark, d):
    return table(spark, d, "part").select(cid("H", "p_partkey").alias("a"), cid("H", F.col("p_partkey") + 1).alias("b"))


def _deep_ic(spark, d):
    o = deep(spark, d)
    n = o.nodes.count()
    return o.reflexive_closure().groupBy(F.col("anc").alias("term")).agg(F.count("*").alias("k")).select("term", (-F.log2(F.col("k") / n)).alias("ic"))


@query(f"{sql(DEEP)}, {DP}, {COMMON} SELECT a, b, anc FROM ca WHERE NOT EXISTS (SELECT 1 FROM ca x JOIN hc ON hc.term = x.anc WHERE x.a = ca.a AND x.b = ca.b AND hc.anc = ca.anc)")
def sim_mrca(spark, d):
    o = deep(spark, d)
    return S.mrca(_deep_pairs(spark, d), o.reflexive_closure(), o.parents().toDF("term", "anc"))


@query(f"{sql(DEEP)}, {DP}, {COMMON}, {DIC}, m AS (SELECT a, b, ic, string_agg(anc, '|' ORDER BY anc) AS terms FROM ca JOIN dic ON anc = term GROUP BY ALL), b1 AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY ic DESC) = 1) SELECT a, b, coalesce(round(ic, 8), 0)::DOUBLE AS ic, coalesce(terms, '') AS terms FROM dp LEFT JOIN b1 USING (a, b)")
def sim_mica(spark, d):
    o = deep(spark, d)
    return S.mica(_deep_pairs(spark, d), o.reflexive_closure(), _deep_ic(spark, d)).select("a", "b", _r("ic").alias("ic"), F.array_join("terms", "|").alias("terms"))


@query(f"""{sql(DEEP)}, {DIC}, prof AS (SELECT DISTINCT p_partkey // 20 AS id, 'H:' || p_partkey AS term FROM part),
  cells AS (SELECT p.id AS x, q.id AS y, p.term AS a, q.term AS b FROM prof p JOIN prof q ON q.id = p.id + 1), m AS (SELECT x, y, a, b, max(ic) AS ic FROM cells JOIN hr u ON u.term = a JOIN hr v ON v.term = b AND v.anc = u.anc JOIN dic ON dic.term = u.anc GROUP BY ALL),
  r1 AS (SELECT x, y, avg(k) AS m0 FROM (SELECT x, y, a, max(ic) AS k FROM m GROUP BY ALL) GROUP BY ALL), r2 AS (SELECT x, y, avg(k) AS m1 FROM (SELECT x, y, b, max(ic) AS k FROM m GROUP BY ALL) GROUP BY ALL)
  SELECT x, y, round((m0 + m1) / 2, 8)::DOUBLE AS score FROM r1 JOIN r2 USING (x, y)""")
def sim_resnik_bma(spark, d):
    prof = table(spark, d, "part").select(F.expr("p_partkey div 20").alias("id"), cid("H", "p_partkey").alias("term")).distinct()
    ids = prof.select("id").distinct()
    pairs = ids.toDF("x").join(ids.toDF("y"), F.col("y") == F.col("x") + 1)
    return S.resnik_bma_of(prof, pairs, deep(spark, d).reflexive_closure(), _deep_ic(spark, d)).select("x", "y", _r("score").alias("score"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6)::DOUBLE AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def sim_cosine_dense(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = v.toDF("a", "u").join(v.toDF("b", "w"), F.col("b") == F.col("a") + 1)
    return p.select("a", "b", _r(S.cosine_dense(F.col("u"), F.col("w")), 6).alias("cosine"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal / 1000) DESC)::INT AS rank FROM customer")
def sim_dense_rank(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") / 1000).alias("score"))
    return S.ranked(rows, ["segment"]).drop("score")


@query(f"""{I}, icc AS (SELECT term, -log2(count(*) / (SELECT count(*) FROM customer)) AS ic FROM i GROUP BY term), per AS (SELECT subject, avg(ic) AS m, max(ic) AS x, sum(ic) AS s FROM a JOIN icc ON object = term GROUP BY subject)
  SELECT round(avg(m), 6)::DOUBLE AS mean_mean_ic, round(avg(s), 6)::DOUBLE AS mean_sum_ic, round(max(x), 6)::DOUBLE AS max_max_ic, round(max(s), 6)::DOUBLE AS max_sum_ic, round(max(m), 6)::DOUBLE AS max_mean_ic, count(*)::BIGINT AS individuals FROM per""")
def sim_ic_stats(spark, d):
    row = S.ic_statistics(customers(spark, d))
    return row.select(*(_r(c, 6).alias(c) for c in row.columns if c != "individuals"), "individuals")


@query(f"""{I}, icc AS (SELECT term, -log2(count(*) / (SELECT count(*) FROM customer)) AS ic FROM i GROUP BY term),
  prof AS (SELECT DISTINCT subject AS id, object AS term, (regexp_extract(object, '[0-9]+')::BIGINT % 5 = 0) AS negated FROM a),
  g AS (SELECT id, coalesce(avg(ic) FILTER (WHERE NOT negated), 0) AS m, coalesce(max(ic) FILTER (WHERE NOT negated), 0) AS x, coalesce(sum(ic) FILTER (WHERE NOT negated), 0) AS s, avg(ic) FILTER (WHERE negated) AS nm, max(ic) FILTER (WHERE negated) AS nx, coalesce(sum(ic) FILTER (WHERE negated), 0) AS ns FROM prof JOIN icc USING (term) GROUP BY id)
  SELECT id, round((least(CASE WHEN nm IS NULL THEN m ELSE greatest(m, (m + 0.25 * nm) / 1.25) END / 10, 1) + least(greatest(x, 0.25 * coalesce(nx, 0)) / 12, 1) + least((s + 0.25 * ns) / 400, 1)) / 3, 8)::DOUBLE AS simple FROM g""")
def sim_sufficiency(spark, d):
    s = customers(spark, d)
    prof = s.assoc.select(F.col("subject").alias("id"), F.col("object").alias("term"), (F.regexp_extract("object", "[0-9]+", 0).cast("long") % 5 == 0).alias("negated"))
    return S.sufficiency(prof, S.information_content(s), 10.0, 12.0, 400.0).withColumn("simple", _r("simple"))


@query(f"""{SUP}, t AS (SELECT count(DISTINCT subject) AS n FROM a2), icc AS (SELECT term, log2(any_value(t.n) / count(*)) AS ic FROM i2 CROSS JOIN t GROUP BY term), tot AS (SELECT subject, sum(ic) AS s FROM i2 JOIN icc USING (term) GROUP BY subject),
  pr AS (SELECT 'SUPP:' || s_suppkey AS a, 'SUPP:' || (s_suppkey + 1) AS b FROM supplier), cc AS (SELECT a, b, sum(ic) AS c FROM pr JOIN i2 x ON x.subject = a JOIN i2 y ON y.subject = b AND x.term = y.term JOIN icc ON icc.term = x.term GROUP BY ALL)
  SELECT a, b, round(coalesce(c, 0) / (x.s + y.s - coalesce(c, 0)), 8)::DOUBLE AS sim_gic FROM pr LEFT JOIN cc USING (a, b) JOIN tot x ON x.subject = a JOIN tot y ON y.subject = b""")
def sim_gic(spark, d):
    s = suppliers(spark, d)
    pairs = table(spark, d, "supplier").select(cid("SUPP", "s_suppkey").alias("a"), cid("SUPP", F.col("s_suppkey") + 1).alias("b"))
    return S.sim_gic(s, pairs, S.information_content(s)).withColumn("sim_gic", _r("sim_gic"))


@query(f"{SUP}, n AS (SELECT term, count(*) AS n FROM i2 GROUP BY term) SELECT term, round(log2((SELECT max(n) FROM n) / n), 8)::DOUBLE AS ic FROM n")
def facet_content(spark, d):
    return S.facet_content(suppliers(spark, d).term_counts).withColumn("ic", _r("ic"))


@query("SELECT 'SUPP:' || l_suppkey AS subject, count(DISTINCT l_orderkey)::BIGINT AS n FROM lineitem GROUP BY ALL")
def publications_per_subject(spark, d):
    rows = table(spark, d, "lineitem").select(cid("SUPP", "l_suppkey").alias("subject"), cid("PMID", "l_orderkey").alias("reference"))
    return A.publications_per_subject(rows)


@query("SELECT event_id AS id, event_type AS relation, (props->>'k')::BIGINT AS k FROM events")
def json_properties(spark, d):
    e = table(spark, d, "events")
    made = e.select(cid("E", "event_id").alias("id"), cid("U", "user_id").alias("subject"), F.col("event_type").alias("relation"), F.lit("x").alias("object"), F.col("props").alias("evidence_map"))
    found = G.nested(made)
    return found.select(F.regexp_extract("id", "E:(.*)", 1).cast("long").alias("id"), "relation", F.element_at("evidence_labels", "k").cast("long").alias("k"))


# --- triples

TRIPLES = "t AS (SELECT 'SUPP:' || l_suppkey AS s, 'supplies' AS p, 'PART:' || l_partkey AS o FROM lineitem UNION SELECT 'SUPP:' || s_suppkey, 'in', 'NATION:' || s_nationkey FROM supplier UNION SELECT 'PART:' || p_partkey, 'type', 'TYPE:' || p_type FROM part)"


def _triples(spark, d):
    l, s, p = (table(spark, d, t) for t in ("lineitem", "supplier", "part"))
    one = l.select(cid("SUPP", "l_suppkey").alias("s"), F.lit("supplies").alias("p"), cid("PART", "l_partkey").alias("o"))
    return one.union(s.select(cid("SUPP", "s_suppkey"), F.lit("in"), cid("NATION", "s_nationkey"))).union(p.select(cid("PART", "p_partkey"), F.lit("type"), cid("TYPE", "p_type"))).distinct()


@query(f"WITH {TRIPLES} SELECT DISTINCT a.s AS supplier, c.o AS nation FROM t a JOIN t b ON b.s = a.o AND b.p = 'type' AND b.o = 'TYPE:MEDIUM' JOIN t c ON c.s = a.s AND c.p = 'in' WHERE a.p = 'supplies'")
def triples_pattern(spark, d):
    return R.match(_triples(spark, d), [("?part", "type", "TYPE:MEDIUM"), ("?supplier", "supplies", "?part"), ("?supplier", "in", "?nation")]).select("supplier", "nation").distinct()


@query("""WITH b AS (SELECT DISTINCT 'SUPP:' || l_suppkey AS subject, 'PART:' || l_partkey AS object, 'PMID:' || l_orderkey AS ref FROM lineitem),
  k AS (SELECT *, '_:' || substr(sha256('axiom' || chr(9) || subject || chr(9) || 'enables' || chr(9) || object), 1, 24) AS x, '_:' || substr(sha256('evidence' || chr(9) || subject || chr(9) || 'enables' || chr(9) || object || chr(9) || 'ECO:1' || chr(9) || ref), 1, 24) AS e FROM b)
  SELECT subject AS s, 'enables' AS p, object AS o FROM k UNION SELECT x, 'rdf:type', 'owl:Axiom' FROM k UNION SELECT x, 'owl:annotatedSource', subject FROM k UNION SELECT x, 'owl:annotatedProperty', 'enables' FROM k UNION SELECT x, 'owl:annotatedTarget', object FROM k
  UNION SELECT x, 'RO:0002612', e FROM k UNION SELECT e, 'rdf:type', 'ECO:1' FROM k UNION SELECT e, 'dc:source', ref FROM k""")
def triples_emit(spark, d):
    rows = table(spark, d, "lineitem").select(cid("SUPP", "l_suppkey").alias("subject"), F.lit("enables").alias("relation"), cid("PART", "l_partkey").alias("object"), F.lit("ECO:1").alias("evidence"), F.array(cid("PMID", "l_orderkey")).alias("references"))
    return R.with_evidence(rows)


@query("""SELECT 'SUPP:' || l_suppkey AS subject, 'PART:' || l_partkey AS object, l_returnflag = 'R' AS negated, string_agg('PMID:' || l_orderkey || '/' || l_linestatus, '|' ORDER BY 'PMID:' || l_orderkey || '/' || l_linestatus) AS lines, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def collapse_annotations(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "lineitem").select(cid("SUPP", "l_suppkey").alias("subject"), cid("PART", "l_partkey").alias("object"), (F.col("l_returnflag") == "R").alias("negated"), none.alias("qualifiers"), none.alias("extensions"), none.alias("with_from"), F.col("l_linestatus").alias("evidence"), cid("PMID", "l_orderkey").alias("reference"), F.lit("20200101").alias("date"))
    lines = F.array_join(F.array_sort(F.transform("lines", lambda x: F.concat_ws("/", x["reference"], x["evidence"]))), "|")
    return R.collapsed(rows).select("subject", "object", "negated", lines.alias("lines"), "n")


@query(f"WITH {TRIPLES} SELECT '<http://e/' || replace(s, ':', '/') || '> <http://e/' || p || '> <http://e/' || replace(o, ':', '/') || '> .' AS value FROM t")
def triples_lines(spark, d):
    slash = lambda c: F.concat(F.lit("E:"), F.replace(F.col(c), F.lit(":"), F.lit("/"))).alias(c)
    named = _triples(spark, d).select(slash("s"), F.concat(F.lit("E:"), "p").alias("p"), slash("o"))
    return R.ntriples(named, {"E": "http://e/"})


@query(f"WITH {TRIPLES} SELECT s, coalesce(string_agg(o, '|' ORDER BY o) FILTER (WHERE p = 'in'), '') AS \"in\", coalesce(string_agg(o, '|' ORDER BY o) FILTER (WHERE p = 'type'), '') AS type FROM t WHERE p IN ('in', 'type') GROUP BY s")
def triples_grouped(spark, d):
    return R.grouped_values(_triples(spark, d), ["in", "type"])
