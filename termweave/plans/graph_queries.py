"""Queries over the derived graphs: ONT-*, SNK-11, SRC-30."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure as C
from ..operators import ontology as O
from ..sources import readers
from .derived import CLOSURE, DEEP, EDGES, ISA_CLOSURE, REFLEXIVE, cid, deep, product, sql, suppliers, table
from .registry import query

E, EC, ER = sql(EDGES), sql(EDGES, CLOSURE), sql(EDGES, CLOSURE, REFLEXIVE)
H = sql(DEEP)
BRANDS = [f"BRAND:Brand#{k}" for k in range(1, 6)]


@query(f"{EC} SELECT anc, count(*)::BIGINT AS n FROM c WHERE term <> anc GROUP BY anc")
def ont_closure_counts(spark, d):
    return product(spark, d).closure().groupBy("anc").agg(F.count("*").alias("n"))


@query(f"{H} SELECT anc, count(*)::BIGINT AS n FROM hc GROUP BY anc")
def ont_deep_closure_counts(spark, d):
    return deep(spark, d).closure().groupBy("anc").agg(F.count("*").alias("n"))


@query(f"{sql(EDGES, ISA_CLOSURE)} SELECT term, anc FROM ci")
def ont_ancestors_rel_filtered(spark, d):
    return product(spark, d).closure(["subClassOf"])


@query(f"{ER} SELECT anc AS id, term AS descendant FROM r WHERE anc IN ('TYPE:MEDIUM', 'REGION:1')")
def ont_descendants_of(spark, d):
    return product(spark, d).descendants(["TYPE:MEDIUM", "REGION:1"], reflexive=True).select("id", F.col("desc").alias("descendant"))


@query(f"""{E}, rt AS (SELECT DISTINCT obj AS id FROM e WHERE obj NOT IN (SELECT sub FROM e)),
  l1 AS (SELECT s.sub AS id FROM rt JOIN (SELECT DISTINCT sub, obj FROM e) s ON rt.id = s.obj), l2 AS (SELECT s.sub AS id FROM l1 JOIN (SELECT DISTINCT sub, obj FROM e) s ON l1.id = s.obj)
  SELECT 0 AS level, id, count(*)::BIGINT AS n FROM rt GROUP BY id UNION ALL SELECT 1, id, count(*)::BIGINT FROM l1 GROUP BY id UNION ALL SELECT 2, id, count(*)::BIGINT FROM l2 GROUP BY id""")
def ont_roots_levels(spark, d):
    return product(spark, d).levels(2)


@query(f"""{E} SELECT sub, pred, obj FROM e WHERE sub IN (SELECT id FROM nodes WHERE id LIKE 'SIZE:%' OR id LIKE 'SBAND:%' OR id = 'THING:0') AND obj IN (SELECT id FROM nodes WHERE id LIKE 'SIZE:%' OR id LIKE 'SBAND:%' OR id = 'THING:0')""")
def ont_subontology(spark, d):
    o = product(spark, d)
    return o.subontology(o.nodes.filter("id like 'SIZE:%' or id like 'SBAND:%' or id = 'THING:0'")).edges


@query(f"{E} SELECT n.id, coalesce((SELECT string_agg(DISTINCT obj, '|' ORDER BY obj) FROM e WHERE e.sub = n.id), '') AS parents FROM nodes n")
def ont_parent_index(spark, d):
    return product(spark, d).parent_index().select("id", F.array_join("parents", "|").alias("parents"))


@query(f"""{E} SELECT 'regex' AS how, id FROM nodes WHERE regexp_matches(label, 'red.*') UNION ALL SELECT 'part', id FROM nodes WHERE contains(label, 'Brand#1') UNION ALL SELECT 'id', 'PART:1'""")
def ont_search_labels(spark, d):
    o = product(spark, d)
    return o.search(["red%"]).select(F.lit("regex").alias("how"), "id").union(o.search(["Brand#1"], partial=True).select(F.lit("part"), "id")).union(o.search(["PART:1"]).select(F.lit("id"), "id"))


@query(f"""{EC}, k AS (SELECT 'PART:' || p_partkey AS key, unnest(['PART:' || p_partkey, 'TYPE:' || p_type, 'SIZE:' || (p_partkey % 50 + 1), 'SBAND:' || (p_partkey % 5), 'THING:0']) AS id FROM part),
  u AS (SELECT DISTINCT key, id FROM k) SELECT key, id FROM u WHERE NOT EXISTS (SELECT 1 FROM u x JOIN c ON c.term = x.id WHERE x.key = u.key AND c.anc = u.id)""")
def ont_filter_redundant(spark, d):
    p = table(spark, d, "part")
    ids = F.array(cid("PART", "p_partkey"), cid("TYPE", "p_type"), cid("SIZE", F.col("p_partkey") % 50 + 1), cid("SBAND", F.col("p_partkey") % 5), F.lit("THING:0"))
    keyed = p.select(cid("PART", "p_partkey").alias("key"), F.explode(ids).alias("id")).distinct()
    return O.not_redundant(keyed, product(spark, d).closure())


@query(f"""{ER}, s AS (SELECT id FROM nodes WHERE id LIKE 'SBAND:%' OR id LIKE 'TYPE:%' OR id IN ('SIZE:1', 'THING:0', 'REGION:2')),
  m AS (SELECT term AS id, anc AS slim FROM r JOIN s ON anc = s.id), t AS (SELECT id, slim FROM m WHERE NOT EXISTS (SELECT 1 FROM m x JOIN c ON c.term = x.slim WHERE x.id = m.id AND c.anc = m.slim))
  SELECT n.id, coalesce(slim, '-') AS slim FROM nodes n LEFT JOIN t ON t.id = n.id""")
def ont_slim_map(spark, d):
    o = product(spark, d)
    subset = o.nodes.filter("id like 'SBAND:%' or id like 'TYPE:%' or id in ('SIZE:1', 'THING:0', 'REGION:2')")
    return o.slim_map(subset).select("id", F.coalesce("slim", F.lit("-")).alias("slim"))


@query(f"""{sql(EDGES, DEEP)}, b AS (SELECT id, label, 0 AS o FROM nodes UNION ALL SELECT 'CUST:' || c_custkey, c_name, 1 FROM customer UNION ALL SELECT id, id, 1 FROM hn)
  SELECT id, max_by(label, o) AS label FROM b GROUP BY id""")
def ont_merge(spark, d):
    other = table(spark, d, "customer").select(cid("CUST", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("CLASS").alias("type"), F.lit(False).alias("deprecated"))
    h = deep(spark, d)
    return product(spark, d).merge(O.Ontology(other.unionByName(h.nodes), h.edges)).nodes.select("id", "label")


XREFS = "x AS (SELECT 'PART:' || p_partkey AS id, 'BRAND:' || p_brand AS xref FROM part)"


def _with_xrefs(spark, d):
    x = table(spark, d, "part").select(cid("PART", "p_partkey").alias("id"), cid("BRAND", "p_brand").alias("xref"), cid("PART", "p_partkey").alias("source"))
    o = product(spark, d)
    return O.Ontology(o.nodes, o.edges, xrefs=x)


@query(f"{E}, {XREFS} SELECT id, xref FROM x UNION SELECT xref, id FROM x")
def ont_xrefs_bidirectional(spark, d):
    return _with_xrefs(spark, d).xrefs_of(bidirectional=True)


@query(f"{E}, {XREFS}, b AS (SELECT id, xref FROM x UNION SELECT xref, id FROM x) SELECT sub, pred, obj FROM e UNION ALL SELECT id, 'xref', xref FROM b WHERE id IN (SELECT id FROM nodes) AND xref IN (SELECT id FROM nodes)")
def ont_xref_edges(spark, d):
    return _with_xrefs(spark, d).with_xref_edges().edges


@query(f"{E}, {XREFS} SELECT n.id, coalesce(max(regexp_extract(xref, '([^:]*)$', 1)), '') AS \"BRAND\" FROM nodes n LEFT JOIN x ON x.id = n.id GROUP BY n.id")
def ont_xref_table(spark, d):
    return _with_xrefs(spark, d).xref_table(["BRAND"]).select("id", "BRAND")


@query(f"""{E} SELECT DISTINCT e1.sub AS id, e3.obj AS sink FROM e e1 JOIN e e2 ON e1.obj = e2.sub JOIN e e3 ON e2.obj = e3.sub WHERE e1.pred = 'BFO:0000050' AND e2.pred = 'subClassOf' AND e3.pred = 'subClassOf' AND e1.sub LIKE 'CUST:%'""")
def ont_chain_traversal(spark, d):
    o = product(spark, d)
    return o.chain(o.nodes.filter("id like 'CUST:%'"), ["BFO:0000050", "subClassOf", "subClassOf"])


FOCUS = ["PART:1", "PART:2", "PART:3", "SUPP:1"]


@query(f"""{ER}, f AS (SELECT unnest({FOCUS}) AS id), m AS (SELECT anc, count(*) AS n FROM r JOIN f ON term = f.id GROUP BY anc),
  ie AS (SELECT DISTINCT sub, obj, a.n AS ns, b.n AS no FROM e JOIN m a ON a.anc = sub JOIN m b ON b.anc = obj),
  gone AS (SELECT DISTINCT obj AS id FROM ie WHERE ns = no AND obj NOT IN (SELECT id FROM f))
  SELECT anc AS id FROM m WHERE anc NOT IN (SELECT id FROM gone)""")
def ont_min_subgraph(spark, d):
    return product(spark, d).minimal_subgraph(FOCUS).nodes.select("id")


@query(f"{E} SELECT sub, obj, string_agg(DISTINCT pred, '|' ORDER BY pred) AS preds FROM e GROUP BY sub, obj")
def ont_pair_relations(spark, d):
    return product(spark, d).pair_relations().select("sub", "obj", F.array_join("preds", "|").alias("preds"))


@query(f"{E} SELECT id, neighbor, count(*)::BIGINT AS n FROM (SELECT DISTINCT sub AS id, obj AS neighbor FROM e UNION ALL SELECT DISTINCT obj, sub FROM e) GROUP BY ALL")
def ont_neighbors(spark, d):
    return product(spark, d).neighbors().groupBy("id", "neighbor").agg(F.count("*").alias("n"))


@query(f"{E} SELECT DISTINCT regexp_extract(id, '^(.*):', 1) AS prefix FROM nodes")
def ont_prefixes(spark, d):
    return product(spark, d).prefixes()


@query(f"{ER} SELECT anc AS id FROM r WHERE term IN ('PART:5', 'NATION:3') UNION SELECT term FROM r WHERE anc IN ('PART:5', 'NATION:3')")
def ont_traverse(spark, d):
    return product(spark, d).traverse(["PART:5", "NATION:3"], up=True, down=True)


@query(f"""{H}, t AS (SELECT 'H:0' AS id, 0 AS depth UNION ALL SELECT h.sub, t.depth + 1 FROM t JOIN h ON h.obj = t.id) SELECT id, max(depth) AS depth FROM t GROUP BY id""")
def ont_topological(spark, d):
    return deep(spark, d).topological()


@query(f"""{H}, p AS (SELECT 'H:0' AS id, 1::HUGEINT AS k UNION ALL SELECT h.sub, p.k FROM p JOIN h ON h.obj = p.id) SELECT id, count(*)::BIGINT AS n_paths FROM p GROUP BY id""")
def ont_path_counts(spark, d):
    o = deep(spark, d)
    return C.path_counts(o.edges, o.nodes).select("id", "n_paths")


@query(f"""{H}, p AS (SELECT ['H:100'] AS path, 'H:100' AS cur UNION ALL SELECT list_append(p.path, h.obj), h.obj FROM p JOIN h ON h.sub = p.cur) SELECT array_to_string(path, '>') AS path FROM p WHERE cur = 'H:0'""")
def ont_simple_paths(spark, d):
    o = deep(spark, d)
    return C.simple_paths(o.edges, spark.createDataFrame([("H:100",)], "id string")).select(F.array_join("path", ">").alias("path"))


@query(f"""{H}, w AS (SELECT 'H:200' AS id, 0 AS depth UNION SELECT h.obj, w.depth + 1 FROM w JOIN h ON h.sub = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def ont_depth_bounded(spark, d):
    return C.walk(deep(spark, d).edges, spark.createDataFrame([("H:200",)], "id string"), depth=3).select("id", "depth")


CYCLE = "cy AS (SELECT 'K:' || p_partkey AS sub, 'K:' || (p_partkey // 10 * 10 + (p_partkey + 1) % 10) AS obj FROM part)"


def _cycles(spark, d):
    return table(spark, d, "part").select(cid("K", "p_partkey").alias("sub"), F.lit("subClassOf").alias("pred"), cid("K", F.expr("p_partkey div 10 * 10 + (p_partkey + 1) % 10")).alias("obj"))


@query(f"WITH RECURSIVE {CYCLE}, cc AS (SELECT sub AS term, obj AS anc FROM cy UNION SELECT cc.term, cy.obj FROM cc JOIN cy ON cc.anc = cy.sub) SELECT DISTINCT term AS id FROM cc WHERE term = anc")
def ont_cycle_nodes(spark, d):
    return C.in_cycles(_cycles(spark, d))


@query(f"""WITH RECURSIVE {CYCLE}, cc AS (SELECT sub AS term, obj AS anc FROM cy UNION SELECT cc.term, cy.obj FROM cc JOIN cy ON cc.anc = cy.sub)
  SELECT n.id, least(n.id, coalesce((SELECT min(x.anc) FROM cc x JOIN cc y ON x.anc = y.term AND x.term = y.anc WHERE x.term = n.id), n.id)) AS component FROM (SELECT sub AS id FROM cy UNION SELECT obj FROM cy) n""")
def ont_strong_components(spark, d):
    e = _cycles(spark, d)
    return C.strong_components(e, C.nodes_of(e))


@query(f"""{ER} SELECT term AS id, min_by(aspect, k) AS aspect FROM r JOIN (VALUES ('TYPE:MEDIUM', 'M', 0), ('THING:0', 'T', 1), ('WORLD:0', 'W', 2)) v(anc, aspect, k) USING (anc) GROUP BY term""")
def ont_aspect(spark, d):
    return product(spark, d).aspect([("TYPE:MEDIUM", "M"), ("THING:0", "T"), ("WORLD:0", "W")])


@query(f"""{E} SELECT e.sub, s.label AS sub_label, e.pred, e.obj, o.label AS obj_label FROM e JOIN nodes s ON s.id = e.sub JOIN nodes o ON o.id = e.obj""")
def label_expand(spark, d):
    o = product(spark, d)
    return O.expand_labels(o.edges, ["sub", "obj"], o.labels())


@query(f"""{sql(EDGES, ISA_CLOSURE)}, ri AS (SELECT term, anc FROM ci UNION SELECT id, id FROM nodes), p AS (SELECT DISTINCT 'TYPE:' || p_type AS anc, 'BRAND:' || p_brand AS object FROM part),
  a2 AS (SELECT DISTINCT 'SUPP:' || l_suppkey AS subject, 'PART:' || l_partkey AS object FROM lineitem)
  SELECT DISTINCT a2.subject, p.object FROM a2 JOIN ri ON a2.object = ri.term JOIN p ON p.anc = ri.anc""")
def ont_has_part_inferences(spark, d):


    parts = table(spark, d, "part").select(cid("TYPE", "p_type").alias("sub"), F.lit("BFO:0000051").alias("pred"), cid("BRAND", "p_brand").alias("obj")).distinct()
    o = product(spark, d)
    made = O.Ontology(o.nodes, o.edges.unionAll(parts))
    return made.has_part_inferences(suppliers(spark, d).assoc)


@query(f"""{E} SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS n FROM nodes""")
def graph_compact_ids(spark, d):
    return product(spark, d).compact()[0].select("id", F.col("n").cast("long").alias("n"))


@query(f"{E} SELECT DISTINCT sub AS id FROM e WHERE sub NOT IN (SELECT obj FROM e)")
def ont_leaves(spark, d):
    return product(spark, d).leaves()


@query("""SELECT DISTINCT trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')) AS label FROM (SELECT unnest(regexp_extract_all(html, '(?is)<(?:li|h[1-6]|a)\\b[^>]*>(.*?)</(?:li|h[1-6]|a)>')) AS x FROM pages)
  WHERE trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')) <> ''""")
def scraped_names(spark, d):
    return readers.scraped_names(table(spark, d, "pages")).select("label").distinct()
