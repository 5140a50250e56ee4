"""Ontologies and associations made from the relational test tables, as DataFrames and as the same SQL for the oracle.

Product graph: parts under brands and types, part of sizes, sizes under bands, all of those under one thing. Geography:
customers and suppliers part of nations, nations under regions, regions under the world. Deep graph: part k under k/2 and k/3.
Associations: customers and the parts they ordered, suppliers and their parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assoc import AssociationSet
from ..operators.ontology import IS_A, PART_OF, Ontology

_memo: dict[tuple, object] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, make: Callable):
    """What is made once for a session and folder: closures are shared by queries."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def forget() -> None:
    _memo.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cid(prefix: str, col: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), (F.col(col) if isinstance(col, str) else col).cast("string"))


def product_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parts are unique by key; those of brands, types and sizes come from their distinct combinations."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")

    def edges(df: DataFrame, *links: tuple[Column, str, Column]) -> DataFrame:
        made = F.array(*(F.struct(s.alias("sub"), F.lit(p).alias("pred"), o.alias("obj")) for s, p, o in links))
        return df.select(F.explode(made).alias("e")).select("e.*")

    me, brand, kind, size, band = cid("PART", "p_partkey"), cid("BRAND", "p_brand"), cid("TYPE", "p_type"), cid("SIZE", "p_size"), cid("SBAND", F.expr("p_size div 10"))
    thing = F.lit("THING:0")
    groups = part.select("p_brand", "p_type", "p_size").distinct()
    out = edges(part, (me, IS_A, brand), (me, IS_A, kind), (me, PART_OF, size))
    out = out.unionAll(edges(groups, (size, IS_A, band), (brand, IS_A, thing), (kind, IS_A, thing), (band, IS_A, thing)).distinct())
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    out = out.unionAll(edges(c, (cid("CUST", "c_custkey"), PART_OF, cid("NATION", "c_nationkey")))).unionAll(edges(s, (cid("SUPP", "s_suppkey"), PART_OF, cid("NATION", "s_nationkey"))))
    return out.unionAll(edges(n, (cid("NATION", "n_nationkey"), IS_A, cid("REGION", "n_regionkey")))).unionAll(edges(r, (cid("REGION", "r_regionkey"), IS_A, F.lit("WORLD:0"))))


def product(spark: SparkSession, sf_dir: str) -> Ontology:
    def make() -> Ontology:
        onto = Ontology.of_edges(product_edges(spark, sf_dir))
        part = table(spark, sf_dir, "part").select(cid("PART", "p_partkey").alias("id"), F.col("p_name").alias("name"))
        nodes = onto.nodes.join(part, "id", "left").select("id", F.coalesce("name", "label").alias("label"), "type", "deprecated")
        return Ontology(nodes, onto.edges)

    return _once("product", spark, sf_dir, make)


def deep(spark: SparkSession, sf_dir: str) -> Ontology:
    def make() -> Ontology:
        p = table(spark, sf_dir, "part").select("p_partkey").filter("p_partkey > 0")
        up = F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3")))
        return Ontology.of_edges(p.select(cid("H", "p_partkey").alias("sub"), F.lit(IS_A).alias("pred"), up.alias("o")).select("sub", "pred", cid("H", "o").alias("obj")).distinct())

    return _once("deep", spark, sf_dir, make)


def orders_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(cid("CUST", "o_custkey").alias("subject"), cid("PART", "l_partkey").alias("object")).distinct()


def customers(spark: SparkSession, sf_dir: str) -> AssociationSet:
    known = lambda: table(spark, sf_dir, "customer").select(cid("CUST", "c_custkey").alias("subject"))
    return _once("customers", spark, sf_dir, lambda: AssociationSet(orders_of_parts(spark, sf_dir), product(spark, sf_dir), known()))


def suppliers(spark: SparkSession, sf_dir: str) -> AssociationSet:
    made = lambda: table(spark, sf_dir, "lineitem").select(cid("SUPP", "l_suppkey").alias("subject"), cid("PART", "l_partkey").alias("object")).distinct()
    return _once("suppliers", spark, sf_dir, lambda: AssociationSet(made(), product(spark, sf_dir)))


def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, value): one tab-separated annotation line of 17 cells for each lineitem."""
    l = table(spark, sf_dir, "lineitem")
    qual = F.when(F.col("l_returnflag") == "R", "NOT|enables").when(F.col("l_returnflag") == "A", "involved_in").otherwise("")
    ev = F.get(F.array(*map(F.lit, ("IEA", "IDA", "IPI", "ISS", "ND", "IBA", "IC"))), (F.col("l_orderkey") % 7).cast("int"))
    asp = F.get(F.array(*map(F.lit, "PFC")), (F.col("l_partkey") % 3).cast("int"))
    withs = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("PART:"), F.col("l_partkey"), F.lit("|SUPP:"), F.col("l_suppkey"), F.lit(",X:1"))).otherwise("")
    ref = F.when(F.col("l_linenumber") == 7, "bad ref").otherwise(F.concat(F.lit("PMID:"), F.col("l_orderkey")))
    date = F.when(F.col("l_linenumber") == 6, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    taxon = F.when(F.col("l_linenumber") == 5, "taxon:0").otherwise(F.concat(F.lit("taxon:"), F.col("l_suppkey")))
    cells = (F.lit("SUPP"), F.col("l_suppkey"), F.concat(F.lit("S"), F.col("l_suppkey")), qual, cid("PART", "l_partkey"), ref, ev, withs, asp, F.lit(""), F.lit(""), F.lit("gene_product"), taxon, date, F.lit("TST"), F.lit("part_of(CL:1)|occurs_in(CL:2),part_of(CL:3)"), F.lit(""))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.concat_ws("\t", *(c.cast("string") for c in cells)).alias("value"))


#: The same, for DuckDB. Each is a list of common table expressions without WITH.
EDGES = """
e AS (
  SELECT 'PART:' || p_partkey AS sub, 'subClassOf' AS pred, 'BRAND:' || p_brand AS obj FROM part
  UNION SELECT 'PART:' || p_partkey, 'subClassOf', 'TYPE:' || p_type FROM part
  UNION SELECT 'PART:' || p_partkey, 'BFO:0000050', 'SIZE:' || p_size FROM part
  UNION SELECT 'SIZE:' || p_size, 'subClassOf', 'SBAND:' || (p_size // 10) FROM part
  UNION SELECT 'BRAND:' || p_brand, 'subClassOf', 'THING:0' FROM part
  UNION SELECT 'TYPE:' || p_type, 'subClassOf', 'THING:0' FROM part
  UNION SELECT 'SBAND:' || (p_size // 10), 'subClassOf', 'THING:0' FROM part
  UNION SELECT 'CUST:' || c_custkey, 'BFO:0000050', 'NATION:' || c_nationkey FROM customer
  UNION SELECT 'SUPP:' || s_suppkey, 'BFO:0000050', 'NATION:' || s_nationkey FROM supplier
  UNION SELECT 'NATION:' || n_nationkey, 'subClassOf', 'REGION:' || n_regionkey FROM nation
  UNION SELECT 'REGION:' || r_regionkey, 'subClassOf', 'WORLD:0' FROM region),
nodes AS (
  SELECT id, coalesce(p_name, id) AS label FROM (SELECT sub AS id FROM e UNION SELECT obj FROM e) LEFT JOIN part ON id = 'PART:' || p_partkey)"""
CLOSURE = "c AS (SELECT sub AS term, obj AS anc FROM e UNION SELECT c.term, e.obj FROM c JOIN e ON c.anc = e.sub)"
ISA_CLOSURE = "ci AS (SELECT sub AS term, obj AS anc FROM e WHERE pred = 'subClassOf' UNION SELECT ci.term, e.obj FROM ci JOIN e ON ci.anc = e.sub AND e.pred = 'subClassOf')"
REFLEXIVE = "r AS (SELECT term, anc FROM c UNION SELECT id, id FROM nodes)"
DEEP = """
h AS (SELECT 'H:' || p_partkey AS sub, 'H:' || (p_partkey // 2) AS obj FROM part WHERE p_partkey > 0 UNION SELECT 'H:' || p_partkey, 'H:' || (p_partkey // 3) FROM part WHERE p_partkey > 0),
hn AS (SELECT sub AS id FROM h UNION SELECT obj FROM h),
hc AS (SELECT sub AS term, obj AS anc FROM h UNION SELECT hc.term, h.obj FROM hc JOIN h ON hc.anc = h.sub),
hr AS (SELECT term, anc FROM hc UNION SELECT id, id FROM hn)"""
ASSOC = "a AS (SELECT DISTINCT 'CUST:' || o_custkey AS subject, 'PART:' || l_partkey AS object FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
INFERRED = "i AS (SELECT subject, object AS term FROM a UNION SELECT subject, anc FROM a JOIN c ON object = term)"
SUPPLIED = """
a2 AS (SELECT DISTINCT 'SUPP:' || l_suppkey AS subject, 'PART:' || l_partkey AS object FROM lineitem),
i2 AS (SELECT subject, object AS term FROM a2 UNION SELECT subject, anc FROM a2 JOIN c ON object = term)"""
LINES = r"""
lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id,
    CASE l_returnflag WHEN 'R' THEN 'NOT|enables' WHEN 'A' THEN 'involved_in' ELSE '' END AS qualifier,
    'SUPP:' || l_suppkey AS subject, 'PART:' || l_partkey AS term,
    ['IEA', 'IDA', 'IPI', 'ISS', 'ND', 'IBA', 'IC'][(l_orderkey % 7 + 1)::INT] AS evidence, ['P', 'F', 'C'][(l_partkey % 3 + 1)::INT] AS aspect,
    l_linenumber % 2 = 0 AS has_with, CASE WHEN l_linenumber = 7 THEN 'bad ref' ELSE 'PMID:' || l_orderkey END AS reference,
    l_linenumber = 5 OR l_suppkey = 0 AS bad_taxon, l_suppkey, l_partkey, l_linenumber, l_shipdate::DATE AS date FROM lineitem)"""


def sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)
