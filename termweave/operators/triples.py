"""Triples from associations, patterns over triples, and collapsed annotations (RDF-01 to RDF-19)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import expanded

TYPE = "rdf:type"
#: How an aspect relates a term to the gene product.
ASPECT_RELATIONS = {"F": "RO:0002333", "P": "BFO:0000050", "C": "BFO:0000066"}


def blank(*parts: Column) -> Column:
    """A node id made from its parts, the same on every run (SCA-26)."""
    return F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("\t", *parts), 256), 1, 24))


def _exploded(rows: DataFrame, *triples: tuple[Column, Column, Column]) -> DataFrame:
    made = F.array(*(F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in triples))
    return rows.select(F.explode(made).alias("t")).select("t.*").filter("o is not null")


def plain(rows: DataFrame) -> DataFrame:
    """(s, p, o) of associations as they stand (RDF-04)."""
    return rows.select(F.col("subject").alias("s"), F.col("relation").alias("p"), F.col("object").alias("o")).distinct()


def with_evidence(rows: DataFrame) -> DataFrame:
    """Reified associations with an evidence node, its references and with/from ids (RDF-02). references and with_from are arrays."""
    axiom = blank(F.lit("axiom"), F.col("subject"), F.col("relation"), F.col("object"))
    ev = blank(F.lit("evidence"), F.col("subject"), F.col("relation"), F.col("object"), F.col("evidence"), F.array_join("references", "|"))
    lit = F.lit
    base = rows.withColumn("__x", axiom).withColumn("__e", ev)
    x, e = F.col("__x"), F.col("__e")
    heads = _exploded(
        base,
        (F.col("subject"), F.col("relation"), F.col("object")),
        (x, lit(TYPE), lit("owl:Axiom")), (x, lit("owl:annotatedSource"), F.col("subject")), (x, lit("owl:annotatedProperty"), F.col("relation")), (x, lit("owl:annotatedTarget"), F.col("object")),
        (x, lit("RO:0002612"), e), (e, lit(TYPE), F.col("evidence")),
    )
    refs = base.select(e.alias("s"), lit("dc:source").alias("p"), F.explode("references").alias("o"))
    withs = base.select(e.alias("s"), lit("evidence_with").alias("p"), F.explode("with_from").alias("o")) if "with_from" in rows.columns else None
    parts = [heads, refs, *([withs] if withs is not None else [])]
    return reduce(DataFrame.unionByName, parts).distinct()


def activity_models(rows: DataFrame) -> DataFrame:
    """Activity-style triples by aspect: F enabled by, P part of, C occurs in; one block for each alternative extension (RDF-03).

    extensions is an array of arrays of (relation, term).
    """
    blocks = rows.select("*", F.posexplode_outer("extensions").alias("k", "units"))
    node = blank(F.lit("term"), F.col("subject"), F.col("object"), F.coalesce(F.col("k").cast("string"), F.lit("")))
    product = blank(F.lit("product"), F.col("subject"), F.col("object"), F.coalesce(F.col("k").cast("string"), F.lit("")))
    base = blocks.withColumn("__n", node).withColumn("__g", product).withColumn("__a", blank(F.lit("activity"), F.col("__n")))
    n, g, a, lit = F.col("__n"), F.col("__g"), F.col("__a"), F.lit
    rel = F.create_map(*(lit(x) for kv in ASPECT_RELATIONS.items() for x in kv))[F.col("aspect")]
    mf = F.col("aspect") == "F"
    made = _exploded(
        base,
        (n, lit(TYPE), F.col("object")), (g, lit(TYPE), F.col("subject")),
        (n, lit(ASPECT_RELATIONS["F"]), F.when(mf, g)),
        (a, lit(TYPE), F.when(~mf, lit("GO:0003674"))), (a, lit(ASPECT_RELATIONS["F"]), F.when(~mf, g)), (a, rel, F.when(~mf, n)),
    )
    units = base.select(n.alias("__n"), F.explode("units").alias("u"))
    to = blank(F.lit("unit"), F.col("__n"), F.col("u.relation"), F.col("u.term"))
    more = units.select(F.explode(F.array(F.struct(F.col("__n").alias("s"), F.col("u.relation").alias("p"), to.alias("o")), F.struct(to.alias("s"), lit(TYPE).alias("p"), F.col("u.term").alias("o")))).alias("t")).select("t.*")
    return made.unionByName(more).distinct()


def collapsed(rows: DataFrame, binding: DataFrame | None = None, taxa: DataFrame | None = None) -> DataFrame:
    """(subject, object, negated, qualifiers, extensions, header, lines, n): evidence lines of annotations that say the same (RDF-05, RDF-06).

    rows have with_from, reference, evidence and date. With binding (term) and taxa (id, taxon), the with/from ids of IPI
    annotations to binding terms that are of the subject's taxon move to the header, and so to the key.
    """
    base = rows.withColumn("qualifiers", F.array_sort("qualifiers"))
    if binding is not None and taxa is not None:
        mine = taxa.select(F.col("id").alias("subject"), F.col("taxon").alias("__mine"))
        theirs = taxa.select(F.col("id").alias("__w"), F.col("taxon").alias("__t"))
        keyed = base.withColumn("__row", F.struct(*base.columns))
        ids = keyed.select("__row", "subject", F.explode("with_from").alias("__w")).join(mine, "subject").join(theirs, "__w").filter("__t = __mine").groupBy("__row").agg(F.array_sort(F.collect_set("__w")).alias("__same"))
        hit = keyed.join(F.broadcast(binding.select(F.col("term").alias("object"))).withColumn("__b", F.lit(True)), "object", "left").join(ids, "__row", "left")
        move = F.coalesce(F.col("__b"), F.lit(False)) & (F.col("evidence") == "IPI")
        base = hit.withColumn("header", F.when(move, F.coalesce("__same", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).withColumn("with_from", F.array_except("with_from", "header"))
    else:
        base = base.withColumn("header", F.array().cast("array<string>"))
    line = F.struct("evidence", "reference", "with_from", "date")
    return base.groupBy("subject", "object", "negated", "qualifiers", "extensions", "header").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count("*").alias("n"))


def by_gene(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """rows with gene: the subject's parent (id, parent) if it has one, else itself (RDF-07)."""
    p = parents.groupBy(F.col("id").alias("subject")).agg(F.min("parent").alias("gene"))
    return rows.join(p, "subject", "left").withColumn("gene", F.coalesce("gene", "subject"))


def evidence_dates(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys with the greatest and least date and the greatest import date (RDF-09)."""
    return lines.groupBy(*keys).agg(F.max("date").alias("modified"), F.min("date").alias("created"), F.max("imported").alias("imported"))


def match(triples: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Bindings of the ?variables of triple patterns that all hold, joined in the order given (RDF-10, RDF-14)."""
    out = None
    for s, p, o in patterns:
        cond, cols, seen = F.lit(True), [], {}
        for name, value in (("s", s), ("p", p), ("o", o)):
            if not value.startswith("?"):
                cond = cond & (F.col(name) == value)
            elif value in seen:
                cond = cond & (F.col(name) == F.col(seen[value]))
            else:
                seen[value] = name
                cols.append(F.col(name).alias(value[1:]))
        found = triples.filter(cond).select(*cols).distinct() if cols else triples.filter(cond).select(F.lit(1).alias("__ok")).limit(1)
        if out is None:
            out = found
        else:
            common = [c for c in found.columns if c in out.columns]
            out = out.join(found, common) if common else out.crossJoin(found)  # patterns without a common variable are a product by definition
    return out.distinct()


def filtered_lines(rows: DataFrame, unwanted_evidence: Sequence[str] = (), unwanted_pairs: Sequence[tuple[str, str]] = (), unwanted_properties: Sequence[str] = (), required: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """rows without unwanted evidence, evidence with reference, or properties, and with the required attributes (RDF-11)."""
    keep = F.lit(True)
    if unwanted_evidence:
        keep = keep & ~F.col("evidence").isin(*unwanted_evidence)
    for code, ref in unwanted_pairs:
        keep = keep & ~((F.col("evidence") == code) & (F.col("reference") == ref))
    if unwanted_properties:
        keep = keep & ~F.arrays_overlap(F.transform("properties", lambda x: x["key"]), F.array(*map(F.lit, unwanted_properties)))
    for name, values in (required or {}).items():
        keep = keep & F.col(name).isin(*values)
    return rows.filter(F.coalesce(keep, F.lit(False)))


def named_relations(rows: DataFrame, names: DataFrame, column: str = "relation") -> DataFrame:
    """rows with relation labels as ids (label, id); spaces and underscores are alike; unknown ones are null (RDF-12)."""
    key = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    n = F.broadcast(names.select(key(F.col("label")).alias("__k"), F.col("id").alias("__id")).dropDuplicates(["__k"]))
    return rows.join(n, key(F.col(column)) == F.col("__k"), "left").withColumn(column, F.col("__id")).drop("__k", "__id")


def causal_relations(direct: DataFrame, chains: DataFrame) -> DataFrame:
    """(sub, pred, obj) that chains (pred, first, second) of two relations imply (RDF-12)."""
    a, b = direct.toDF("sub", "first", "mid"), direct.toDF("mid", "second", "obj")
    return a.join(b, "mid").join(F.broadcast(chains), ["first", "second"]).select("sub", "pred", "obj").distinct()


def labelled_search(triples: DataFrame, pattern: str, label: str = "rdfs:label") -> DataFrame:
    """(id, label): subjects whose label matches, whatever the case (RDF-16, SCA-05)."""
    return triples.filter((F.col("p") == label) & F.rlike("o", F.lit(f"(?i){pattern}"))).select(F.col("s").alias("id"), F.col("o").alias("label"))


def ntriples(triples: DataFrame, prefixes: Mapping[str, str], graph: str | None = None) -> DataFrame:
    """(value): N-Triples, or N-Quads with a graph; objects with white space or without a colon are literals (SNK-08)."""


    node = lambda c: F.when(F.startswith(c, F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit("<"), expanded(F.col(c), prefixes), F.lit(">")))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    obj = F.when(F.rlike("o", F.lit(r"^[^\s:]*:\S+$")), node("o")).otherwise(quoted)
    return triples.select(F.concat_ws(" ", node("s"), node("p"), obj, *([F.lit(f"<{graph}>")] if graph else []), F.lit(".")).alias("value"))


def gene_models(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(graph, s, p, o): activity-style triples, one graph for each gene and its products (RDF-07, RDF-08).

    Nodes are named after the gene, so models of genes are disjoint; all genes are made in one plan.
    """
    keyed = by_gene(rows, parents)
    own = {r: F.concat_ws("|", F.col("gene"), F.col(r)) for r in ("subject",)}
    made = activity_models(keyed.withColumn("__subject", F.col("subject")).withColumn("subject", own["subject"]))
    graph = F.when(F.contains("o", F.lit("|")), F.substring_index("o", "|", 1))
    named = made.withColumn("graph", graph).withColumn("o", F.when(graph.isNotNull(), F.regexp_extract("o", r"\|(.*)$", 1)).otherwise(F.col("o")))
    products = named.filter("graph is not null").select("graph", F.col("s").alias("g"))
    owner = products.union(made.join(products, made.o == products.g).select("graph", F.col("s").alias("g"))).distinct()
    owner = owner.union(made.filter("not o like '%|%'").join(owner.toDF("graph", "n"), F.col("s") == F.col("n")).filter("o like '\\_:%'").select("graph", F.col("o").alias("g"))).distinct()
    return named.drop("graph").join(owner, F.col("s") == F.col("g")).select("graph", "s", "p", "o").distinct()


def grouped_values(triples: DataFrame, predicates: Sequence[str], separator: str = "|") -> DataFrame:
    """s and a column for each predicate with its values joined in order, blank without any (RDF-14, RDF-15)."""
    wide = triples.filter(F.col("p").isin(*predicates)).groupBy("s").pivot("p", list(predicates)).agg(F.array_join(F.array_sort(F.collect_set("o")), separator))
    return wide.na.fill("", list(predicates))


def run_sql(triples: DataFrame, body: str) -> DataFrame:
    """A SQL query over the view ``triples`` (s, p, o) (RDF-17)."""
    triples.createOrReplaceTempView("triples")
    return triples.sparkSession.sql(body)


def mapped_ids(triples: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target): ids that a node has by two properties (RDF-18)."""
    a = triples.filter(F.col("p") == source).select("s", F.col("o").alias("source"))
    return a.join(triples.filter(F.col("p") == target).select("s", F.col("o").alias("target")), "s").select("source", "target").distinct()
