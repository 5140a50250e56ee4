"""Writers and renderers (SNK-01 to SNK-16). Each gives a DataFrame with one string column, value, to be written as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import closure as C
from ..operators.ontology import Ontology
from ..operators.parse import QUALIFIERS_21
from ..operators.rules import capped, report_counts


def _s(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _have(columns: Sequence[str], name: str) -> Column:
    return _s(name) if name in columns else F.lit("")


def _extensions() -> Column:
    unit = lambda u: F.concat(u["relation"], F.lit("("), u["term"], F.lit(")"))
    return F.array_join(F.transform("extensions", lambda us: F.array_join(F.transform(us, unit), ",")), "|")


def with_header(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """lines after the header's, in that order once written to one file."""
    spark = lines.sparkSession
    return spark.createDataFrame([(x,) for x in header], "value string").coalesce(1).union(lines)


def gaf_value(columns: Sequence[str], version: str = "2.2") -> Column:
    """A GAF line of the columns of an annotation."""
    rel = F.when(F.col("relation").isin(*QUALIFIERS_21), F.col("relation")) if version == "2.1" else F.col("relation")
    neg = F.when(F.col("negated"), F.lit("NOT"))
    qualifier = F.concat_ws("|", rel, neg) if version == "2.1" else F.concat_ws("|", neg, rel)
    taxon = F.array_join(F.transform("taxa", lambda t: F.regexp_replace(t, "^[^:]*:", "taxon:")), "|")
    have = lambda name: _have(columns, name)
    cols = (
        F.substring_index("subject", ":", 1), F.regexp_extract("subject", "^[^:]*:(.*)$", 1), have("label"), qualifier, _s("term"), F.array_join("references", "|"), _s("evidence"),
        text.conjunctions_text(F.col("with_from")), have("aspect"), have("name"), have("synonym"), have("type"), _s(taxon), _s(F.date_format("date", "yyyyMMdd")), _s("assigned_by"), _extensions(), have("isoform"),
    )
    return F.concat_ws("\t", *map(_s, cols))


def gaf(rows: DataFrame, version: str = "2.2") -> DataFrame:
    """Annotations as GAF lines: 2.1 knows two qualifiers and puts NOT last, 2.2 any relation and NOT first (SNK-01)."""
    return rows.select(gaf_value(rows.columns, version).alias("value"))


def gpad_value(columns: Sequence[str], version: str = "2.0") -> Column:
    """A GPAD line of the columns of an annotation."""
    taxon = F.regexp_replace(_s(F.get("taxa", F.lit(1))), "^[^:]*:", "taxon:" if version == "1.2" else "NCBITaxon:")
    tail = (_s("term"), F.array_join("references", "|"), _s("evidence"), text.conjunctions_text(F.col("with_from")), taxon)
    ends = (_s("assigned_by"), _extensions(), _have(columns, "properties"))
    if version == "1.2":
        neg = F.when(F.col("negated"), F.lit("NOT"))
        cols = (F.substring_index("subject", ":", 1), F.regexp_extract("subject", "^[^:]*:(.*)$", 1), F.concat_ws("|", neg, F.col("relation")), *tail, F.date_format("date", "yyyyMMdd"), *ends)
    else:
        subject = F.coalesce(F.nullif(F.col("isoform"), F.lit("")), F.col("subject")) if "isoform" in columns else F.col("subject")
        cols = (subject, F.when(F.col("negated"), "NOT").otherwise(""), _s("relation"), *tail, F.date_format("date", "yyyy-MM-dd"), *ends)
    return F.concat_ws("\t", *map(_s, cols))


def gpad(rows: DataFrame, version: str = "2.0") -> DataFrame:
    """Annotations as GPAD lines: 1.2 has labels of qualifiers, 2.0 relations, ISO dates and the isoform as subject (SNK-02). properties is text."""
    return rows.select(gpad_value(rows.columns, version).alias("value"))


def gpi(rows: DataFrame, version: str = "2.0") -> DataFrame:
    """Entities as GPI lines (SNK-03)."""
    many = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "|")
    props = F.array_join(F.transform("properties", lambda p: F.concat_ws("=", p["key"], p["value"])), "|")
    if version == "1.2":
        cols = (F.substring_index("id", ":", 1), F.regexp_extract("id", "^[^:]*:(.*)$", 1), "label", "name", many("synonyms"), many("types"), F.regexp_replace("taxon", "^[^:]*:", "taxon:"), many("parents"), many("xrefs"), props)
    else:
        cols = ("id", "label", "name", many("synonyms"), many("types"), "taxon", many("encoded_by"), many("parents"), many("members"), many("xrefs"), props)
    return rows.select(F.concat_ws("\t", *map(_s, cols)).alias("value"))


def as_json(rows: DataFrame) -> DataFrame:
    """One nested JSON object per row (SNK-04)."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def report(found: DataFrame, counters: DataFrame, group: str, dataset: str, most: int = 10_000) -> DataFrame:
    """One JSON object: counts and the first messages of each rule; INFO left out (SNK-05)."""
    some = capped(found, most)
    per = some.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct(*[c for c in some.columns if c != "rule"]))).alias("messages"))
    whole = per.agg(F.map_from_entries(F.collect_list(F.struct(F.lpad(F.col("rule").cast("string"), 7, "0"), "messages"))).alias("messages"))
    return counters.crossJoin(whole).select(F.to_json(F.struct(F.lit(group).alias("group"), F.lit(dataset).alias("dataset"), *counters.columns, "messages")).alias("value"))  # one row by one row


def report_markdown(found: DataFrame, counters: DataFrame, title: str, shown: int = 100) -> str:
    """Summary and a section for each rule, with its first messages (SNK-06)."""
    n = counters.first().asDict()
    rows = report_counts(found).orderBy("rule", "level").collect()
    lines = [f"# {title}", "", *(f"* {k}: {v}" for k, v in n.items()), "", *(f"* rule {r.rule}, {r.level}: {r.n}" for r in rows)]
    first = capped(found, shown).orderBy("rule", "level", "row_id").collect()
    for rule in sorted({r.rule for r in first}):
        lines += ["", f"## Rule {rule}", "", *(f"* {r.level}, line {r.row_id}: {r.message}" for r in first if r.rule == rule)]
    return "\n".join(lines)


def without_evidence(lines: DataFrame, codes: Sequence[str], column: int = 7) -> DataFrame:
    """The file's lines but those with one of the evidence codes (SNK-07)."""
    return lines.filter(F.startswith("value", F.lit("!")) | ~F.coalesce(F.get(F.split("value", "\t", -1), F.lit(column - 1)), F.lit("")).isin(*codes))


def obo(ontology: Ontology) -> DataFrame:
    """(id, value): an OBO stanza for each node, its lines in the usual order (SNK-09)."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = lambda df, k, v: df.select("id", F.lit(k).alias("k"), v.alias("line"))
    label = ontology.labels().toDF("__o", "__l")
    e = ontology.edges.join(label, F.col("obj") == F.col("__o"), "left").withColumn("id", F.col("sub"))
    mark = F.when(F.col("__l").isNotNull(), F.concat(F.lit(" ! "), F.col("__l"))).otherwise("")
    isa = F.col("pred").isin("subClassOf", "subPropertyOf")
    logic = ontology.logical_defs
    parts = [
        line(ontology.nodes.filter("label is not null"), 1, F.concat(F.lit("name: "), "label")),
        line(ontology.definitions, 2, F.concat(F.lit('def: "'), esc(F.col("val")), F.lit('" ['), F.array_join("xrefs", ", "), F.lit("]"))),
        line(ontology.subsets, 3, F.concat(F.lit("subset: "), F.regexp_extract("subset", "([^#]*)$", 1))),
        line(ontology.synonyms, 4, F.concat(F.lit('synonym: "'), esc(F.col("val")), F.lit('" '), F.upper("scope"), F.lit(" []"))),
        line(ontology.xrefs_of(), 5, F.concat(F.lit("xref: "), "xref")),
        line(e.filter(isa), 6, F.concat(F.lit("is_a: "), "obj", mark)),
        line(logic.select("id", F.explode("genus").alias("g")), 7, F.concat(F.lit("intersection_of: "), "g")),
        line(logic.select("id", F.explode("restrictions").alias("r")), 8, F.concat(F.lit("intersection_of: "), "r.property", F.lit(" "), "r.filler")),
        line(e.filter(~isa), 9, F.concat(F.lit("relationship: "), "pred", F.lit(" "), "obj", mark)),
        line(ontology.nodes.filter("deprecated"), 10, F.lit("is_obsolete: true")),
    ]
    body = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    kind = F.when(F.col("type") == "PROPERTY", "[Typedef]").otherwise("[Term]")
    return ontology.nodes.join(body, "id", "left").select("id", F.concat_ws("\n", kind, F.concat(F.lit("id: "), "id"), "body", F.lit("")).alias("value")).orderBy("id")


def obograph(ontology: Ontology) -> DataFrame:
    """One JSON object per node and edge, in the shape of an obograph's lists (SNK-10)."""
    nodes = ontology.nodes.select(F.lit("nodes").alias("list"), F.to_json(F.struct("id", F.col("label").alias("lbl"), "type")).alias("value"))
    edges = ontology.edges.select(F.lit("edges").alias("list"), F.to_json(F.struct("sub", "pred", "obj")).alias("value"))
    return nodes.unionByName(edges)


def tree(ontology: Ontology, relations: Sequence[str] | None = None, most: int | None = None, symbols: Mapping[str, str] | None = None) -> DataFrame:
    """(path, value): each node under each of its parents, indented by depth; a node above itself ends its branch with a mark (SNK-11).

    With ``most``, down to that depth only.
    """
    marks = symbols or {"subClassOf": "%", "BFO:0000050": "<"}
    e = C.with_relations(ontology.edges, relations).select("sub", "pred", "obj").distinct()
    now = ontology.roots(relations).select(F.array("id").alias("path"), F.lit(None).cast("string").alias("pred"), F.lit(False).alias("again"))
    done = now
    for _ in count() if most is None else range(most):
        last = F.element_at("path", -1)
        step = now.filter("not again").select("path").join(e, last == F.col("obj"))
        now = C.cut(step.select(F.concat("path", F.array("sub")).alias("path"), "pred", F.array_contains("path", F.col("sub")).alias("again")))
        if not now.limit(1).count():
            break
        done = done.unionAll(now)
    sign = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in marks.items() for x in kv)), F.col("pred")), F.when(F.col("pred").isNull(), "*").otherwise(F.concat(F.lit("-"), "pred", F.lit("-"))))
    labelled = done.withColumn("id", F.element_at("path", -1)).join(ontology.labels(), "id", "left")
    return labelled.select("path", F.concat(F.repeat(F.lit(" "), (F.size("path") - 1) * 2), sign, F.lit(" "), "id", F.lit(" ! "), _s("label"), F.when(F.col("again"), " (cycle)").otherwise("")).alias("value")).orderBy("path")


def dot(ontology: Ontology) -> DataFrame:
    """Graphviz statements without the enclosing braces (SNK-12)."""
    q = lambda c: F.concat(F.lit('"'), F.replace(_s(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = ontology.nodes.select(F.concat(q("id"), F.lit(" [label="), q("label"), F.lit("];")).alias("value"))
    return nodes.union(ontology.edges.select(F.concat(q("sub"), F.lit(" -> "), q("obj"), F.lit(" [label="), q("pred"), F.lit("];")).alias("value")))


def names(ontology: Ontology) -> DataFrame:
    """id and label lines in order (SNK-12)."""
    return ontology.nodes.orderBy("id").select(F.concat_ws(" ", "id", _s("label")).alias("value"))


def compact(ontology: Ontology) -> DataFrame:
    """Numbered nodes, then for each relation the adjacency of numbers (SNK-16)."""
    ids, lists = ontology.compact()
    first = ids.join(ontology.labels(), "id", "left").select(F.concat_ws("\t", F.lit("N"), "n", "id", _s("label")).alias("value"))
    return first.union(lists.select(F.concat_ws("\t", F.lit("E"), "pred", "n", F.array_join(F.col("parents").cast("array<string>"), ",")).alias("value")))


def merged_lines(valid: DataFrame, mixins: Sequence[DataFrame]) -> DataFrame:
    """Headers first, then all annotation lines; (part, value) (SNK-15)."""
    all_lines = reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("part"), "value") for i, df in enumerate([valid, *mixins])))
    head = F.startswith("value", F.lit("!"))
    return all_lines.filter(head).unionByName(all_lines.filter(~head & (F.trim("value") != "")))


def save_lines(lines: DataFrame, path: str, gzip: bool = False) -> None:
    """As text files; gzip compresses them (SNK-14)."""
    lines.select("value").write.option("compression", "gzip" if gzip else "none").text(path)


def save_table(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """As delimited text with a header (SNK-13)."""
    rows.write.option("header", True).option("sep", sep).csv(path)


def registry() -> dict:
    """Writers by format name, for callers that choose one at run time (UDF-04)."""
    return {"gaf-2.1": lambda r: gaf(r, "2.1"), "gaf-2.2": lambda r: gaf(r, "2.2"), "gpad-1.2": lambda r: gpad(r, "1.2"), "gpad-2.0": lambda r: gpad(r, "2.0"), "json": as_json}
