"""From lines of association and entity files to annotations and messages (PRS-01 to PRS-35).

Every step is a projection; a line that can't be used keeps its place and gets a message, so counts add up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

GAF_COLUMNS = ("db", "db_object_id", "symbol", "qualifier", "term", "reference", "evidence", "with_from", "aspect", "name", "synonym", "type", "taxon", "date", "assigned_by", "extension", "isoform")
GPAD_COLUMNS = ("db", "db_object_id", "qualifier", "term", "reference", "evidence", "with_from", "interacting_taxon", "date", "assigned_by", "extension", "properties")
GPAD2_COLUMNS = ("subject", "negation", "relation", "term", "reference", "evidence", "with_from", "interacting_taxon", "date", "assigned_by", "extension", "properties")
GPI_COLUMNS = ("db", "db_object_id", "symbol", "name", "synonym", "type", "taxon", "parent", "xref", "properties")
GPI2_COLUMNS = ("id", "symbol", "name", "synonym", "type", "taxon", "encoded_by", "parent", "complex_members", "xref", "properties")
HPOA_COLUMNS = ("db", "db_object_id", "symbol", "qualifier", "term", "reference", "evidence", "onset", "frequency", "with_from", "aspect", "synonym", "date", "assigned_by")
#: Fixed values: (columns, least columns) by format and version; an unknown version is the first one.
LAYOUTS = {
    "gaf": {"2.1": (GAF_COLUMNS, 15), "2.2": (GAF_COLUMNS, 15)},
    "gpad": {"1.2": (GPAD_COLUMNS, 10), "2.0": (GPAD2_COLUMNS, 10)},
    "gpi": {"1.2": (GPI_COLUMNS, 7), "2.0": (GPI2_COLUMNS, 7)},
    "hpoa": {"1.0": (HPOA_COLUMNS, 14)},
}
#: The relation that an aspect implies.
DEFAULT_RELATION = {"C": "located_in", "P": "involved_in", "F": "enables"}
HPO_RELATION = {"O": "has_phenotype", "I": "has_inheritance", "M": "has_modifier", "C": "has_onset"}
#: Qualifiers that version 2.1 and version 2.2 allow, besides NOT.
QUALIFIERS_21 = ("contributes_to", "colocalizes_with")
QUALIFIERS_22 = (
    "enables", "contributes_to", "involved_in", "acts_upstream_of", "acts_upstream_of_positive_effect", "acts_upstream_of_negative_effect",
    "acts_upstream_of_or_within", "acts_upstream_of_or_within_positive_effect", "acts_upstream_of_or_within_negative_effect",
    "located_in", "part_of", "is_active_in", "colocalizes_with",
)
VERSION = r"!(\w+)-version:\s*(\d+\.\d+(\.\d+)?)"


def header_version(lines: DataFrame, kind: str) -> str:
    """The version that a header line (value) names, or the format's first one (PRS-01). Reads headers only."""
    layout = LAYOUTS[kind]
    found = lines.filter(F.startswith("value", F.lit("!"))).select(F.lower(F.regexp_extract("value", VERSION, 1)).alias("k"), F.regexp_extract("value", VERSION, 2).alias("v"))
    row = found.filter(F.col("k") == kind).agg(F.min("v").alias("v")).first()
    return row.v if row.v in layout else next(iter(layout))


def cells(lines: DataFrame, kind: str, version: str) -> DataFrame:
    """Named, trimmed cells of data lines (value), with n_cells and problem: too few cells, or some too many (PRS-02)."""
    names, least = LAYOUTS[kind][version]
    row = lines.filter(~F.startswith("value", F.lit("!")) & (F.trim("value") != ""))
    row = row.withColumn("__c", F.transform(F.split("value", "\t", -1), lambda x: F.trim(x)))
    full = text.padded_cells(F.col("__c"), len(names), least)
    problem = F.when(full.isNull(), "too few columns").when(F.size("__c") > len(names), "too many columns")
    keep = [c for c in lines.columns if c not in names]
    return row.select(*keep, F.size("__c").alias("n_cells"), problem.alias("problem"), full.alias("__f")).select(*keep, "n_cells", "problem", *(F.get("__f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def required(rows: DataFrame, names: Sequence[str], no_pipe: Sequence[str] = ()) -> Column:
    """The first required cell that is empty, or cell that holds |, as a message (PRS-03)."""
    tests = [F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(f"{n} is empty")) for n in names]
    tests += [F.when(F.contains(F.col(n), F.lit("|")), F.lit(f"{n} holds |")) for n in no_pipe]
    return F.coalesce(*tests)


def taxa(cell: Column) -> Column:
    """One or two taxon ids as array, the second of an interacting organism; null unless each is a positive number (PRS-04)."""
    ids = F.transform(F.split(cell, r"\|"), lambda x: F.regexp_extract(x, r"^(?:[tT]axon|NCBITaxon):([0-9]+)$", 1))
    ok = (F.size(ids) <= 2) & F.forall(ids, lambda x: (x != "") & ~F.rlike(x, F.lit("^0+$")))
    return F.when(ok, F.transform(ids, lambda x: F.concat(F.lit("NCBITaxon:"), x)))


def qualifiers(cell: Column, aspect: Column) -> Column:
    """(negated, relation, qualifiers) of a qualifier cell; without a relation the aspect's (PRS-07)."""
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(parts, lambda x: F.upper(x) != "NOT")
    default = F.element_at(F.create_map(*(F.lit(x) for kv in DEFAULT_RELATION.items() for x in kv)), aspect)
    return F.struct(F.exists(parts, lambda x: F.upper(x) == "NOT").alias("negated"), F.coalesce(F.get(rest, F.lit(0)), default).alias("relation"), rest.alias("qualifiers"))


def qualifier_problem(cell: Column, version: str) -> Column:
    """What is wrong with a qualifier cell in a version (PRS-08): 2.1 takes up to two items, 2.2 one or two, one of them a relation."""
    allowed = QUALIFIERS_21 if version == "2.1" else QUALIFIERS_22
    parts = F.filter(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: x != "")
    odd = F.array_except(parts, F.array(F.lit("NOT"), *map(F.lit, allowed)))
    few = F.lit(False) if version == "2.1" else F.size(F.filter(parts, lambda x: x != "NOT")) != 1
    return F.when(F.size(odd) > 0, "unknown qualifier").when(F.size(parts) > 2, "too many qualifiers").when(few, "one relation is needed")


def cardinality_problem(cell: Column, least: int, most: int | None = None) -> Column:
    """Too few or too many items in a | list (PRS-09)."""
    n = F.size(F.filter(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: x != ""))
    return F.when(n < least, "too few items").when(n > most if most is not None else F.lit(False), "too many items")


def identifier_list(cell: Column) -> Column:
    """The ids of a | list in order, or null if one isn't valid (PRS-22)."""
    ids = F.array_sort(F.filter(F.transform(F.split(cell, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.forall(ids, lambda x: text.identifier_problem(x).isNull()), ids)


def evidence_classes(rows: DataFrame, codes: DataFrame, reference: str = "reference") -> DataFrame:
    """rows with eco: the class of code and reference, else the code's default (PRS-14). codes: code, ref (null: default), cls."""
    exact = F.broadcast(codes.filter("ref is not null").select(F.col("code").alias("__c1"), F.col("ref").alias("__r1"), F.col("cls").alias("__e1")).dropDuplicates(["__c1", "__r1"]))
    other = F.broadcast(codes.filter("ref is null").select(F.col("code").alias("__c2"), F.col("cls").alias("__e2")).dropDuplicates(["__c2"]))
    met = rows.join(exact, (F.col("evidence") == F.col("__c1")) & (F.col(reference) == F.col("__r1")), "left").join(other, F.col("evidence") == F.col("__c2"), "left")
    return met.withColumn("eco", F.coalesce("__e1", "__e2")).drop("__c1", "__r1", "__e1", "__c2", "__e2")


def evidence_codes(rows: DataFrame, codes: DataFrame, derived: DataFrame) -> DataFrame:
    """rows with code of eco: that of the table, else of the derived one (cls, code) (PRS-15)."""
    one = F.broadcast(codes.groupBy(F.col("cls").alias("eco")).agg(F.min("code").alias("__a")))
    two = F.broadcast(derived.groupBy(F.col("cls").alias("eco")).agg(F.min("code").alias("__b")))
    return rows.join(one, "eco", "left").join(two, "eco", "left").withColumn("code", F.coalesce("__a", "__b")).drop("__a", "__b")


def with_entities(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """rows whose subject is an entity (id, label, type, taxon) with its label, type and taxon (PRS-17)."""
    new = [c for c in ("label", "type", "taxon") if c in entities.columns]
    e = entities.select(F.col("id").alias("subject"), *(F.col(c).alias(f"__{c}") for c in new))
    met = rows.join(e, "subject", "left")
    return met.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in rows.columns else F.col(f"__{c}") for c in new}).drop(*(f"__{c}" for c in new))


def repaired_terms(rows: DataFrame, nodes: DataFrame, replacements: DataFrame, column: str = "term", repair: bool = True) -> DataFrame:
    """rows with the term repaired, rule, level and drop (PRS-18).

    Unknown: kept, warning 27. Obsolete: replaced by its only replacement, warning 20; else dropped, error 20.
    nodes: id, deprecated; replacements: id, replacements.
    """
    n = nodes.select(F.col("id").alias(column), F.coalesce("deprecated", F.lit(False)).alias("__old"))
    r = replacements.select(F.col("id").alias(column), F.when(F.size("replacements") == 1, F.get("replacements", F.lit(0))).alias("__new"))
    met = rows.join(n, column, "left").join(r, column, "left")
    mend = F.col("__old") & F.col("__new").isNotNull() & F.lit(repair)
    rule = F.when(F.col("__old").isNull(), 27).when(F.col("__old"), 20)
    level = F.when(F.col("__old").isNull() | mend, "WARNING").when(F.col("__old"), "ERROR")
    out = met.withColumns({"rule": rule, "level": level, "drop": F.coalesce(F.col("__old") & ~mend, F.lit(False))})
    return out.withColumn(column, F.when(mend, F.col("__new")).otherwise(F.col(column))).drop("__old", "__new")


def repaired_lists(rows: DataFrame, replacements: DataFrame, column: str = "with_from", id_col: str = "row_id") -> DataFrame:
    """rows whose array<array<string>> has obsolete ids replaced where there is one replacement, order kept (PRS-19, PRS-20)."""
    one = replacements.filter(F.size("replacements") == 1).select(F.col("id").alias("__x"), F.get("replacements", F.lit(0)).alias("__y"))
    flat = rows.select(id_col, F.posexplode(column).alias("i", "part")).select(id_col, "i", F.posexplode("part").alias("j", "__x"))
    met = flat.join(one, "__x", "left").select(id_col, "i", F.struct("j", F.coalesce("__y", "__x").alias("x")).alias("v"))
    parts = met.groupBy(id_col, "i").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    whole = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "vs"))).alias("__all"))
    lists = F.transform("__all", lambda p: F.transform(p["vs"], lambda v: v["x"]))
    return rows.join(whole, id_col, "left").withColumn(column, F.coalesce(lists, F.array().cast("array<array<string>>"))).drop("__all")


def upgraded_qualifiers(rows: DataFrame) -> DataFrame:
    """rows with a relation where 2.1 had none, by root, aspect and complex (PRS-23). rows have in_complex."""
    rel = (
        F.when(F.col("term") == "GO:0008150", "involved_in")
        .when(F.col("term") == "GO:0008372", "is_active_in")
        .when(F.col("in_complex"), "part_of")
        .when(F.col("aspect") == "F", "enables")
        .when(F.col("aspect") == "P", "acts_upstream_of_or_within")
        .when(F.col("aspect") == "C", "located_in")
    )
    return rows.withColumn("relation", F.coalesce(F.nullif(F.col("relation"), F.lit("")), rel))


def canonical_spaces(rows: DataFrame, spaces: DataFrame, column: str = "subject") -> DataFrame:
    """rows with the canonical prefix of spaces (prefix, canonical), and known_space (PRS-24)."""
    s = F.broadcast(spaces.select(F.col("prefix").alias("__p"), F.col("canonical").alias("__q")).dropDuplicates(["__p"]))
    met = rows.join(s, F.substring_index(column, ":", 1) == F.col("__p"), "left")
    mended = F.concat("__q", F.regexp_extract(column, "^[^:]*(:.*)$", 1))
    return met.withColumn("known_space", F.col("__q").isNotNull()).withColumn(column, F.when(F.col("__q").isNotNull(), mended).otherwise(F.col(column))).drop("__p", "__q")


def allowed(rows: DataFrame, taxa_list: Sequence[str] | None = None, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """rows of valid taxa and wanted relations (PRS-25, PRS-26)."""
    out = rows if taxa_list is None else rows.filter(F.get("taxa", F.lit(0)).isin(*taxa_list))
    out = out if include is None else out.filter(F.col("relation").isin(*include))
    return out if exclude is None else out.filter(~F.col("relation").isin(*exclude))


def skim(rows: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(subject, label, term) of rows (cells), without NOT and excluded qualifiers, and with valid ids (PRS-27)."""
    subject = text.without_double_prefix(F.concat_ws(":", "db", "db_object_id"))
    parts = F.split(F.coalesce("qualifier", F.lit("")), r"\|")
    kept = rows.filter(~F.exists(parts, lambda x: (F.upper(x) == "NOT") | x.isin(*exclude or ("NOT",))))
    return kept.select(subject.alias("subject"), F.col("symbol").alias("label"), "term").filter(text.identifier_problem(F.col("subject")).isNull() & text.identifier_problem(F.col("term")).isNull())


def annotations(rows: DataFrame, kind: str, version: str) -> DataFrame:
    """The model of a line (cells): subject, relation, negated, lists and dates; problem says why a line can't be used."""
    if kind == "gpad" and version == "2.0":
        subject, q = F.col("subject"), F.struct((F.upper("negation") == "NOT").alias("negated"), F.col("relation").alias("relation"), F.array(F.col("relation")).alias("qualifiers"))
        need, date = ("subject", "relation", "term", "reference", "evidence", "date", "assigned_by"), F.to_date(F.concat_ws("-", *(text.iso_date(F.col("date"))[x] for x in ("year", "month", "day"))))
    else:
        aspect = F.col("aspect") if "aspect" in rows.columns else F.lit(None).cast("string")
        subject, q = F.concat_ws(":", "db", "db_object_id"), qualifiers(F.col("qualifier"), aspect)
        if kind == "hpoa":
            rel = F.element_at(F.create_map(*(F.lit(x) for kv in HPO_RELATION.items() for x in kv)), aspect)
            q = F.struct(q["negated"].alias("negated"), rel.alias("relation"), q["qualifiers"].alias("qualifiers"))
        need = tuple(c for c in ("db", "db_object_id", "symbol", "term", "reference") if c in rows.columns)
        date = text.gaf_date(F.col("date"))
    taxon = F.col("taxon") if "taxon" in rows.columns else F.lit("taxon:9606") if kind == "hpoa" else F.lit(None).cast("string")
    out = rows.withColumns({"__s": text.without_double_prefix(subject), "__q": q, "__d": date, "__t": taxa(taxon)})
    bad = F.coalesce(
        F.when(F.col("problem") == "too few columns", F.col("problem")),
        required(rows, need, ("symbol",) if "symbol" in rows.columns else ()),
        F.when((F.col("date") != "") & F.col("__d").isNull(), "date can't be read"),
        F.when(taxon.isNotNull() & F.col("__t").isNull(), "taxon can't be read"),
        text.identifier_problem(F.col("__s")),
        text.identifier_problem(F.col("term")),
    )
    fixed = {"subject", "relation", "negated", "qualifiers", "taxa", "references", "with_from", "extensions", "date", "problem", *(n for ns, _ in LAYOUTS[kind].values() for n in ns)}
    keep = [c for c in rows.columns if c not in fixed]
    opt = lambda c: [F.col(c)] if c in rows.columns else []
    ext = text.extension_units(F.col("extension")) if "extension" in rows.columns else F.array().cast("array<array<struct<relation:string,term:string>>>")
    return out.select(
        *keep, F.col("__s").alias("subject"), *(F.col("symbol").alias("label"),) * ("symbol" in rows.columns), F.col("__q.relation").alias("relation"), F.col("__q.negated").alias("negated"), F.col("__q.qualifiers").alias("qualifiers"),
        "term", F.filter(F.split("reference", r"\|"), lambda x: x != "").alias("references"), "evidence", text.conjunctions(F.col("with_from")).alias("with_from"),
        *opt("aspect"), *opt("name"), *opt("synonym"), *opt("type"), F.col("__t").alias("taxa"), F.col("__d").alias("date"), "assigned_by", ext.alias("extensions"), *opt("isoform"), *opt("properties"), bad.alias("problem"),
    )


def counters(rows: DataFrame) -> DataFrame:
    """(lines, associations, skipped) (PRS-35)."""
    return rows.agg(F.count("*").alias("lines"), F.count_if(F.col("problem").isNull()).alias("associations"), F.count_if(F.col("problem").isNotNull()).alias("skipped"))


def mapped_to_subset(rows: DataFrame, slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each class that the term maps to, rows whose term maps to none) (PRS-29). slim: id, slim."""
    m = slim.filter("slim is not null").select(F.col("id").alias("term"), "slim")
    return rows.join(m, "term").withColumn("term", F.col("slim")).drop("slim"), rows.join(m, "term", "left_anti")


def entities_of(rows: DataFrame) -> DataFrame:
    """Distinct entities of annotations: the bridge from associations to entities (PRS-30)."""
    cols = [c for c in ("label", "name", "synonym", "type", "taxa") if c in rows.columns]
    return rows.groupBy(F.col("subject").alias("id")).agg(*(F.min(c).alias(c) for c in cols))


def isoforms_to_genes(rows: DataFrame, entities: DataFrame, prefix: str = "PR") -> DataFrame:
    """rows whose subject has the prefix with the gene that encodes it; isoform keeps the subject (PRS-31). entities: id, encoded_by, label."""
    iso = entities.select(F.col("id").alias("subject"), F.get("encoded_by", F.lit(0)).alias("__gene"))
    genes = entities.select(F.col("id").alias("__gene"), F.col("label").alias("__label"))
    met = rows.join(iso, "subject", "left").join(genes, "__gene", "left")
    move = F.startswith("subject", F.lit(f"{prefix}:")) & F.col("__gene").isNotNull()
    out = met.withColumn("isoform", F.when(move, F.col("subject")).otherwise(F.col("isoform") if "isoform" in rows.columns else F.lit(None).cast("string")))
    if "label" in rows.columns:
        out = out.withColumn("label", F.when(move, F.coalesce("__label", "label")).otherwise(F.col("label")))
    return out.withColumn("subject", F.when(move, F.col("__gene")).otherwise(F.col("subject"))).drop("__gene", "__label")


def merged_entities(one: DataFrame, two: DataFrame) -> DataFrame:
    """Entities of both; two's fields hold, but its blank label is filled from one (PRS-32)."""
    cols = [c for c in one.columns if c != "id"]
    met = one.toDF(*(f"a_{c}" for c in one.columns)).join(two.select("id", *cols).toDF("b_id", *(f"b_{c}" for c in cols)), F.col("a_id") == F.col("b_id"), "full_outer")
    there = F.col("b_id").isNotNull()
    pick = {c: F.when(there & ~((F.lit(c) == "label") & (F.coalesce(F.col("b_label"), F.lit("")) == "")), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")) for c in cols}
    return met.select(F.coalesce("b_id", "a_id").alias("id"), *(v.alias(c) for c, v in pick.items()))


def syntax_problems(ids: DataFrame, spaces: DataFrame) -> DataFrame:
    """(id, ok): whether an id has the form that its database states; true for unknown databases (PRS-21). spaces: database, id_syntax."""
    local = F.regexp_extract("id", "^[^:]*:(.*)$", 1)
    met = ids.join(F.broadcast(spaces), F.substring_index("id", ":", 1) == F.col("database"), "left")
    hit = F.expr("rlike(regexp_extract(id, '^[^:]*:(.*)$', 1), concat('^(', id_syntax, ')$'))")
    return met.withColumn("__l", local).groupBy("id").agg(F.max(F.coalesce(hit, F.col("id_syntax").isNull())).alias("ok"))


def typed(label: Column, types: Mapping[str, str], default: str = "CHEBI:33695") -> Column:
    """The id of a type label; an unknown label is a gene product (PRS-16)."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in types.items() for x in kv)), label), F.lit(default))
