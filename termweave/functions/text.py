"""Column expressions over identifiers, labels and tab-separated cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(curie: Column) -> Column:
    """What stands before the last colon; of an http URI what stands before # or else the last slash (ONT-08)."""
    uri = F.when(F.contains(curie, F.lit("#")), F.regexp_extract(curie, "^(.*)#", 1)).otherwise(F.regexp_extract(curie, "^(.*)/", 1))
    return F.when(F.startswith(curie, F.lit("http")), uri).otherwise(F.regexp_extract(curie, "^(.*):", 1))


def fragment(curie: Column) -> Column:
    return F.when(F.startswith(curie, F.lit("http")), F.regexp_extract(curie, "[#/]?([^#/]*)$", 1)).otherwise(F.regexp_extract(curie, "([^:]*)$", 1))


def curie(text: Column) -> Column:
    """struct(namespace, identity, error) split at the first colon (PRS-10); error is null if both sides are there."""
    text = F.trim(text)
    ns, ident = F.regexp_extract(text, "^([^:]*):", 1), F.regexp_extract(text, "^[^:]*:(.*)$", 1)
    error = (
        F.when(text.isNull() | (text == ""), "empty")
        .when(~F.contains(text, F.lit(":")), "no colon")
        .when(ns == "", "no namespace")
        .when(ident == "", "no identity")
        .when(F.rlike(text, F.lit(r"\s")), "white space")
    )
    return F.struct(F.when(error.isNull(), ns).alias("namespace"), F.when(error.isNull(), ident).alias("identity"), error.alias("error"))


def identifier_problem(ident: Column) -> Column:
    """null, or why an identifier is not valid (PRS-21)."""
    return (
        F.when(ident.isNull() | (ident == ""), "empty")
        .when(~F.contains(ident, F.lit(":")), "no colon")
        .when(F.rlike(ident, F.lit("^:")) | F.rlike(ident, F.lit(":$")), "empty side")
        .when(~F.rlike(ident, F.lit("(?i)^doi:")) & F.rlike(ident, F.lit(r"[^.:_\-0-9a-zA-Z]")), "bad character")
    )


def without_double_prefix(ident: Column) -> Column:
    """MGI:MGI:1 as MGI:1 (PRS-28)."""
    return F.regexp_replace(ident, r"^([^:]+):\1:", "$1:")


def conjunctions(cell: Column) -> Column:
    """a|b,c as array of arrays: alternatives of parts that hold together; empties are left out (PRS-11)."""
    parts = F.transform(F.split(cell, r"\|"), lambda x: F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != ""))
    return F.filter(parts, lambda x: F.size(x) > 0)


def conjunctions_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.array_join(x, ",")), "|")


def sorted_conjunctions(cell: Column) -> Column:
    """The same with alternatives and parts in order (PRS-33)."""
    return F.array_sort(F.transform(conjunctions(cell), lambda x: F.array_sort(x)))


def extension_units(cell: Column) -> Column:
    """rel(ID),rel(ID)|... as array of arrays of (relation, term); a part of another form has null fields (PRS-12)."""
    form = r"^([^()]+)\(([^()]+)\)$"
    unit = lambda x: F.struct(F.nullif(F.regexp_extract(x, form, 1), F.lit("")).alias("relation"), F.nullif(F.regexp_extract(x, form, 2), F.lit("")).alias("term"))
    return F.transform(conjunctions(cell), lambda xs: F.transform(xs, unit))


def properties(cell: Column) -> Column:
    """k=v|k=v as array of (key, value); without = the value is null (PRS-13)."""
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("value"))
    return F.transform(F.filter(F.split(cell, r"\|"), lambda x: x != ""), pair)


def padded_cells(cells: Column, width: int, least: int) -> Column:
    """cells cut or filled up to width; null if there are fewer than least (PRS-02)."""
    n = F.size(cells)
    return F.when(n >= width, F.slice(cells, 1, width)).when(n >= least, F.concat(cells, F.array_repeat(F.lit(""), F.lit(width) - n)))


def gaf_date(text: Column) -> Column:
    """A date of eight digits, or one of a few other layouts; null if it is none (PRS-05)."""
    others = [F.try_to_date(text, layout) for layout in ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy")]
    return F.when(F.rlike(text, F.lit("^[0-9]{8}$")), F.try_to_date(text, "yyyyMMdd")).otherwise(F.coalesce(*others))


def iso_date(text: Column) -> Column:
    """struct(year, month, day, time) of an ISO date of ten characters at least, else null (PRS-06)."""
    ok = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}(T.*)?$"))
    return F.when(ok, F.struct(F.substring(text, 1, 4).alias("year"), F.substring(text, 6, 2).alias("month"), F.substring(text, 9, 2).alias("day"), F.substring(text, 12, 100).alias("time")))


def contracted(uri: Column, prefixes: Mapping[str, str]) -> Column:
    """The shortest CURIE that prefixes (name to URI stem) allow, or the URI itself (RDF-01, SCA-20)."""
    forms = [F.when(F.startswith(uri, F.lit(stem)), F.concat(F.lit(f"{name}:"), F.substring(uri, len(stem) + 1, 1 << 20))) for name, stem in sorted(prefixes.items())]
    short = F.array_compact(F.array(*forms)) if forms else F.array().cast("array<string>")
    best = F.array_min(F.transform(short, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))
    return F.coalesce(best["x"], uri)


def expanded(curie_col: Column, prefixes: Mapping[str, str]) -> Column:
    """The URI of a CURIE; characters that a URI can't hold become _ (RDF-01)."""
    stems = F.create_map(*(F.lit(x) for kv in sorted(prefixes.items()) for x in kv)) if prefixes else F.create_map().cast("map<string,string>")
    stem = F.element_at(stems, F.substring_index(curie_col, ":", 1))
    return F.when(stem.isNull(), curie_col).otherwise(F.concat(stem, F.regexp_replace(F.regexp_extract(curie_col, "^[^:]*:(.*)$", 1), r"[\s<>\"{}|\\^`]", "_")))


def obo_curie(uri: Column) -> Column:
    """http://.../GO_0001 as GO:0001 (SCA-03)."""
    return F.regexp_replace(F.regexp_extract(uri, "([^/#]+)$", 1), "^([^_]*)_", "$1:")


#: Tokens that stand for others when labels are compared; an empty string drops the token.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
STOP = {"a": "", "of": "", "the": "", "in": "", "and": "", "or": "", "to": "", "by": ""}


def standard_label(label: Column) -> Column:
    """camelCase parted, lower case (LEX-03)."""
    return F.lower(F.regexp_replace(label, "([a-z])([A-Z])", "$1 $2"))


def normal_label(label: Column, synonyms: Mapping[str, str] | None = None) -> Column:
    """Distinct word tokens, mapped, empties dropped, sorted; tokens that a mapping makes equal both stay (LEX-04)."""
    synonyms = ROMAN | STOP if synonyms is None else synonyms
    tokens = F.array_distinct(F.split(F.regexp_replace(label, r"[\W_]+", " "), " "))
    if synonyms:
        by = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv))
        tokens = F.transform(tokens, lambda t: F.coalesce(F.element_at(by, t), t))
    return F.array_join(F.array_sort(F.filter(tokens, lambda t: t != "")), " ")


def abbreviated(label: Column) -> Column:
    """Whether the leading run of capitals takes a third of the label at least (SCA-08)."""
    return F.char_length(F.regexp_extract(label, "^[A-Z]+", 0)) * 3 >= F.char_length(label)


def logit(p: Column) -> Column:
    return F.log2(p / (1 - p))


def inv_logit(w: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -w))


def longest_highlight(texts: Column) -> Column:
    """Of texts with <em> marks the one with most marked text, tags removed; null if none has a mark (GLR-31)."""
    marked = F.transform(texts, lambda t: F.struct(F.aggregate(F.regexp_extract_all(t, F.lit("(?s)<em>(.*?)</em>"), 1), F.lit(0), lambda a, x: a + F.char_length(x)).alias("n"), F.regexp_replace(t, "</?[a-zA-Z]+>", "").alias("text")))
    best = F.array_max(marked)
    return F.when(best["n"] > 0, best["text"])


def any_of(col: Column, values: Sequence) -> Column:
    return col.isin(*values) if values else F.lit(False)
