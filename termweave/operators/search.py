"""Faceted search over association documents (GLR-01 to GLR-37).

A document has subject, object, relation, and may have their closures as arrays, categories, taxon, evidence and so on; the
builder turns options into one declarative plan, so filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fisher

#: Facets are the 25 most frequent values that occur at all.
FACET_LIMIT, FACET_MIN = 25, 1
#: The pairs of names that an inversion swaps.
SWAPPED = (("subject", "object"), ("subject_closure", "object_closure"), ("subject_category", "object_category"), ("subject_taxon", "object_taxon"), ("subject_label", "object_label"))


def _any(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(*values)


def _overlaps(column: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)))


@dataclass
class AssociationQuery:
    """Options of a search. Lists are alternatives; a leading - of an evidence negates it (GLR-01). non_null fields must be there (GLR-12)."""

    subjects: Sequence[str] = ()
    objects: Sequence[str] = ()
    subject_direct: bool = False
    object_direct: bool = False
    either: Sequence[str] = ()
    subject_category: str | None = None
    object_category: str | None = None
    relation: str | None = None
    taxon: Sequence[str] = ()
    taxon_direct: bool = True
    evidence: str | None = None
    ids: Sequence[str] = ()
    non_null: Sequence[str] = ()
    invert: bool = False
    names: Mapping[str, str | None] = field(default_factory=dict)

    def condition(self) -> Column:
        """A predicate over the documents; names maps a field to another name or, with None, drops its filter (GLR-04)."""
        tests: list[Column] = []

        def add(name: str, make) -> None:
            actual = self.names.get(name, name)
            if actual is not None:
                tests.append(make(actual))

        sub, obj = ("object", "subject") if self.invert else ("subject", "object")
        for values, direct, side in ((self.subjects, self.subject_direct, sub), (self.objects, self.object_direct, obj)):
            if values:
                add(side if direct else f"{side}_closure", lambda c, v=values, d=direct: _any(c, v) if d else _overlaps(c, v))
        for value, side in ((self.subject_category, sub), (self.object_category, obj)):
            if value and not self.either:
                add(f"{side}_category", lambda c, v=value: F.col(c) == v)
        if self.either:  # on one side, the category on the other (GLR-02)
            sides = []
            for mine, other, category in ((sub, obj, self.object_category), (obj, sub, self.object_category)):
                test = _overlaps(f"{mine}_closure", self.either)
                sides.append(test & (F.col(f"{other}_category") == category) if category else test)
            tests.append(sides[0] | sides[1])
        if self.relation:
            add("relation", lambda c: F.col(c) == self.relation)
        if self.taxon:
            add(f"{sub}_taxon" if self.taxon_direct else f"{sub}_taxon_closure", lambda c: _any(c, self.taxon) if self.taxon_direct else _overlaps(c, self.taxon))
        if self.evidence:
            code = self.evidence.removeprefix("-")
            add("evidence", lambda c: F.col(c) != code if self.evidence.startswith("-") else F.col(c) == code)
        if self.ids:
            add("id", lambda c: _any(c, self.ids))
        for name in self.non_null:
            add(name, lambda c: F.col(c).isNotNull())
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def run(self, docs: DataFrame) -> DataFrame:
        found = docs.filter(self.condition())
        return inverted(found) if self.invert else found


def inverted(docs: DataFrame) -> DataFrame:
    """subject and object, and what belongs to them, swapped (GLR-03)."""
    swap = {x: y for a, b in SWAPPED if a in docs.columns and b in docs.columns for x, y in ((a, b), (b, a))}
    return docs.select(*(F.col(swap.get(c, c)).alias(c) for c in docs.columns))


#: The fields that a search returns by default, where documents have them.
DEFAULT_FIELDS = ("id", "subject", "subject_label", "subject_category", "subject_taxon", "relation", "object", "object_label", "object_category", "evidence", "source", "is_defined_by", "qualifier")


def projected(docs: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS, more: Sequence[str] = ()) -> DataFrame:
    """docs with the fields asked for that there are (GLR-05)."""
    return docs.select(*(c for c in (*fields, *more) if c in docs.columns))


def renamed(docs: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return docs.withColumnsRenamed({k: v for k, v in names.items() if k in docs.columns})


def page(docs: DataFrame, order: Sequence[Column | str], start: int = 0, rows: int = 100) -> DataFrame:
    """Sorted rows from start; all of them if rows is negative (GLR-11)."""
    found = docs.orderBy(*order).offset(start)
    return found if rows < 0 else found.limit(rows)


def facets(docs: DataFrame, columns: Sequence[str], limit: int = FACET_LIMIT, least: int = FACET_MIN, limits: Mapping[str, int] | None = None) -> DataFrame:
    """(facet, value, n): the most frequent values of each column, arrays by element; ties by value (GLR-06)."""
    kinds = dict(docs.dtypes)
    parts = F.array(*(F.struct(F.lit(c).alias("facet"), (F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))).alias("vs")) for c in columns))
    counts = docs.select(F.explode(parts).alias("p")).select("p.facet", F.explode("p.vs").alias("value")).filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (limits or {"": 0}).items() for x in kv)), F.col("facet")), F.lit(limit))
    k = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.filter(F.col("n") >= least).withColumn("k", k).filter(F.col("k") <= most).drop("k")


def pivot_facet(docs: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """(a, b, n) (GLR-07)."""
    return docs.groupBy(a, b).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def pivot_matrix(docs: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """a and a column of counts for each value of b (GLR-08)."""
    return docs.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def unique_facet(docs: DataFrame, column: str, of: str) -> DataFrame:
    """(column, n): distinct values of another column (GLR-09)."""
    kind = dict(docs.dtypes)[column]
    value = F.explode(column) if kind.startswith("array") else F.col(column)
    return docs.select(value.alias(column), of).groupBy(column).agg(F.countDistinct(of).alias("n"))


def field_statistics(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, min, max, sum, mean, n, stddev) (GLR-10)."""
    long = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.count("v").alias("n"), F.stddev_samp("v").alias("stddev"))


def distinct_values(docs: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first (GLR-13, GLR-22)."""
    return docs.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def with_slim(docs: DataFrame, slim: Sequence[str], closure: str = "object_closure") -> DataFrame:
    """docs with slim, those of the slim that the object lies under (GLR-14)."""
    return docs.withColumn("slim", F.array_sort(F.array_intersect(F.col(closure), F.array(*map(F.lit, slim)))))


def compact(docs: DataFrame, use_slim: bool = False) -> DataFrame:
    """(subject, relation, objects): distinct objects, or slim terms, of each; negated documents left out (GLR-16)."""
    kept = docs.filter(~F.coalesce("negated", F.lit(False))) if "negated" in docs.columns else docs
    values = kept.select("subject", "relation", F.explode("slim").alias("object")) if use_slim else kept.select("subject", "relation", "object")
    return values.groupBy("subject", "relation").agg(F.array_sort(F.collect_set("object")).alias("objects"))


def slim_groups(docs: DataFrame) -> DataFrame:
    """(subject, slim, objects, n): what stands behind each slim term (GLR-19)."""
    return docs.select("subject", "object", F.explode("slim").alias("slim")).groupBy("subject", "slim").agg(F.array_sort(F.collect_set("object")).alias("objects"), F.count("*").alias("n"))


def nested(docs: DataFrame) -> DataFrame:
    """subject and object as (id, label, category), NOT apart from the relation, evidence labels from their JSON map (GLR-15)."""
    have = set(docs.columns)
    part = lambda s: F.struct(F.col(s).alias("id"), *(F.col(f"{s}_{x}").alias(x) for x in ("label", "category", "taxon") if f"{s}_{x}" in have)).alias(s)
    words = F.split("relation", r"\|")
    out = [F.col("id")] if "id" in have else []
    out += [part("subject"), F.array_join(F.filter(words, lambda w: F.lower(w) != "not"), "|").alias("relation"), F.exists(words, lambda w: F.lower(w) == "not").alias("negated"), part("object")]
    if "evidence_map" in have:
        out.append(F.from_json("evidence_map", "map<string,string>").alias("evidence_labels"))
    return docs.select(*out)


def mapped_id(closure: Column, prefix: str) -> Column:
    """The first id of a closure list that has the prefix (GLR-17)."""
    return F.get(F.filter(closure, lambda x: F.startswith(x, F.lit(prefix))), F.lit(0))


def cooccurrence(inferred: DataFrame, xs: DataFrame, ys: DataFrame, population: int) -> DataFrame:
    """(x, y, n, nx, ny, p_less, p_greater) for terms that share a subject; x is xs' column, y that of ys (GLR-25)."""
    n = inferred.groupBy("term").agg(F.count("*").alias("k"))
    a = inferred.select("subject", F.col("term").alias("x")).join(xs.toDF("x"), "x", "left_semi")
    b = inferred.select("subject", F.col("term").alias("y")).join(ys.toDF("y"), "y", "left_semi")
    c = a.select("subject", "x").join(b, "subject").groupBy("x", "y").agg(F.count("*").alias("n"))
    met = c.join(n.toDF("x", "nx"), "x").join(n.toDF("y", "ny"), "y")
    cells = (F.col("n"), F.col("nx") - F.col("n"), F.col("ny") - F.col("n"), F.lit(population) - F.col("nx") - F.col("ny") + F.col("n"))
    return met.select("x", "y", "n", "nx", "ny", fisher(*cells, "less").alias("p_less"), fisher(*cells, "greater").alias("p_greater"))


def either_side(docs: DataFrame, ids: Sequence[str], category: str | None = None) -> DataFrame:
    """(id, other, relation, flipped): associations of the ids on either side, seen from them (GLR-27)."""
    there = docs.filter(_any("subject", ids)).select(F.col("subject").alias("id"), F.col("object").alias("other"), "relation", F.lit(False).alias("flipped"), *([F.col("object_category").alias("c")] if category else []))
    back = docs.filter(_any("object", ids)).select(F.col("object").alias("id"), F.col("subject").alias("other"), "relation", F.lit(True).alias("flipped"), *([F.col("subject_category").alias("c")] if category else []))
    both = there.unionByName(back)
    return both.filter(F.col("c") == category).drop("c") if category else both


def text_search(docs: DataFrame, query: str, weights: Mapping[str, float], prefixes: Sequence[str] = (), but: Sequence[str] = (), least: float = 0.0, limit: int = 100) -> DataFrame:
    """docs with score, best first: for each field its weight times the share of query words it holds, and once more if it is equal (GLR-28, GLR-29).

    A query with a colon that is a document's id scores highest. prefixes and but keep and leave out databases.
    """
    words = [w for w in query.lower().split() if w]
    score = F.when(F.col("id") == query, 1000.0).otherwise(0.0) if ":" in query else F.lit(0.0)
    for column, weight in weights.items():
        have = F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+")
        hits = sum((F.array_contains(have, w).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
        score = score + weight * hits + F.when(F.lower(F.col(column)) == query.lower(), F.lit(float(weight))).otherwise(0.0)
    found = docs.withColumn("score", score).filter(F.col("score") > least)
    if prefixes:
        found = found.filter(reduce(lambda a, b: a | b, (F.startswith("id", F.lit(f"{p}:")) for p in prefixes)))
    for p in but:
        found = found.filter(~F.startswith("id", F.lit(f"{p}:")))
    return found.orderBy(F.desc("score"), "id").limit(limit)


#: What fields weigh in a search for everyday words.
EVERYDAY_WEIGHTS = {"label": 5.0, "everyday_synonym": 2.0, "description": 1.0, "synonym": 3.0}


def everyday_search(docs: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """text_search over the fields that docs have, everyday synonyms among them (GLR-32)."""
    return text_search(docs, query, {k: v for k, v in EVERYDAY_WEIGHTS.items() if k in docs.columns}, limit=limit)


def autocomplete(docs: DataFrame, typed: str, column: str = "label", limit: int = 20) -> DataFrame:
    """(id, value): values with a word that begins with what is typed, whole values first (GLR-30)."""
    v = F.lower(F.col(column))
    t = typed.lower()
    hit = F.startswith(v, F.lit(t)) | F.exists(F.split(v, " "), lambda w: F.startswith(w, F.lit(t)))
    return docs.filter(hit).select("id", F.col(column).alias("value"), F.startswith(v, F.lit(t)).alias("whole")).orderBy(F.desc("whole"), "value", "id").limit(limit).drop("whole")


def annotate_text(docs: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "text", longest: int | None = None) -> DataFrame:
    """(id, start, end, text, term): where names (term, val) stand in texts (GLR-37), or those of up to ``longest`` words.

    Words are found with their offsets natively; runs of as many words as some name has are joined with the names by their
    lower-case form.
    """
    lower = F.lower(F.col(text_col))
    words = F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spaced = F.regexp_replace(lower, r"[^\p{L}\p{N}]", " ")
    named = names.filter("val is not null").select("term", F.lower("val").alias("gram")).distinct()
    sizes = named.select(F.size(F.split("gram", " ")).alias("n")).distinct()
    sizes = sizes if longest is None else sizes.filter(F.col("n") <= longest)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole"), spaced.alias("spaced"), words.alias("words")).filter(F.size("words") > 0)
    starts = base.select("id", "whole", "spaced", "words").join(F.broadcast(sizes), F.col("n") <= F.size("words"))
    grams = starts.select("id", "whole", "spaced", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))"))).alias("gram"))
    hits = grams.join(named, "gram")
    spans = hits.select("id", "whole", "term", "gram", F.explode(F.expr("filter(transform(sequence(1, length(spaced) - length(gram) + 1), p -> if(substring(concat(' ', spaced, ' '), p, length(gram) + 2) = concat(' ', gram, ' '), p, 0)), p -> p > 0)")).alias("p"))
    return spans.select("id", (F.col("p") - 1).alias("start"), (F.col("p") - 1 + F.char_length("gram")).alias("end"), F.expr("substring(whole, p, length(gram))").alias("text"), "term")


def evidence_table(triples: DataFrame, subject_p: str = "OBAN:association_has_subject", object_p: str = "OBAN:association_has_object", predicate_p: str = "OBAN:association_has_predicate", eco_p: str = "RO:0002558", source_p: str = "dc:source") -> DataFrame:
    """(subject, predicate, object, evidence, publications) of reified associations in triples (s, p, o) (GLR-34)."""
    one = lambda p, name: triples.filter(F.col("p") == p).select("s", F.col("o").alias(name)).distinct()
    met = one(subject_p, "subject").join(one(predicate_p, "predicate"), "s").join(one(object_p, "object"), "s")
    met = met.join(one(eco_p, "eco"), "s", "left").join(one(source_p, "pub"), "s", "left")
    return met.groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set("eco")).alias("evidence"), F.array_sort(F.collect_set("pub")).alias("publications"))


def objects_of(docs: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """(subject, object) (GLR-18)."""
    return docs.filter(_any("subject", subjects)).select("subject", "object").distinct()


def homologs(docs: DataFrame, ids: Sequence[str], relations: Sequence[str] = ("RO:HOM0000017", "RO:HOM0000020", "RO:HOM0000011")) -> DataFrame:
    """(id, other, relation, flipped) of homology relations, whichever side an id is on (GLR-18)."""
    return either_side(docs.filter(_any("relation", relations)), ids)


def top_species(docs: DataFrame, column: str = "subject_taxon") -> DataFrame:
    """(value, n): species by their documents (GLR-20)."""
    return distinct_values(docs.filter(F.col(column).isNotNull()), column)


def bulk(docs: DataFrame, subject_category: str, object_category: str, taxon: str | None = None) -> DataFrame:
    """Compact associations of two categories, of a taxon (GLR-21)."""
    q = AssociationQuery(subject_category=subject_category, object_category=object_category, taxon=[taxon] if taxon else ())
    return compact(q.run(docs))


def merged_options(base: Mapping, change: Mapping) -> dict:
    """Options with lists joined and other values replaced (GLR-33)."""
    return {k: [*base[k], *v] if isinstance(v, list) and isinstance(base.get(k), list) else v for k, v in change.items()} | {k: v for k, v in base.items() if k not in change}


def zipped(docs: DataFrame, keys: str, values: str, out: str) -> DataFrame:
    """docs with a map of two parallel arrays; the last of equal keys holds (GLR-33, SCA-22)."""
    pairs = F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v"))
    last = F.filter(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: x["k"].isNotNull())
    newest = F.filter(last, lambda x: ~F.exists(last, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return docs.withColumn(out, F.map_from_entries(F.transform(newest, lambda x: F.struct(x["k"], x["v"]))))
