"""Quality rules over annotations, as data (RUL-*, INF-*).

A rule is an identifier, a mode and a Column that says when an annotation fails; a repairing rule also says which columns it
sets. Rules run in the order of the list, each on what earlier repairs left, up to and including the first error, which
drops the annotation. Failures are bits of one long, so that a row without any costs no array; the rules themselves have no
lambda but for rule 58, so that they stay in generated code.

Annotations have: row_id, subject, subject_type, taxa array, relation, term, aspect, negated, evidence, references array,
with_from array<array>, extensions array<array<(relation, term)>>, assigned_by, date. Facts that need the ontology come in as
columns made beforehand by ``with_flags``, so that a rule is an expression and never a join of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HARD, SOFT = "ERROR", "WARNING"
ROOTS = {"P": "GO:0008150", "F": "GO:0003674", "C": "GO:0005575"}
NAMESPACES = {"biological_process": "P", "molecular_function": "F", "cellular_component": "C"}
BINDING = ("GO:0005488", "GO:0005515")
#: Evidence that binding may not have, that is inferred by similarity, and that isn't from experiments.
COMPUTATIONAL = ("IEA", "ISS", "ISO", "ISM", "ISA", "IBA", "RCA")
SIMILARITY = ("ISS", "ISA", "ISO")
NOT_EXPERIMENTAL = ("IBA", "IKR", "IRD", "IC", "ISA", "ISM", "ISO", "ISS", "NAS", "RCA", "TAS", "ND", "IEA")
#: Identifiers of relations by their labels.
RELATIONS = {
    "enables": "RO:0002327", "contributes_to": "RO:0002326", "involved_in": "RO:0002331", "acts_upstream_of_or_within": "RO:0002264",
    "acts_upstream_of_or_within_positive_effect": "RO:0004032", "acts_upstream_of_or_within_negative_effect": "RO:0004033", "acts_upstream_of": "RO:0002263",
    "acts_upstream_of_positive_effect": "RO:0004034", "acts_upstream_of_negative_effect": "RO:0004035", "part_of": "BFO:0000050", "located_in": "RO:0001025",
    "is_active_in": "RO:0002432", "colocalizes_with": "RO:0002325",
}
#: The relations that each kind of term allows, and the one that others become.
ALLOWED_RELATIONS = {
    "function root": (("enables",), "enables"),
    "function": (("enables", "contributes_to"), "enables"),
    "process root": (("involved_in",), "involved_in"),
    "process": (("involved_in", "acts_upstream_of_or_within", "acts_upstream_of_or_within_positive_effect", "acts_upstream_of_or_within_negative_effect", "acts_upstream_of", "acts_upstream_of_positive_effect", "acts_upstream_of_negative_effect"), "acts_upstream_of_or_within"),
    "component root": (("is_active_in",), "is_active_in"),
    "complex": (("part_of",), "part_of"),
    "anatomical": (("located_in", "is_active_in", "colocalizes_with"), "located_in"),
}
NOT_MANUAL, NOT_ANNOTATE, CANDIDATE = "gocheck_do_not_manually_annotate", "gocheck_do_not_annotate", "gocheck_obsoletion_candidate"
#: The roots of each flag, and whether what lies below them by part_of counts beside subclasses.
FLAG_ROOTS = {
    "catalytic": {"GO:0003824": False},
    "complex": {"GO:0032991": False},
    "self_binding": {"GO:0042803": False, "GO:0051260": False, "GO:0051289": False, "GO:0070207": False, "GO:0043621": False, "GO:0032840": False},
    "multi_organism": {"GO:0044419": True, "GO:0043903": False, "GO:0018995": False},
    "anatomical": {"GO:0110165": False, "GO:0044423": False},
}
#: Rules that one run can hold: a bit of a long each. More are run on what the first run gives.
MOST_RULES = 63


@dataclass(frozen=True)
class Rule:
    """A rule as data: others may be added to the list that ``run`` gets; none needs a Python function over rows (UDF-01)."""

    id: int
    title: str
    mode: str
    fails: Callable[[], Column]
    sets: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    message: str = ""
    tag: str | None = None
    level: Callable[[], Column] | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _ev(*codes: str) -> Column:
    """code is the evidence, or blank where its reference makes it another class than the code's usual one."""
    return F.col("code").isin(*codes)


def _no_with() -> Column:
    return F.size("with_from") == 0


def _names_itself() -> Column:
    return F.array_contains(F.flatten("with_from"), F.col("subject"))


def _age(days: int, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col("date")) > days


def _another_term() -> Column:
    """Whether with/from holds a GO term that isn't the annotated one. Each item stands between tabs of its own."""
    items = F.concat(F.lit("\t"), F.array_join(F.flatten("with_from"), "\t\t"), F.lit("\t"))
    return F.startswith("term", F.lit("GO:")) & F.contains(F.replace(items, F.concat(F.lit("\t"), F.col("term"), F.lit("\t")), F.lit("")), F.lit("\tGO:"))


def _repeated_space() -> Column:
    spaces = F.split(F.regexp_replace(F.array_join("references", "\t"), ":[^\t]*", ""), "\t")
    return F.size(F.array_distinct(spaces)) < F.size(spaces)


def _kind() -> Column:
    """The key of ALLOWED_RELATIONS for the term, or null: terms without a branch and other components are left alone."""
    root = {"function root": "F", "process root": "P", "component root": "C"}
    out = F.when(_c("term_aspect") == "C", F.when(_c("in_complex"), "complex").when(_c("in_anatomical"), "anatomical"))
    out = F.when(_c("term_aspect") == "F", "function").when(_c("term_aspect") == "P", "process").otherwise(out)
    for name, aspect in root.items():
        out = F.when(_c("term") == ROOTS[aspect], name).otherwise(out)
    return out


def _literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def _relation_label() -> Column:
    return F.coalesce(F.element_at(_literal_map({v: k for k, v in RELATIONS.items()}), F.col("relation")), F.col("relation"))


def _wrong_relation() -> Column:
    pairs = [f"{kind}\t{r}" for kind, (allowed, _) in ALLOWED_RELATIONS.items() for r in allowed]
    return _kind().isNotNull() & ~F.concat_ws("\t", _kind(), _relation_label()).isin(*pairs)


def _right_relation() -> Column:
    """As a label, or as an identifier where the annotation has one."""
    label = F.element_at(_literal_map({kind: r for kind, (_, r) in ALLOWED_RELATIONS.items()}), _kind())
    return F.when(F.contains("relation", F.lit(":")), F.element_at(_literal_map(RELATIONS), label)).otherwise(label)


def standard_rules(as_of: str = "2024-01-01", retracted: Sequence[str] = (), old_refs: Sequence[str] = (), reference_taxa: Sequence[str] = (), ref_evidence: Mapping[str, Sequence[str]] | None = None, paint: bool = False) -> list[Rule]:
    """The registered rules in their order; 13 is last. as_of stands for today."""
    combos = F.lit(False)
    for ref, codes in (ref_evidence or {}).items():
        combos = combos | (F.array_contains("references", ref) & ~F.col("evidence").isin(*codes))
    refers_to = lambda refs: F.arrays_overlap("references", F.array(*map(F.lit, refs))) if refs else F.lit(False)
    complexes = F.startswith("subject", F.lit("ComplexPortal:")) & (F.coalesce("subject_type", F.lit("")) != "")
    return [
        Rule(2, "no NOT to protein binding", HARD, lambda: _c("term").isin(*BINDING) & _c("negated")),
        Rule(5, "no computational evidence for binding", SOFT, lambda: _c("term").isin(*BINDING) & _ev(*COMPUTATIONAL)),
        Rule(6, "expression pattern evidence for processes only", HARD, lambda: _ev("IEP", "HEP") & ~_c("assigned_by").eqNullSafe("GOC") & ~_c("term_aspect").eqNullSafe("P")),
        Rule(7, "no IPI with catalytic activity", SOFT, lambda: _ev("IPI") & _c("in_catalytic")),
        Rule(8, "no annotation to high-level terms", SOFT, lambda: F.array_contains("term_subsets", NOT_ANNOTATE) | (~_ev("IEA") & F.array_contains("term_subsets", NOT_MANUAL))),
        Rule(11, "ND with roots and only with them", HARD, lambda: _ev("ND") != _c("term").isin(*ROOTS.values())),
        Rule(15, "two taxa need a suitable term", SOFT, lambda: (F.size("taxa") > 1) & (~_c("in_multi_organism") | (F.get("taxa", F.lit(0)) == F.get("taxa", F.lit(1))))),
        Rule(16, "IC needs another term in with/from", SOFT, lambda: _ev("IC") & ~_another_term()),
        Rule(17, "IDA has no with/from", SOFT, lambda: _ev("IDA") & ~_no_with()),
        Rule(18, "IPI needs with/from", SOFT, lambda: _ev("IPI") & _no_with()),
        Rule(22, "no retracted publication", HARD, lambda: refers_to(retracted)),
        Rule(26, "IBA from phylogenetic annotation only", HARD, lambda: _ev("IBA") & F.lit(not paint)),
        Rule(28, "aspect is the term's", HARD, lambda: _c("term_aspect").isNotNull() & ~_c("aspect").eqNullSafe(_c("term_aspect")), {"aspect": lambda: _c("term_aspect")}, level=lambda: F.lit(SOFT)),
        Rule(29, "no old IEA", HARD, lambda: _ev("IEA") & _age(365, as_of), level=lambda: F.when(_age(1095, as_of), HARD).otherwise(SOFT)),
        Rule(30, "no deprecated reference", SOFT, lambda: refers_to(old_refs)),
        Rule(37, "IBA by its group and reference", HARD, lambda: _ev("IBA") & ~(_c("assigned_by").eqNullSafe("GO_Central") & F.array_contains("references", "GO_REF:0000033"))),
        Rule(39, "no complex to a complex term", HARD, lambda: (_c("term_aspect") == "C") & _c("in_complex") & (complexes | _c("subject_type").isin("protein_complex", "GO:0032991"))),
        Rule(42, "IKR needs NOT", HARD, lambda: _ev("IKR") & ~_c("negated")),
        Rule(43, "evidence suits the reference", SOFT, lambda: combos),
        Rule(46, "self-binding names itself", SOFT, lambda: _c("in_self_binding") & ~_names_itself()),
        Rule(50, "similarity not to itself", SOFT, lambda: _ev(*SIMILARITY) & _names_itself()),
        Rule(55, "one reference of each kind", SOFT, _repeated_space),
        Rule(58, "extensions meet the constraints", HARD, lambda: _c("allowed_extensions").isNotNull() & F.exists("extensions", _bad_conjunction), {"extensions": lambda: F.filter("extensions", lambda c: ~_bad_conjunction(c))}, tag="context-import", level=lambda: F.lit(SOFT)),
        Rule(61, "relation suits the term", HARD, _wrong_relation, {"relation": _right_relation}, level=lambda: F.lit(SOFT)),
        Rule(63, "similarity needs with/from", SOFT, lambda: _ev(*SIMILARITY) & _no_with()),
        Rule(64, "tree grafting not in reference species", HARD, lambda: _ev("IEA") & F.array_contains("references", "GO_REF:0000118") & (F.get("taxa", F.lit(0)).isin(*reference_taxa) if reference_taxa else F.lit(False))),
        Rule(65, "no candidate for obsoletion", SOFT, lambda: F.array_contains("term_subsets", CANDIDATE)),
        Rule(13, "taxon suits the term", HARD, lambda: _c("taxon_problem") & ~_c("negated"), level=lambda: F.when(_ev(*NOT_EXPERIMENTAL), HARD).otherwise(SOFT)),
    ]


def extension_rule() -> Rule:
    """Defined, but not among the registered rules."""
    return Rule(51, "binding needs an extension", SOFT, lambda: _c("term").isin(*BINDING) & (F.size("extensions") == 0))


def _bad_conjunction(units: Column) -> Column:
    """Whether a unit meets none of the term's constraints: the same relation, a namespace that it lists, and no pair of
    relation and namespace more often in the conjunction than its cardinality."""
    space = lambda u: F.substring_index(u["term"], ":", 1)
    pair = lambda u: F.concat_ws("\t", u["relation"], space(u))
    most = F.array_max(F.transform(units, lambda u: F.size(F.filter(units, lambda v: pair(v) == pair(u)))))
    met = lambda u: F.exists("allowed_extensions", lambda c: (c["relation"] == u["relation"]) & F.array_contains(c["namespaces"], space(u)) & (c["cardinality"].isNull() | (most <= c["cardinality"])))
    return F.exists(units, lambda u: ~F.coalesce(met(u), F.lit(False)))


def with_flags(rows: DataFrame, closed: DataFrame, terms: DataFrame, wide: DataFrame | None = None, roots: Mapping[str, Mapping[str, bool]] | None = None, constraints: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """rows with in_<name> for each name of roots (is the term one of these or below), term_aspect and term_subsets of terms
    (id, aspect, subsets), code, allowed_extensions and, unless there, taxon_problem (false).

    closed is the reflexive closure over subclasses, wide the one over subclasses and part_of, for the roots that count both
    (closed without it). Both are cut to the roots, so one row per term is joined. constraints has relation, namespaces,
    cardinality and terms, as ``constraint_closure`` gives; without it rule 58 passes. evidence (code, ref, cls) tells which
    references make a code another class.
    """
    roots = FLAG_ROOTS if roots is None else roots
    both = (closed, {r for rs in roots.values() for r, w in rs.items() if not w}), (closed if wide is None else wide, {r for rs in roots.values() for r, w in rs.items() if w})
    names = {root: [n for n, rs in roots.items() if root in rs] for root in set().union(*(s for _, s in both))}
    known = rows.sparkSession.createDataFrame([(r, ns) for r, ns in sorted(names.items())], "anc string, names array<string>")
    under = None
    for reach, wanted in both:
        if wanted:
            part = reach.filter(F.col("anc").isin(*sorted(wanted))).select("term", "anc")
            under = part if under is None else under.unionByName(part)
    out = rows
    if under is not None:
        own = under.unionByName(known.select(F.col("anc").alias("term"), "anc")).join(F.broadcast(known), "anc")  # one row for each of the roots given
        out = out.join(own.groupBy("term").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("__under")), "term", "left")
    else:
        out = out.withColumn("__under", F.lit(None).cast("array<string>"))
    out = out.join(terms.select(F.col("id").alias("term"), F.col("aspect").alias("term_aspect"), F.col("subsets").alias("term_subsets")), "term", "left")
    out = out.withColumns({f"in_{name}": F.coalesce(F.array_contains("__under", name), F.lit(False)) for name in roots} | {"term_subsets": F.coalesce("term_subsets", F.array().cast("array<string>"))}).drop("__under")
    kind = "array<struct<relation:string,namespaces:array<string>,cardinality:int>>"
    if constraints is not None:
        each = constraints.select(F.explode("terms").alias("term"), F.struct("relation", "namespaces", F.col("cardinality").cast("int").alias("cardinality")).alias("c"))
        out = out.join(each.groupBy("term").agg(F.collect_set("c").cast(kind).alias("allowed_extensions")), "term", "left").withColumn("allowed_extensions", F.coalesce("allowed_extensions", F.array().cast(kind)))
    elif "allowed_extensions" not in out.columns:
        out = out.withColumn("allowed_extensions", F.lit(None).cast(kind))
    if "taxon_problem" not in out.columns:
        out = out.withColumn("taxon_problem", F.lit(False))
    return with_code(out, evidence)


def with_code(rows: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """rows with code: the evidence, or blank where the table (code, ref, cls; null ref: default) gives the code and the first reference a class of their own."""
    if evidence is None:
        return rows.withColumn("code", F.coalesce("evidence", F.lit("")))
    usual = evidence.filter("ref is null").groupBy("code").agg(F.min("cls").alias("usual"))
    other = evidence.filter("ref is not null").join(usual, "code", "left").filter("not cls <=> usual").select(F.col("code").alias("evidence"), F.col("ref").alias("__ref"), F.lit(True).alias("__other")).distinct()
    met = rows.withColumn("__ref", F.get("references", F.lit(0))).join(other, ["evidence", "__ref"], "left")
    return met.withColumn("code", F.when(F.col("__other"), "").otherwise(F.coalesce("evidence", F.lit("")))).drop("__ref", "__other")


def run(rows: DataFrame, rules: Sequence[Rule], rule_set: Sequence[int] | str | None = "all", contexts: Sequence[str] = ()) -> DataFrame:
    """rows, repaired, with failures and errors (longs; bit k is the k-th rule that ran), dropped, and results: an array of
    (k, rule, level, message). All go up to the first error. No rules run for None or an empty set; tagged ones run in their
    contexts only."""
    chosen = _chosen(rules, rule_set, contexts)
    if len(chosen) > MOST_RULES:
        raise ValueError(f"{len(chosen)} rules: a run holds {MOST_RULES}; run the others on its result")
    zero = F.lit(0).cast("long")
    out, waiting = rows.withColumns({"failures": zero, "errors": zero}), []

    def settle(df: DataFrame) -> DataFrame:
        masks = {"failures": F.col("failures"), "errors": F.col("errors")}
        for k, r in waiting:
            failed, bit = F.coalesce(r.fails(), F.lit(False)), F.lit(1 << k).cast("long")
            masks["failures"] = masks["failures"].bitwiseOR(F.when(failed, bit).otherwise(zero))
            fatal = (r.level() == HARD) if r.level else F.lit(r.mode == HARD)
            masks["errors"] = masks["errors"].bitwiseOR(F.when(failed & fatal, bit).otherwise(zero))
        waiting.clear()
        return df.withColumns(masks)

    for k, r in enumerate(chosen):
        waiting.append((k, r))
        if r.sets:
            out = settle(out)
            out = out.withColumns({c: F.when(F.getbit("failures", F.lit(k)) == 1, v()).otherwise(F.col(c)) for c, v in r.sets.items()})
    out = settle(out)
    low = F.col("errors").bitwiseAND(-F.col("errors"))  # the first error; what comes after it isn't reported
    out = out.withColumns({"failures": F.when(F.col("errors") == 0, F.col("failures")).otherwise(F.col("failures").bitwiseAND(low.bitwiseOR(low - 1))), "errors": low, "dropped": F.col("errors") != 0})
    return out.withColumn("results", _results(chosen))


def _chosen(rules: Sequence[Rule], rule_set: Sequence[int] | str | None, contexts: Sequence[str]) -> list[Rule]:
    tags = {f"context-{c}" for c in contexts}
    return [r for r in rules if rule_set is not None and (rule_set == "all" or r.id in rule_set) and (r.tag is None or r.tag in tags)]


def _results(chosen: Sequence[Rule]) -> Column:
    empty = F.array().cast("array<struct<k:int,rule:int,level:string,message:string>>")
    if not chosen:
        return empty
    ids, titles = F.array(*(F.lit(r.id) for r in chosen)), F.array(*(F.lit(_text(r)) for r in chosen))
    found = F.filter(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda k: F.getbit("failures", k) == 1)
    item = lambda k: F.struct(k.alias("k"), F.get(ids, k).alias("rule"), F.when(F.getbit("errors", k) == 1, HARD).otherwise(SOFT).alias("level"), F.get(titles, k).alias("message"))
    return F.when(F.col("failures") == 0, empty).otherwise(F.transform(found, item))


def messages(done: DataFrame, rules: Sequence[Rule], rule_set: Sequence[int] | str | None = "all", contexts: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """(row_id, rule, level, message), one row for each result of ``run`` with the same rules, rule_set and contexts.

    Rules are exploded as a constant and kept where their bit is set, which stays in generated code; a filter on the bits
    before it would be pushed below the rules and evaluate them twice.
    """
    chosen = _chosen(rules, rule_set, contexts)
    if not chosen:
        return done.limit(0).select(id_col, F.lit(0).alias("rule"), F.lit("").alias("level"), F.lit("").alias("message"))
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r.id).alias("rule"), F.lit(_text(r)).alias("message")) for k, r in enumerate(chosen)))
    each = done.select(id_col, "failures", "errors", F.explode(known).alias("r")).filter(F.getbit("failures", F.col("r.k")) == 1)
    return each.select(id_col, "r.rule", F.when(F.getbit("errors", F.col("r.k")) == 1, HARD).otherwise(SOFT).alias("level"), "r.message")


def _text(rule: Rule) -> str:
    return rule.message or (f"{rule.title}: repaired" if rule.sets else rule.title)


def report_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "level").agg(F.count("*").alias("n"))


def capped(found: DataFrame, most: int = 10_000, id_col: str = "row_id") -> DataFrame:
    """The first messages of each rule, INFO left out (SNK-05, STR-03)."""
    k = F.row_number().over(Window.partitionBy("rule").orderBy(id_col, "message"))
    return found.filter("level <> 'INFO'").withColumn("__k", k).filter(F.col("__k") <= most).drop("__k")


def inference_key(relation: Column, term: Column, taxon: Column, extensions: Column) -> Column:
    """A canonical text of relation, term, taxon and a set of (relation, term) units (INF-01)."""
    units = F.array_sort(F.array_distinct(F.transform(extensions, lambda u: F.concat_ws(" ", u["relation"], u["term"]))))
    return F.concat_ws("\t", relation, term, taxon, F.array_join(units, ","))


#: The aspect that the relation of an inference stands for.
RELATION_ASPECTS = {
    "RO:0002327": "F", "RO:0002326": "F", "RO:0002264": "P", "RO:0004032": "P", "RO:0004033": "P", "RO:0002263": "P", "RO:0004034": "P", "RO:0004035": "P", "RO:0002331": "P",
    "BFO:0000050": "C", "RO:0002432": "C", "RO:0002325": "C",
}


def infer(rows: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with taxon_problem, new annotations) by the inference table (key, satisfiable, taxon_problem, inferences) (INF-01, INF-02).

    Each conjunction of extensions has a key of its own, and an annotation without any has one. New annotations keep the
    subject, relation and evidence; term comes from the inference, and aspect from its relation, which is inferred_relation; they
    have no extensions.
    """
    conj = rows.select("*", F.explode_outer(F.when(F.size("extensions") > 0, F.col("extensions"))).alias("__u"))
    conj = conj.withColumn("__key", inference_key(F.col("relation"), F.col("term"), F.get("taxa", F.lit(0)), F.coalesce("__u", F.array().cast("array<struct<relation:string,term:string>>"))))
    met = conj.join(table.select(F.col("key").alias("__key"), "satisfiable", F.col("taxon_problem").alias("__problem"), "inferences"), "__key", "left")
    flags = met.groupBy("row_id").agg(F.max(F.coalesce(~F.col("satisfiable") & F.col("__problem"), F.lit(False))).alias("taxon_problem"))
    each = met.filter("satisfiable").select("row_id", "subject", "relation", "evidence", F.explode("inferences").alias("i"))
    labels = {k: v for label, k in RELATIONS.items() if k in RELATION_ASPECTS for k, v in ((k, RELATION_ASPECTS[k]), (label, RELATION_ASPECTS[k]))}
    new = each.select("row_id", "subject", "relation", "evidence", F.col("i.term").alias("term"), F.element_at(_literal_map(labels), F.col("i.relation")).alias("aspect"), F.col("i.relation").alias("inferred_relation")).distinct()
    return rows.drop("taxon_problem").join(flags, "row_id", "left"), new


def constraint_closure(constraints: DataFrame, closed: DataFrame) -> DataFrame:
    """constraints (relation, namespaces, primary_root_terms, cardinality) with terms, all that are a root or, by the reflexive
    closure over subclasses, below one (RUL-EC)."""
    roots = constraints.select("*", F.explode("primary_root_terms").alias("anc"))
    every = roots.join(closed.select("term", "anc"), "anc").unionByName(roots.withColumn("term", F.col("anc")))
    kept = ["relation", "namespaces", "primary_root_terms", "cardinality"]
    return every.groupBy(*kept).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def examples(cases: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, kind, row_id, ok): whether example rows fail, pass or are repaired as their rule says (RUL-EX)."""
    done = run(cases, rules)
    mine = F.filter("results", lambda r: r["rule"] == F.col("rule_id"))
    ok = F.when(F.col("kind") == "pass", F.size(mine) == 0).otherwise(F.size(mine) > 0)
    return done.select("rule_id", "kind", "row_id", ok.alias("ok"))
