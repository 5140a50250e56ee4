"""Validation of association files from lines to kept annotations, messages and counts: parse, repair, check, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import parse, rules
from .ontology import IS_A, PART_OF, Ontology


@dataclass
class ParserConfig:
    """Options of a run. rule_set None runs no rule, "all" all of them, a list those; as_of stands for today.

    constraints (relation, namespaces, primary_root_terms, cardinality) are those of rule 58, evidence (code, ref, cls) the
    table of evidence classes, inferences (key, satisfiable, taxon_problem, inferences) what rule 13 looks up.
    """

    kind: str = "gaf"
    version: str | None = None
    rule_set: Sequence[int] | str | None = None
    contexts: Sequence[str] = ()
    repair_obsoletes: bool = True
    valid_taxa: Sequence[str] | None = None
    include_relations: Sequence[str] | None = None
    exclude_relations: Sequence[str] | None = None
    entity_spaces: DataFrame | None = None
    entities: DataFrame | None = None
    slim: DataFrame | None = None
    as_of: str = "2024-01-01"
    paint: bool = False
    retracted: Sequence[str] = ()
    old_refs: Sequence[str] = ()
    reference_taxa: Sequence[str] = ()
    ref_evidence: Mapping[str, Sequence[str]] | None = None
    constraints: DataFrame | None = None
    evidence: DataFrame | None = None
    inferences: DataFrame | None = None
    rules: Sequence[rules.Rule] | None = None


@dataclass
class Validated:
    """annotations that stay, messages (row_id, rule, level, message), and counts of lines."""

    annotations: DataFrame
    messages: DataFrame
    counters: DataFrame


def validate(lines: DataFrame, ontology: Ontology, config: ParserConfig, aspects: DataFrame | None = None) -> Validated:
    """lines (row_id, value) through all steps. aspects (id, aspect) stand for the namespaces that the ontology states.

    Rule 1 stands for a line that can't be used, 20 and 27 for obsolete and unknown terms, 59 for a relation that was upgraded.
    """
    version = config.version or parse.header_version(lines, config.kind)
    # each step that several results rest on is checkpointed: lines are parsed, repaired and checked once
    rows = cut(parse.annotations(parse.cells(lines, config.kind, version), config.kind, version))
    message = lambda df, rule, level, text: df.select("row_id", F.lit(rule).alias("rule"), F.lit(level).alias("level"), text.alias("message"))
    found = [message(rows.filter("problem is not null"), 1, "ERROR", F.col("problem"))]
    good = rows.filter("problem is null").drop("problem")
    if config.entities is not None:
        good = parse.with_entities(good, config.entities)
    if config.entity_spaces is not None:
        good = parse.canonical_spaces(good, config.entity_spaces)
        found.append(message(good.filter("not known_space"), 27, "WARNING", F.concat(F.lit("unknown database of "), "subject")))
        good = good.drop("known_space")
    good = parse.allowed(good, config.valid_taxa, config.include_relations, config.exclude_relations)
    mended = cut(parse.repaired_terms(good, ontology.nodes, ontology.replaced_by(), repair=config.repair_obsoletes))
    found.append(mended.filter("rule is not null").select("row_id", "rule", "level", F.concat(F.lit("term "), "term").alias("message")))
    good = parse.repaired_lists(mended.filter("not drop").drop("rule", "level", "drop"), ontology.replaced_by())
    spaces = F.create_map(*(F.lit(x) for kv in rules.NAMESPACES.items() for x in kv))
    branch = ontology.obo_namespace().select("id", F.element_at(spaces, F.col("namespace")).alias("aspect")) if aspects is None else aspects.select("id", "aspect")
    terms = ontology.nodes.select("id").distinct().join(ontology.subsets.groupBy("id").agg(F.collect_set(F.regexp_extract("subset", "([^#]*)$", 1)).alias("subsets")), "id", "left").join(branch, "id", "left")
    if config.inferences is not None:
        good = rules.infer(good, config.inferences)[0]
    typed = good.withColumn("subject_type", F.col("type") if "type" in good.columns else F.lit(""))
    subclasses, wide = ontology.reflexive_closure([IS_A]), ontology.reflexive_closure([IS_A, PART_OF])
    allowed = None if config.constraints is None else rules.constraint_closure(config.constraints, subclasses)
    flagged = rules.with_flags(typed, subclasses, terms, wide, constraints=allowed, evidence=config.evidence)
    if "aspect" not in flagged.columns:
        flagged = flagged.withColumn("aspect", F.col("term_aspect"))
    flagged = cut(flagged)
    blank = flagged.filter("coalesce(relation, '') = ''")
    found.append(message(blank, 59, "WARNING", F.lit("a relation was added")))
    flagged = parse.upgraded_qualifiers(flagged)
    chosen = config.rules or rules.standard_rules(config.as_of, config.retracted, config.old_refs, config.reference_taxa, config.ref_evidence, config.paint)
    done = cut(rules.run(flagged, chosen, config.rule_set, config.contexts))
    found.append(rules.messages(done, chosen, config.rule_set, config.contexts))
    kept = done.filter("not dropped").select(*(c for c in good.columns if c in done.columns), *(["aspect"] if "aspect" not in good.columns else []))
    if config.slim is not None:
        kept, lost = parse.mapped_to_subset(kept, config.slim)
        found.append(message(lost, 1, "ERROR", F.concat(F.lit("no class of the subset for "), "term")))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return Validated(kept, whole, parse.counters(rows))
