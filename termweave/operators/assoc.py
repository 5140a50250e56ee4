"""Association sets: subjects, the terms they are annotated to, and what follows from the closure (ASC-01 to ASC-23)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import fisher
from ..functions.lineage import cut
from .blocks import shared_counts
from .closure import closure
from .ontology import Ontology

THING = "owl:Thing"
#: Ancestors of sets of parents that are broadcast, of 8 bytes each; more are joined.
LOOKED_UP = 500_000


def of_associations(rows: DataFrame) -> DataFrame:
    """(subject, object) without negated rows (ASC-01)."""
    kept = rows.filter(~F.coalesce("negated", F.lit(False))) if "negated" in rows.columns else rows
    return kept.select("subject", "object").distinct()


def _list(spark: SparkSession, name: str, values: Sequence[str] | DataFrame) -> DataFrame:
    return values.select(F.col(values.columns[0]).alias(name)).distinct() if isinstance(values, DataFrame) else spark.createDataFrame([(x,) for x in dict.fromkeys(values)], f"{name} string")


@dataclass
class AssociationSet:
    """assoc(subject, object). ``subjects`` are those of assoc unless given, so that a subject without a term can be known."""

    assoc: DataFrame
    ontology: Ontology
    known: DataFrame | None = None
    relations: Sequence[str] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.assoc.sparkSession

    @cached_property
    def subjects(self) -> DataFrame:
        return (self.assoc if self.known is None else self.known).select("subject").distinct()

    @cached_property
    def inferred(self) -> DataFrame:
        """(subject, term): terms and all their ancestors; a term that the ontology lacks stays (ASC-02)."""
        direct = self.assoc.filter("object is not null").select("subject", F.col("object").alias("term")).distinct()
        closed = self.ontology.closure(self.relations)
        return cut(direct.unionAll(direct.join(closed, "term").select("subject", F.col("anc").alias("term"))).distinct())

    @cached_property
    def term_counts(self) -> DataFrame:
        return self.inferred.groupBy("term").agg(F.count("*").alias("n"))

    def query(self, terms: Sequence[str] = (), negated: Sequence[str] = ()) -> DataFrame:
        """(subject): those that have all the terms and none of the negated, by inference (ASC-06). No terms: every subject."""
        wanted = [t for t in dict.fromkeys(terms)]
        found = self.subjects
        if wanted and THING not in wanted:
            some = self.inferred.filter(F.col("term").isin(*wanted)).groupBy("subject").agg(F.count("*").alias("n"))
            found = found.join(some.filter(F.col("n") == len(wanted)), "subject", "left_semi")
        if negated:
            found = found.join(self.inferred.filter(F.col("term").isin(*dict.fromkeys(negated))), "subject", "left_anti")
        return found

    def under(self, seeds: Sequence[str] | DataFrame, xrefs: bool = True) -> DataFrame:
        """(subject, object): associations of the seeds, of what lies below them in the ontology, and of their xrefs (ASC-04)."""
        ids = _list(self.spark, "id", seeds)
        wide = ids.unionAll(self.ontology.descendants(ids, self.relations).select(F.col("desc").alias("id")))
        if xrefs:
            wide = wide.unionAll(wide.distinct().join(self.ontology.xrefs_of(bidirectional=True), "id").select(F.col("xref").alias("id")))
        return self.assoc.join(wide.select(F.col("id").alias("subject")).distinct(), "subject", "left_semi")

    def intersections(self, xs: Sequence[str] | DataFrame, ys: Sequence[str] | DataFrame, symmetric: bool = False) -> DataFrame:
        """(x, y, c, j): subjects that two terms share, and their Jaccard similarity; dense over xs by ys (ASC-07)."""
        x, y = _list(self.spark, "x", xs), _list(self.spark, "y", ys)
        have = self.inferred.join(x.toDF("term").unionAll(y.toDF("term")).distinct(), "term", "left_semi")
        a, b = have.select("subject", F.col("term").alias("x")), have.select("subject", F.col("term").alias("y"))
        shared = a.join(x, "x", "left_semi").join(b.join(y, "y", "left_semi"), "subject").groupBy("x", "y").agg(F.count("*").alias("c"))
        n = have.groupBy("term").agg(F.count("*").alias("n"))
        dense = x.crossJoin(y)  # dense by contract: lists of terms that the caller gives
        dense = dense.filter("x < y") if symmetric else dense
        met = dense.join(shared, ["x", "y"], "left").join(n.toDF("x", "nx"), "x", "left").join(n.toDF("y", "ny"), "y", "left").na.fill(0, ["c", "nx", "ny"])
        union = F.col("nx") + F.col("ny") - F.col("c")
        return met.select("x", "y", "c", F.when(union > 0, F.col("c") / union).otherwise(0.0).alias("j"))

    def matrix(self, terms: Sequence[str]) -> DataFrame:
        """subject and a 0/1 column for each term (ASC-09, ASC-17)."""
        return self.inferred.groupBy("subject").pivot("term", list(terms)).agg(F.lit(1)).na.fill(0, list(terms))

    def jaccard(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) of subjects with j, 0 if neither has a term (ASC-14, SIM-01, GLR-26)."""
        n = self.inferred.groupBy("subject").agg(F.count("*").alias("n"))
        mine = pairs.select("a", "b").distinct()
        c = mine.join(self.inferred.toDF("a", "term"), "a").join(self.inferred.toDF("b", "term"), ["b", "term"]).groupBy("a", "b").agg(F.count("*").alias("c"))
        met = pairs.join(c, ["a", "b"], "left").join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left").na.fill(0, ["c", "na", "nb"])
        union = F.col("na") + F.col("nb") - F.col("c")
        return met.select("a", "b", F.when(union > 0, F.col("c") / union).otherwise(0.0).alias("j"))

    def numbered(self, subjects: DataFrame | None = None) -> DataFrame:
        """(subject, terms), in two rows of a subject at most: its terms and all their ancestors as numbers, a row without doubles.

        The same pairs as ``inferred``, without a row for each on the way: terms are told by the set of their parents, which many
        share, so that associations are shuffled as they are, and only sets of parents meet their ancestors.
        """
        parents = self.ontology.parents(self.relations).filter("id <> parent")
        sets = cut(parents.groupBy(F.col("id").alias("term")).agg(F.array_sort(F.collect_set("parent")).alias("parents")))
        above = sets.select(F.explode("parents").alias("term")).distinct()
        upper = sets.join(above, "term", "left_semi").select(F.col("term").alias("sub"), F.explode("parents").alias("obj"))
        kinds = cut(sets.select("parents").distinct().withColumn("kind", F.monotonically_increasing_id()))
        first = kinds.select("kind", F.explode("parents").alias("term"))
        reached = cut(first.unionAll(first.join(closure(upper), "term").select("kind", F.col("anc").alias("term"))).distinct())
        direct = self.assoc.filter("subject is not null and object is not null").select("subject", F.col("object").alias("term"))
        ids = cut(direct.select("term").unionAll(reached.select("term")).distinct().withColumn("id", F.monotonically_increasing_id()))
        told = ids.join(sets, "term", "left").join(kinds, "parents", "left").select("term", "id", "kind")
        lists = direct.join(told, "term").groupBy("subject").agg(F.collect_set("id").alias("terms"), F.collect_set("kind").alias("kinds"))
        lists = cut(lists if subjects is None else lists.join(subjects, "subject", "left_semi"))
        known = cut(reached.join(ids, "term").groupBy("kind").agg(F.collect_list("id").alias("ids")))
        known = F.broadcast(known) if reached.count() <= LOOKED_UP else known
        more = lists.select("subject", F.explode("kinds").alias("kind")).join(known, "kind").select("subject", F.explode("ids").alias("id")).distinct()
        return lists.select("subject", "terms").unionAll(more.groupBy("subject").agg(F.collect_list("id").alias("terms")))

    def similar_subjects(self, subjects: Sequence[str] | DataFrame, most_common: float = 1.0, digits: int | None = None) -> DataFrame:
        """(a, b, c, j), a < b, of the given subjects that share a term; j rounded to ``digits`` if given (ASC-15).

        Subjects meet in blocks, where the counts decide which terms are common enough for a matrix product (``blocks``). So
        neither the result nor the work depends on ``most_common``, the share from which callers take a term as common.
        """
        return shared_counts(cut(self.numbered(_list(self.spark, "subject", subjects))), digits)

    def enrichment(self, sample: Sequence[str] | DataFrame, background: Sequence[str] | DataFrame | None = None, hypotheses: Sequence[str] | DataFrame | None = None, threshold: float = 0.05, side: str = "greater") -> DataFrame:
        """(term, sample_count, bg_count, p, p_adjusted), least p first (ASC-13).

        Hypotheses are the inferred terms of the sample, or those of the list; terms with one background subject are left out
        before the Bonferroni factor is counted; p_adjusted is below the threshold. Unannotated ids count in the sizes.
        """
        s = _list(self.spark, "subject", sample)
        bg = (self.subjects if background is None else _list(self.spark, "subject", background)).union(s).distinct()
        sized = s.agg(F.count("*").alias("ns")).crossJoin(bg.agg(F.count("*").alias("nb")))  # one row by one row
        marked = self.inferred.join(bg, "subject", "left_semi").join(s.withColumn("in_s", F.lit(1)), "subject", "left")
        counts = marked.groupBy("term").agg(F.count("in_s").alias("sample_count"), F.count("*").alias("bg_count"))
        counts = counts.filter("sample_count > 0") if hypotheses is None else counts.join(_list(self.spark, "term", hypotheses), "term", "left_semi")
        counts = cut(counts.filter("bg_count > 1"))
        m = counts.count()
        a, c = F.col("sample_count"), F.col("bg_count") - F.col("sample_count")
        b = F.col("ns") - a
        p = fisher(a, b, c, F.col("nb") - F.col("bg_count") - b, side)
        # p depends on the two counts alone, which many terms share
        tables = cut(counts.select("sample_count", "bg_count").distinct().repartition("sample_count", "bg_count").crossJoin(F.broadcast(sized)).select("sample_count", "bg_count", p.alias("p")))
        out = counts.join(tables, ["sample_count", "bg_count"]).select("term", "sample_count", "bg_count", "p")
        out = out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * m))
        return out.filter(F.col("p_adjusted") < threshold).orderBy("p", "term")

    def closure_enrichment(self, sample: Sequence[str] | DataFrame, least: int = 2, threshold: float = 0.05) -> DataFrame:
        """Two-sided enrichment of terms that at least ``least`` subjects of the sample have (GLR-24)."""
        return self.enrichment(sample, threshold=threshold, side="two-sided").filter(F.col("sample_count") >= least)

    def phenolog(self, other: AssociationSet, least: int = 3, threshold: float = 0.05) -> DataFrame:
        """(class1, class2, c, n1, n2, p): pairs of classes of two sets whose subjects overlap more than chance (ASC-16)."""
        common = self.subjects.join(other.subjects, "subject", "left_semi")
        n = common.count()
        one, two = (x.inferred.join(common, "subject", "left_semi") for x in (self, other))
        n1 = one.groupBy("term").agg(F.count("*").alias("n1")).filter(F.col("n1") >= least).toDF("class1", "n1")
        n2 = two.groupBy("term").agg(F.count("*").alias("n2")).filter(F.col("n2") > 1).toDF("class2", "n2")
        both = one.toDF("subject", "class1").join(n1, "class1").join(two.toDF("subject", "class2").join(n2, "class2"), "subject")
        cells = both.groupBy("class1", "class2").agg(F.count("*").alias("c"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
        p = fisher(F.col("c"), F.col("n1") - F.col("c"), F.col("n2") - F.col("c"), F.lit(n) - F.col("n1") - F.col("n2") + F.col("c"))
        return cells.withColumn("p", p).filter(F.col("p") < threshold)

    def specificity(self, term: str) -> DataFrame:
        """(subject, score): 1 over one more than the subject's other terms that aren't below the term (ASC-22)."""
        below = self.ontology.descendants([term], self.relations, True).select(F.col("desc").alias("object"))
        hit = self.assoc.join(below, "object", "left_semi").select("subject").distinct()
        others = self.assoc.join(hit, "subject", "left_semi").join(below, "object", "left_anti").groupBy("subject").agg(F.countDistinct("object").alias("n"))
        return hit.join(others, "subject", "left").select("subject", (1 / (1 + F.coalesce("n", F.lit(0)))).alias("score"))

    def slimmed(self, slim: DataFrame) -> DataFrame:
        """(subject, slim): associations carried over a mapping (id, slim) (ASC-19, PRS-29)."""
        return self.assoc.join(slim.filter("slim is not null"), F.col("object") == F.col("id")).select("subject", "slim").distinct()

    def summary(self, rows: DataFrame, facets: Sequence[str]) -> DataFrame:
        """Counts by facets with their totals (ASC-21)."""
        return rows.rollup(*facets).agg(F.count("*").alias("n"))

    def labelled(self, labels: DataFrame | None = None) -> DataFrame:
        """assoc with subject_label and object_label, from the ontology first, then from labels (id, label) (ASC-10)."""
        names = self.ontology.labels().filter("label is not null").withColumn("k", F.lit(0))
        if labels is not None:
            names = names.unionByName(labels.select("id", "label").withColumn("k", F.lit(1)))
        one = names.groupBy("id").agg(F.min_by("label", "k").alias("label"))
        out = self.assoc.join(one.toDF("subject", "subject_label"), "subject", "left").join(one.toDF("object", "object_label"), "object", "left")
        return out.select("subject", "subject_label", "object", "object_label")

    def between(self, subject: str | None = None, obj: str | None = None) -> DataFrame:
        """Associations of a subject, an object, or both (ASC-05, ASC-12)."""
        out = self.assoc if subject is None else self.assoc.filter(F.col("subject") == subject)
        return out if obj is None else out.filter(F.col("object") == obj)

    def inferred_types(self, subject: str, strict: bool = False) -> DataFrame:
        """(term) of a subject; an unknown one has none, or with strict is an error (ASC-03)."""
        if strict and not self.subjects.filter(F.col("subject") == subject).limit(1).count():
            raise KeyError(subject)
        return self.inferred.filter(F.col("subject") == subject).select("term")

    def chain_annotations(self, seeds: Sequence[str], relations: Sequence[str]) -> DataFrame:
        """(id, subject, object): what is said of the nodes that seeds reach by a chain of relations (ASC-23)."""
        return self.ontology.chain(seeds, relations).join(self.assoc, F.col("sink") == F.col("subject")).select("id", "subject", "object")

    def used_ontology(self, minimal: bool = False) -> Ontology:
        """The part of the ontology that the inferred terms use (ASC-11)."""
        return self.ontology.subontology(self.inferred.select(F.col("term").alias("id")).distinct(), minimal)


def pivot_intersections(cells: DataFrame, xs: Sequence[str]) -> DataFrame:
    """y and a column for each x, of (x, y, j) (ASC-08)."""
    return cells.groupBy("y").pivot("x", list(xs)).agg(F.first("j"))


def publications_per_subject(rows: DataFrame, column: str = "reference", prefix: str = "PMID:") -> DataFrame:
    """(subject, n): distinct publications (ASC-20)."""
    return rows.filter(F.startswith(column, F.lit(prefix))).groupBy("subject").agg(F.countDistinct(column).alias("n"))


def linkage(distances: DataFrame) -> DataFrame:
    """(step, a, b, distance, size): complete-linkage clustering of (a, b, d), for a result small enough to draw (ASC-18)."""
    import numpy as np
    import pandas as pd

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.a, *pdf.b})
        at = {x: i for i, x in enumerate(names)}
        d = np.full((len(names), len(names)), np.inf)
        for a, b, x in zip(pdf.a, pdf.b, pdf.d):
            d[at[a], at[b]] = d[at[b], at[a]] = x
        label, size, rows = {i: n for i, n in enumerate(names)}, dict.fromkeys(range(len(names)), 1), []
        live = list(range(len(names)))
        for step in range(len(names) - 1):
            sub = d[np.ix_(live, live)]
            sub[np.tril_indices(len(live))] = np.inf
            i, j = divmod(int(sub.argmin()), len(live))
            i, j = live[i], live[j]
            size[i] += size[j]
            rows.append((step, label[i], label[j], float(d[i, j]), size[i]))
            label[i] = f"{label[i]}+{label[j]}"
            d[i], d[:, i] = np.maximum(d[i], d[j]), np.maximum(d[:, i], d[:, j])
            live.remove(j)
        return pd.DataFrame(rows, columns=["step", "a", "b", "distance", "size"])

    return distances.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(cluster, "step int, a string, b string, distance double, size int")

