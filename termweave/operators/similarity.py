"""Information content, common ancestors and profile similarity (SIM-01 to SIM-19)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .assoc import AssociationSet
from .ontology import not_redundant

#: The names of similarity measures.
MEASURES = ("phenodigm", "jaccard", "simGIC", "resnik", "symmetric_resnik", "cosine")


def information_content(aset: AssociationSet) -> DataFrame:
    """(term, freq, ic): -log2 of the share of subjects that have the term by inference (SIM-03)."""
    total = F.broadcast(aset.subjects.agg(F.count("*").alias("total")))  # one row
    return aset.term_counts.crossJoin(total).select("term", F.col("n").alias("freq"), F.log2(F.col("total") / F.col("n")).alias("ic"))


def facet_content(counts: DataFrame) -> DataFrame:
    """(term, ic): -log2 of a count (term, n) over the greatest (GLR-23)."""
    top = F.broadcast(counts.agg(F.max("n").alias("top")))
    return counts.crossJoin(top).select("term", F.log2(F.col("top") / F.col("n")).alias("ic"))


def common_ancestors(pairs: DataFrame, reflexive: DataFrame) -> DataFrame:
    """(a, b, anc) of pairs (a, b) of terms."""
    p = pairs.select("a", "b").distinct()
    return p.join(reflexive.toDF("a", "anc"), "a").join(reflexive.toDF("b", "anc"), ["b", "anc"]).select("a", "b", "anc")


def mrca(pairs: DataFrame, reflexive: DataFrame, closed: DataFrame) -> DataFrame:
    """(a, b, anc): common ancestors that are above no other common ancestor (SIM-04).

    closed (term, anc) may hold the direct parents alone: whatever lies between two common ancestors is one itself, so that an
    ancestor above another is a parent of one. Then each common ancestor meets its parents instead of all that is above it.
    """
    keyed = common_ancestors(pairs, reflexive).select(F.struct("a", "b").alias("key"), F.col("anc").alias("id"))
    return not_redundant(keyed, closed.filter("term <> anc")).select("key.a", "key.b", F.col("id").alias("anc"))


def mica(pairs: DataFrame, reflexive: DataFrame, ic: DataFrame) -> DataFrame:
    """(a, b, ic, terms): the greatest content of a common ancestor, and all that have it; 0 and none without any (SIM-05)."""
    rated = common_ancestors(pairs, reflexive).join(ic.select(F.col("term").alias("anc"), "ic"), "anc")
    # by content from the greatest: the list of an equal greatest value is an aggregate of its own
    best = rated.groupBy("a", "b", "ic").agg(F.array_sort(F.collect_set("anc")).alias("terms")).groupBy("a", "b").agg(F.max_by("terms", "ic").alias("terms"), F.max("ic").alias("ic"))
    return pairs.select("a", "b").distinct().join(best, ["a", "b"], "left").select("a", "b", F.coalesce("ic", F.lit(0.0)).alias("ic"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def term_pairs(profiles: DataFrame, one: DataFrame) -> DataFrame:
    """(x, y, a, b): terms of profiles x and y (id, term) for the pairs (x, y) of ``one``."""
    return one.select("x", "y").distinct().join(profiles.toDF("x", "a"), "x").join(profiles.toDF("y", "b"), "y")


def resnik_bma(cells: DataFrame) -> DataFrame:
    """(x, y, score, rows, cols): mean of the best matches of either side of (x, y, a, b, ic) (SIM-06)."""
    rows = cells.groupBy("x", "y", "a").agg(F.max("ic").alias("m")).groupBy("x", "y").agg(F.avg("m").alias("rows"))
    cols = cells.groupBy("x", "y", "b").agg(F.max("ic").alias("m")).groupBy("x", "y").agg(F.avg("m").alias("cols"))
    return rows.join(cols, ["x", "y"]).select("x", "y", ((F.col("rows") + F.col("cols")) / 2).alias("score"), "rows", "cols")


def resnik_bma_of(profiles: DataFrame, pairs: DataFrame, reflexive: DataFrame, ic: DataFrame) -> DataFrame:
    """(x, y, score, rows, cols) as resnik_bma has them over all cells of the pairs (x, y) of profiles (id, term) (SIM-06).

    A term's best match in a profile is its most informative ancestor among those of any of the profile's terms. So each term
    meets the other profile once, as lists, and neither pairs of terms nor their common ancestors are made.
    """
    prof = profiles.select("id", "term").distinct()
    rated = reflexive.join(ic.select(F.col("term").alias("anc"), "ic"), "anc").join(prof.select("term").distinct(), "term", "left_semi")
    lists = rated.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("ic", "anc")), False).alias("l")).select("term", F.col("l.anc").alias("ancs"), F.col("l.ic").alias("ics"))
    none = F.array().cast("array<string>")
    terms = cut(prof.join(lists, "term", "left").select("id", "term", F.coalesce("ancs", none).alias("ancs"), "ics"))
    wide = terms.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("ancs"))).alias("all"))
    asked = pairs.select("x", "y").distinct()
    both = asked.toDF("p", "q").unionAll(asked.select("y", "x")).distinct()
    met = both.join(wide.toDF("q", "all"), "q").join(terms.withColumnRenamed("id", "p"), "p")
    # by content from the greatest, and the intersection keeps that order
    first = F.get(F.array_intersect("ancs", "all"), F.lit(0))
    best = met.select("p", "q", F.coalesce(F.get("ics", F.array_position("ancs", first).cast("int") - 1), F.lit(0.0)).alias("ic"))
    mean = cut(best.groupBy("p", "q").agg(F.avg("ic").alias("m")))
    two = asked.join(mean.toDF("x", "y", "rows"), ["x", "y"]).join(mean.toDF("y", "x", "cols"), ["x", "y"])
    return two.select("x", "y", ((F.col("rows") + F.col("cols")) / 2).alias("score"), "rows", "cols")


def cosine_binary(aset: AssociationSet, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the cosine of their term sets (SIM-02)."""
    n = aset.inferred.groupBy("subject").agg(F.count("*").alias("n"))
    p = pairs.select("a", "b").distinct()
    c = p.join(aset.inferred.toDF("a", "term"), "a").join(aset.inferred.toDF("b", "term"), ["b", "term"]).groupBy("a", "b").agg(F.count("*").alias("c"))
    met = p.join(c, ["a", "b"], "left").join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left")
    return met.select("a", "b", F.coalesce(F.col("c") / F.sqrt(F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def cosine_dense(u: Column, v: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))


def sim_gic(aset: AssociationSet, pairs: DataFrame, ic: DataFrame) -> DataFrame:
    """pairs (a, b) with the content of shared terms over that of all terms (SIM-08)."""
    rated = aset.inferred.join(ic.select("term", "ic"), "term")
    p = pairs.select("a", "b").distinct()
    tot = rated.groupBy("subject").agg(F.sum("ic").alias("t"))
    c = p.join(rated.select(F.col("subject").alias("a"), "term", "ic"), "a").join(rated.select(F.col("subject").alias("b"), "term"), ["b", "term"]).groupBy("a", "b").agg(F.sum("ic").alias("c"))
    met = p.join(c, ["a", "b"], "left").join(tot.toDF("a", "ta"), "a").join(tot.toDF("b", "tb"), "b").na.fill(0.0, ["c"])
    union = F.col("ta") + F.col("tb") - F.col("c")
    return met.select("a", "b", F.when(union > 0, F.col("c") / union).otherwise(0.0).alias("sim_gic"))


def search_profiles(aset: AssociationSet, profile: Sequence[str], limit: int = 100) -> DataFrame:
    """(subject, score, rank): subjects by the content of what they share with a profile, over all (SIM-07, SIM-09)."""
    spark = aset.spark
    ic = information_content(aset)
    seeds = spark.createDataFrame([(x,) for x in dict.fromkeys(profile)], "id string")
    wide = seeds.select(F.col("id").alias("term")).union(aset.ontology.ancestors(seeds, aset.relations).select(F.col("anc").alias("term"))).distinct()
    mine = F.broadcast(wide.join(ic, "term").agg(F.sum("ic").alias("q")))
    rated = aset.inferred.join(ic.select("term", "ic"), "term").join(wide.withColumn("hit", F.lit(1)), "term", "left")
    sums = rated.groupBy("subject").agg(F.sum("ic").alias("t"), F.sum(F.when(F.col("hit") == 1, F.col("ic"))).alias("c")).filter("c > 0")
    out = sums.crossJoin(mine).select("subject", (F.col("c") / (F.col("t") + F.col("q") - F.col("c"))).alias("score"))
    top = out.orderBy(F.desc("score"), "subject").limit(limit)
    return ranked(top)


def ranked(scores: DataFrame, by: Sequence[str] = (), column: str = "score") -> DataFrame:
    """scores with rank: equal scores share one, the next takes the next number (SIM-10)."""
    return scores.withColumn("rank", F.dense_rank().over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.desc(column))))


def ic_statistics(aset: AssociationSet, terms: DataFrame | None = None) -> DataFrame:
    """One row: mean, max and sum of content over subjects' direct terms, averaged over subjects, and their number (SIM-15)."""
    ic = information_content(aset)
    direct = aset.assoc.select("subject", F.col("object").alias("term")).distinct()
    if terms is not None:
        direct = direct.join(terms.select("term"), "term", "left_semi")
    per = direct.join(ic, "term").groupBy("subject").agg(F.avg("ic").alias("mean"), F.max("ic").alias("max"), F.sum("ic").alias("sum"))
    return per.agg(F.avg("mean").alias("mean_mean_ic"), F.avg("sum").alias("mean_sum_ic"), F.max("max").alias("max_max_ic"), F.max("sum").alias("max_sum_ic"), F.max("mean").alias("max_mean_ic"), F.count("*").alias("individuals"))


def sufficiency(profiles: DataFrame, ic: DataFrame, mean_ic: float, max_ic: float, sum_ic: float, negation_weight: float = 0.25) -> DataFrame:
    """(id, simple): how well profiles (id, term, negated) are described, 0 to 1 (SIM-14).

    A profile's terms count once. The three parts are capped at 1 and averaged; negated terms may only raise them.
    """
    rated = profiles.select("id", "term", "negated").distinct().join(ic.select("term", "ic"), "term")
    pos, neg = F.when(~F.col("negated"), F.col("ic")), F.when(F.col("negated"), F.col("ic"))
    a = rated.groupBy("id").agg(F.avg(pos).alias("m"), F.max(pos).alias("x"), F.sum(pos).alias("s"), F.avg(neg).alias("nm"), F.max(neg).alias("nx"), F.sum(neg).alias("ns")).na.fill(0.0, ["m", "x", "s"])
    w = negation_weight
    mean = F.when(F.col("nm").isNull(), F.col("m")).otherwise(F.greatest(F.col("m"), (F.col("m") + w * F.col("nm")) / (1 + w)))
    top = F.greatest(F.col("x"), w * F.coalesce("nx", F.lit(0.0)))
    total = F.col("s") + w * F.coalesce("ns", F.lit(0.0))
    cap = lambda v, bg: F.least(v / bg, F.lit(1.0))
    return a.select("id", ((cap(mean, mean_ic) + cap(top, max_ic) + cap(total, sum_ic)) / 3).alias("simple"))


def scaled_sufficiency(simple: Column, categorical: Column, weight: float = 0.5) -> Column:
    return (simple + weight * categorical) / (1 + weight)


def profile_content(profile: DataFrame, ic: DataFrame) -> DataFrame:
    """(term, ic) of a profile's terms (SIM-16)."""
    return profile.select("term").distinct().join(ic.select("term", "ic"), "term")


def resolve_profiles(rows: DataFrame, types: DataFrame, phenotypes: DataFrame, kind: str = "phenotype") -> DataFrame:
    """(id, term): entities (id) that are phenotypes stand for themselves, others for what phenotypes (subject, object) says (SIM-13)."""
    typed = rows.select("id").distinct().join(types, "id", "left")
    own = typed.filter(F.col("type") == kind).select("id", F.col("id").alias("term"))
    rest = typed.filter(F.coalesce(F.col("type") != kind, F.lit(True))).join(phenotypes, F.col("id") == F.col("subject")).select("id", F.col("object").alias("term"))
    return own.union(rest).distinct()


def in_namespace(rows: DataFrame, column: str, prefixes: Mapping[str, str], taxon: str | None = None, category: str | None = None) -> DataFrame:
    """Rows whose id has the namespace of the taxon, and of the category if both are given (SIM-12)."""
    for key in (taxon, category):
        if key is not None and key in prefixes:
            rows = rows.filter(F.startswith(column, F.lit(prefixes[key])))
    return rows


def patient_features(patients: DataFrame) -> DataFrame:
    """(id, terms): observed features, else disorders, else genes, of match requests (SIM-18, SRC-26); MIM: is OMIM:."""
    clean = lambda xs: F.transform(F.array_compact(xs), lambda x: F.regexp_replace(x, "^MIM:", "OMIM:"))
    seen = F.filter("features", lambda f: F.coalesce(f["observed"], F.lit("yes")) != "no")
    lists = [clean(F.transform(seen, lambda f: f["id"])), clean(F.col("disorders.id")), clean(F.col("genomicFeatures.gene.id"))]
    pick = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    return patients.select("id", pick.alias("terms"))


def compare_profiles(profiles: DataFrame, reference: str, aset: AssociationSet) -> DataFrame:
    """(x, y, score, rows, cols): the reference profile against all others of profiles (id, term), by best matches (SIM-11)."""
    others = profiles.filter(F.col("id") != reference).select(F.lit(reference).alias("x"), F.col("id").alias("y")).distinct()
    cells = term_pairs(profiles.select("id", "term").distinct(), others)
    best = mica(cells, aset.ontology.reflexive_closure(aset.relations), information_content(aset)).select("a", "b", "ic")
    return resnik_bma(cells.join(best, ["a", "b"]))


def match_triples(best: DataFrame) -> DataFrame:
    """(a, b, lcs): each pair with each of its most informative common ancestors (SIM-17)."""
    return best.select("a", "b", F.explode("terms").alias("lcs"))


def clean_types(types: DataFrame, noise: Sequence[str] = ("Class", "Node", "cliqueLeader", "NamedIndividual")) -> DataFrame:
    """(id, types): lower-case type names without those that say nothing (SIM-19)."""
    kept = types.filter(~F.col("type").isin(*noise))
    return kept.groupBy("id").agg(F.array_sort(F.collect_set(F.lower("type"))).alias("types"))


def categorical_sufficiency(profiles: DataFrame, ic: DataFrame, categories: DataFrame, statistics: DataFrame) -> DataFrame:
    """(id, categorical): the mean over categories of how well profiles are described in each (SIM-14).

    categories: category, term (all at or below it); statistics: category, mean_ic, max_ic, sum_ic of the background.
    """
    rated = profiles.select("id", "term").distinct().join(ic.select("term", "ic"), "term").join(categories, "term")
    per = rated.groupBy("id", "category").agg(F.avg("ic").alias("m"), F.max("ic").alias("x"), F.sum("ic").alias("s"))
    dense = profiles.select("id").distinct().crossJoin(F.broadcast(statistics))  # every profile has every category: a fixed, small list
    met = dense.join(per, ["id", "category"], "left").na.fill(0.0, ["m", "x", "s"])
    cap = lambda v, bg: F.least(F.col(v) / F.col(bg), F.lit(1.0))
    return met.groupBy("id").agg(F.avg((cap("m", "mean_ic") + cap("x", "max_ic") + cap("s", "sum_ic")) / 3).alias("categorical"))
