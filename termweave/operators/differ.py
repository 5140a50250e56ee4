"""Comparing two association files (DIF-01 to DIF-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_counts(one: DataFrame, two: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n1, n2): distinct values of each column of both; nulls don't count (DIF-01)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*(F.countDistinct(c).alias(c) for c in columns))
        return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in columns))).alias("x")).select("x.*")

    return long(one, "n1").join(long(two, "n2"), "column", "full_outer")


def group_changes(one: DataFrame, two: DataFrame, keys: Sequence[str], only_fewer: bool = False) -> DataFrame:
    """keys, n1, n2 of groups whose counts differ, or have fallen (DIF-02)."""
    a, b = one.groupBy(*keys).agg(F.count("*").alias("n1")), two.groupBy(*keys).agg(F.count("*").alias("n2"))
    met = a.join(b, list(keys), "full_outer").na.fill(0, ["n1", "n2"])
    return met.filter("n2 < n1" if only_fewer else "n1 <> n2")


def missing(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one with no row of two that has the same keys, nulls alike (DIF-03). Swap them for the other direction."""
    b = two.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & one[k].eqNullSafe(F.col(f"__{k}"))
    return one.join(b, on, "left_anti")


def normalised(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows with evidence classes as codes (cls, code), and identifiers without a doubled prefix (DIF-05)."""
    met = rows.join(F.broadcast(evidence.select("cls", "code").dropDuplicates(["cls"])), rows.evidence == F.col("cls"), "left") if "evidence" in rows.columns else rows
    out = met.withColumn("evidence", F.coalesce("code", "evidence")).drop("cls", "code") if "evidence" in rows.columns else met
    return out.withColumn("subject", F.regexp_replace("subject", r"^([^:]+):\1:", "$1:"))


def report(one: DataFrame, two: DataFrame, keys: Sequence[str], title: str = "Differences", shown: int = 20) -> str:
    """Markdown with the number of missing rows in either direction and the first of them (DIF-04)."""
    lines = [f"# {title}"]
    for name, a, b in (("Only in the first", one, two), ("Only in the second", two, one)):
        gone = missing(a, b, keys).select(*keys)
        lines += ["", f"## {name}: {gone.count()}", ""]
        lines += ["* " + " ".join(map(str, r)) for r in gone.orderBy(*keys).limit(shown).collect()]
    return "\n".join(lines)
