"""A corpus pipeline over ``documents``: each stage applies one operator of ``termweave.llm``.

Each function of STAGES takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All stages but the last return the columns of docs, further ones than those of ``documents`` included
and whatever their names: those are carried past the operator as one struct. Any column may be null, rows may repeat, texts
may be empty or of any length, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import lines, mixing, quality, simhash
from termweave.llm.common import scratch_scope, staged, table
from termweave.llm.queries import digests, encoded, held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = "__rest"


def _past(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """apply to the columns of documents, with all others in one struct; its result with docs' columns in their order."""
    rest = [c for c in docs.columns if c not in COLUMNS]
    own = [c for c in docs.columns if c in COLUMNS]
    out = apply(docs.select(*own, *([F.struct(*rest).alias(REST)] if rest else [])))
    return out.select(*(F.col(c) if c in own else F.col(REST)[c].alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the classifier puts under 0.7 go. Labels of held-out documents are not learned from.

    A null text scores as an empty one; repeated rows have one score, and stay or go together; without usable labels all stay.
    """
    model = quality.fit_sample(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    return _past(docs, lambda d: quality.score(d, model, score_out="__score", keep_text=True).filter("__score >= 0.7"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents go from all; n_chars is counted anew.

    A null text becomes an empty one; repeated rows are one document where documents are counted, and lose the same lines.
    """
    kept = lambda d: lines.apply_bitmaps(d, lines.keep_bitmaps(d, min_docs=10, min_chars=1), kept_col="text")
    return _past(docs, lambda d: kept(d).withColumn("n_chars", F.char_length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id, null ids last.

    Of rows that share the id the least text hash stays, then the least other columns as JSON; null and empty texts are copies.
    """
    return _past(docs, lambda d: simhash.one_of_each(d, shingle=4, distance=4))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is one, ordered last; a document without words stays once; which of equal sizes is taken again is settled by
    hashes of id and text, so repeated rows cannot be told apart.
    """
    taken = F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("__copy")
    return _past(docs, lambda d: mixing.mix(d, weights=(5, 2, 1), budget=1.5, limit=2).select("*", taken))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and digests of the ids and of what they decode to; a row for each copy.

    A null or empty text has no ids; further columns end here.
    """
    return digests(encoded(docs.select("doc_id", "source", "text"))).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_scope() as keep:  # what a stage wrote on its way goes with its end
            docs = keep(staged(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
