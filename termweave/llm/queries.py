"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, langid, lines, media, mixing, quality, simhash, warc
from .common import scratch_path, table, text_of


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat.format_paths(chat.chains(turns), "tree", "id", "parent")
    read = made.select(F.col("tree").alias("conv_id"), "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text")), weights=(5, 2, 1), budget=1.5, limit=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"), "text")
    read = media.wav_features(media.wav_column(docs))
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256).alias("feature"),
        F.size("fingerprint").alias("n_pairs"),
    )


def encoded(docs: DataFrame) -> DataFrame:
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


def digests(encoded: DataFrame) -> DataFrame:
    """Of ids, and of the bytes that they decode to."""
    read = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return read.select("*", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")).drop("decoded")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out())
    scored = quality.score(docs, quality.fit_sample(docs.filter("not held_out"), labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hnsw.clean_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return hnsw.nearest(hnsw.build_index(vectors, k=10), vectors.filter("id % 100 = 0"), k=10)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = langid.fit_sample(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=100), path)
    number = lambda c: F.nullif(F.regexp_extract(c, "page:(-?[0-9]+)", 1), F.lit("")).cast("long")
    found = warc.resolved(warc.read(spark, path))
    return found.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
QUERIES = {"op1_chat_format": op1_chat_format, "op2_line_dedup": op2_line_dedup, "op3_media_columns": op3_media_columns, "op4_mix_sources": op4_mix_sources, "op5_quality": op5_quality, "op6_ann": op6_ann, "op7_langid": op7_langid, "op8_simhash": op8_simhash, "op9_warc": op9_warc, "op10_bpe": op10_bpe}
ORACLE_SQL = {"op1_chat_format": chat.SQL, "op2_line_dedup": lines.SQL, "op9_warc": warc.SQL}
