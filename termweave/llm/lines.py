"""Line dedup (native): which lines of which documents stay, as compressed bitmaps.

Every text is split and hashed once. Occurrences of line keys are range-partitioned by (key hash, document) and sorted by
position within; so a frequent key spreads over many partitions, every (key, document) pair lies in one, and the first
occurrence of a key in a document is told from its place in the stream. Counts of documents leave at most a row for each key
and partition to exchange; what is dropped is decided on the streamed occurrences. Texts take no part in these shuffles: they
meet their bitmaps by a broadcast of those while they are small, and by a shuffle on (id, text hash) beyond it.

Defined results: a null text is an empty text, which is one empty line; a document is a distinct pair of id and text, so
repeated rows count once and get the same bitmap; a null id is an id like another (the first, in keep="first"); of keep="first"
the occurrence of least id, then text hash, then position stays, so equal lines of one document tie by position; a text of
very many lines is an array of them in one task, and its bitmap has a word for 64 of them; an empty table gives an
empty result. Extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, release, staged, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent keys up to this many (16 bytes of hash each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Bytes of bitmaps that are broadcast; beyond them texts and bitmaps are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Texts of which lower() changes A-Z only: ASCII, and signs and letters without a lower case of their own.
_PLAIN = r"\A[\x00-\x7F\xA0-\xBF\xDF-\xFF\u2000-\u206F\u3000-\u303F\u4E00-\u9FFF]*+\z"


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else, by the faster lower() where the text has no character that it might change."""
    plain = (F.octet_length(col) == F.char_length(col)) | F.rlike(col, F.lit(_PLAIN))
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, th, pos, h: a row for each line whose key has min_chars code points at least."""
    text = text_of(text_col)
    # the hash first: beside the generator it would be taken of the whole text for every line
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(ascii_lower(text), "\n", -1).alias("ls"))
    lines = hashed.select("id", "th", F.posexplode("ls").alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(SPACES))
    return lines.select("id", "th", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars).select("id", "th", "pos", F.unhex(F.md5("key")).alias("h"))


def key_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """h, id, th, pos, n, staged in order of the first four: n numbers the occurrences of a key in one document."""
    found = staged(_occurrences(docs, id_col, text_col, min_chars), "line-occurrences")
    ranged = found.repartitionByRange("h", "id", "th").sortWithinPartitions("h", "id", "th", "pos")
    out = staged(ranged.withColumn("n", F.row_number().over(Window.partitionBy("h", "id", "th").orderBy("pos"))), "line-stream")
    release(found)
    return out


def key_statistics(stream: DataFrame) -> DataFrame:
    """h, n_docs, first (struct id, th, pos): for each line key of a stream, its documents and its first occurrence."""
    return stream.filter("n = 1").groupBy("h").agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "th", "pos")).alias("first"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """id, th (xxhash64 of the text), n_dropped, keep_bitmap, staged: for each document that loses a line.

    Keys of at least min_chars code points found in at least min_docs documents lose all their lines (keep="none") or all
    but the first, by id and position (keep="first"). keep_bitmap is an array of longs: bit i of word w stands for
    line 64 w + i, 1 keeps; it ends with the last word that drops a line, and documents that keep all have none.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    stream = key_stream(docs, id_col, text_col, min_chars)
    kept = ["h"] if keep == "none" else ["h", "first"]
    frequent = staged(key_statistics(stream).filter(F.col("n_docs") >= min_docs).select(*kept), "line-keys")
    small = frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    dropped = stream.join(F.broadcast(frequent) if small else frequent, "h")
    if keep == "first":
        dropped = dropped.filter(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
    words = dropped.groupBy("id", "th", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    found = words.groupBy("id", "th").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("words"))
    # words between those that drop a line keep all: -1
    dense = F.expr("flatten(transform(words, (e, i) -> concat(array_repeat(-1L, e.word - coalesce(get(words, i - 1).word, -1) - 1), array(e.bits))))")
    bitmaps = found.select("id", "th", "n_dropped", dense.alias("keep_bitmap"))
    out = staged(bitmaps, "line-bitmaps")
    release(stream, frequent)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """docs with the lines that stay, joined by \\n, and the counts of lines before and of dropped ones. Columns of these names are replaced."""
    new = (kept_col, lines_col, dropped_col)
    size = bitmaps.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("keep_bitmap")), F.lit(0)).alias("words")).first()
    marks = bitmaps.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("n_dropped").alias("__n"), F.col("keep_bitmap").alias("__words"))
    if 64 * size.n + 8 * size.words <= BROADCAST_BYTES:
        marks = F.broadcast(marks)
    text = text_of(text_col)
    joined = docs.join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    joined = joined.withColumn("__lines", F.when(F.col("__n").isNotNull(), F.split(text, "\n", -1)))
    stays = F.expr("array_join(filter(__lines, (x, i) -> getbit(coalesce(get(__words, i div 64), -1L), i % 64) = 1), '\n')")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    values = F.when(F.col("__n").isNull(), text).otherwise(stays), (breaks + 1).cast("long"), F.coalesce(F.col("__n"), F.lit(0)).cast("long")
    return joined.select(*(c for c in docs.columns if c not in new), *(v.alias(n) for v, n in zip(values, new)))


#: DuckDB, for the query's parameters.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
