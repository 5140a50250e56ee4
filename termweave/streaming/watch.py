"""A folder of association files as a stream: the same parsing and rules as in batch (STR-01 to STR-04).

Lines are stateless; the version that a file's header would latch is a parameter, so nothing depends on their order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse


def annotation_stream(spark: SparkSession, folder: str, kind: str = "gaf", version: str = "2.2", files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumn("file", F.col("_metadata.file_path"))
    return parse.annotations(parse.cells(lines, kind, version), kind, version)


def watch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Hands every micro-batch to ``handle``; with once, what is there now and then ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def message_counts(stream: DataFrame, keys: Sequence[str] = ("problem",)) -> DataFrame:
    """Running counts of problems; for output mode complete or update."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))
