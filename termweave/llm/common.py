"""What the operators share: the shared scratch folder, staged tables and bounded Arrow batches.

One setting of the session is changed: spark.sql.execution.arrow.maxBytesPerBatch is lowered to BATCH_BYTES where it is more. It
only bounds what a batch holds, is never raised, and is the same for all operators, so lazy plans don't depend on their order.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of whole texts that a worker turns into Python values at once, and bytes of an Arrow batch (or one row).
TEXT_ROWS, BATCH_BYTES = 256, 1 << 19
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the Python workers, once for a context: executors needn't have it installed."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_termweave_shipped", False) or not package.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="termweave-")).resolve()  # the driver's own; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, True)
    made = folder / "termweave_sources.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(made))
    context._termweave_shipped = True


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session may lack it: then a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="termweave-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder; removed by ``release`` or ``scratch_scope``, or when the driver's process ends in the ordinary way."""
    ship(spark)
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in list(_made):
            _remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the scratch folder and read again: lineage ends here, and any executor can read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more."""
    for t in tables:
        _remove(getattr(t, "_staged_at", ""))


@contextlib.contextmanager
def scratch_scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end what was staged in it, but for the tables that the function it gives was called with."""
    before, kept = set(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    yield keep
    for path in [p for p in _made if p not in before and p not in kept]:
        _remove(path)


def bound_batches(spark: SparkSession) -> None:
    said = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(_LIMIT).strip().lower())
    if said is None or int(said[1]) << 10 * " kmgt".index(said[2] or " ") > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int | None = TEXT_ROWS) -> DataFrame:
    """mapInArrow over slices of at most ``rows`` rows; at its end a task gives freed memory back to the system, as workers are
    used again by later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = batches if rows is None else (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
            ctypes.CDLL(None).malloc_trim(0)

    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(whole, schema)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
