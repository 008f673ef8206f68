"""Helpers that the training-data operators share.

Word definitions, pass-through Arrow mapping, tables cut from their lineage in
the shared checkpoint folder, and gapless numbering without a hot partition.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that one Arrow batch hands to Python at most.
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
#: Prefix of the columns that operators add to tables whose other columns they keep.
OWN = "__tf_"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts don't add up in a worker.

    Spark reads these settings when a query is planned, which for what an operator returns is
    after it has returned. So they stay set, unless the session has smaller ones.
    """
    for key, most in _LIMITS.items():
        now = spark.conf.get(key) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def lean(run):
    """A function for mapInArrow that gives free memory back when its task ends: idle workers stay alive."""

    @wraps(run)
    def until_done(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return until_done


def space_words(text: bytes) -> list[bytes]:
    """Runs of `[^\\x20\\x09-\\x0D]+`: bytes.split() parts at just these six bytes."""
    return text.split()


def lower_space_words(text: bytes) -> list[bytes]:
    """The same, with A-Z in lower case; other letters stay as they are."""
    return text.translate(_LOWER).split()


_own_folder: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is set and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="twinframe-checkpoint-"))
        named = _own_folder[0]
    return named


#: Path of each table that stash() wrote and nothing has deleted yet.
_stashed: dict[str, SparkSession] = {}
#: Spark deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it back.

    Later stages then depend on that table alone: a lost executor costs no
    recomputation, and values that depend on row order or row ids stay as they were.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    _stashed[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.stashed_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that stash() gave, once nothing will read them again."""
    for table in tables:
        _delete(getattr(table, "stashed_at", None))


def _delete(path: str | None) -> None:
    if (spark := _stashed.pop(path, None)) is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stashes() -> None:
    """Delete the tables that stash() wrote in this process."""
    for path in list(_stashed):
        try:
            _delete(path)
        except Exception:  # the session may be gone at exit; the folder's owner then cleans up
            return


atexit.register(drop_stashes)


def append_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[list[bytes | None]], list[list]]]) -> DataFrame:
    """df with columns computed from the UTF-8 bytes of one of its columns.

    make() runs once per task and returns a function from a batch's values to one
    list per field. All other columns pass through Arrow untouched, whatever their names.
    """
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts = batch.column(at)
            got = compute(texts.cast(pa.binary() if texts.type != pa.large_string() else pa.large_binary()).to_pylist())
            arrays = [*batch.columns, *(pa.array(v, kind) for v, (_, kind) in zip(got, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *(n for n, _ in kinds)])

    return df.mapInArrow(lean(run), schema)


def text_frame(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: extra columns, whatever their names, never meet ours."""
    return docs.select("doc_id", "text")


def salted_cells(rows: int, keys: int, per_cell: int) -> int:
    """Cells a key is split into, so that an even share of rows fits per_cell."""
    return max(1, -(-rows // max(1, keys * per_cell)))


def numbered(df: DataFrame, key: list[str], salt: Column, order: list[Column], cells: int, name: str) -> DataFrame:
    """df with a gapless number from 0 within key, as column name.

    A key is dealt out over cells by salt; rows are counted for each cell, the small
    table of counts is summed up within the key, and rows are numbered in their cell.
    No task holds more than a cell of a hot key. salt and order must be deterministic.
    """
    cell, first = f"{OWN}cell", f"{OWN}first"
    salted = df.withColumn(cell, F.pmod(salt, F.lit(cells)).cast("int") if cells > 1 else F.lit(0))
    within = (F.row_number().over(Window.partitionBy(*key, cell).orderBy(*order)) - 1).cast("long")
    if cells == 1:
        return salted.withColumn(name, within).drop(cell)
    counts = salted.groupBy(*key, cell).agg(F.count(F.lit(1)).alias(f"{OWN}n"))
    before = F.sum(f"{OWN}n").over(Window.partitionBy(*key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(*key, cell, F.coalesce(before, F.lit(0)).alias(first))
    return salted.withColumn(name, within).join(firsts, [*key, cell]).withColumn(name, F.col(name) + F.col(first)).drop(cell, first)
