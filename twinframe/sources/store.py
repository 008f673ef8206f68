"""Feature store: cached rows by content key, incremental rescans and logical deletes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn

SCHEMA_VERSION = 2


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of our own only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="twinframe-"))
        named = _own_folder[0]
    return named


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: iterations don't grow the lineage, and a lost executor costs one step."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


#: Path of each table that written() wrote and nothing has deleted yet.
_written: dict[str, SparkSession] = {}


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() gave, once nothing will read them again."""
    for path in [getattr(t, "written_at", None) for t in tables]:
        if (spark := _written.pop(path, None)) is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit; the folder's owner then cleans up
            return


def with_key(items: DataFrame) -> DataFrame:
    return items.withColumn("cache_key", fn.cache_key("full_path", "size_bytes", "last_write_ticks"))


def first_by_key(cached: DataFrame) -> DataFrame:
    """One cached row per key; the one with the least item_id where a key repeats."""
    columns = [c for c in cached.columns if c != "cache_key"]
    return cached.groupBy("cache_key").agg(F.min_by(F.struct(*columns), "item_id").alias("row")).select("cache_key", *(F.col(f"row.{c}") for c in columns))


def cache_hits(items: DataFrame, cached: DataFrame) -> DataFrame:
    """Scanned files whose features are cached."""
    return items.join(cached.select("cache_key"), "cache_key", "left_semi")


def cache_misses(items: DataFrame, cached: DataFrame) -> DataFrame:
    """Scanned files that need extraction."""
    return items.join(cached.select("cache_key"), "cache_key", "left_anti")


def rewritten(scanned: DataFrame, cached: DataFrame, videos_only: bool) -> DataFrame:
    """The cache after a scan: what was scanned and, in videos-only mode, all photos cached before."""
    return scanned.unionByName(cached.where("kind = 'photo'")) if videos_only else scanned


def without_deleted(items: DataFrame, deleted: DataFrame) -> DataFrame:
    return items.join(deleted.select("full_path"), "full_path", "left_anti")


def surviving_groups(groups: DataFrame, deleted: DataFrame) -> DataFrame:
    """Group rows after a delete; groups of one item go."""
    left = without_deleted(groups, deleted)
    alive = left.groupBy("folder", "sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return left.join(alive, ["folder", "sha256"], "left_semi")


def write_features(items: DataFrame, path: str) -> None:
    """Full overwrite, partitioned by folder hash."""
    items.withColumns({"folder_hash": fn.folder_hash("folder"), "schema_version": F.lit(SCHEMA_VERSION)}).write.mode("overwrite").partitionBy("folder_hash").parquet(path)


def read_features(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Cached rows of the current version; a folder prunes partitions."""
    rows = spark.read.parquet(path).where(F.col("schema_version") == SCHEMA_VERSION)
    return rows.where(F.col("folder_hash") == fn.folder_hash(F.lit(folder))) if folder is not None else rows


#: Ticks of 100 ns in a second, as the cache keeps durations.
TICKS = 10_000_000
_AS_THEY_ARE = ("full_path", "file_name", "size_bytes", "last_write_ticks", "sha256", "width", "height", "codec", "bit_rate_bps", "audio_sample_rate_hz")


def to_cached(items: DataFrame) -> DataFrame:
    """Items as cached rows: kinds as numbers, durations in ticks; signals that items have (hashes, histogram, embeddings) stay."""
    signals = [c for c in ("orientation_hashes", "hsv_histogram", "frame_orientation_hashes", "face_embeddings", "body_embeddings") if c in items.columns]
    return items.select("cache_key", "item_id", *_AS_THEY_ARE, F.when(F.col("kind") == "video", 1).otherwise(0).alias("kind"), (F.col("duration_s") * TICKS).cast("long").alias("duration_ticks"), *signals)


def from_cached(cached: DataFrame) -> DataFrame:
    """Cached rows as items again; the ids of people are not cached."""
    return first_by_key(cached).withColumns({"kind": F.when(F.col("kind") == 1, "video").otherwise("photo"), "duration_s": F.col("duration_ticks") / TICKS}).drop("duration_ticks")


FINGERPRINT_VERSION = 1


def write_fingerprints(items: DataFrame, seconds: DataFrame, path: str) -> None:
    """Append the fingerprints (video_id, sec, hash, mirror_hash, usable) of items by content key; a missing mirror hash is the plain one."""
    keyed = items.select(F.col("item_id").alias("video_id"), fn.fingerprint_key(fn.cache_key("full_path", "size_bytes", "last_write_ticks")).alias("fingerprint_key"))
    rows = seconds.join(keyed, "video_id").select("fingerprint_key", "sec", "hash", F.coalesce("mirror_hash", "hash").alias("mirror_hash"), "usable", F.lit(FINGERPRINT_VERSION).alias("version"))
    rows.write.mode("append").parquet(path)


def read_fingerprints(spark: SparkSession, items: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(seconds, missing): cached fingerprints of items in the present version, once each, and the items that need one."""
    keyed = items.withColumn("fingerprint_key", fn.fingerprint_key(fn.cache_key("full_path", "size_bytes", "last_write_ticks")))
    try:
        cached = spark.read.parquet(path).where(F.col("version") == FINGERPRINT_VERSION).drop("version").dropDuplicates(["fingerprint_key", "sec"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "video_id long, sec int, hash long, mirror_hash long, usable boolean"), items
    seconds = keyed.select(F.col("item_id").alias("video_id"), "fingerprint_key").join(cached, "fingerprint_key").drop("fingerprint_key")
    return seconds, keyed.join(cached.select("fingerprint_key"), "fingerprint_key", "left_anti").drop("fingerprint_key")


def reuse_by_path(scanned: DataFrame, shown: DataFrame) -> DataFrame:
    """Scanned rows with `reused` and `selected` of the row shown for their path before, whatever its case; the first where there are several."""
    before = shown.groupBy(F.lower("full_path").alias("__path")).agg(F.min_by("selected", "item_id").alias("selected"))
    rows = scanned.join(before, F.lower("full_path") == F.col("__path"), "left")
    return rows.withColumns({"reused": F.col("__path").isNotNull(), "selected": F.coalesce("selected", F.lit(False))}).drop("__path")
