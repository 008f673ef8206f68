"""File sources: media enumeration, decoded images, cached JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn


def media_files(spark: SparkSession, root: str, videos_only: bool = False) -> DataFrame:
    """Media files below root with kind, size and time; contents are read only where a query asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("kind", fn.media_kind("path")).where("kind IS NOT NULL")
    return files.where("kind = 'video'") if videos_only else files


def digests(files: DataFrame) -> DataFrame:
    """(path, kind, size_bytes, sha256) of files, the digest taken on the executors."""
    return files.select("path", "kind", F.col("length").alias("size_bytes"), fn.content_digest("content").alias("sha256"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pictures (height, width, channels, BGR bytes); files that don't decode are left out."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root).select("image.*")


def folder_last_change(files: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.max("modificationTime").alias("last_modified"), F.count(F.lit(1)).alias("item_count"))


def subfolders(spark: SparkSession, root: str, deep: bool = False) -> list[str]:
    """Folders below root, direct ones or all, without hidden ones, by path regardless of case; none where root can't be listed. Driver-side, as a picker needs it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [path]
    while todo:
        try:
            inside = [s.getPath() for s in files.listStatus(todo.pop()) if s.isDirectory() and not s.getPath().getName().startswith(".")]
        except Exception:  # missing, or no right to read it
            continue
        found += inside
        todo += inside if deep else []
    return sorted((p.toString() for p in found), key=lambda p: (p.lower(), p))


def cached_json(spark: SparkSession, path: str) -> DataFrame:
    """Cached items from JSON; unsigned 64-bit hashes become signed bit patterns."""
    raw = spark.read.option("multiLine", "true").schema("FullPath string, Kind int, SizeBytes long, Sha256 string, OrientationHashes array<decimal(20,0)>").json(path)
    signed = lambda h: F.when(h >= F.lit(str(2**63)).cast("decimal(20,0)"), h - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(h).cast("long")
    return raw.select(F.col("FullPath").alias("full_path"), F.when(F.col("Kind") == 1, "video").otherwise("photo").alias("kind"), F.col("SizeBytes").alias("size_bytes"), F.col("Sha256").alias("sha256"), F.transform("OrientationHashes", signed).alias("orientation_hashes"))
