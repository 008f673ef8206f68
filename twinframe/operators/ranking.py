"""Numbers within a key that no key turns into one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

_RANGE, _FIRST = "__range", "__first"


def numbered(items: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """items numbered from 1 within keys by order, which must tell the rows of a key apart.

    Rows are dealt out by ranges of (keys, order) and written, so that ranges stay as they are; each range
    numbers its rows, and the small table of counts by key and range says where it begins.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(items.repartitionByRange(parts, *keys, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, _RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(*keys, _RANGE, F.coalesce(before, F.lit(0)).alias(_FIRST))
    within = F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(*order))
    return dealt.withColumn(name, within).join(firsts, [*keys, _RANGE]).withColumn(name, F.col(name) + F.col(_FIRST)).select(*items.columns, name)
