"""Pairs of items: candidates by folder or by near hashes, and their scores."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn

#: Parts of a hash that candidates are looked up by.
PARTS = 4
_PART_BITS = fn.HASH_BITS // PARTS


def folder_pairs(items: DataFrame, ordered: bool = True, condition: Column | None = None) -> DataFrame:
    """All pairs of items of a folder, as columns a and b: each once, or both ways round.

    Needed where the score's radius is too wide for lookups; quadratic in the folder, so items should be narrow.
    """
    a = items.select(F.col("folder"), F.struct(*items.columns).alias("a"))
    b = items.select(F.col("folder"), F.struct(*items.columns).alias("b"))
    on = F.col("a.item_id") < F.col("b.item_id") if ordered else F.col("a.item_id") != F.col("b.item_id")
    joined = a.join(b, "folder").where(on)
    return joined if condition is None else joined.where(condition)


def _part(hash_column: Column, k: int) -> Column:
    return F.shiftrightunsigned(hash_column, _PART_BITS * k).bitwiseAND(2**_PART_BITS - 1)


def near_hashes(a: DataFrame, b: DataFrame, radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, hash_a, hash_b) of hashes within the radius; a and b are distinct rows (by, hash).

    Hashes within the radius differ in radius // 4 bits at most in one of their four parts. So a's parts
    look up all values that near (137 for radius 10), b's parts stand under their own value: an equi-join.
    A pair that meets in several parts is taken in the first of them. Beyond radius 11 the lookups outgrow their use.
    """
    if radius == 0:
        same = a.select(*by, F.col("hash").alias("hash_a"), F.col("hash").alias("value"))
        return same.join(b.select(*by, F.col("hash").alias("hash_b"), F.col("hash").alias("value")), [*by, "value"]).drop("value")
    most = radius // PARTS
    masks = F.array(*(F.lit(sum(1 << x for x in bits)).cast("long") for n in range(most + 1) for bits in combinations(range(_PART_BITS), n)))
    parts = lambda: F.posexplode(F.array(*(_part(F.col("hash"), k) for k in range(PARTS))))
    asked = a.select(*by, F.col("hash").alias("hash_a"), parts().alias("part", "own")).select(*by, "hash_a", "part", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
    stands = b.select(*by, F.col("hash").alias("hash_b"), parts().alias("part", "value"))
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    earlier = reduce(lambda x, y: x | y, ((F.col("part") > k) & (F.bit_count(_part(differ, k)) <= most) for k in range(PARTS - 1)))
    # the planner takes asked for no larger than a, so it would send all lookups to the driver for a broadcast
    return asked.hint("merge").join(stands, [*by, "part", "value"]).where((F.bit_count(differ) <= radius) & ~earlier).select(*by, "hash_a", "hash_b")


def near_pairs(items: DataFrame, radius: int) -> DataFrame:
    """(folder, item_a, item_b, distance) within the radius: near hashes of the folder first, then the items that have them."""
    rows = items.select("folder", "item_id", "hash")
    hashes = rows.select("folder", "hash").distinct()
    end = lambda n: rows.select("folder", F.col("item_id").alias(f"item_{n}"), F.col("hash").alias(f"hash_{n}"))
    met = near_hashes(hashes, hashes, radius, ("folder",)).join(end("a"), ["folder", "hash_a"]).join(end("b"), ["folder", "hash_b"])
    return met.where("item_a < item_b").select("folder", "item_a", "item_b", fn.hamming("hash_a", "hash_b").alias("distance"))


def exact_groups(items: DataFrame) -> DataFrame:
    """(folder, sha256, n, first_item) of digests that occur twice or more in a folder."""
    return items.groupBy("folder", "sha256").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item")).where("n >= 2")


def nearest_two(rows: DataFrame, partition: list[str], distance: str, tie: str, ratio: float = 0.75) -> DataFrame:
    """The nearest neighbour of each partition whose distance is under ratio times the second's; two rows of each are ever held."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(distance, tie))
    two = rows.select(*partition, distance, tie, place.alias("place")).where("place <= 2")
    of = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    both = two.groupBy(*partition).agg(of(distance, 1).alias(distance), of(tie, 1).alias(tie), of(distance, 2).alias("second"))
    return both.where(F.col(distance) < ratio * F.col("second")).select(*partition, tie, distance)
