"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that must not be split. Groups go by falling
size into the bin with the least remaining capacity that still holds them; the bins
stand in a balanced tree by remaining capacity. With a given capacity this keeps the
number of shards small; with a given number of shards the smallest capacity is
searched at which the packing needs no more, which makes the sizes near equal.

Scale: groups of one size are interchangeable, so packing needs only the table of
(group size, number of groups). D distinct sizes add up to D * (D + 1) / 2 bytes at
least, so the table has no more than sqrt(2 * total bytes) rows: 14 million for
100 TB, and in practice far fewer. The driver packs that table in runs; the rows
themselves are numbered within their size in cells that no hot size can fill, and
take the shard of their run. Joins are by group, where Spark may split a hot group.

Defined cases: a null text counts 8 bytes and forms a group of its own, apart from
the empty text; repeated rows are rows of one group; ties between bins go to the
lower number; groups larger than the capacity (a copied text may hold a third of all
bytes) get a bin of their own and raise the law's bound, as nothing may split them;
an empty table gives an empty table; other columns are ignored or, in `shard`, kept.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, numbered, salted_cells, stash, text_frame

SHARDS = 24
#: Bytes that every row costs besides its text.
ROW_BYTES = 8
#: Rows of one cell when groups or slots are numbered.
CELL_ROWS = 5_000
#: The search for the smallest capacity ends at this share of it: each step packs all groups anew.
TOLERANCE = 100_000


class BinTree:
    """Bins by (remaining capacity, number), in a treap whose priorities are hashes of the key."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _join(left, right):
        """One tree from two, all keys of left below those of right."""
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            left[3] = BinTree._join(left[3], right)
            return left
        right[2] = BinTree._join(left, right[2])
        return right

    @staticmethod
    def _cut(node, key):
        """Keys below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = BinTree._cut(node[3], key)
            return node, right
        left, node[2] = BinTree._cut(node[2], key)
        return left, node

    def add(self, remaining: int, number: int) -> None:
        key = (remaining, number)
        left, right = self._cut(self.root, key)
        self.root = self._join(self._join(left, [key, zlib.crc32(repr(key).encode()), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds size."""
        left, right = self._cut(self.root, (size, -1))
        node = right
        while node is not None and node[2] is not None:
            node = node[2]
        if node is not None:
            _, right = self._cut(right, (node[0][0], node[0][1] + 1))
        self.root = self._join(left, right)
        return None if node is None else node[0]


def pack(sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first, end, bin): of the groups of a size, those numbered first to end - 1 go to bin.

    sizes fall strictly. None if more than `most` bins are needed. A group above the
    capacity gets a bin that is full.
    """
    tree, runs, bins = BinTree(), [], 0
    for size, count in zip(sizes, counts, strict=True):
        at = 0
        while at < count:
            remaining, number = tree.take_tightest(size) or (max(capacity, size), bins)
            if number == bins:
                bins += 1
                if most is not None and bins > most:
                    return None
            n = min(count - at, remaining // size)
            runs.append((size, at, at + n, number))
            tree.add(remaining - n * size, number)
            at += n
    return runs


def pack_evenly(sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """The packing into at most `shards` bins with the smallest capacity found by bisection, to a part in TOLERANCE."""
    if not sizes:
        return []
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    low, high = -(-total // shards), max(-(-2 * total // shards), -(-total // shards) + sizes[0])  # any fit succeeds with the latter
    best = pack(sizes, counts, low, shards)
    if best is not None:
        return best
    best = pack(sizes, counts, high, shards)
    while high - low > max(1, low // TOLERANCE):
        middle = (low + high) // 2
        got = pack(sizes, counts, middle, shards)
        low, high, best = (middle, high, best) if got is None else (low, middle, got)
    return best


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """docs with `__tf_` columns size, crc, shard and slot. Give shards, or capacity for as few shards as fit."""
    spark = docs.sparkSession
    size, group = f"{OWN}size", f"{OWN}group"
    text = F.col("text").cast("string")
    rows = docs.withColumns({size: (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long"), f"{OWN}crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary")), group: F.unhex(F.coalesce(F.sha2(text, 256), F.lit("00")))})
    narrow = rows.select(group, size)
    groups = narrow.groupBy(group).agg(F.sum(size).alias(f"{OWN}bytes"), F.count(F.lit(1)).alias(f"{OWN}rows"))
    groups = stash(groups, "shard-groups")
    table = groups.groupBy(f"{OWN}bytes").agg(F.count(F.lit(1)).alias("n"), F.sum(f"{OWN}rows").alias("r")).toArrow()
    sizes, counts, n_rows = (table.column(k).to_numpy() for k in range(3))
    order = np.argsort(-sizes)
    sizes, counts = sizes[order].tolist(), counts[order].tolist()
    if capacity is not None:
        runs = pack(sizes, counts, capacity)
    else:
        runs = pack_evenly(sizes, counts, shards)
    most, n_rows, bins = max(counts, default=1), int(n_rows.sum()), 1 + max((r[3] for r in runs), default=0)

    import pyarrow as pa

    bounds = np.array(runs, dtype=np.int64).reshape(-1, 4)
    bounds = spark.createDataFrame(pa.table({f"{OWN}bytes": bounds[:, 0], f"{OWN}from": bounds[:, 1], f"{OWN}to": bounds[:, 2], f"{OWN}shard": bounds[:, 3].astype(np.int32)}))
    ranked = numbered(groups, [f"{OWN}bytes"], F.xxhash64(group), [F.col(group)], salted_cells(most, 1, CELL_ROWS), f"{OWN}rank")
    placed = ranked.join(bounds, f"{OWN}bytes").where((F.col(f"{OWN}rank") >= F.col(f"{OWN}from")) & (F.col(f"{OWN}rank") < F.col(f"{OWN}to"))).select(group, f"{OWN}shard")
    dealt = rows.join(placed, group).drop(group)
    row = [F.col("doc_id"), F.col(f"{OWN}crc"), F.col(size)]
    return numbered(dealt, [f"{OWN}shard"], F.xxhash64(*row), row, salted_cells(n_rows, bins, CELL_ROWS), f"{OWN}slot")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, checksum, shard and place, under the law of near equal bytes."""
    docs = text_frame(docs)
    text = F.col("text").cast("string")
    narrow = docs.select("doc_id", "text")
    got = shard(narrow)
    return got.select("doc_id", F.col(f"{OWN}size").alias("size"), F.col(f"{OWN}crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col(f"{OWN}shard").alias("shard"), F.col(f"{OWN}slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
