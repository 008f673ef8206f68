"""Mixing sources to target weights, in fixed-length token blocks.

The words of a source, document after document, are cut into blocks of BLOCK_WORDS.
The mix is a sequence of slots in OUTPUT_SHARDS shards, each slot one block. For every
shard a multinomial draw says how many slots each source gets there; draws stay within
what the source has left, so the totals meet the targets. Slot q of a source takes the
block at perm(q mod blocks), perm being a Feistel permutation keyed by source and pass;
every pass visits each block once. A source's last slot is cut where its target is
reached, so the words taken equal the rounded target. Blocks and slots join by index.

Scale: the driver holds one row per source and the shards-by-sources table of counts.
Offsets of documents within a source are summed up in cells, so that a source with a
third of all rows is many tasks' work; blocks join on (source, block), which no key
dominates. Slots are computed where they are needed, from their number.

Defined cases: null or empty texts have size 0 and are never taken; documents without a
source form one source, last in order; sources without words have target 0; repeated
rows are documents of their own; ties in order are between equal rows; an empty table
gives an empty table; other columns are ignored, or kept by `mixed_documents`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, bounded_batches, lean, salted_cells, stash

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK_WORDS, OUTPUT_SHARDS, SEED = 256, 64, 20_011
CELL_ROWS = 5_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_U = np.uint64


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source gets of share * sum(sizes): by weight, at most `most` times its size, the excess reshared."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
        free -= above
    return out


class Permutation:
    """A keyed Feistel permutation of range(n), vectorised; values that fall outside walk on."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = _U(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = (_U(1) << self.half) - _U(1)
        self.keys = np.frombuffer(hashlib.sha256(key.encode()).digest(), np.uint64)

    def _round(self, x, k):
        x = (x + self.keys[k]) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return (x ^ (x >> _U(32))) & self.mask

    def _once(self, x, back):
        left, right = x >> self.half, x & self.mask
        for k in range(3, -1, -1) if back else range(4):
            left, right = (right ^ self._round(left, k), left) if back else (right, left ^ self._round(right, k))
        return (left << self.half) | right

    def __call__(self, x, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64).reshape(-1), back)
        while (far := out >= _U(self.n)).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source's place in the mix: its words, target, blocks, slots, and the length of the last slot."""

    name: str
    size: int
    target: float
    blocks: int
    slots: int
    last_take: int

    def permutation(self, turn: int) -> Permutation:
        return Permutation(self.blocks, f"{SEED}|{self.name}|{turn}")


def plan_source(name: str, size: int, target: float, block_words: int) -> Source:
    words = min(round(target), MOST * size)
    if not size or not words:
        return Source(name, size, target, -(-size // block_words), 0, 0)
    blocks = -(-size // block_words)
    turns, rest = divmod(words, size)
    short = size - (blocks - 1) * block_words
    if not rest:
        whole = Source(name, size, target, blocks, turns * blocks, 0)
        last = int(whole.permutation(turns - 1)([blocks - 1])[0])
        return Source(name, size, target, blocks, turns * blocks, short if last == blocks - 1 else block_words)
    where = int(Permutation(blocks, f"{SEED}|{name}|{turns}")([blocks - 1], back=True)[0])  # slot of the short block
    extra = -(-rest // block_words)
    if where < extra and (extra - 1) * block_words + short < rest:
        extra += 1
    before = (extra - 1) * block_words - (block_words - short if where < extra - 1 else 0)
    return Source(name, size, target, blocks, turns * blocks + extra, rest - before)


def draw_counts(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each output shard: multinomial draws that use up what each source has."""
    left = np.array(slots, np.int64)
    total = int(left.sum())
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        want = total * (k + 1) // shards - total * k // shards
        while want:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += drawn
            left -= drawn
            want -= int(drawn.sum())
    return out


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))


def _starts(rows: DataFrame, cells: int) -> DataFrame:
    """rows with `__tf_start`, the words of their source that stand before them; summed up in cells."""
    cell, key, size, start = f"{OWN}cell", f"{OWN}key", f"{OWN}size", f"{OWN}start"
    order = [F.col("doc_id"), F.col(f"{OWN}hash"), F.col(f"{OWN}row")]
    rows = rows.withColumn(cell, F.pmod(F.xxhash64("doc_id", f"{OWN}hash"), F.lit(cells)).cast("int"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, cell).agg(F.sum(size).alias(f"{OWN}n"))
    first = sums.select(key, cell, F.coalesce(F.sum(f"{OWN}n").over(before(key).orderBy(cell)), F.lit(0)).alias(f"{OWN}first"))
    rows = rows.withColumn(start, F.coalesce(F.sum(size).over(before(key, cell).orderBy(*order)), F.lit(0)))
    return rows.join(first, [key, cell]).withColumn(start, F.col(start) + F.col(f"{OWN}first")).drop(cell, f"{OWN}first")


def _slots(spark, sources: list[Source], counts: np.ndarray, block_words: int) -> DataFrame:
    """A row per slot: shard, place in the shard, source, block, words taken from the block's start, and the pass."""
    by_shard = np.cumsum(counts.sum(axis=1))
    earlier = np.cumsum(counts, axis=0) - counts  # slots of the source in the shards before
    shipped = spark.sparkContext.broadcast((sources, counts, by_shard, earlier))

    def run(batches):
        sources, counts, by_shard, earlier = shipped.value
        kept: dict[tuple[int, int], Permutation] = {}
        for batch in batches:
            g = batch.column(0).to_numpy()
            shard = np.searchsorted(by_shard, g, side="right")
            at = g - (by_shard - counts.sum(axis=1))[shard]
            source, slot = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
            for k in np.unique(shard):
                mine = np.flatnonzero(shard == k)
                ends = np.cumsum(counts[k])
                mixed = Permutation(int(ends[-1]), f"{SEED}|shard|{k}")(at[mine])
                source[mine] = s = np.searchsorted(ends, mixed, side="right")
                slot[mine] = earlier[k][s] + mixed - (ends - counts[k])[s]
            block, take, turn = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), np.zeros(len(g), np.int32)
            for s in np.unique(source):
                src, mine = sources[s], np.flatnonzero(source == s)
                turn[mine] = t = slot[mine] // src.blocks
                for e in np.unique(t):
                    these = mine[t == e]
                    if (s, e) not in kept:
                        kept[s, e] = src.permutation(int(e))
                    block[these] = kept[s, e](slot[these] % src.blocks)
                take[mine] = np.where(slot[mine] == src.slots - 1, src.last_take, np.minimum(block_words, src.size - block[mine] * block_words))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(at), pa.array([sources[s].name for s in source], pa.string()), pa.array(block), pa.array(take), pa.array(turn)], names=["shard", "place", f"{OWN}key", "block", "take", "turn"])

    total = int(counts.sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 100_000))
    return spark.range(0, total, 1, min(parts, max(1, total // 1000))).mapInArrow(lean(run), f"shard int, place long, {OWN}key string, block long, take long, turn int")


def plan(rows: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS) -> tuple[DataFrame, list[Source]]:
    """(pieces, sources): for documents with words, their blocks, and for each the slots that take it, if any.

    rows has doc_id, source and `__tf_` size, hash and row; pieces has besides start,
    block, from and to (places in the block), shard, place, take and turn.
    """
    key, size, start = f"{OWN}key", f"{OWN}size", f"{OWN}start"
    rows = rows.withColumn(key, _source_key())
    stats = sorted(((r[0], int(r[1]), int(r[2])) for r in rows.groupBy(key).agg(F.sum(size), F.count(F.lit(1))).toLocalIterator()), key=lambda r: (r[0] == "-", r[0]))
    goal = targets([s for _, s, _ in stats], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(stats))])
    sources = [plan_source(name, n, t, block_words) for (name, n, _), t in zip(stats, goal, strict=True)]
    counts = draw_counts([s.slots for s in sources], shards) if any(s.slots for s in sources) else np.zeros((shards, max(1, len(sources))), np.int64)
    cells = salted_cells(max((c for *_, c in stats), default=1), 1, CELL_ROWS)
    placed = _starts(rows.where(F.col(size) > 0), cells)
    end = F.col(start) + F.col(size)
    block = lambda x: F.floor(x / block_words).cast("long")
    pieces = placed.withColumn("block", F.explode(F.sequence(block(F.col(start)), block(end - 1))))
    low = F.col("block") * block_words
    pieces = pieces.withColumn("from", F.greatest(F.col(start) - low, F.lit(0))).withColumn("to", F.least(end - low, F.lit(block_words)))
    return pieces.join(_slots(rows.sparkSession, sources, counts, block_words), [key, "block"], "left"), sources


def sized(docs: DataFrame) -> DataFrame:
    """docs with `__tf_` size (words), hash and row; row numbers hold once the table is written."""

    words = F.regexp_count(F.col("text").cast("string"), F.lit(_WORD.pattern))
    return docs.withColumns({f"{OWN}size": F.coalesce(words, F.lit(0)).cast("long"), f"{OWN}hash": F.xxhash64("text"), f"{OWN}row": F.monotonically_increasing_id()})


def _taken() -> Column:
    """Words of a piece that its slot takes; null where no slot takes its block."""
    return F.greatest(F.least("to", "take") - F.col("from"), F.lit(0)) * F.when(F.col("take").isNotNull(), 1)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "source")
    rows = stash(sized(rows).drop("text"), "mix-rows")
    pieces, sources = plan(rows)
    key, size = f"{OWN}key", f"{OWN}size"
    taken = pieces.groupBy(key, f"{OWN}start").agg(F.first("doc_id").alias("doc_id"), F.first(size).alias("size"), F.coalesce(F.sum(_taken()), F.lit(0)).alias("taken")).drop(f"{OWN}start")
    every = taken.unionByName(rows.where(F.col(size) == 0).select(_source_key().alias(key), "doc_id", F.col(size).alias("size"), F.lit(0).cast("long").alias("taken")))
    known = spark.createDataFrame([(s.name, s.size, s.target) for s in sources], f"{key} string, source_size long, target double")
    return every.join(known, key).select("doc_id", "size", "source_size", "target", "taken")


def slices(text: str, ranges: list[tuple[int, int, int]]) -> list[str]:
    """The texts of word ranges (turn, from, to); ranges of a turn that touch become one."""
    merged: list[list[int]] = []
    for turn, start, end in sorted(ranges):
        if merged and merged[-1][0] == turn and merged[-1][2] == start:
            merged[-1][2] = end
        else:
            merged.append([turn, start, end])
    at = [m.span() for m in _WORD.finditer(text)]
    return [text if (a, b) == (0, len(at)) else text[at[a][0] : at[b - 1][1]] for _, a, b in merged]


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """The mix as documents with the columns of docs: one row per run of words taken from a document in one pass.

    A document taken whole keeps its text as it is; n_chars, if there is such a column,
    follows the text.
    """
    columns = docs.columns
    rows = stash(sized(docs), "mix-documents")
    pieces, _ = plan(rows.select("doc_id", "source", f"{OWN}size", f"{OWN}hash", f"{OWN}row"), block_words, shards)
    taken = pieces.where(_taken() > 0).withColumn("low", F.col("block") * block_words - F.col(f"{OWN}start") + F.col("from"))
    ranges = taken.groupBy(f"{OWN}row").agg(F.collect_list(F.struct("turn", "low", (F.col("low") + _taken()).alias("high"))).alias(f"{OWN}ranges"))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    joined = rows.join(ranges, f"{OWN}row").select(*(F.col(f"`{c}`") for c in columns), f"{OWN}ranges")
    text_at = columns.index("text")

    def cut(batches):
        for batch in batches:
            texts, owner = [], []
            for i, (text, ranges) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)):
                got = slices(text, [(r["turn"], r["low"], r["high"]) for r in ranges])
                texts += got
                owner += [i] * len(got)
            out = batch.select(columns).take(pa.array(owner, pa.int32()))
            out = out.set_column(text_at, "text", pa.array(texts, out.column(text_at).type))
            if "n_chars" in columns:
                k = columns.index("n_chars")
                out = out.set_column(k, "n_chars", pa.array([len(t) for t in texts], out.column(k).type))
            yield out

    bounded_batches(docs.sparkSession)
    return joined.mapInArrow(lean(cut), T.StructType([T.StructField(c, kinds[c]) for c in columns]))
