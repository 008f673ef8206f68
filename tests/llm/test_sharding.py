import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from twinframe.llm import sharding as s


def brute_pack(items, capacity):
    """Best fit decreasing item by item over a list of bins."""
    left = []
    placed = []
    for size in sorted(items, reverse=True):
        fit = min(((r, k) for k, r in enumerate(left) if r >= size), default=None)
        if fit is None:
            left.append(max(capacity, size))
            fit = (left[-1], len(left) - 1)
        left[fit[1]] -= size
        placed.append((size, fit[1]))
    return Counter(placed)


def test_runs_equal_item_by_item_packing():
    rng = random.Random(2)
    for _ in range(100):
        items = [rng.choice([3, 5, 8, 13, 21, 34, 400]) for _ in range(rng.randrange(1, 80))]
        sizes = sorted(set(items), reverse=True)
        runs = s.pack(sizes, [items.count(x) for x in sizes], 55)
        got = Counter()
        for size, first, end, number in runs:
            got[size, number] += end - first
        assert got == brute_pack(items, 55)


def checked(rows, got, shards=24):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("cell_rows", [7, 5000])
def test_all_rows_near_equal_and_groups_whole(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(s, "CELL_ROWS", cell_rows)
    rng = random.Random(4)
    rows = [(i, rng.choice("abc") * rng.randrange(1, 60)) for i in range(1500)]
    rows += [(2000 + i, None) for i in range(9)] + [(2100 + i, "") for i in range(5)] + [(5, rows[5][1])] * 3 + [(None, "é" * 40)] * 2 + [(7000, "long " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.digest(docs).collect()
    checked(rows, got)
    where = defaultdict(set)
    text_of = defaultdict(set)
    for d, t in rows:
        text_of[d].add(t)
    for r in got:
        if len(text_of[r.doc_id]) == 1:
            where[next(iter(text_of[r.doc_id]))].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    group = Counter()
    for _, t in rows:
        group[t] += len((t or "").encode()) + 8
    assert max(sizes.values()) <= max(max(group.values()), sum(sizes.values()) / 24 * 1.02)


def test_hot_group_and_small_tables(spark):
    rows = [(i, "copied text") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(600)]
    got = s.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    checked(rows, got)
    assert len({r.shard for r in got if r.doc_id < 300}) == 1
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:2] + (r.slot,) for r in s.digest(one).collect()] == [(1, 8, 0)]
    assert s.digest(one.limit(0)).count() == 0


def test_fixed_capacity_uses_few_shards_and_keeps_columns(spark):
    rows = [Row(doc_id=i, text="x" * (i % 50), shard="mine", size=-1) for i in range(400)]
    got = s.shard(spark.createDataFrame(rows), capacity=4000).collect()
    total = sum(r.asDict()["__tf_size"] for r in got)
    assert len({r["__tf_shard"] for r in got}) <= -(-total // 4000) * 1.3 and all(r.shard == "mine" and r.size == -1 for r in got)
