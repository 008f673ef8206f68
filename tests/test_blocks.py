"""Picture pairs in blocks against the Column expressions, and what the planner makes of lookups."""

import random

import pytest
from pyspark.sql import functions as F

from twinframe.functions import scalars as fn
from twinframe.operators import blocks, similarity, views

DDL = "folder string, item_id long, sha256 string, hash long, hashes array<long>, embedding array<float>, people array<int>"


@pytest.fixture(scope="module")
def items(spark):
    import __spark_entry__ as entry

    entry._ship(spark)
    rng = random.Random(3)
    signed = lambda: rng.getrandbits(64) - 2**63
    rows = [(f, i, rng.choice([None, "A", "B", str(i)]), signed(), [signed() for _ in range(8)], [rng.uniform(-1, 1) for _ in range(64)], rng.choice([None, [], [1], [2, 3], [3]])) for f, n in (("x", 40), ("y", 13), ("z", 1)) for i in range(n)]
    rows += [("x", 100, "A", None, None, None, [1]), ("x", 101, "A", 5, [5] * 8, [1.0] * 64, None), ("x", 102, "C", 7, [7] * 8, [0.5] * 32, [1])]
    return spark.createDataFrame(rows, DDL)


def by_columns(items, score):
    """The same pairs from a plain join."""
    pairs = similarity.folder_pairs(items)
    return {(r.folder, r.one, r.other): r.v for r in pairs.select("folder", F.col("a.item_id").alias("one"), F.col("b.item_id").alias("other"), score.alias("v")).collect()}


def scored(items, score, least=None):
    return {(r.folder, r.item_a, r.item_b): r.v for r in blocks.folder_scores(items, score, "v", least).collect()}


def columns() -> dict:
    """The same scores as Column expressions of pairs a and b."""
    pct = fn.similarity_pct(fn.orientation_min("a.hashes", "b.hashes"))
    correlation = fn.histogram_correlation("a.embedding", "b.embedding", 64)
    shared, same = F.coalesce(F.arrays_overlap("a.people", "b.people"), F.lit(False)), F.coalesce(F.col("a.sha256") == F.col("b.sha256"), F.lit(False))
    return {
        "cosine": F.coalesce(fn.cosine("a.embedding", "b.embedding"), F.lit(0.0)),
        "correlation": correlation,
        "combined": fn.combined_similarity(F.lit(False), F.lit(True), pct, F.lit(True), correlation),
        "whole": fn.combined_similarity(same, F.lit(True), pct, F.lit(True), correlation, None, shared),
        "thumbnail": fn.thumbnail_similarity(F.lit(False), pct, correlation),
    }


SCORES = {
    "cosine": lambda p: p.cosine(),
    "correlation": lambda p: p.correlation(64),
    "combined": lambda p: blocks.combined(p, 64, False),
    "whole": lambda p: blocks.combined(p, 64, True),
    "thumbnail": lambda p: blocks.thumbnail(p, 64),
}


@pytest.mark.parametrize("name", SCORES)
def test_blocks_equal_columns(items, name, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    score, wanted = SCORES[name], by_columns(items, columns()[name])
    assert scored(items, score) == wanted
    assert scored(items, score, 60.0) == {k: v for k, v in wanted.items() if v >= 60}


def test_nearest_of_blocks_and_chain(items, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    known = items.where("hash is not null")
    plain = by_columns(known, fn.hamming("a.hash", "b.hash"))
    both = {(f, a, b): v for (f, x, y), v in plain.items() for a, b in ((x, y), (y, x))}
    two = {}
    for (f, a, b), v in sorted(both.items(), key=lambda kv: (kv[1], kv[0][2])):
        two.setdefault((f, a), []).append((v, b))
    got = similarity.nearest_two(blocks.nearest_in_blocks(items), ["folder", "item"], "distance", "other", 0.95).collect()
    assert {(r.folder, r.item, r.other, r.distance) for r in got} == {(f, a, x[0][1], x[0][0]) for (f, a), x in two.items() if len(x) > 1 and x[0][0] < 0.95 * x[1][0]}
    thumbs = blocks.folder_scores(items, SCORES["thumbnail"], "pct").withColumn("pct", F.round("pct", 6))
    chain = views.nearest_chain(thumbs.union(thumbs.select("folder", "item_b", "item_a", "pct")), items)
    assert sorted(map(tuple, blocks.nearest_chain(items, SCORES["thumbnail"]).collect())) == sorted(map(tuple, chain.collect()))


@pytest.mark.parametrize("query", ["cosine_pairs", "hist_correlation", "combined_similarity", "combined_similarity_person", "knn_ratio_test", "thumb_similarity", "thumb_nn_chain"])
def test_no_vectors_join_pairs(spark, query):
    """A folder's pairs come from blocks: a join of all pairs, with vectors or both ways round, would be an inner join on folder alone or on items."""
    import __spark_entry__ as entry

    plan = entry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "item_a" not in "".join(line for line in plan.splitlines() if "Join Inner" in line) and "FlatMapGroupsInArrow" in plan


def test_lookups_are_never_broadcast(spark):
    """137 lookups of each part of a small table's hashes: the planner takes them for no more than the table."""
    hashes = lambda n: spark.range(n).select(F.xxhash64("id").alias("hash"))
    plan = similarity.near_hashes(hashes(50), hashes(50), 10)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
