import random
import zlib

import numpy as np

from twinframe.llm import nbsvm as n


def test_descent_reaches_the_optimum():
    """The duality gap of the fitted weights is small."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(80)]
    signs = np.where([(r < 12).sum() > (r >= 18).sum() for r in rows], 1.0, -1.0)
    scaled = [np.ones(len(r)) for r in rows]
    w = n.dual_coordinate_descent(rows, scaled, signs, np.ones(80), 30, rounds=500)
    primal = w @ w / 2 + sum(max(0.0, 1 - s * w[r].sum()) for r, s in zip(rows, signs))
    for _ in range(200):
        v = w + rng.normal(0, 0.05, 30)
        assert v @ v / 2 + sum(max(0.0, 1 - s * v[r].sum()) for r, s in zip(rows, signs)) >= primal - 1e-2


def test_ratios():
    got = n.log_count_ratios([np.array([0, 1]), np.array([1, 2])], np.array([1, 0]), 3)
    assert got[0] > 0 and abs(got[1]) < 1e-9 and got[2] < 0


def test_shape():
    assert n.shape(b"The!!") == b"Aa!" and n.shape("É12".encode()) == b"a0"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = n.digest(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    accuracy = np.mean([r.predicted == r.quality for r in got])
    print("held-out AUC", auc, "accuracy", accuracy)
    assert auc > 0.95 and accuracy > 0.93


def test_defined_cases(spark):
    rng = random.Random(2)
    text = lambda good: " ".join(rng.choice(["fine", "prose", "here"] if good else ["###", "BUY!!", "|"]) for _ in range(20))
    rows = [(i, text(i % 2)) for i in range(60)] + [(100, None), (101, ""), (None, "fine"), (102, "long " * 4000), (0, text(0))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 1), (2, None), (None, 1), (999, 0)], "doc_id long, quality int")
    got = n.digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    by = {r.doc_id: r.score for r in got if r.doc_id is not None and 50 <= r.doc_id < 60}
    assert min(v for k, v in by.items() if k % 2) > max(v for k, v in by.items() if not k % 2)
    assert {round(r.score, 6) for r in n.digest(docs, labels.limit(0)).collect()} == {0.5}
    assert n.digest(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(n.digest(docs, labels).collect()) == sorted(n.digest(docs, flipped).collect())
