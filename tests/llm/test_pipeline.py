"""The pipeline's stages, one after the other, against plain Python on the smallest tables."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_ngram_join import brute as similar
from twinframe.llm import line_quality, mixing

DATA = "/root/testdata/sf0.001"


def test_stages_like_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good = {}
    for i, r in rows.items():
        m = line_quality.measure((r.text or "").encode(), line_quality.LineField())
        if m.n_words >= 50 and 100 * m.n_repeat_words <= 50 * m.n_words and m.content_words >= 0.5 * m.n_words:
            good[i] = r.text
    assert {r.doc_id for r in seen["quality_rules"]} == set(good)
    one = {d for d, _, c in similar(sorted(good.items())) if d == c}
    assert {r.doc_id for r in seen["ngram_jaccard_join"]} == one
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = {r[0]: r for r in contamination([(i, good[i]) for i in sorted(one)], items)}
    clean = {r.doc_id: r for r in seen["benchmark_decontamination"]}
    assert set(clean) == {i for i in one if not hits[i][5]}
    assert all((r.text == good[i]) == (hits[i][2] == 0) for i, r in clean.items())
    size, taken = Counter(), Counter()
    for r in clean.values():
        size[r.source] += len(r.text.split())
    for r in seen["source_mixing"]:
        taken[r.source] += len(r.text.split())
    names = sorted(size)
    goal = mixing.targets([size[s] for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    assert all(taken[s] == round(t) for s, t in zip(names, goal))
    last = seen["shard_packing"]
    assert Counter((r.doc_id, r.text) for r in last) == Counter((r.doc_id, r.text) for r in seen["source_mixing"])
    slots = defaultdict(list)
    for r in last:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_stand_beside_columns_of_their_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i, "mine", -1) for i in range(60)], "doc_id long, text string, shard string, Size int")
    corpus_pipeline.shard_packing(spark, docs, DATA).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["doc_id", "text", "shard", "Size", "__tf_size", "__tf_shard", "slot"]
    assert all(r.shard == "mine" and r.Size == -1 and r["__tf_size"] == r.doc_id + 8 and 0 <= r["__tf_shard"] < 24 for r in got.collect())
