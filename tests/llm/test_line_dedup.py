import random
import re
from collections import defaultdict

from pyspark.sql import Row

from twinframe.llm import line_dedup as d


def brute(docs, min_words=50):
    """All runs of lines, by content: later copies of any run with enough words lose its lines."""
    n_words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    lines = {k: [(p, x) for p, x in enumerate((docs[k][1] or "").split("\n")) if n_words(x)] for k in order}
    first, gone = {}, defaultdict(set)
    for k in order:
        for s in range(len(lines[k])):
            for e in range(s + 1, len(lines[k]) + 1):
                run = tuple(x for _, x in lines[k][s:e])
                if sum(map(n_words, run)) >= min_words:
                    if run in first:
                        gone[k] |= {p for p, _ in lines[k][s:e]}
                    else:
                        first[run] = (k, s)
    out = []
    for k, (doc_id, text) in enumerate(docs):
        parts = [] if text is None else text.split("\n")
        out.append((doc_id, len(parts), len(gone[k]), sum(n_words(parts[p]) for p in gone[k]), None if text is None else "\n".join(x for p, x in enumerate(parts) if p not in gone[k])))
    return out


def fixture(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.choice([1, 3, 9, 20, 60]))) for _ in range(14)]
    passage = [f"p{i} " * 15 for i in range(6)]
    docs = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()} " * 4 for _ in range(rng.randrange(0, 9))]
        if rng.random() < 0.4:
            at, a = rng.randrange(len(lines) + 1), rng.randrange(4)
            lines[at:at] = passage[a : a + rng.randrange(1, 5)]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", " \t"]))
        docs.append((i * 3, "\n".join(lines)))
    docs += [(1, docs[5][1]), (2, docs[6][1] + "\n"), (900, None), (901, ""), (902, "\n\n"), (None, "\n".join(passage)), (903, "w\n" * 300), (904, "w\n" * 120)]
    return docs


def test_like_brute_force(spark):
    for seed in (1, 2):
        docs = fixture(seed)
        key = lambda r: tuple(map(str, r))
        got = d.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs), key=key)


def test_columns_repeats_and_empty_tables(spark):
    text = "\n".join(f"line {i} with ten words in it to be long" for i in range(8))
    rows = [Row(doc_id=1, text=text, n_lines="mine", d=5), Row(doc_id=1, text=text, n_lines="mine", d=5), Row(doc_id=2, text="own\n" + text, n_lines="x", d=6), Row(doc_id=3, text="own\nalone", n_lines=None, d=None)]
    got = sorted(d.dedup(spark.createDataFrame(rows)).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == [text, text, "own", "own\nalone"] and [r["__tf_n_removed"] for r in got] == [0, 0, 8, 0]
    assert got[0].n_lines == "mine" and got[2].d == 6
    none = spark.createDataFrame(rows).limit(0)
    assert d.digest(none).count() == 0
    assert d.digest(spark.createDataFrame(rows[3:], "doc_id long, text string, n_lines string, d long")).collect()[0].text == "own\nalone"


def test_a_hot_rank_is_numbered_in_cells(spark, monkeypatch):
    monkeypatch.setattr(d, "RANK_CELLS", 5)
    rng = random.Random(6)
    hot = "hot line " * 6
    tails = [f"tail {k} " * 20 for k in range(30)]
    docs = [(i, "\n".join([hot, rng.choice(tails), hot, rng.choice(tails)])) for i in range(60)]
    key = lambda r: tuple(map(str, r))
    got = d.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs), key=key)


def test_very_long_documents(spark):
    lines = [f"line {i} of many" for i in range(8_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "own\n" + "\n".join(lines) + "\nend")], "doc_id long, text string")
    got = {r.doc_id: r for r in d.digest(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 8_000 and got[2].text == "own\nend"
