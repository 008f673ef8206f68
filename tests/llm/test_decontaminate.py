import hashlib
import random
import re

import pytest
from pyspark.sql import Row

from twinframe.llm import decontaminate as d

SCHEMA = "doc_id long, text string"


def brute(docs, items, window=13):
    """By comparing every window with every place of a document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, who = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[a : a + n]:
                        hit |= set(range(i, i + n))
                        who.add("" if item is None else str(item))
        ids = ",".join(sorted(who))
        out.append((doc_id, len(w), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fixture():
    rng = random.Random(7)
    vocab = ["a", "b", "c", "É", "d9"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 13, 14, 30]))) for i in range(12)] + [(3, "a b"), (12, None), (13, ""), (None, "zz-zz zz")]
    docs = [(i, text(rng.randrange(0, 120))) for i in range(40)]
    docs += [(100, items[4][1].upper()), (101, "x " * 50 + items[5][1] + " y" * 2000), (102, None), (103, ""), (103, ""), (None, "zz zz zz"), (104, "!!" * 300)]
    return docs, items


@pytest.mark.parametrize(("chunk_words", "parts"), [(15, 10), (d.CHUNK_WORDS, 1)])
def test_like_brute_force(spark, chunk_words, parts):
    docs, items = fixture()
    assert parts <= d._parted(spark.createDataFrame(items, "item_id long, text string"), chunk_words)[1] < 2 * parts
    got = d.digest(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), chunk_words).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], SCHEMA)
    assert d.digest(docs, none).collect()[0]["contaminated"] is False
    assert d.digest(docs.limit(0), none).count() == 0


def test_removal_keeps_columns_and_clean_documents(spark):
    item = " ".join(f"w{i}" for i in range(15))
    rows = [Row(doc_id=1, text="Clean text, untouched.", n_words="mine", n_chars=22), Row(doc_id=2, text=item, n_words="x", n_chars=len(item)), Row(doc_id=3, text="z " * 400 + item.upper() + ", end", n_words="x", n_chars=1), Row(doc_id=4, text=None, n_words=None, n_chars=None)]
    docs = spark.createDataFrame(rows)
    got = {r.doc_id: r for r in d.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4} and got[1] == rows[0] and got[4].text is None
    assert got[3].text == "z " * 400 + ", end" and got[3].n_chars == len(got[3].text)
