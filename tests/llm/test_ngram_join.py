import random
import re

import pytest
from pyspark.sql import Row

from twinframe.llm import components as c
from twinframe.llm import ngram_join as j


def brute(docs, width=4, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(x.lower() if x.isascii() else x for x in t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k]):
                parent[root(i)] = root(k)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[k][0] for k in range(len(docs)) if root(k) == root(i) and docs[k][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def fixture(seed, n_near=60):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = " ".join(text(12))
    docs, base = [], text(130)
    for _ in range(n_near):  # near copies around the threshold, most of them linked through others
        docs.append(edited(rng, base, rng.randrange(0, 6)))
    for _ in range(40):
        b = text(rng.choice([1, 3, 4, 5, 9, 40, 200]))
        docs += [" ".join(b)] * rng.choice([1, 1, 2, 5]) + [edited(rng, b, 1).upper() for _ in range(rng.randrange(3))]
    docs += [line + " " + " ".join(text(rng.choice([1, 2, 3, 30]))) for _ in range(40)] + [line] * 3
    docs += [None, "", " \n ", "a b", "A  b", "a b c", "v " * 4000]
    ids = rng.sample(range(10_000), len(docs))
    docs = list(zip(ids, docs))
    return docs + docs[:3] + [(None, "null id text here now"), (None, docs[0][1])]


@pytest.mark.parametrize(("seed", "short", "frequent"), [(1, 8, 16), (3, 1, 2)])
def test_like_brute_force(spark, monkeypatch, seed, short, frequent):
    monkeypatch.setattr(j, "FREQUENT", frequent)
    docs = fixture(seed)
    key = lambda r: tuple(map(str, r))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(j, "SHORT_LIST", short)
    monkeypatch.setattr(j, "GROUP_ROWS", 8 * short)
    for components in (j.digest(frame).select("doc_id", "n_shingles", "component_id"), j.jaccard_components(frame)):
        assert sorted(map(tuple, components.collect()), key=key) == sorted(brute(docs), key=key)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_one_of_each_group_stays(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [Row(doc_id=5, text=long, row="mine"), Row(doc_id=3, text=long.upper(), row="kept"), Row(doc_id=3, text=long.upper(), row="kept"), Row(doc_id=9, text="", row="e"), Row(doc_id=10, text=None, row=None), Row(doc_id=11, text="alone here", row="a"), Row(doc_id=None, text=long, row="n")]
    got = j.keep_one(spark.createDataFrame(rows))
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted(r.doc_id for r in got.collect()) == [3, 9, 10, 11]
    assert j.digest(spark.createDataFrame(rows).limit(0)).count() == 0


@pytest.mark.parametrize(("short", "frequent", "group_rows"), [(8, 16, 64), (1, 2, 8)])
def test_every_link_is_counted(spark, monkeypatch, short, frequent, group_rows):
    for name, value in (("SHORT_LIST", short), ("FREQUENT", frequent), ("GROUP_ROWS", group_rows)):
        monkeypatch.setattr(j, name, value)
    docs = [(d, t) for d, t in fixture(5) if d is not None]
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        s = frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset({d})
        sets.setdefault(s, set()).add(d)
    least = {s: min(ids) for s, ids in sets.items()}
    pairs = {(min(least[x], least[y]), max(least[x], least[y]), len(x & y)) for x in sets for y in sets if x != y and 100 * len(x & y) >= 85 * len(x | y)}
    linked = [x for a, b, _ in pairs for x in (a, b)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert len(pairs) > 1.5 * len(set(linked))  # not just a forest
    found = [tuple(r) for r in j.link_pairs(frame).collect()]
    assert sorted(found) == sorted(pairs)
    got = j.digest(frame).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(d, least[s], linked.count(least[s])) for s, ids in sets.items() for d in ids}
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(map(tuple, j.jaccard_components(frame).collect()))
    assert j.digest(frame.limit(0)).count() == 0 and j.link_pairs(frame.limit(0)).count() == 0


def test_unlinked_rows_of_one_id_or_none_all_stay(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, "alone without an id"), (None, "another one without an id"), (None, "another one without an id"), (None, ""), (None, None), (4, "four has this text"), (4, "and four has that text"), (4, "four has this text"), (2, long), (4, long), (7, ""), (7, "")]
    got = j.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = [(None, "alone without an id"), (None, "another one without an id"), (None, ""), (None, None), (4, "four has this text"), (4, "and four has that text"), (2, long), (7, "")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
