import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from twinframe.llm import mixing as m


def test_permutations_are_bijections():
    for n in (1, 2, 3, 5, 17, 64, 1000):
        p = m.Permutation(n, f"k{n}")
        got = p(np.arange(n))
        assert sorted(got.tolist()) == list(range(n)) and (p(got, back=True) == np.arange(n)).all()


def test_targets_reshare_the_excess():
    assert m.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert m.targets([0, 0], [5, 2]) == [0, 0] and m.targets([], []) == []
    got = m.targets([10, 1000, 7, 300], [5, 2, 1, 5])
    assert abs(sum(got) - 1.5 * 1317) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 7, 300]))


def test_slots_take_exactly_the_target():
    rng = random.Random(1)
    for _ in range(400):
        size, block = rng.randrange(1, 120), rng.randrange(1, 30)
        target = rng.uniform(0, 2 * size)
        s = m.plan_source("x", size, target, block)
        taken = Counter()
        for q in range(s.slots):
            b = int(s.permutation(q // s.blocks)([q % s.blocks])[0])
            n = s.last_take if q == s.slots - 1 else min(block, size - b * block)
            assert 0 < n <= min(block, size - b * block)
            taken.update(range(b * block, b * block + n))
        assert sum(taken.values()) == round(target) and max(taken.values(), default=0) <= 2


def test_draws_use_up_the_slots():
    got = m.draw_counts([1000, 3, 0, 250], 7)
    assert got.sum(axis=0).tolist() == [1000, 3, 0, 250] and got.min() >= 0 and max(got.sum(axis=1)) - min(got.sum(axis=1)) <= 1


@pytest.mark.parametrize("cell_rows", [3, 5000])
def test_every_document_and_every_target(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(m, "CELL_ROWS", cell_rows)
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["b", "a", "é", None, "hot", "hot", "hot"])) for i in range(200)]
    rows += [(500, None, "a"), (501, "", "empty"), (502, "x " * 5000, "z"), (None, "n n", "a")] + [rows[0]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = m.digest(docs).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None)) + [None]
    goal = dict(zip(names, m.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == round(goal[s]) for s in names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, m.digest(docs.repartition(5)).collect())) == sorted(map(key, got))
    assert m.digest(docs.limit(0)).count() == 0


def test_documents_of_the_mix(spark):
    rng = random.Random(8)
    text = {i: " \n".join(f"d{i}w{k}" for k in range(rng.randrange(0, 70))) for i in range(40)}
    rows = [Row(doc_id=i, text=text[i], source=["a", None, "c"][i % 3], n_chars=0, size="mine") for i in text] + [Row(doc_id=99, text=None, source="a", n_chars=None, size="x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string")
    plan = {r.doc_id: r.taken for r in m.digest(docs).collect()}
    got = m.mixed_documents(docs).collect()
    words, turns = Counter(), Counter()
    for r in got:
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text) and r.size == "mine"
        words[r.doc_id] += len(r.text.split())
        turns.update(r.text.split())
    assert {k: v for k, v in plan.items() if v} == dict(words) and max(turns.values()) <= 2
