"""Counts of containment pairs in blocks and cells, and hashes of words, against plain Python and Column expressions."""

import random

from pyspark.sql import functions as F

from twinframe.operators import containment
from twinframe.plans import bindings

DDL = "video_id long, sec int, hash long, mirror_hash long, usable boolean"


def shipped(spark):
    import __spark_entry__ as entry

    entry._ship(spark)
    return spark


def test_counts_of_pairs_in_small_blocks(spark, monkeypatch):
    for name, most in (("CLIP_ROWS", 20), ("SOURCES", 2), ("CELLS", 16)):
        monkeypatch.setattr(containment, name, most)
    rng = random.Random(4)
    words = [rng.getrandbits(60) for _ in range(25)]
    shown = lambda k, n, bits: [(k, i, rng.choice(words) ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(bits + 1))), None, i % 9 != 5) for i in range(n)]
    sources, clips = [r for k in range(7) for r in shown(k, 60, 0)], [r for k in (3, 100, 101, 102) for r in shown(k, 20, 4)]
    a, b = shipped(spark).createDataFrame(clips, DDL), spark.createDataFrame(sources, DDL)
    met = {}
    for c, i, h, _, u in clips:
        for s in range(7):
            js = [r[1] for r in sources if r[0] == s and r[4] and (r[2] ^ h).bit_count() <= 10]
            if u and c != s and js:
                islands = [[js[0]]]
                for j in js[1:]:
                    islands[-1].append(j) if j - islands[-1][-1] <= 2 else islands.append([j])
                bad = len(islands) > 3 or max(x[-1] - x[0] for x in islands) > 20
                met.setdefault((c, s), [0, 0])[not bad] += 1
    usable = {k: sum(r[4] for r in clips if r[0] == k) for k in (3, 100, 101, 102)}
    matches = containment.Matches(a, b)
    assert matches.listed.count() == len({(k, r.source_id) for r in matches.listed.collect() for k in [r.key]})
    for share in (0.0, 0.6):
        wanted = {(m, c, s, bad, good) for (c, s), (bad, good) in met.items() if good >= 5 and good >= share * (usable[c] - bad) for m in (False, True)}
        assert wanted and set(map(tuple, matches.counts(a, share).collect())) == wanted


def test_hashes_of_words_like_columns(spark):
    texts = [(1, "a b\x0bc\x0c a\r\n\tb "), (2, None), (3, ""), (4, " \n"), (5, "café  x y \x1cz z")]
    docs = shipped(spark).createDataFrame(texts, "doc_id long, text string")
    plain = bindings._words(docs, F.col("doc_id")).select("video_id", "sec", bindings._digest(F.col("w")))
    assert sorted(map(tuple, bindings._seconds(docs).select("video_id", "sec", "hash").collect())) == sorted(map(tuple, plain.collect()))
