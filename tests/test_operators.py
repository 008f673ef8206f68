import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import cluster, containment, persons, ranking, similarity, views

DDL = "video_id long, sec int, hash long, mirror_hash long, usable boolean"


# --- pairs ----------------------------------------------------------------------------


def test_banded_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) - 2**63 for _ in range(6)]
    flip = lambda h, n: np.int64(np.uint64(h & (2**64 - 1)) ^ np.uint64(sum(1 << b for b in rng.sample(range(64), n))))
    items = [(rng.choice("xy"), i, int(flip(rng.choice(base), rng.randrange(0, 9)))) for i in range(80)]
    got = similarity.near_pairs(spark.createDataFrame(items, "folder string, item_id long, hash long"), 10).collect()
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    wanted = {(f, a, b, distance(x, y)) for f, a, x in items for g, b, y in items if f == g and a < b and distance(x, y) <= 10}
    assert sorted(map(tuple, got)) == sorted(wanted)


@pytest.mark.parametrize("radius", [0, 3, 6, 10])
def test_near_hashes_miss_none(spark, radius):
    rng = random.Random(radius)
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    a = [rng.getrandbits(64) for _ in range(30)]
    b = list({flip(rng.choice(a), rng.randrange(0, 14)) for _ in range(150)})
    frame = lambda x: spark.createDataFrame([(signed(h),) for h in x], "hash long")
    got = {tuple(r) for r in similarity.near_hashes(frame(a), frame(b), radius).collect()}
    assert got == {(signed(x), signed(y)) for x in a for y in b if (x ^ y).bit_count() <= radius}


def test_numbers_by_ranges(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(20)) for i in range(400)]
    got = ranking.numbered(spark.createDataFrame(rows, "folder string, item_id long, size long").repartition(5), ["folder"], [F.desc("size"), F.col("item_id")], "pos")
    for folder in "hot", "a", "b", "c":
        wanted = [i for _, i, _ in sorted((r for r in rows if r[0] == folder), key=lambda r: (-r[2], r[1]))]
        assert [r.item_id for r in got.where(F.col("folder") == folder).orderBy("pos").collect()] == wanted
        assert [r.pos for r in got.where(F.col("folder") == folder).orderBy("pos").collect()] == list(range(1, len(wanted) + 1))


def test_people_of_faces_or_else_bodies(spark):
    face, other, body = [1.0, 0.0], [0.0, 1.0], [1.0, 1.0, 0.0]
    rows = [("f", 1, [face, other], [body]), ("f", 2, [[0.9, 0.1]], []), ("f", 3, [], [body]), ("f", 4, [], [[1.0, 0.9, 0.0]]), ("f", 5, [], []), ("g", 1, [face], []), ("f", 6, None, [[0.0, 0.0, 0.0]])]
    got = {(r.folder, r.item_id): (r.used, r.person_ids) for r in persons.resolved(spark.createDataFrame(rows, "folder string, item_id long, faces array<array<float>>, bodies array<array<float>>")).collect()}
    assert got == {("f", 1): ("face", [0, 1]), ("f", 2): ("face", [0]), ("f", 3): ("body", [2]), ("f", 4): ("body", [2]), ("f", 5): (None, []), ("g", 1): ("face", [0]), ("f", 6): ("body", [3])}


# --- groups ---------------------------------------------------------------------------


def sequential(n, near):
    taken = {}
    for r in range(1, n + 1):
        if r not in taken and (free := [c for c in range(1, n + 1) if c != r and c not in taken and (r, c) in near]):
            taken[r] = r
            taken.update(dict.fromkeys(free, r))
    return taken


def test_leader_clusters_like_the_sequential_rule(spark):
    rng = random.Random(2)
    for trial in range(3):
        n, folders = 30, ("f", "g")
        edges = {f: {(a, b) for a in range(1, n + 1) for b in range(a + 1, n + 1) if rng.random() < 0.08} for f in folders}
        ranks = spark.createDataFrame([(f, k) for f in folders for k in range(1, n + 1)], "folder string, rank int")
        rows = spark.createDataFrame([(f, a, b) for f in folders for a, b in edges[f]], "folder string, low int, high int")
        got = {(r.folder, r["rank"]): r.leader for r in cluster.leader_clusters(ranks, rows).collect()}
        wanted = {(f, k): v for f in folders for k, v in sequential(n, edges[f] | {(b, a) for a, b in edges[f]}).items()}
        assert got == wanted, trial


def test_no_chaining_and_threshold(spark):
    hashes = {1: 0x00, 2: 0x0F, 3: 0xFF}
    rows = [("f", a, b) for a in hashes for b in hashes if a < b and 100 * (1 - (hashes[a] ^ hashes[b]).bit_count() / 64) >= 90]
    ranks = spark.createDataFrame([("f", k) for k in hashes], "folder string, rank int")
    got = cluster.leader_clusters(ranks, spark.createDataFrame(rows, "folder string, low int, high int")).collect()
    assert sorted((r["rank"], r.leader) for r in got) == [(1, 1), (2, 1)]
    none = spark.createDataFrame([], "folder string, low int, high int")
    assert cluster.leader_clusters(ranks, none).count() == 0


def test_asymmetric_clusters(spark):
    rng = random.Random(5)
    near = {(a, b) for a in range(1, 16) for b in range(1, 16) if a != b and rng.random() < 0.12}
    edges = spark.createDataFrame([("f", a, b) for a, b in near], "folder string, reference int, candidate int")
    got = {r["rank"]: r.leader for r in cluster.leader_clusters_asymmetric(None, edges).collect()}
    assert got == sequential(15, near)


def test_selection_keeps_one(spark):
    rows = [("g", 1, 5, "/a"), ("g", 2, 9, "/b"), ("g", 3, 9, "/c"), ("h", 4, 1, "/d"), ("h", 5, 1, "/e")]
    frame = spark.createDataFrame(rows, "g string, item_id long, size_bytes long, full_path string")
    best = cluster.kept_and_selected(frame, ["g"], F.col("size_bytes"), "best")
    worst = cluster.kept_and_selected(frame, ["g"], F.col("size_bytes"), "worst")
    assert {r.item_id for r in best.where("not selected").collect()} == {2, 4}
    assert {r.item_id for r in worst.where("not selected").collect()} == {1, 5}
    assert tuple(cluster.selection_totals(best.union(best)).first()) == (3, 5 + 9 + 1)


# --- identities and orders --------------------------------------------------------------


def test_person_clusters(spark):
    rows = [("a", 1, [1.0, 0.0, 0.0, 0.0]), ("a", 2, [0.98, 0.02, 0.0, 0.0]), ("a", 3, [0.0, 0.0, 1.0, 0.0]), ("b", 1, [0.5] * 4), ("b", 2, [0.5] * 4), ("b", 3, [0.5] * 960)]
    got = {(r.folder, r.item_id): (r.cluster_id, r.sample_count) for r in persons.person_clusters(spark.createDataFrame(rows, "folder string, item_id long, embedding array<float>")).collect()}
    assert got == {("a", 1): (0, 2), ("a", 2): (0, 2), ("a", 3): (1, 1), ("b", 1): (0, 2), ("b", 2): (0, 2), ("b", 3): (1, 1)}


def test_nearest_chain(spark):
    pct = {(1, 2): 10.0, (1, 3): 50.0, (1, 4): 50.0, (2, 3): 5.0, (2, 4): 70.0, (3, 4): 1.0}
    both = [("f", a, b, p) for (a, b), p in pct.items()] + [("f", b, a, p) for (a, b), p in pct.items()]
    got = views.nearest_chain(spark.createDataFrame(both, "folder string, item_a long, item_b long, pct double"), spark.createDataFrame([("f", i) for i in (4, 1, 3, 2)], "folder string, item_id long")).collect()
    assert [r.item_id for r in sorted(got, key=lambda r: r.pos)] == [1, 3, 2, 4]


# --- containment ------------------------------------------------------------------------


def video(key, seconds, rng, base=None):
    """Rows of a video; base gives its hashes."""
    hashes = base or [rng.getrandbits(64) for _ in range(seconds)]
    return [[key, i, h, rng.getrandbits(64), True] for i, h in enumerate(hashes)]


def excerpt(rows, key, start, length, rng, bits=4):
    return [[key, i, rows[start + i][2] ^ sum(1 << b for b in rng.sample(range(64), bits)), rng.getrandbits(64), True] for i in range(length)]


def frame(spark, rows):
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    return spark.createDataFrame([(k, i, signed(h), signed(m), u) for k, i, h, m, u in rows], DDL)


def aligned(spark, clip, source):
    clips, sources = frame(spark, clip), frame(spark, source)
    found = containment.Matches(clips, sources)
    inside = containment.contained(found, clips, sources).collect()
    parts = containment.segments(found, clips, sources).collect()
    return inside, parts


def brute_contained(clip, source):
    """The alignment of one clip with one source, second by second."""
    usable = lambda rows: [r for r in rows if r[4]]
    limit = max(20, int(0.10 * len(source)))
    for column in (2, 3):
        hits = {c[1]: [s[1] for s in usable(source) if (c[column] ^ s[2]).bit_count() <= 10] for c in usable(clip)}
        distinct = {}
        for i, js in hits.items():
            islands = []
            for j in js:
                if islands and j - islands[-1][-1] <= 2:
                    islands[-1].append(j)
                else:
                    islands.append([j])
            distinct[i] = len(islands) <= 3 and all(x[-1] - x[0] <= limit for x in islands)
        votes, first = {}, {}
        for i in sorted(hits):
            for j in hits[i]:
                votes[j - i] = votes.get(j - i, 0) + 1 / len(hits[i])
                first.setdefault(j - i, i)
        best = None
        eligible = sum(distinct.values())
        for o in sorted(votes, key=lambda o: (-round(votes[o], 6), first[o], o))[:8]:
            n = sum(distinct[i] and any(abs(j - i - o) <= 1 for j in hits[i]) for i in hits)
            if eligible >= 5 and n >= 5 and len(clip) <= 0.95 * len(source) and 100 * n / eligible >= 60 and (best is None or n > best[0]):
                start = min(max(o, 0), len(source))
                best = (n, start, min(max(o + len(clip), start), len(source)), column == 3)
        if best:
            return best
    return None


def test_excerpts_drift_and_rejections(spark):
    rng = random.Random(8)
    source = video(100, 150, rng)
    drift = excerpt(source, 2, 60, 30, rng)
    for k in range(1, 30, 2):
        drift[k][2] = source[60 + k + rng.choice((-1, 1))][2]
    mirrored = video(3, 40, rng)
    for row, s in zip(mirrored, excerpt(source, 3, 50, 40, rng)):
        row[3] = s[2]
    blank = [[4, i, h, m, False] for _, i, h, m, _ in excerpt(source, 4, 10, 30, rng)]
    near_full = excerpt(source, 5, 1, 148, rng)
    scene = [[6, i, source[20][2] ^ 0b101, rng.getrandbits(64), True] for i in range(30)]
    clips = {1: excerpt(source, 1, 45, 40, rng), 2: drift, 3: mirrored, 4: blank, 5: near_full, 6: scene, 7: video(7, 40, rng)}
    still = [[101, i, source[20][2], rng.getrandbits(64), True] for i in range(120)]
    inside, _ = aligned(spark, [r for c in clips.values() for r in c], source + still)
    got = {(r.clip_id, r.source_id): (r.matched, r.start_s, r.end_s, r.mirrored) for r in inside}
    wanted = {(k, s[0][0]): b for k, c in clips.items() for s in (source, still) if (b := brute_contained(c, s))}
    assert got == wanted
    assert got[1, 100] == (40, 45, 85, False) and got[3, 100][1:] == (50, 90, True) and 59 <= got[2, 100][1] <= 61 and {k for k, _ in got} == {1, 2, 3}


def test_compilation(spark):
    rng = random.Random(9)
    a, b = video(100, 120, rng), video(101, 90, rng)
    clip = excerpt(a, 1, 50, 30, rng) + [[1, 30 + r[1], *r[2:]] for r in excerpt(b, 1, 20, 25, rng)]
    inside, parts = aligned(spark, clip, a + b)
    assert not inside
    assert sorted((r.source_id, r.clip_start, r.clip_end, r.src_start, r.src_end, r.mirrored) for r in parts) == [(100, 0, 30, 50, 80, False), (101, 30, 55, 20, 45, False)]
    clips, sources = frame(spark, clip), frame(spark, a + b)
    shared = spark.createDataFrame(parts)
    none = spark.createDataFrame([], "clip_id long, source_id long, coverage_pct double")
    made = containment.compilations(shared, none, clips, sources).collect()
    assert [tuple(r) for r in made] == [(1, 55, 2, 55)]
    assert tuple(containment.summary(none, spark.createDataFrame(made)).first()) == (0, 0, 1)


@pytest.mark.parametrize("key", views.ORDERS)
def test_orders_are_stable(spark, key):
    rows = [("f", i, f"N{i % 3}", i % 2, None if i % 2 else 5, i % 3, 1, None, 44100, 50.0, "AB") for i in range(9)] + [("g", 99, "x", 1, 1, 1, 1, 1, 1, 1.0, "c")]
    items = spark.createDataFrame(rows, "folder string, item_id long, file_name string, size_bytes long, duration_s long, width int, height int, bit_rate_bps long, audio_sample_rate_hz int, similarity_pct double, sha256 string")
    got = views.ordered(items, key).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 10))
    sort = {"file": lambda r: r.file_name.lower(), "size": lambda r: -r.size_bytes, "length": lambda r: -(r.duration_s or 0), "resolution": lambda r: -r.width * r.height}.get(key, lambda r: 0)
    assert [r.item_id for r in got] == [r.item_id for r in sorted(sorted(got, key=lambda r: r.item_id), key=sort)]
