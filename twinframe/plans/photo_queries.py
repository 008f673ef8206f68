"""Queries over pictures: hashes, scores, leader groups, identities, orders by likeness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import blocks, cluster, persons, similarity
from ..sources.store import written
from .bindings import BITS, COPY_BASE, FRAMES, ORIENTATIONS, PAIRS, PHOTOS, _noise, _noise_sql, detections, framed_videos, photo_pairs, photos, table, variant_sql, written_photos
from .catalog import query

WITH = f"WITH {PHOTOS}"
THRESHOLD, NEAR_RADIUS, LENGTH, RATIO, PERSON = 90.0, 6, 64, 0.95, 0.3

_DOT = "list_sum(list_transform(range(1, 65), lambda i: ({a}[i] * {b}[i])::DOUBLE))"
_SUM = "list_sum(list_transform({a}, lambda x: x::DOUBLE))"
_SQ = "list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))"
_COS = f"{_DOT.format(a='ea', b='eb')} / (sqrt({_DOT.format(a='ea', b='ea')}) * sqrt({_DOT.format(a='eb', b='eb')}))"
_MIX = "list_sum(list_transform(range(1, 65), lambda i: ea[i]::DOUBLE * eb[i]::DOUBLE))"
_CORR = f"greatest(0.0, ({_MIX} - {_SUM.format(a='ea')} * {_SUM.format(a='eb')} / 64.0) / sqrt(({_SQ.format(a='ea')} - {_SUM.format(a='ea')} * {_SUM.format(a='ea')} / 64.0) * ({_SQ.format(a='eb')} - {_SUM.format(a='eb')} * {_SUM.format(a='eb')} / 64.0)))"
_PCT = "(100.0::DOUBLE * (1.0::DOUBLE - distance / 64.0::DOUBLE))"
_RAISED = f"(CASE WHEN {_PCT} > 60 AND {_PCT} < 92 THEN greatest({_PCT}, least(least(greatest({_CORR}, 0.0), 1.0) * 100.0, {_PCT} + 20)) ELSE {_PCT} END)"
#: Clusters of one folder's detections, one after the other: faces at 0.6, else bodies at 0.8.
PEOPLE = """detected AS (
  SELECT folder, item_id, CASE WHEN face THEN 'face' ELSE 'body' END AS used, CASE WHEN face THEN plain ELSE list_concat(plain, plain) END AS e, CASE WHEN face THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS least_similar, row_number() OVER (PARTITION BY folder ORDER BY item_id) AS k
  FROM (SELECT CAST(label AS VARCHAR) AS folder, vec_id AS item_id, vec_id % 3 <> 0 AS face, plain FROM shown)
), """
_SIMILAR = "list_transform({c}, lambda c: CASE WHEN len(c) <> len({e}) THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform(range(1, len(c) + 1), lambda i: (c[i] * {e}[i])::DOUBLE)) / nullif(sqrt(list_sum(list_transform(c, lambda x: (x * x)::DOUBLE))) * sqrt(list_sum(list_transform({e}, lambda x: (x * x)::DOUBLE))), 0), 0.0) END)"


def _walk(source: str) -> str:
    """Recursive SQL: the clusters after each of source's rows (folder, k, e, least_similar), in order of k."""
    return f"""walk AS (
  SELECT folder, 0::BIGINT AS k, []::FLOAT[][] AS c, []::INT[] AS n, -1::BIGINT AS id FROM (SELECT DISTINCT folder FROM {source})
  UNION ALL
  SELECT folder, k, CASE WHEN place > 0 THEN list_transform(range(1, len(c) + 1), lambda p: CASE WHEN p <> place THEN c[p] ELSE list_transform(range(1, len(e) + 1), lambda i: (c[p][i] + (e[i] - c[p][i]) / (n[p] + 1)::FLOAT)::FLOAT) END) ELSE list_append(c, e) END,
    CASE WHEN place > 0 THEN list_transform(range(1, len(n) + 1), lambda p: CASE WHEN p = place THEN (n[p] + 1)::INT ELSE n[p] END) ELSE list_append(n, 1) END, CASE WHEN place > 0 THEN place - 1 ELSE len(c) END
  FROM (SELECT folder, k, c, n, e, CASE WHEN len(s) > 0 AND list_max(s) > 0 AND list_max(s) >= least_similar THEN list_position(s, list_max(s)) ELSE 0 END AS place
    FROM (SELECT w.folder, d.k, w.c, w.n, d.e, d.least_similar, {_SIMILAR.format(c="w.c", e="d.e")} AS s FROM walk w JOIN {source} d ON d.folder = w.folder AND d.k = w.k + 1))
)"""


PEOPLE += _walk("detected") + ", people AS (SELECT d.folder, d.item_id, d.used, [w.id::INT] AS person_ids FROM detected d JOIN walk w ON w.folder = d.folder AND w.k = d.k)"
_SCORE = f"scored AS MATERIALIZED (SELECT p.folder, item_a, item_b, CASE WHEN same THEN 100.0::DOUBLE WHEN list_has_any(a.person_ids, b.person_ids) AND r > 40 AND r < 90 THEN least(r + 10, 90) ELSE r END AS pct FROM (SELECT *, {_RAISED} AS r FROM pairs) p JOIN people a ON a.folder = p.folder AND a.item_id = item_a JOIN people b ON b.folder = p.folder AND b.item_id = item_b)"


@query(f"{WITH} SELECT item_id, hash FROM photos")
def hash_from_vector(spark, d):
    return photos(spark, d).select("item_id", "hash")


@query("SELECT vec_id, orientation, " + BITS.format(v="v") + " AS hash FROM (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS orientation, {variant_sql(*x)} AS v FROM embeddings" for k, x in enumerate(ORIENTATIONS)) + ")")
def orientation_hashes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(fn.orientation_hashes("embedding")).alias("orientation", "hash"))


@query(f"{WITH}, {PAIRS} SELECT folder, item_a, item_b, CAST(plain AS INT) AS distance, 100.0::DOUBLE * (1.0::DOUBLE - plain / 64.0::DOUBLE) AS similarity_pct FROM pairs")
def hamming_pairs(spark, d):
    return photo_pairs(written_photos(spark, d)).select("folder", "item_a", "item_b", F.col("plain").alias("distance"), fn.similarity_pct("plain").alias("similarity_pct"))


@query(f"{WITH}, {PAIRS} SELECT folder, item_a, item_b, CAST(distance AS INT) AS distance FROM pairs")
def orientation_min_pairs(spark, d):
    return photo_pairs(written_photos(spark, d)).select("folder", "item_a", "item_b", "distance")


_BEST = "best AS MATERIALIZED (SELECT a.folder, a.item_id AS item_a, b.item_id AS item_b, 100.0::DOUBLE * (1.0::DOUBLE - s[least(2, len(s))] / 64.0::DOUBLE) AS pct FROM (SELECT a, b, list_sort(list_transform(a.hs, lambda x: list_min(list_transform(b.hs, lambda y: bit_count(xor(x, y)))))) AS s FROM frames a JOIN frames b ON a.folder = b.folder AND a.item_id <> b.item_id))"


def _frame_scores(videos):
    """Both ways round, as the score isn't symmetric: a is the candidate, b what it is compared with."""
    pairs = similarity.folder_pairs(videos.select("folder", "item_id", "frames"), ordered=False)
    return pairs.select("folder", F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b"), fn.frame_pct("a.frames", "b.frames").alias("pct"))


@query(f"{WITH}, {FRAMES}, {_BEST} SELECT * FROM best")
def frame_second_best(spark, d):
    return _frame_scores(written(framed_videos(photos(spark, d)), "frames"))


@query(f"{WITH}, {PAIRS} SELECT folder, item_a, item_b, round({_COS}, 6) AS cosine FROM pairs")
def cosine_pairs(spark, d):
    return blocks.folder_scores(photos(spark, d), lambda p: p.cosine(), "cosine").withColumn("cosine", F.round("cosine", 6))


@query(f"{WITH}, {PAIRS} SELECT folder, item_a, item_b, round({_CORR}, 6) AS correlation FROM pairs")
def hist_correlation(spark, d):
    return blocks.folder_scores(photos(spark, d), lambda p: p.correlation(LENGTH), "correlation").withColumn("correlation", F.round("correlation", 6))


def _scores(shown, people=None, least=None):
    """(folder, item_a, item_b, pct) of all pairs, or of those that reach the least; with people the whole score."""
    whole = people is not None
    if whole:
        shown = shown.join(people.select("folder", "item_id", F.col("person_ids").alias("people")), ["folder", "item_id"], "left")
    return blocks.folder_scores(shown, lambda p: blocks.combined(p, LENGTH, whole), "pct", least)


@query(f"{WITH}, {PAIRS} SELECT folder, item_a, item_b, round({_RAISED}, 6) AS pct FROM pairs")
def combined_similarity(spark, d):
    return _scores(photos(spark, d)).withColumn("pct", F.round("pct", 6))


@query(f"WITH RECURSIVE {PHOTOS}, {PAIRS}, {PEOPLE}, {_SCORE} SELECT folder, item_a, item_b, round(pct, 6) AS pct FROM scored")
def combined_similarity_person(spark, d):
    """The whole score: digests, hashes, histograms, and people that both pictures show."""
    return _scores(photos(spark, d), persons.resolved(detections(spark, d))).withColumn("pct", F.round("pct", 6))


@query(f"WITH RECURSIVE {PHOTOS}, {PEOPLE} SELECT folder, item_id, used, person_ids[1] AS person_id FROM people")
def person_resolution(spark, d):
    """Faces at 0.6, else bodies at 0.8, into the clusters of their folder."""
    return persons.resolved(detections(spark, d)).select("folder", "item_id", "used", F.col("person_ids")[0].alias("person_id"))


_ENCODED = f"encoded AS (SELECT folder, item_id, hash FROM photos UNION ALL SELECT folder, item_id + {10 * COPY_BASE}, xor(hash, {_noise_sql('item_id % 9', 'item_id * 7', 9)}) FROM photos)"


@query(f"{WITH}, {_ENCODED} SELECT a.folder, a.item_id AS item_a, b.item_id AS item_b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM encoded a JOIN encoded b ON a.folder = b.folder AND a.item_id < b.item_id WHERE bit_count(xor(a.hash, b.hash)) <= {NEAR_RADIUS}")
def banded_near_pairs(spark, d):
    """Pictures and their re-encodes, up to eight bits of whose hashes differ: pairs at 90 percent and more."""
    shown = photos(spark, d).select("folder", "item_id", "hash")
    encoded = shown.withColumn("hash", F.col("hash").bitwiseXOR(_noise(F.col("item_id") % 9, F.col("item_id") * 7, 9))).withColumn("item_id", F.col("item_id") + 10 * COPY_BASE)
    return similarity.near_pairs(written(shown.union(encoded), "encoded"), NEAR_RADIUS)


# --- leader groups ------------------------------------------------------------------

_RANKED = "ranked AS MATERIALIZED (SELECT folder, item_id, CAST(row_number() OVER (PARTITION BY folder ORDER BY 0.5::DOUBLE * (width::BIGINT * height::BIGINT) + 0.15::DOUBLE * size_bytes DESC, item_id) AS INT) AS rank FROM {0})"
_LEADERS = f"""WITH RECURSIVE {PHOTOS}, {PAIRS}, {PEOPLE}, {_SCORE}, {_RANKED.format("photos")}, near AS MATERIALIZED (
  SELECT a.folder, least(a.rank, b.rank) AS low, greatest(a.rank, b.rank) AS high, pct FROM scored s JOIN ranked a ON a.folder = s.folder AND a.item_id = s.item_a JOIN ranked b ON b.folder = s.folder AND b.item_id = s.item_b WHERE pct >= {THRESHOLD}
), earlier AS (
  SELECT r.folder, r.rank, coalesce(list(n.low) FILTER (n.low IS NOT NULL), []::INT[]) AS lows FROM ranked r LEFT JOIN near n ON n.folder = r.folder AND n.high = r.rank GROUP BY r.folder, r.rank
), led AS (
  SELECT folder, 0 AS k, []::INT[] AS leaders FROM (SELECT DISTINCT folder FROM ranked)
  UNION ALL
  SELECT w.folder, w.k + 1, CASE WHEN list_has_any(e.lows, w.leaders) THEN w.leaders ELSE list_append(w.leaders, e.rank) END FROM led w JOIN earlier e ON e.folder = w.folder AND e.rank = w.k + 1
), leaders AS (
  SELECT folder, unnest(leaders) AS rank FROM (SELECT folder, arg_max(leaders, k) AS leaders FROM led GROUP BY folder)
), both_ways AS (SELECT folder, low AS l, high AS m, pct FROM near UNION ALL SELECT folder, high, low, pct FROM near
), members AS (
  SELECT b.folder, b.m AS rank, min(b.l) AS leader FROM both_ways b JOIN leaders x ON x.folder = b.folder AND x.rank = b.l WHERE NOT EXISTS (SELECT 1 FROM leaders y WHERE y.folder = b.folder AND y.rank = b.m) GROUP BY b.folder, b.m
), placed AS (
  SELECT folder, rank, leader FROM members UNION ALL SELECT DISTINCT folder, leader, leader FROM members
)"""


def _ranked(items):
    score = fn.quality_score("width", "height", F.lit(None).cast("long"), "size_bytes", F.lit(None).cast("string"))
    return written(cluster.quality_ranked(items, score).select("folder", "item_id", "rank"), "ranked")


def _by_rank(scores, ranked, a, b):
    """scores with the ranks of both items, as a and b."""
    end = lambda n, name: ranked.select("folder", F.col("item_id").alias(f"item_{n}"), F.col("rank").alias(name))
    return scores.join(end("a", a), ["folder", "item_a"]).join(end("b", b), ["folder", "item_b"])


def leaders(spark, d):
    """(ranked photos, edges with pct, placements): groups on the whole score, digests and people included."""
    shown = written_photos(spark, d)
    ranked = _ranked(shown)
    scores = _scores(shown, persons.resolved(detections(spark, d)), THRESHOLD)
    near = _by_rank(scores, ranked, "ra", "rb").select("folder", F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high"), "pct")
    near = written(near, "near")
    return ranked, near, cluster.leader_clusters(ranked.select("folder", "rank"), near)


@query(f"{_LEADERS} SELECT p.folder, r.item_id AS leader, count(*) AS n FROM placed p JOIN ranked r ON r.folder = p.folder AND r.rank = p.leader GROUP BY p.folder, r.item_id")
def leader_groups(spark, d):
    ranked, _, placed = leaders(spark, d)
    sizes = placed.groupBy("folder", "leader").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(ranked.select("folder", F.col("rank").alias("leader"), "item_id"), ["folder", "leader"]).select("folder", F.col("item_id").alias("leader"), "n")


@query(
    f"""{_LEADERS} SELECT p.folder, l.item_id AS leader, r.item_id, row_number() OVER (PARTITION BY p.folder, p.leader ORDER BY p.rank <> p.leader, p.rank) AS member_rank, CASE WHEN p.rank = p.leader THEN 100.0::DOUBLE ELSE round(b.pct, 6) END AS similarity_pct
    FROM placed p JOIN ranked r ON r.folder = p.folder AND r.rank = p.rank JOIN ranked l ON l.folder = p.folder AND l.rank = p.leader LEFT JOIN both_ways b ON b.folder = p.folder AND b.l = p.leader AND b.m = p.rank"""
)
def leader_group_members(spark, d):
    ranked, near, placed = leaders(spark, d)
    both = near.select("folder", F.col("low").alias("leader"), F.col("high").alias("rank"), "pct").union(near.select("folder", "high", "low", "pct"))
    rows = placed.join(both, ["folder", "leader", "rank"], "left").join(ranked.select("folder", "rank", "item_id"), ["folder", "rank"]).join(ranked.select("folder", F.col("rank").alias("leader"), F.col("item_id").alias("leader_item")), ["folder", "leader"])
    order = Window.partitionBy("folder", "leader").orderBy(F.col("rank") != F.col("leader"), "rank")
    return rows.select("folder", F.col("leader_item").alias("leader"), "item_id", F.row_number().over(order).alias("member_rank"), F.when(F.col("rank") == F.col("leader"), 100.0).otherwise(F.round("pct", 6)).alias("similarity_pct"))


@query(
    f"""WITH RECURSIVE {PHOTOS}, {FRAMES}, {_BEST}, {_RANKED.format("frames")}, near AS MATERIALIZED (
      SELECT r.folder, r.rank, coalesce(list(c.rank ORDER BY c.rank) FILTER (s.pct >= {THRESHOLD}), []::INT[]) AS free FROM ranked r LEFT JOIN best s ON s.folder = r.folder AND s.item_b = r.item_id LEFT JOIN ranked c ON c.folder = s.folder AND c.item_id = s.item_a GROUP BY r.folder, r.rank
    ), led AS (
      SELECT folder, 0 AS k, []::INT[] AS taken, []::STRUCT(rank INT, leader INT)[] AS placed FROM (SELECT DISTINCT folder FROM ranked)
      UNION ALL
      SELECT folder, rank, CASE WHEN new THEN list_concat(taken, list_concat([rank], free)) ELSE taken END, CASE WHEN new THEN list_concat(placed, list_transform(list_concat([rank], free), lambda c: {{'rank': c, 'leader': rank}})) ELSE placed END
      FROM (SELECT folder, rank, taken, placed, free, NOT list_contains(taken, rank) AND len(free) > 0 AS new FROM (SELECT w.folder, n.rank, w.taken, w.placed, list_filter(n.free, lambda c: NOT list_contains(w.taken, c)) AS free FROM led w JOIN near n ON n.folder = w.folder AND n.rank = w.k + 1))
    ), last AS (SELECT folder, unnest(arg_max(placed, k)) AS p FROM led GROUP BY folder)
    SELECT x.folder, l.item_id AS leader, r.item_id FROM last x JOIN ranked r ON r.folder = x.folder AND r.rank = x.p.rank JOIN ranked l ON l.folder = x.folder AND l.rank = x.p.leader"""
)
def video_leader_groups(spark, d):
    """Groups of videos: a candidate joins by its second best frame, best videos lead."""
    videos = written(framed_videos(photos(spark, d)), "frames")
    ranked = _ranked(videos)
    scores = _frame_scores(videos).where(F.col("pct") >= THRESHOLD)
    edges = _by_rank(scores, ranked, "candidate", "reference").select("folder", "reference", "candidate")
    placed = cluster.leader_clusters_asymmetric(ranked.select("folder", "rank"), edges)
    named = lambda c, name: ranked.select("folder", F.col("rank").alias(c), F.col("item_id").alias(name))
    return placed.join(named("rank", "item_id"), ["folder", "rank"]).join(named("leader", "leader_item"), ["folder", "leader"]).select("folder", F.col("leader_item").alias("leader"), "item_id")


# --- identities and orders by likeness ------------------------------------------------


@query(
    f"""WITH RECURSIVE {PHOTOS}, seen AS (SELECT folder, item_id, embedding AS e, {PERSON}::DOUBLE AS least_similar, row_number() OVER (PARTITION BY folder ORDER BY item_id) AS k FROM photos), {_walk("seen")}, last AS (SELECT folder, arg_max(n, k) AS n FROM walk GROUP BY folder)
    SELECT d.folder, d.item_id, w.id::INT AS cluster_id, l.n[w.id + 1] AS sample_count FROM seen d JOIN walk w ON w.folder = d.folder AND w.k = d.k JOIN last l ON l.folder = d.folder"""
)
def person_clusters(spark, d):
    return persons.person_clusters(photos(spark, d), PERSON)


@query(f"{WITH} SELECT item_id, CASE WHEN folder::INT % 2 = 0 THEN 'face' ELSE 'body' END AS used, 64 AS length FROM photos")
def face_else_body(spark, d):
    faces = F.when(F.col("folder").cast("int") % 2 == 0, F.array("embedding")).otherwise(F.slice(F.array("embedding"), 1, 0))
    rows = photos(spark, d).select("item_id", faces.alias("faces"), F.array("embedding").alias("bodies"))
    chosen = F.when(F.size("faces") > 0, F.col("faces")).otherwise(F.col("bodies"))
    return rows.select("item_id", F.when(F.size("faces") > 0, "face").otherwise("body").alias("used"), F.size(chosen[0]).alias("length"))


@query(f"{WITH}, {PAIRS}, p AS (SELECT folder, item_a AS item, item_b AS other, plain AS distance FROM pairs UNION ALL SELECT folder, item_b, item_a, plain FROM pairs), o AS (SELECT *, row_number() OVER (PARTITION BY folder, item ORDER BY distance, other) AS k FROM p) SELECT x.folder, x.item, CAST(x.distance AS INT) AS distance, x.other FROM o x JOIN o y ON x.folder = y.folder AND x.item = y.item AND x.k = 1 AND y.k = 2 WHERE x.distance < {RATIO} * y.distance")
def knn_ratio_test(spark, d):
    return similarity.nearest_two(blocks.nearest_in_blocks(photos(spark, d)), ["folder", "item"], "distance", "other", RATIO)


_THUMB = f"least(greatest(greatest({_PCT}, 0.9 * 100.0 * {_CORR}), 0.0), 100.0)"


@query(f"{WITH}, {PAIRS} SELECT folder, item_a, item_b, round({_THUMB}, 6) AS pct FROM pairs")
def thumb_similarity(spark, d):
    return blocks.folder_scores(photos(spark, d), lambda p: blocks.thumbnail(p, LENGTH), "pct").withColumn("pct", F.round("pct", 6))


@query(
    f"""WITH RECURSIVE {PHOTOS}, {PAIRS}, thumbs AS (SELECT folder, item_a, item_b, round({_THUMB}, 6) AS pct FROM pairs), likes AS MATERIALIZED (
      SELECT folder, a, list(b ORDER BY pct DESC, b) AS others FROM (SELECT folder, item_a AS a, item_b AS b, pct FROM thumbs UNION ALL SELECT folder, item_b, item_a, pct FROM thumbs) GROUP BY folder, a
    ), chain AS (
      SELECT folder, min(item_id) AS item_id, 1 AS pos, [min(item_id)] AS seen FROM photos GROUP BY folder
      UNION ALL
      SELECT folder, next, pos + 1, list_append(seen, next) FROM (SELECT c.folder, c.pos, c.seen, list_filter(l.others, lambda x: NOT list_contains(c.seen, x))[1] AS next FROM chain c JOIN likes l ON l.folder = c.folder AND l.a = c.item_id) WHERE next IS NOT NULL
    ) SELECT folder, item_id, pos FROM chain"""
)
def thumb_nn_chain(spark, d):
    return blocks.nearest_chain(photos(spark, d), lambda p: blocks.thumbnail(p, LENGTH))
