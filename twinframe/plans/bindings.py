"""How the driver's tables stand in for media, in Spark and as SQL text for the same rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn

CLIP_BASE = 1_000_000_000
SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def media(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: folder is lang, the digest is the text's, other fields follow from id and length."""
    docs = table(spark, d, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    video = i % 4 == 3
    name = F.concat("source", F.lit("_"), i.cast("string"), F.when(video, ".MP4").otherwise(".jpg"))
    return docs.select(
        F.col("lang").alias("folder"),
        i.alias("item_id"),
        F.concat(F.lit("/"), "lang", F.lit("/"), name).alias("full_path"),
        name.alias("file_name"),
        F.when(video, "video").otherwise("photo").alias("kind"),
        (n * 100003).alias("size_bytes"),
        (i * 10000000 + n).alias("last_write_ticks"),
        (1 + n % 1920).cast("int").alias("width"),
        (1 + n % 1080).cast("int").alias("height"),
        F.element_at(F.array(*map(F.lit, ("hevc", "h264", "png", "jpeg", "av1", "vp9"))), (1 + i % 6).cast("int")).alias("codec"),
        F.when(i % 5 != 0, 8000 * n).alias("bit_rate_bps"),
        n.alias("duration_s"),
        F.when(i % 7 != 0, 44100 + 1950 * (i % 3)).cast("int").alias("audio_sample_rate_hz"),
        fn.content_digest("text").alias("sha256"),
    )


MEDIA = """media AS (
  SELECT lang AS folder, doc_id AS item_id, '/' || lang || '/' || source || '_' || doc_id || CASE WHEN doc_id % 4 = 3 THEN '.MP4' ELSE '.jpg' END AS full_path,
    source || '_' || doc_id || CASE WHEN doc_id % 4 = 3 THEN '.MP4' ELSE '.jpg' END AS file_name,
    CASE WHEN doc_id % 4 = 3 THEN 'video' ELSE 'photo' END AS kind, n_chars * 100003 AS size_bytes, doc_id * 10000000 + n_chars AS last_write_ticks,
    CAST(1 + n_chars % 1920 AS INT) AS width, CAST(1 + n_chars % 1080 AS INT) AS height, (['hevc', 'h264', 'png', 'jpeg', 'av1', 'vp9'])[1 + doc_id % 6] AS codec,
    CASE WHEN doc_id % 5 <> 0 THEN 8000 * n_chars END AS bit_rate_bps, n_chars AS duration_s,
    CASE WHEN doc_id % 7 <> 0 THEN CAST(44100 + 1950 * (doc_id % 3) AS INT) END AS audio_sample_rate_hz, upper(sha256(text)) AS sha256
  FROM documents)"""
RANK = "CASE lower(codec) WHEN 'hevc' THEN 1.0 WHEN 'h265' THEN 1.0 WHEN 'av1' THEN 1.0 WHEN 'h264' THEN 0.6 WHEN 'avc' THEN 0.6 WHEN 'png' THEN 0.8 WHEN 'jpeg' THEN 0.3 WHEN 'jpg' THEN 0.3 WHEN 'mjpeg' THEN 0.3 ELSE 0.0 END::DOUBLE"
SCORE = f"(0.5::DOUBLE * (width::BIGINT * height::BIGINT) + 0.3::DOUBLE * coalesce(bit_rate_bps, 0) + 0.15::DOUBLE * size_bytes + 0.05::DOUBLE * ({RANK}))"


def quality() -> object:
    return fn.quality_score("width", "height", "bit_rate_bps", "size_bytes", "codec")


def cached(spark: SparkSession, d: str) -> DataFrame:
    """The cache from the last scan: the documents that have labels."""
    return media(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("item_id")).distinct(), "item_id", "left_semi")


def deleted(spark: SparkSession, d: str) -> DataFrame:
    """What a user picked for deletion: the documents labelled toxic."""
    return media(spark, d).join(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id")).distinct(), "item_id", "left_semi")


CACHED = "cached AS (SELECT * FROM media WHERE item_id IN (SELECT doc_id FROM labels))"
DELETED = "deleted AS (SELECT * FROM media WHERE item_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"


# --- pictures -----------------------------------------------------------------------

#: Every fourth picture has a re-encoded copy, turned or flipped and with some coefficients lost, of this id and more.
COPY_BASE = 1_000_000
ORIENTATIONS = [(t, r, c) for t in (False, True) for r in (False, True) for c in (False, True)]


def _sources_of_photos(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, embedding, plain): embeddings and copies; plain is the vector before it was turned."""
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    lost = lambda v: F.transform(v, lambda x, k: F.when((k * 7 + i) % 16 == 0, F.lit(0).cast("float")).otherwise(x.cast("float")))
    turned = F.col("embedding")
    for o, variant in enumerate(ORIENTATIONS[1:], 1):
        turned = F.when(F.floor(i / 4) % 8 == o, fn.orientation_coefficients("embedding", *variant)).otherwise(turned)
    # ids change in a step of their own: names in lambdas would else mean the new ones
    copies = e.where(i % 4 == 0).select("vec_id", "label", lost(turned).alias("embedding"), lost(F.col("embedding")).alias("plain")).withColumn("vec_id", i + COPY_BASE)
    return e.select("vec_id", "label", "embedding", F.col("embedding").alias("plain")).union(copies)


def photos(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings and their copies as pictures: the vector holds the 64 cosine coefficients; folder is the label."""
    i = F.col("vec_id")
    return _sources_of_photos(spark, d).select(
        F.col("label").cast("string").alias("folder"), i.alias("item_id"), "embedding", fn.orientation_hashes("embedding").alias("hashes"), fn.median_hash("embedding").alias("hash"),
        (100 + i * 37 % 400).cast("int").alias("width"), (100 + i * 53 % 300).cast("int").alias("height"), (1000 + i * 101 % 5000).alias("size_bytes"),
        fn.content_digest((i - F.when(i % 11 == 1, 1).otherwise(0)).cast("string")).alias("sha256"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    """(folder, item_id, faces, bodies): two of three pictures show a face, the plain vector; all show a body, the vector twice."""
    rows = _sources_of_photos(spark, d)
    faces = F.when(F.col("vec_id") % 3 != 0, F.array("plain")).otherwise(F.slice(F.array("plain"), 1, 0))
    return rows.select(F.col("label").cast("string").alias("folder"), F.col("vec_id").alias("item_id"), faces.alias("faces"), F.array(F.concat("plain", "plain")).alias("bodies"))


BITS = "CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN {v}[i + 1] > list_sort({v}[2:64])[32] THEN (1::BIGINT << i) ELSE 0::BIGINT END)) AS BIGINT) + CASE WHEN {v}[64] > list_sort({v}[2:64])[32] THEN (-9223372036854775807 - 1)::BIGINT ELSE 0::BIGINT END"


def variant_sql(t: bool, r: bool, c: bool) -> str:
    """SQL for the coefficients of one orientation; element k of a row of 64."""
    at = "(k % 8) * 8 + k // 8" if t else "k"
    sign = "CASE WHEN ({}) THEN -1 ELSE 1 END".format(" <> ".join([f"({'true' if r else 'false'} AND k // 8 % 2 = 1)", f"({'true' if c else 'false'} AND k % 2 = 1)"]))
    return f"list_transform(range(0, 64), lambda k: ({sign}) * embedding[({at}) + 1])"


_TURNED = "CASE vec_id // 4 % 8 " + " ".join(f"WHEN {o} THEN {variant_sql(*x)}::FLOAT[]" for o, x in enumerate(ORIENTATIONS)) + " END"
_LOST = "list_transform(range(0, 64), lambda z: CASE WHEN (z * 7 + vec_id) % 16 = 0 THEN 0::FLOAT ELSE {v}[z + 1] END)::FLOAT[]"
PHOTOS = f"""shown AS (
  SELECT vec_id, label, embedding::FLOAT[] AS embedding, embedding::FLOAT[] AS plain FROM embeddings
  UNION ALL SELECT vec_id + {COPY_BASE}, label, {_LOST.format(v="turned")}, {_LOST.format(v="embedding")} FROM (SELECT *, {_TURNED} AS turned FROM embeddings WHERE vec_id % 4 = 0)
), photos AS MATERIALIZED (
  SELECT CAST(label AS VARCHAR) AS folder, vec_id AS item_id, embedding, [{", ".join(BITS.format(v=variant_sql(*x)) for x in ORIENTATIONS)}] AS hashes, {BITS.format(v="embedding")} AS hash, CAST(100 + vec_id * 37 % 400 AS INT) AS width,
    CAST(100 + vec_id * 53 % 300 AS INT) AS height, 1000 + vec_id * 101 % 5000 AS size_bytes, upper(sha256(CAST(vec_id - CASE WHEN vec_id % 11 = 1 THEN 1 ELSE 0 END AS VARCHAR))) AS sha256 FROM shown)"""
#: distance is the least over orientations, plain that of the pictures as they stand.
PAIRS = "pairs AS (SELECT a.folder, a.item_id AS item_a, b.item_id AS item_b, a.embedding AS ea, b.embedding AS eb, a.sha256 = b.sha256 AS same, bit_count(xor(a.hash, b.hash)) AS plain, list_min(list_transform(a.hashes, lambda x: list_min(list_transform(b.hashes, lambda y: bit_count(xor(x, y)))))) AS distance FROM photos a JOIN photos b ON a.folder = b.folder AND a.item_id < b.item_id)"


def written_photos(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.store import written

    return written(photos(spark, d), "photos")


def photo_pairs(shown: DataFrame) -> DataFrame:
    """(folder, item_a, item_b, distance, plain, same) of all pairs of a folder, from hashes alone."""
    from ..operators.similarity import folder_pairs

    met = folder_pairs(shown.select("folder", "item_id", "hashes", "hash", "sha256"))
    return met.select("folder", F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b"), fn.orientation_min_fixed("a.hashes", "b.hashes").alias("distance"), fn.hamming("a.hash", "b.hash").alias("plain"), (F.col("a.sha256") == F.col("b.sha256")).alias("same"))


def with_vectors(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """pairs with the vectors of both, as ea and eb."""
    end = lambda n: shown.select("folder", F.col("item_id").alias(f"item_{n}"), F.col("embedding").alias(f"e{n}"))
    return pairs.join(end("a"), ["folder", "item_a"]).join(end("b"), ["folder", "item_b"])


# --- videos as frames ---------------------------------------------------------------

#: Every third video has a copy whose frames' hashes differ in a few bits.
VIDEO_COPY = 100_000


def _noise(count, seed, bits: int):
    """A mask of count bits (at most `bits`) below the 60th, which ones by the seed."""
    masks = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda t: F.when(t < count, F.call_function("shiftleft", F.lit(1).cast("long"), ((seed + t * 11) % 60).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(masks, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _noise_sql(count: str, seed: str, bits: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, {bits}), lambda t: CASE WHEN t < {count} THEN 1::BIGINT << CAST(({seed} + t * 11) % 60 AS INT) ELSE 0::BIGINT END)) AS BIGINT)"


def framed_videos(shown: DataFrame) -> DataFrame:
    """(folder, item_id, frames, rank columns): five pictures in a row are the frames of one video; copies besides."""
    video, f = F.floor(F.col("item_id") / 5), F.col("item_id") % 5
    rows = shown.where(F.col("item_id") < COPY_BASE).select(video.alias("video"), f.alias("f"), "hash")
    copies = rows.where("video % 3 = 0").withColumn("hash", F.col("hash").bitwiseXOR(_noise((F.col("video") + F.col("f")) % 7, F.col("video") * 5 + F.col("f"), 7))).withColumn("video", F.col("video") + VIDEO_COPY)
    framed = rows.union(copies).groupBy("video").agg(F.array_sort(F.collect_list(F.struct("f", "hash"))).alias("f"))
    v = F.col("video")
    return framed.select(
        (v % 10).cast("string").alias("folder"), v.alias("item_id"), F.transform("f", lambda x: F.array(x["hash"])).alias("frames"),
        (100 + v * 37 % 400).cast("int").alias("width"), (100 + v * 53 % 300).cast("int").alias("height"), (1000 + v * 101 % 5000).alias("size_bytes"),
    )


FRAMES = f"""frames AS MATERIALIZED (
  SELECT CAST(video % 10 AS VARCHAR) AS folder, video AS item_id, list(hash ORDER BY f) AS hs, CAST(100 + video * 37 % 400 AS INT) AS width, CAST(100 + video * 53 % 300 AS INT) AS height, 1000 + video * 101 % 5000 AS size_bytes
  FROM (SELECT item_id // 5 AS video, item_id % 5 AS f, hash FROM photos WHERE item_id < {COPY_BASE}
    UNION ALL SELECT item_id // 5 + {VIDEO_COPY}, item_id % 5, xor(hash, {_noise_sql("(item_id // 5 + item_id % 5) % 7", "item_id // 5 * 5 + item_id % 5", 7)}) FROM photos WHERE item_id < {COPY_BASE} AND item_id // 5 % 3 = 0) GROUP BY video)"""


# --- videos as fingerprints ---------------------------------------------------------

#: Every hundredth document starts a compilation: seconds of it, and of the next one.
MADE_BASE, MADE_EVERY = 2 * CLIP_BASE, 100
_PARTS = ((0, 5, 35, 0), (1, 5, 30, 30))  # document after the first, its seconds from and to, where they stand in the clip


def _digest(word) -> object:
    return F.conv(F.substring(F.sha2(word, 256), 1, 15), 16, 10).cast("long")


#: Words whose hashes a task keeps, and rows that one Arrow batch hands back at most.
_KEPT_WORDS, _BATCH = 500_000, 1000


class _Hashes(dict):
    """Digest of a word as a second's hash, as _digest() has it; kept, as words repeat."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = got = int.from_bytes(hashlib.sha256(word).digest()[:8]) >> 4
        return got


def _hashed(docs: DataFrame) -> DataFrame:
    """(video_id, hash list) of documents: bytes.split() parts a text at just the six bytes of SPLIT."""

    def run(batches):
        kept = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                texts = batch.column(1)
                texts = texts.cast(pa.large_binary() if texts.type == pa.large_string() else pa.binary()).to_pylist()
                hashes = [None if t is None else list(map(kept.__getitem__, t.split())) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["video_id", "hashes"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"video_id {key}, hashes array<long>")


def _words(rows: DataFrame, key) -> DataFrame:
    words = F.filter(F.split(F.col("text"), SPLIT), lambda w: w != "")
    return rows.select(key.alias("video_id"), F.posexplode(words).alias("sec", "w"))


def whole_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same videos as sources(), each as one row (video_id, hashes)."""
    return _hashed(table(spark, d, "documents"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as videos: a word is a second, its digest the second's hash; words are never blank."""
    return _seconds(table(spark, d, "documents"))


def _seconds(docs: DataFrame) -> DataFrame:
    return _hashed(docs).select("video_id", F.posexplode("hashes").alias("sec", "hash")).select("video_id", "sec", "hash", F.lit(None).cast("long").alias("mirror_hash"), F.lit(True).alias("usable"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as re-encoded clips, up to four bits of a second's hash wrong, every third mirrored; and compilations."""
    items = _words(table(spark, d, "benchmark"), F.col("item_id"))
    i, sec = F.col("video_id"), F.col("sec")
    near = _digest(F.col("w")).bitwiseXOR(_noise((i + sec) % 5, i * 7 + sec * 13, 5))
    other, mirrored = _digest(F.concat(F.lit("m"), "w")), i % 3 == 0
    cut = items.select("video_id", "sec", F.when(mirrored, other).otherwise(near).alias("hash"), F.when(mirrored, near).otherwise(other).alias("mirror_hash"), F.lit(True).alias("usable")).withColumn("video_id", i + CLIP_BASE)
    docs = table(spark, d, "documents")
    for after, start, end, at in _PARTS:
        first = F.col("video_id") - after
        shown = _seconds(docs.where((F.col("doc_id") - after) % MADE_EVERY == 0))
        part = shown.where((F.col("sec") >= start) & (F.col("sec") < end))
        cut = cut.union(part.select(first + MADE_BASE, F.col("sec") - start + at, "hash", "mirror_hash", "usable"))
    return cut


_TOKENS = "SELECT {key} AS video_id, CAST(row_number() OVER (PARTITION BY {key} ORDER BY p) - 1 AS INT) AS sec, w FROM (SELECT {key}, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM (SELECT *, string_split_regex(text, '" + SPLIT + "') AS ws FROM {source})) WHERE w <> ''"
_HASH = "('0x' || substr(sha256({w}), 1, 15))::BIGINT"
_NEAR = f"xor({_HASH.format(w='w')}, {_noise_sql('(video_id + sec) % 5', 'video_id * 7 + sec * 13', 5)})"
_OTHER = _HASH.format(w="'m' || w")
_PAIR = "mirrored, clip_id, source_id"
FINGERPRINTS = "WITH RECURSIVE " + ",\n".join([
    f"src AS MATERIALIZED (SELECT video_id, sec, {_HASH.format(w='w')} AS hash FROM ({_TOKENS.format(key='doc_id', source='documents')}))",
    f"clip AS MATERIALIZED (SELECT video_id + {CLIP_BASE} AS video_id, sec, CASE WHEN video_id % 3 = 0 THEN {_OTHER} ELSE {_NEAR} END AS hash, CASE WHEN video_id % 3 = 0 THEN {_NEAR} ELSE {_OTHER} END AS mirror_hash FROM ({_TOKENS.format(key='item_id', source='benchmark')})"
    + "".join(f" UNION ALL SELECT video_id - {after} + {MADE_BASE}, sec - {start} + {at}, hash, NULL FROM src WHERE (video_id - {after}) % {MADE_EVERY} = 0 AND sec >= {start} AND sec < {end}" for after, start, end, at in _PARTS) + ")",
    "cl AS (SELECT video_id, CAST(count(*) AS INT) AS n FROM clip GROUP BY video_id)",
    "sl AS (SELECT video_id, CAST(count(*) AS INT) AS n FROM src GROUP BY video_id)",
    "cm AS (SELECT false AS mirrored, video_id AS clip_id, sec AS i, hash AS h FROM clip UNION ALL SELECT true, video_id, sec, coalesce(mirror_hash, hash) FROM clip)",
    "near AS MATERIALIZED (SELECT h, hash FROM (SELECT DISTINCT h FROM cm) x, (SELECT DISTINCT hash FROM src) y WHERE bit_count(xor(h, hash)) <= 10)",
    "m AS MATERIALIZED (SELECT mirrored, clip_id, s.video_id AS source_id, i, s.sec AS j FROM cm JOIN near USING (h) JOIN src s USING (hash) WHERE clip_id <> s.video_id)",
    f"stepped AS (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY {_PAIR}, i ORDER BY j) > 2 THEN 1 ELSE 0 END AS step FROM m)",
    f"islands AS (SELECT *, sum(step) OVER (PARTITION BY {_PAIR}, i ORDER BY j) AS island FROM stepped)",
    f"spans AS (SELECT {_PAIR}, i, island, max(j) - min(j) AS span FROM islands GROUP BY {_PAIR}, i, island)",
    f"seconds AS (SELECT {_PAIR}, i, count(*) AS k, max(span) AS span FROM spans GROUP BY {_PAIR}, i)",
    f"bad AS (SELECT {_PAIR}, i FROM seconds JOIN sl ON sl.video_id = source_id WHERE k > 3 OR span > greatest(20, floor(0.10 * n)))",
    f"el AS MATERIALIZED (SELECT {_PAIR}, i, row_number() OVER (PARTITION BY {_PAIR} ORDER BY i) AS er FROM (SELECT {_PAIR}, c.sec AS i FROM (SELECT DISTINCT {_PAIR} FROM m) JOIN clip c ON c.video_id = clip_id EXCEPT SELECT {_PAIR}, i FROM bad))",
    f"v AS (SELECT {_PAIR}, j - i AS \"offset\", round(sum(1e0 / k), 6) AS weight, min(i) AS first_i FROM (SELECT *, count(*) OVER (PARTITION BY {_PAIR}, i) AS k FROM m) GROUP BY {_PAIR}, j - i)",
    f"top AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {_PAIR} ORDER BY weight DESC, first_i, \"offset\") AS INT) AS r FROM v) WHERE r <= 8)",
    f"hit AS MATERIALIZED (SELECT DISTINCT {_PAIR}, t.r, t.\"offset\", i, e.er FROM (SELECT {_PAIR}, i, j - i + unnest([-1, 0, 1]) AS \"offset\" FROM m) JOIN top t USING ({_PAIR}, \"offset\") JOIN el e USING ({_PAIR}, i))",
    f"cov AS (SELECT {_PAIR}, r, \"offset\", count(*) AS matched, any_value(eligible) AS eligible, 100.0::DOUBLE * count(*) / any_value(eligible) AS coverage_pct FROM hit JOIN (SELECT {_PAIR}, count(*) AS eligible FROM el GROUP BY {_PAIR}) USING ({_PAIR}) GROUP BY {_PAIR}, r, \"offset\")",
    "inside AS (SELECT clip_id, source_id, least(greatest(\"offset\", 0), sn) AS start_s, least(greatest(\"offset\" + cn, least(greatest(\"offset\", 0), sn)), sn) AS end_s, matched, round(coverage_pct, 6) AS coverage_pct, mirrored FROM (SELECT cov.*, cl.n AS cn, sl.n AS sn, row_number() OVER (PARTITION BY clip_id, source_id ORDER BY mirrored, coverage_pct DESC, r) AS place FROM cov JOIN cl ON cl.video_id = clip_id JOIN sl ON sl.video_id = source_id WHERE cl.n <= 0.95 * sl.n AND eligible >= 5 AND matched >= 5 AND coverage_pct >= 60) WHERE place = 1)",
    "best AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY coverage_pct DESC, source_id) AS place FROM inside) WHERE place = 1)",
    f"cut AS (SELECT *, CASE WHEN er - lag(er) OVER (PARTITION BY {_PAIR}, r ORDER BY i) > 3 THEN 1 ELSE 0 END AS step FROM hit)",
    f"grouped AS (SELECT {_PAIR}, r, \"offset\", run, min(i) AS clip_start, max(i) + 1 AS clip_end, count(*) AS matched FROM (SELECT *, sum(step) OVER (PARTITION BY {_PAIR}, r ORDER BY i) AS run FROM cut) GROUP BY {_PAIR}, r, \"offset\", run)",
    f"runs AS MATERIALIZED (SELECT {_PAIR}, r, clip_start, clip_end, least(greatest(clip_start + \"offset\", 0), n) AS src_start, least(greatest(clip_end + \"offset\", 0), n) AS src_end, matched FROM grouped JOIN sl ON sl.video_id = source_id WHERE clip_end - clip_start >= 10 AND matched >= 5)",
    "seq AS (SELECT *, row_number() OVER (PARTITION BY clip_id, source_id ORDER BY clip_start - clip_end, mirrored, r, clip_start, clip_end, src_start, src_end) AS k FROM runs)",
    "walk AS (SELECT clip_id, source_id, 0::BIGINT AS k, []::INT[] AS s, []::INT[] AS e, false AS took FROM seq WHERE k = 1 UNION ALL SELECT clip_id, source_id, k, CASE WHEN free THEN list_append(s, clip_start) ELSE s END, CASE WHEN free THEN list_append(e, clip_end) ELSE e END, free FROM (SELECT w.clip_id, w.source_id, x.k, w.s, w.e, x.clip_start, x.clip_end, len(list_filter(range(1, len(w.s) + 1), lambda p: x.clip_start < w.e[p] AND w.s[p] < x.clip_end)) = 0 AS free FROM walk w JOIN seq x ON x.clip_id = w.clip_id AND x.source_id = w.source_id AND x.k = w.k + 1))",
    "segs AS (SELECT q.clip_id, q.source_id, q.clip_start, q.clip_end, q.src_start, q.src_end, q.mirrored FROM seq q JOIN walk w ON w.clip_id = q.clip_id AND w.source_id = q.source_id AND w.k = q.k WHERE w.took)",
    "parts AS (SELECT clip_id, source_id, sum(clip_end - clip_start) AS shared FROM segs GROUP BY clip_id, source_id)",
    "free AS (SELECT p.*, cl.n AS cn, sl.n AS sn FROM parts p JOIN cl ON cl.video_id = p.clip_id JOIN sl ON sl.video_id = p.source_id WHERE p.clip_id NOT IN (SELECT clip_id FROM inside) AND NOT EXISTS (SELECT 1 FROM inside x WHERE x.clip_id = p.source_id AND x.source_id = p.clip_id))",
    "made AS (SELECT clip_id, any_value(cn) AS len_s, count(*) AS n_sources, CAST(sum(shared) AS BIGINT) AS covered_s FROM free WHERE NOT (shared >= 0.8 * cn AND abs(cn - sn) <= 0.05 * greatest(cn, sn)) GROUP BY clip_id HAVING count(*) >= 2 OR sum(shared) >= 0.3 * any_value(cn))",
])
