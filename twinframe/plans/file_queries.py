"""Queries over files, folders, groups and the cache."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import cluster, ranking, similarity, views
from ..sources import settings, store
from .bindings import CACHED, DELETED, MEDIA, RANK, SCORE, cached, deleted, media, quality, table
from .catalog import query

WITH = f"WITH {MEDIA}"
GROUPED = "grouped AS (SELECT m.* FROM media m JOIN (SELECT folder, sha256 FROM media GROUP BY folder, sha256 HAVING count(*) >= 2) g USING (folder, sha256))"
GROUP = ["folder", "sha256"]


def grouped(spark, d):
    """Items of exact groups."""
    items = media(spark, d)
    return items.join(similarity.exact_groups(items).select(*GROUP), GROUP, "left_semi")


@query(f"{WITH} SELECT folder, sha256, count(*) AS n, min(item_id) AS first_item FROM media GROUP BY folder, sha256 HAVING count(*) >= 2")
def exact_duplicates(spark, d):
    return similarity.exact_groups(media(spark, d))


@query(f"{WITH}, {GROUPED} SELECT folder, sha256, item_id, item_id = min(item_id) OVER (PARTITION BY folder, sha256) AS is_reference, 100.0::DOUBLE AS similarity_pct FROM grouped")
def exact_groups_members(spark, d):
    first = F.min("item_id").over(Window.partitionBy(*GROUP))
    return grouped(spark, d).select(*GROUP, "item_id", (F.col("item_id") == first).alias("is_reference"), F.lit(100.0).alias("similarity_pct"))


@query(f"{WITH} SELECT count(*) AS n_groups, count(DISTINCT folder) AS n_folders FROM (SELECT folder, sha256 FROM media GROUP BY folder, sha256 HAVING count(*) >= 2)")
def total_sets(spark, d):
    return similarity.exact_groups(media(spark, d)).agg(F.count(F.lit(1)).alias("n_groups"), F.count_distinct("folder").alias("n_folders"))


@query(f"{WITH} SELECT folder, sha256, row_number() OVER (PARTITION BY folder ORDER BY first_item) AS set_number FROM (SELECT folder, sha256, min(item_id) AS first_item FROM media GROUP BY folder, sha256 HAVING count(*) >= 2)")
def set_numbering(spark, d):
    return similarity.exact_groups(media(spark, d)).select(*GROUP, F.row_number().over(Window.partitionBy("folder").orderBy("first_item")).alias("set_number"))


_EXT = "regexp_extract(lower(name), '\\.([^./\\\\]+)$', 1)"


@query(
    f"""SELECT doc_id, CASE WHEN {_EXT} IN ('jpg','jpeg','png','bmp','gif','tiff','tif','webp','heic','heif') THEN 'photo'
    WHEN {_EXT} IN ('mp4','mov','avi','mkv','wmv','m4v','webm','flv') THEN 'video' END AS kind
    FROM (SELECT doc_id, source || '.x/' || doc_id || (['.JPG', '.png', '.Mp4', '.mkv', '.txt', '.webp', ''])[1 + doc_id % 7] AS name FROM documents)"""
)
def kind_classifier(spark, d):
    i = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".Mp4", ".mkv", ".txt", ".webp", ""))), (1 + i % 7).cast("int"))
    return table(spark, d, "documents").select("doc_id", fn.media_kind(F.concat("source", F.lit(".x/"), i.cast("string"), ending)).alias("kind"))


@query(f"{WITH} SELECT folder, item_id FROM media WHERE kind = 'video'")
def videos_only(spark, d):
    return media(spark, d).where("kind = 'video'").select("folder", "item_id")


@query(f"{WITH} SELECT folder, item_id FROM (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM media WHERE kind = 'video') WHERE n >= 2")
def videos_of_folders_with_two(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("folder"))
    return media(spark, d).where("kind = 'video'").withColumn("n", n).where("n >= 2").select("folder", "item_id")


_KEY = "lower(full_path) || '|' || size_bytes || '|' || last_write_ticks"


@query(f"{WITH} SELECT item_id, {_KEY} AS cache_key FROM media")
def cache_key(spark, d):
    return media(spark, d).select("item_id", fn.cache_key("full_path", "size_bytes", "last_write_ticks").alias("cache_key"))


@query(f"{WITH} SELECT item_id, substr(upper(sha256({_KEY})), 1, 32) AS fingerprint_key FROM media")
def fingerprint_key(spark, d):
    return media(spark, d).select("item_id", fn.fingerprint_key(fn.cache_key("full_path", "size_bytes", "last_write_ticks")).alias("fingerprint_key"))


@query(f"{WITH} SELECT item_id, upper(sha256({_KEY} || '|' || 5 || '|' || item_id % 5)) || '.jpg' AS thumb_key FROM media")
def thumb_key(spark, d):
    return media(spark, d).select("item_id", fn.thumbnail_key(fn.cache_key("full_path", "size_bytes", "last_write_ticks"), F.lit(5), F.col("item_id") % 5).alias("thumb_key"))


@query("SELECT DISTINCT source, upper(sha256(lower(source))) AS folder_hash FROM documents")
def folder_hash(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", fn.folder_hash("source").alias("folder_hash"))


@query(f"{WITH} SELECT item_id, upper(substr(sha256, 1, 16)) AS hash_hex FROM media")
def hash_hex(spark, d):
    return media(spark, d).select("item_id", fn.hash_hex("sha256").alias("hash_hex"))


@query(f"{WITH} SELECT item_id, {RANK} AS codec_rank FROM media")
def codec_rank(spark, d):
    return media(spark, d).select("item_id", fn.codec_rank("codec").alias("codec_rank"))


@query(f"{WITH} SELECT item_id, round({SCORE}, 4) AS quality FROM media")
def quality_score(spark, d):
    return media(spark, d).select("item_id", F.round(quality(), 4).alias("quality"))


@query(f"{WITH} SELECT folder, item_id, row_number() OVER (PARTITION BY folder ORDER BY {SCORE} DESC, item_id) AS rank FROM media")
def quality_rank(spark, d):
    return cluster.quality_ranked(media(spark, d), quality()).select("folder", "item_id", "rank")


@query(f"{WITH}, {GROUPED} SELECT folder, sha256, item_id AS best_item FROM (SELECT *, row_number() OVER (PARTITION BY folder, sha256 ORDER BY {SCORE} DESC, item_id) AS p FROM grouped) WHERE p = 1")
def best_copy(spark, d):
    return grouped(spark, d).groupBy(*GROUP).agg(F.max_by("item_id", F.struct(quality(), F.negate("item_id"))).alias("best_item"))


@query(
    f"""{WITH}, {GROUPED} SELECT folder, sha256, n || ' items · best copy: ' || file_name || ' · ' || width || '×' || height || ' · ' || CASE WHEN size_bytes / 1048576.0 >= 1024 THEN printf('%.2f GB', size_bytes / 1048576.0 / 1024) ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS meta
    FROM (SELECT *, row_number() OVER (PARTITION BY folder, sha256 ORDER BY {SCORE} DESC, item_id) AS p, count(*) OVER (PARTITION BY folder, sha256) AS n FROM grouped) WHERE p = 1"""
)
def group_meta(spark, d):
    best = F.max_by(F.struct("file_name", "width", "height", "size_bytes"), F.struct(quality(), F.negate("item_id")))
    rows = grouped(spark, d).groupBy(*GROUP).agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    return rows.select(*GROUP, F.concat(F.col("n").cast("string"), F.lit(" items · best copy: "), "b.file_name", F.lit(" · "), fn.resolution_display("b.width", "b.height"), F.lit(" · "), fn.format_bytes("b.size_bytes")).alias("meta"))


def _selection(keep):
    order = f"ORDER BY {SCORE} DESC, item_id"
    test = "p <> 1" if keep == "best" else "p <> n"
    return f"{WITH}, {GROUPED} SELECT folder, sha256, item_id, {test} AS selected FROM (SELECT *, row_number() OVER (PARTITION BY folder, sha256 {order}) AS p, count(*) OVER (PARTITION BY folder, sha256) AS n FROM grouped)"


@query(_selection("best"))
def keep_best_selection(spark, d):
    return cluster.kept_and_selected(grouped(spark, d), GROUP, quality(), "best").select(*GROUP, "item_id", "selected")


@query(_selection("worst"))
def keep_worst_selection(spark, d):
    return cluster.kept_and_selected(grouped(spark, d), GROUP, quality(), "worst").select(*GROUP, "item_id", "selected")


@query(f"{WITH}, {GROUPED} SELECT count(*) FILTER (p <> 1) AS n_selected, CAST(coalesce(sum(size_bytes) FILTER (p <> 1), 0) AS BIGINT) AS bytes_selected FROM (SELECT *, row_number() OVER (PARTITION BY folder, sha256 ORDER BY {SCORE} DESC, item_id) AS p FROM grouped)")
def selection_totals(spark, d):
    return cluster.selection_totals(cluster.kept_and_selected(grouped(spark, d), GROUP, quality(), "best"))


@query(
    f"""{WITH}, c AS (SELECT *, count(*) OVER (PARTITION BY folder, sha256) AS copies, min(item_id) OVER (PARTITION BY folder, sha256) AS first_place FROM media)
    SELECT folder, item_id, CASE WHEN copies > 1 THEN CAST((dense_rank() OVER (PARTITION BY folder, copies > 1 ORDER BY first_place) - 1) % 6 AS INT) END AS colour FROM c"""
)
def identical_copy_colors(spark, d):
    return cluster.copy_colours(media(spark, d), ["folder"]).select("folder", "item_id", "colour")


_ORDERS = {
    "file": "lower(file_name)",
    "size": "size_bytes DESC",
    "length": "coalesce(duration_s, 0) DESC",
    "resolution": "width::BIGINT * height::BIGINT DESC",
    "bitrate": "coalesce(bit_rate_bps, 0) DESC",
    "audio": "coalesce(audio_sample_rate_hz, 0) DESC",
    "match": "coalesce(similarity_pct, 0) DESC",
    "hash": "lower(substr(sha256, 1, 16))",
}


def _sorted(key):
    def run(spark, d):
        n = F.count(F.lit(1)).over(Window.partitionBy(*GROUP))
        items = media(spark, d).withColumn("similarity_pct", F.when(n > 1, 100.0))
        return views.ordered(items, key).select("folder", "item_id", "pos")

    return run


for _key, _order in _ORDERS.items():
    query(f"{WITH}, s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY folder, sha256) > 1 THEN 100.0 END AS similarity_pct FROM media) SELECT folder, item_id, row_number() OVER (PARTITION BY folder ORDER BY {_order}, item_id) AS pos FROM s", f"sort_by_{_key}")(_sorted(_key))


# --- the cache, and deletes ---------------------------------------------------------


@query(f"{WITH}, {CACHED} SELECT item_id, {_KEY} AS cache_key FROM media WHERE item_id IN (SELECT item_id FROM cached)")
def cache_hits(spark, d):
    return store.cache_hits(store.with_key(media(spark, d)), store.with_key(cached(spark, d))).select("item_id", "cache_key")


@query(f"{WITH}, {CACHED} SELECT item_id, {_KEY} AS cache_key FROM media WHERE item_id NOT IN (SELECT item_id FROM cached)")
def cache_misses(spark, d):
    return store.cache_misses(store.with_key(media(spark, d)), store.with_key(cached(spark, d))).select("item_id", "cache_key")


@query(f"{WITH}, {CACHED} SELECT kind, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT kind, size_bytes FROM media WHERE kind = 'video' UNION ALL SELECT kind, size_bytes FROM cached WHERE kind = 'photo') GROUP BY kind")
def cache_rewrite(spark, d):
    """A videos-only rescan keeps the photos cached before."""
    kept = store.rewritten(media(spark, d).where("kind = 'video'"), cached(spark, d), True)
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


@query(f"{WITH}, {DELETED} SELECT item_id FROM media WHERE full_path NOT IN (SELECT full_path FROM deleted)")
def delete_antijoin(spark, d):
    return store.without_deleted(media(spark, d), deleted(spark, d)).select("item_id")


@query(f"{WITH}, {DELETED}, {GROUPED}, lft AS (SELECT * FROM grouped WHERE full_path NOT IN (SELECT full_path FROM deleted)) SELECT folder, sha256, item_id FROM lft JOIN (SELECT folder, sha256 FROM lft GROUP BY folder, sha256 HAVING count(*) > 1) USING (folder, sha256)")
def groups_after_delete(spark, d):
    return store.surviving_groups(grouped(spark, d), deleted(spark, d)).select(*GROUP, "item_id")


@query(f"{WITH}, {DELETED}, {CACHED} SELECT item_id FROM deleted EXCEPT SELECT item_id FROM cached WHERE kind = 'video'")
def deleted_minus_failed(spark, d):
    """Of what was to be deleted, what didn't fail (videos in use)."""
    return deleted(spark, d).join(cached(spark, d).where("kind = 'video'").select("item_id"), "item_id", "left_anti").select("item_id")


@query(f"{WITH}, {CACHED} SELECT item_id, first_from FROM (SELECT item_id, lower(full_path) AS p, 'cache' AS first_from, 0 AS o FROM cached UNION ALL SELECT item_id, lower(full_path), 'scan', 1 FROM media) QUALIFY row_number() OVER (PARTITION BY p ORDER BY o, item_id) = 1")
def union_first_wins(spark, d):
    both = cached(spark, d).select("item_id", F.lower("full_path").alias("p"), F.lit("cache").alias("first_from"), F.lit(0).alias("o")).union(media(spark, d).select("item_id", F.lower("full_path"), F.lit("scan"), F.lit(1)))
    return both.groupBy("p").agg(F.min_by(F.struct("item_id", "first_from"), F.struct("o", "item_id")).alias("x")).select("x.item_id", "x.first_from")


@query(f"{WITH}, {DELETED}, f AS (SELECT folder, count(*) FILTER (item_id IN (SELECT item_id FROM deleted)) AS gone, count(*) AS n FROM media GROUP BY folder) SELECT folder, n - gone AS n_left FROM f WHERE n > gone")
def folders_surviving(spark, d):
    return store.without_deleted(media(spark, d), deleted(spark, d)).groupBy("folder").agg(F.count(F.lit(1)).alias("n_left"))


@query(f"{WITH}, gone AS (SELECT min(folder) AS folder FROM media) SELECT folder, count(*) AS n FROM media WHERE folder NOT IN (SELECT folder FROM gone) GROUP BY folder")
def remove_folder_cascade(spark, d):
    items = media(spark, d)
    return items.join(items.agg(F.min("folder").alias("folder")), "folder", "left_anti").groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


# --- managed folders ----------------------------------------------------------------

# Events stand in for a folder's files: event_type is the folder, ts the time of a change, the user a file.
_FOLDERS = "folders AS (SELECT event_type AS path, max(ts) AS last_modified, count(*) AS item_count, max(ts) FILTER (value > 50) AS last_scanned FROM events GROUP BY event_type)"


def _folders(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.max("ts").alias("last_modified"), F.count(F.lit(1)).alias("item_count"), F.max(F.when(F.col("value") > 50, F.col("ts"))).alias("last_scanned"))


@query(f"WITH {_FOLDERS} SELECT path, CAST(epoch_us(last_modified) AS BIGINT) AS last_modified_us, item_count FROM folders")
def folder_last_change(spark, d):
    return _folders(spark, d).select("path", F.unix_micros(F.col("last_modified").cast("timestamp")).alias("last_modified_us"), "item_count")


@query(f"WITH {_FOLDERS} SELECT path, coalesce(last_modified > last_scanned, false) AS changed FROM folders")
def changed_since_scan(spark, d):
    return _folders(spark, d).select("path", fn.changed_since_scan("last_modified", "last_scanned").alias("changed"))


@query(f"WITH {_FOLDERS} SELECT path, row_number() OVER (ORDER BY coalesce(last_modified, TIMESTAMP '0001-01-01') DESC, path) AS by_modified, row_number() OVER (ORDER BY item_count DESC, path) AS by_items, row_number() OVER (ORDER BY lower(path), path) AS by_path FROM folders")
def folder_sort(spark, d):
    """One row per managed folder: a dimension table."""
    place = lambda *by: F.row_number().over(Window.orderBy(*by))
    never = F.coalesce(F.col("last_modified"), F.lit("0001-01-01").cast("timestamp"))
    return _folders(spark, d).select("path", place(never.desc(), "path").alias("by_modified"), place(F.desc("item_count"), "path").alias("by_items"), place(F.lower("path"), "path").alias("by_path"))


@query(f"WITH {_FOLDERS}, fresh AS (SELECT event_type AS path, max(ts) AS m FROM events WHERE value <= 50 GROUP BY event_type) SELECT path, m IS DISTINCT FROM last_modified AS refreshed FROM folders LEFT JOIN fresh USING (path)")
def refresh_last_modified(spark, d):
    fresh = table(spark, d, "events").where("value <= 50").groupBy(F.col("event_type").alias("path")).agg(F.max("ts").alias("m"))
    return _folders(spark, d).join(fresh, "path", "left").select("path", (~F.col("m").eqNullSafe(F.col("last_modified"))).alias("refreshed"))


@query("SELECT s.source AS path, d.doc_source IS NOT NULL AS already_added FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT DISTINCT lower(d.source) AS doc_source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0) d ON lower(s.source) = d.doc_source")
def subfolder_candidates(spark, d):
    """Direct folders, marked where they are managed already (those with rejected files), without regard to case."""
    docs = table(spark, d, "documents")
    added = docs.join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id").select(F.lower("source").alias("key")).distinct()
    return docs.select("source").distinct().join(added, F.lower("source") == F.col("key"), "left").select(F.col("source").alias("path"), F.col("key").isNotNull().alias("already_added"))


@query("WITH c AS (SELECT DISTINCT source, source IN (SELECT d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0) AS added FROM documents) SELECT count(*) FILTER (NOT added) AS n_to_add, count(*) FILTER (added) AS n_present, coalesce(bool_and(length(source) = 5) FILTER (NOT added), true) AS all_checked FROM c")
def add_folders_tally(spark, d):
    c = subfolder_candidates(spark, d)
    return c.agg(F.count_if(~F.col("already_added")).alias("n_to_add"), F.count_if("already_added").alias("n_present"), F.coalesce(F.every(F.when(~F.col("already_added"), F.length("path") == 5)), F.lit(True)).alias("all_checked"))


@query("SELECT conv_id, CASE WHEN m IN ('All', 'Videos', 'VideosContained') THEN m WHEN legacy THEN 'VideosContained' ELSE 'All' END AS mode FROM (SELECT conv_id, min(CASE role WHEN 'user' THEN 'Videos' WHEN 'assistant' THEN 'none' END) AS m, count(*) % 2 = 0 AS legacy FROM conversations GROUP BY conv_id)")
def scan_mode_resolution(spark, d):
    stored = F.min(F.when(F.col("role") == "user", "Videos").when(F.col("role") == "assistant", "none"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(stored.alias("m"), (F.count(F.lit(1)) % 2 == 0).alias("legacy"))
    return rows.select("conv_id", fn.scan_mode("m", "legacy").alias("mode"))


# --- displays -----------------------------------------------------------------------


@query(f"{WITH} SELECT item_id, CASE WHEN size_bytes / 1048576.0 >= 1024 THEN printf('%.2f GB', size_bytes / 1048576.0 / 1024) ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS size_text FROM media")
def format_bytes(spark, d):
    return media(spark, d).select("item_id", fn.format_bytes("size_bytes").alias("size_text"))


@query(f"{WITH} SELECT item_id, CASE WHEN duration_s >= 3600 THEN printf('%d:%02d:%02d', duration_s // 3600, duration_s % 3600 // 60, duration_s % 60) ELSE printf('%d:%02d', duration_s // 60, duration_s % 60) END AS length_text, printf('%d:%02d', duration_s % 3600 // 60, duration_s % 60) AS duration_text FROM media")
def format_seconds(spark, d):
    return media(spark, d).select("item_id", fn.format_seconds("duration_s").alias("length_text"), fn.duration_display("duration_s").alias("duration_text"))


@query(f"{WITH} SELECT item_id, width || '×' || height AS resolution, CASE WHEN bit_rate_bps IS NULL THEN '—' ELSE printf('%.1f Mbps', bit_rate_bps / 1000000.0) END AS bit_rate, CASE WHEN audio_sample_rate_hz IS NULL THEN '—' ELSE printf('%d kHz', audio_sample_rate_hz // 1000) END AS audio FROM media")
def display_strings(spark, d):
    return media(spark, d).select("item_id", fn.resolution_display("width", "height").alias("resolution"), fn.bit_rate_display("bit_rate_bps").alias("bit_rate"), fn.audio_display("audio_sample_rate_hz").alias("audio"))


@query(
    """WITH a AS (SELECT o_orderkey, date_diff('second', o_orderdate, TIMESTAMP '2030-01-01') AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s < 60 THEN 'just now' WHEN s // 60 < 60 THEN printf('%d min ago', s // 60) WHEN s // 3600 < 24 THEN printf('%d h ago', s // 3600)
    WHEN s // 86400 < 31 THEN printf('%d day%s ago', s // 86400, CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END) WHEN s // 86400 < 365 THEN printf('%d mo ago', s // 86400 // 30) ELSE printf('%d yr ago', s // 86400 // 365) END AS age FROM a"""
)
def relative_age(spark, d):
    seconds = F.expr("timestampdiff(SECOND, CAST(o_orderdate AS TIMESTAMP_NTZ), TIMESTAMP_NTZ '2030-01-01 00:00:00')")
    return table(spark, d, "orders").select("o_orderkey", fn.relative_age(seconds).alias("age"))


@query(
    """WITH p AS (SELECT event_id, CAST(user_id % 97 AS BIGINT) AS done, CAST(90 AS BIGINT) AS total, value AS elapsed FROM events), l AS (SELECT *, CAST(floor((total - done) / (done / elapsed)) AS BIGINT) AS s FROM p WHERE done >= 3 AND done < total AND elapsed >= 1)
    SELECT p.event_id, CASE WHEN l.s >= 3600 THEN printf('%dh %dm', l.s // 3600, l.s % 3600 // 60) WHEN l.s >= 60 THEN printf('%dm %ds', l.s // 60, l.s % 60) WHEN l.s IS NOT NULL THEN printf('%ds', greatest(l.s, 1)) END AS eta FROM p LEFT JOIN l ON l.event_id = p.event_id"""
)
def eta_text(spark, d):
    return table(spark, d, "events").select("event_id", fn.eta_text(F.col("user_id") % 97, F.lit(90).cast("long"), "value").alias("eta"))


@query("SELECT page_id, CASE WHEN length(last) > 0 THEN last ELSE url END AS name FROM (SELECT page_id, url, list_last(string_split_regex(regexp_replace(url, '[/\\\\]+$', ''), '[/\\\\]')) AS last FROM pages)")
def folder_display_name(spark, d):
    return table(spark, d, "pages").select("page_id", fn.folder_display_name("url").alias("name"))


@query("SELECT doc_id, i, round(CASE WHEN n <= 1 THEN 0.02 ELSE 0.02 + 0.96 * i / (n - 1) END, 6) AS fraction FROM (SELECT doc_id, n, unnest(range(n)) AS i FROM (SELECT doc_id, 1 + doc_id % 7 AS n FROM documents))")
def frame_fractions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (1 + F.col("doc_id") % 7).alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return rows.select("doc_id", "i", F.round(fn.frame_fraction("i", "n"), 6).alias("fraction"))


@query("SELECT doc_id, i - 1 AS frame, round(n_chars * i / 6.0, 6) AS at_s FROM (SELECT doc_id, n_chars, unnest(range(1, 6)) AS i FROM documents)")
def sample_timestamps(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(fn.sample_times("n_chars")).alias("frame", "at"))
    return rows.select("doc_id", F.col("frame").cast("long").alias("frame"), F.round("at", 6).alias("at_s"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN v > 0 THEN v END, CASE WHEN c > 0 THEN c END) AS bit_rate FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(floor(l_discount * 100) AS BIGINT) - 5 END AS v, CAST(floor(l_tax * 100) AS BIGINT) - 3 AS c FROM lineitem)")
def probed_bit_rate(spark, d):
    """The video stream's rate, else the container's, where positive."""
    rows = table(spark, d, "lineitem")
    video = F.when(F.col("l_returnflag") != "R", F.floor(F.col("l_discount") * 100) - 5)
    return rows.select("l_orderkey", "l_linenumber", fn.probed_bit_rate(video, F.floor(F.col("l_tax") * 100) - 3).alias("bit_rate"))



@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_tax * 300, l_discount * 200, l_extendedprice / 9000, l_tax * l_quantity] AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, ([0.0, 0.5, 1.0, -0.5, -1.0])[CASE WHEN first IS NOT NULL THEN first ELSE list_position(s, list_max(s)) END]::DOUBLE AS chosen
    FROM (SELECT *, list_position(list_transform(s, lambda x: x >= 10), true) AS first FROM t)"""
)
def usable_frame_choice(spark, d):
    """The sampled frame, or the first retry that isn't flat, or the least flat of all."""
    sigmas = F.array(F.col("l_quantity"), F.col("l_tax") * 300, F.col("l_discount") * 200, F.col("l_extendedprice") / 9000, F.col("l_tax") * F.col("l_quantity"))
    usable = F.array_position(F.transform(sigmas, lambda x: x >= 10), True)
    at = F.when(usable > 0, usable).otherwise(F.array_position(sigmas, F.array_max(sigmas)))
    offsets = F.array(*map(F.lit, (0.0, 0.5, 1.0, -0.5, -1.0)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(offsets, at.cast("int")).alias("chosen"))


@query(f"{WITH} SELECT item_id, kind FROM media WHERE bit_rate_bps IS NOT NULL")
def failed_extraction_drop(spark, d):
    """Files whose extraction failed (here: those without a rate) are left out, to be tried again."""
    return media(spark, d).withColumn("error", F.when(F.col("bit_rate_bps").isNull(), "no rate")).where("error IS NULL").select("item_id", "kind")


@query(f"{WITH} SELECT folder, count(*) AS item_count, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(last_write_ticks) AS last_change FROM media GROUP BY folder")
def record_scan_result(spark, d):
    return media(spark, d).groupBy("folder").agg(F.count(F.lit(1)).alias("item_count"), F.sum("size_bytes").alias("bytes"), F.max("last_write_ticks").alias("last_change"))


# --- rows of the cache, folders and views -------------------------------------------


@query(f"{WITH}, {CACHED}, b AS (SELECT *, {_KEY} AS cache_key FROM (SELECT * FROM cached UNION ALL SELECT * FROM media)) SELECT cache_key, item_id, full_path, file_name, size_bytes, last_write_ticks, sha256, width, height, codec, bit_rate_bps, audio_sample_rate_hz, kind, duration_s::DOUBLE AS duration_s FROM b QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY item_id) = 1")
def cached_row_projection(spark, d):
    """Items to cached rows and back, one row for a key that stands twice."""
    both = store.with_key(cached(spark, d).unionByName(media(spark, d)))
    return store.from_cached(store.to_cached(both))


@query(f"{WITH} SELECT item_id, substr(upper(sha256({_KEY})), 1, 32) AS fingerprint_key, item_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS cached FROM media WHERE kind = 'video'")
def fingerprint_plan(spark, d):
    """Videos whose fingerprint is cached in the present version (of good quality, here), by content key, and those that need one."""
    videos = media(spark, d).where("kind = 'video'").withColumn("fingerprint_key", fn.fingerprint_key(fn.cache_key("full_path", "size_bytes", "last_write_ticks")))
    good = media(spark, d).join(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id")).distinct(), "item_id", "left_semi")
    known = good.select(fn.fingerprint_key(fn.cache_key("full_path", "size_bytes", "last_write_ticks")).alias("fingerprint_key"), F.lit(True).alias("hit")).distinct()
    return videos.join(known, "fingerprint_key", "left").select("item_id", "fingerprint_key", F.coalesce("hit", F.lit(False)).alias("cached"))


@query(f"{WITH}, {CACHED} SELECT m.item_id, c.item_id IS NOT NULL AS reused, coalesce(c.item_id % 2 = 0, false) AS selected FROM media m LEFT JOIN cached c ON lower(c.full_path) = lower(m.full_path)")
def reuse_selection(spark, d):
    """Rows shown before keep their selection after a scan."""
    shown = cached(spark, d).select("item_id", "full_path", (F.col("item_id") % 2 == 0).alias("selected"))
    return store.reuse_by_path(media(spark, d), shown).select("item_id", "reused", "selected")


@query(f"{WITH}, {GROUPED}, f AS (SELECT folder, min(item_id) AS first FROM grouped GROUP BY folder) SELECT folder, first = min(first) OVER () AS expanded FROM f")
def folders_expanded(spark, d):
    """The first folder to have results starts expanded."""
    first = grouped(spark, d).groupBy("folder").agg(F.min("item_id").alias("first"))
    least = first.agg(F.min("first").alias("least"))
    return first.join(F.broadcast(least), F.col("first") == F.col("least"), "left").select("folder", F.col("least").isNotNull().alias("expanded"))


@query(f"{WITH}, {GROUPED} SELECT folder, item_id, row_number() OVER (PARTITION BY folder ORDER BY first_item, item_id) AS pos FROM (SELECT *, min(item_id) OVER (PARTITION BY folder, sha256) AS first_item FROM grouped)")
def restored_order(spark, d):
    """Without a filter, items stand as found: set after set in order of detection."""
    sets = similarity.exact_groups(media(spark, d)).select(*GROUP, "first_item")
    return views.restored(media(spark, d).join(sets, GROUP), "first_item").select("folder", "item_id", "pos")


@query("SELECT source AS path, row_number() OVER (ORDER BY lower(source), source) AS pos FROM (SELECT DISTINCT source FROM documents)")
def subfolder_order(spark, d):
    """Candidates of the folder picker by path, regardless of case."""
    return ranking.numbered(subfolder_candidates(spark, d).select("path"), [], [F.lower("path"), F.col("path")], "pos")


@query(f"WITH {_FOLDERS} SELECT path, item_count FROM folders WHERE length(path) % 2 = 0")
def enabled_folders(spark, d):
    return settings.enabled(_folders(spark, d).withColumn("is_enabled", F.length("path") % 2 == 0)).select("path", "item_count")


@query(
    f"""WITH {_FOLDERS} SELECT path, CASE WHEN length(path) % 3 = 0 THEN 'Scanning...' ELSE coalesce(strftime(last_scanned, '%b %-d, %H:%M'), 'Never') END AS scanned,
    coalesce(strftime(last_modified, '%b %-d, %Y %H:%M'), '—') AS modified, CASE WHEN item_count > 0 THEN format('{{:,}} files', item_count) ELSE '—' END AS items FROM folders"""
)
def folder_displays(spark, d):
    scanned, modified, items = fn.folder_displays("last_scanned", F.length("path") % 3 == 0, "last_modified", F.lit(False), "item_count")
    return _folders(spark, d).select("path", scanned.alias("scanned"), modified.alias("modified"), items.alias("items"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN n <= 1 THEN h ELSE h * (1.15 + 0.5 * (n - 1)) END, 6) AS width, h + 8 AS row_height FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_linenumber, 1), 7) AS n, least(greatest(l_quantity * 10, 48), 400) AS h FROM lineitem)")
def filmstrip_geometry(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.clamped("l_linenumber", 1, 7).alias("n"), fn.clamped(F.col("l_quantity") * 10, 48, 400).alias("h"))
    return rows.select("l_orderkey", "l_linenumber", F.round(fn.filmstrip_width("h", "n"), 6).alias("width"), (F.col("h") + 8).alias("row_height"))
