import json
import logging
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from twinframe.functions import vision
from twinframe.sources import files, settings, store
from twinframe.streaming import incremental


def png(pixels: np.ndarray) -> bytes:
    """An RGB PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def quadrants(n=64):
    out = np.full((n, n, 3), 255)
    out[: n // 2, : n // 2] = 0
    out[: n // 4, n // 2 :] = (255, 0, 0)
    out[3 * n // 4 :, : n // 4] = (0, 0, 255)
    return out


def test_files_digests_and_pictures(spark, tmp_path):
    picture = quadrants()
    (tmp_path / "sub").mkdir()
    for name, data in {"a.jpg": b"same", "b.JPG": b"same", "sub/c.jpeg": b"other", "d.mp4": b"v", "e.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.media_files(spark, str(tmp_path))
    assert found.count() == 4 and files.media_files(spark, str(tmp_path), True).count() == 1
    groups = files.digests(found).groupBy("sha256").count().where("count > 1").collect()
    assert [r["count"] for r in groups] == [2]
    assert files.folder_last_change(found).count() == 2
    pictures = tmp_path / "p"
    pictures.mkdir()
    for name, data in {"o.png": picture, "f.png": picture[:, ::-1], "t.png": np.rot90(picture), "g.png": np.full((64, 64, 3), (50, 205, 50)), "dark.png": picture * 0.8}.items():
        (pictures / name).write_bytes(png(data))
    (pictures / "broken.png").write_bytes(b"nothing")
    rows = files.images(spark, str(pictures)).select("origin", vision.picture_hashes(F.col("height"), F.col("width"), F.col("data")).alias("hashes"), vision.hsv_histogram(F.col("height"), F.col("width"), F.col("data")).alias("hist")).collect()
    got = {r.origin.rpartition("/")[2][:-4]: r for r in rows}
    assert set(got) == {"o", "f", "t", "g", "dark"}
    least = lambda a, b: min(((x ^ y) & (2**64 - 1)).bit_count() for x in got[a].hashes for y in got[b].hashes)
    assert least("o", "f") <= 4 and least("o", "t") <= 4 and least("o", "g") > 4
    corr = lambda a, b: np.corrcoef(got[a].hist, got[b].hist)[0, 1]
    assert len(got["o"].hist) == 960 and corr("o", "dark") > 0.6 > corr("o", "g")


def test_cached_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"FullPath": "/a", "Kind": 1, "SizeBytes": 3, "Sha256": "AB", "OrientationHashes": [2**64 - 1, 5]}]))
    assert tuple(files.cached_json(spark, str(tmp_path / "c.json")).first()) == ("/a", "video", 3, "AB", [-1, 5])


ITEM = "folder string, item_id long, full_path string, kind string, size_bytes long, last_write_ticks long"


def test_store(spark, tmp_path):
    rows = [("F", i, f"/f/{i}.jpg", "photo" if i % 2 else "video", i, i) for i in range(6)]
    items = spark.createDataFrame(rows, ITEM)
    store.write_features(items, str(tmp_path / "features"))
    assert store.read_features(spark, str(tmp_path / "features"), "f").count() == 6 and store.read_features(spark, str(tmp_path / "features"), "g").count() == 0
    old = store.with_key(items.where("item_id < 3"))
    twice = store.first_by_key(old.union(old))
    new = store.with_key(items)
    assert store.cache_hits(new, twice).count() == 3 and store.cache_misses(new, twice).count() == 3
    kept = store.rewritten(items.where("kind = 'video'"), items.where("item_id < 3"), True)
    assert sorted(r.item_id for r in kept.collect()) == [0, 1, 2, 4]


def test_incremental_scan_extracts_new_files_once(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    batch = lambda ids: spark.createDataFrame([("F", i, f"/f/{i}.jpg", "photo", i, i) for i in ids], ITEM).coalesce(1).write.mode("append").parquet(source)
    run = lambda: incremental.incremental_scan(spark, spark.readStream.schema(ITEM).parquet(source), cache, str(tmp_path / "state"), lambda df: df.withColumn("extracted", F.lit(True))).awaitTermination()
    batch([1, 2, 2])
    run()
    batch([2, 3])
    run()
    assert sorted(r.item_id for r in spark.read.parquet(cache).collect()) == [1, 2, 3]


def test_streamed_clusters_keep_their_state(spark, tmp_path):
    ddl = "folder string, item_id long, embedding array<float>"
    source = str(tmp_path / "in")
    for ids in ([(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(3, [0.9, 0.1])]):
        spark.createDataFrame([("a", i, e) for i, e in ids], ddl).coalesce(1).write.mode("append").parquet(source)
        q = incremental.streamed_clusters(spark.readStream.schema(ddl).parquet(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.item_id: (r.cluster_id, r.sample_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 2)}


def test_folders_and_settings(spark, tmp_path):
    path = str(tmp_path / "folders")
    assert settings.read_folders(spark, path).count() == 0
    rows = spark.createDataFrame([("/a", True, None, None, 3), ("/b", False, None, None, 0)], settings.FOLDERS)
    settings.write_folders(rows, path)
    assert sorted(r.path for r in settings.read_folders(spark, path).collect()) == ["/a", "/b"]
    assert [r.path for r in settings.enabled(settings.read_folders(spark, path)).collect()] == ["/a"]
    (tmp_path / "folders" / "more.json").write_text('{"path": ')
    assert settings.read_folders(spark, path).count() == 0
    kept = str(tmp_path / "settings")
    assert settings.read_settings(spark, kept, {"thumbnails": 3}) == {"thumbnails": 3}
    settings.write_settings(spark, {"thumbnails": 5, "other": 1}, kept)
    assert settings.read_settings(spark, kept, {"thumbnails": 3, "mode": "All"}) == {"thumbnails": 5, "mode": "All"}


def test_fingerprints_are_found_by_content(spark, tmp_path):
    path = str(tmp_path / "fingerprints")
    items = spark.createDataFrame([(1, "/A.mp4", 5, 9), (2, "/b.mp4", 6, 9)], "item_id long, full_path string, size_bytes long, last_write_ticks long")
    seconds, missing = store.read_fingerprints(spark, items, path)
    assert seconds.count() == 0 and missing.count() == 2
    made = spark.createDataFrame([(1, 0, 7, None, True), (1, 1, 8, 3, False)], "video_id long, sec int, hash long, mirror_hash long, usable boolean")
    store.write_fingerprints(items, made, path)
    store.write_fingerprints(items, made, path)
    again = spark.createDataFrame([(11, "/a.MP4", 5, 9), (12, "/b.mp4", 7, 9)], "item_id long, full_path string, size_bytes long, last_write_ticks long")
    seconds, missing = store.read_fingerprints(spark, again, path)
    assert sorted((r.video_id, r.sec, r.hash, r.mirror_hash, r.usable) for r in seconds.collect()) == [(11, 0, 7, 7, True), (11, 1, 8, 3, False)]
    assert [r.item_id for r in missing.collect()] == [12]


def test_subfolders_and_log(spark, tmp_path):
    for p in ("b/Inner", "A", ".hidden/x"):
        (tmp_path / "root" / p).mkdir(parents=True)
    names = lambda deep: [p.split("/root/")[1] for p in files.subfolders(spark, str(tmp_path / "root"), deep)]
    assert names(False) == ["A", "b"] and names(True) == ["A", "b", "b/Inner"] and files.subfolders(spark, str(tmp_path / "none")) == []
    log = logging.getLogger("scan")
    log.addHandler(settings.JsonLines(str(tmp_path / "log.jsonl")))
    log.propagate = False
    log.warning("slow %s", "file")
    try:
        raise ValueError("broken")
    except ValueError:
        log.exception("failed")
    log.addHandler(settings.JsonLines("/none/log.jsonl"))
    log.warning("still fine")
    first, second, third = map(json.loads, (tmp_path / "log.jsonl").read_text().splitlines())
    assert first["message"] == "slow file" and first["exception"] is None and second["exception"] == "ValueError: broken" and third["level"] == "WARNING"

