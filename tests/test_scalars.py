import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.functions import scalars as fn
from twinframe.functions import vision


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def longs(*values):
    return F.array(*(F.lit(v).cast("long") for v in values))


def test_hash_distances(spark):
    r = one(
        spark,
        same=fn.hamming(F.lit(5), F.lit(5)),
        bits=fn.hamming(F.lit(0), F.lit(0b11)),
        all_bits=fn.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")),
        least=fn.orientation_min(longs(0xF0, 0x0F), longs(0x0F)),
        best=fn.similarity_pct(F.lit(0)),
        worst=fn.similarity_pct(F.lit(64)),
    )
    assert tuple(r) == (0, 2, 64, 0, 100.0, 0.0)


def test_second_best_frame_is_not_symmetric(spark):
    a = F.array(longs(0), longs(0b1), longs(0xFF))
    b = F.array(longs(0))
    r = one(spark, ab=fn.frame_pct(a, b), ba=fn.frame_pct(b, a), none=fn.frame_pct(F.slice(b, 1, 0), b))
    assert r.ab == 100 * (1 - 1 / 64) and r.ba == 100.0 and r.none == 0.0


@pytest.mark.parametrize(
    ("sha", "kind", "distance", "correlation", "structure", "person", "expected"),
    [
        (True, True, 64, None, None, None, 100.0),
        (False, False, 0, None, None, None, 0.0),
        (False, True, 32, None, 95.0, None, 95.0),
        (False, True, 0, None, 0.0, None, 100.0),
        (False, True, 64, None, 99.0, None, 0.0),
        (False, True, 24, None, None, True, 72.5),
        (False, True, 24, None, None, False, 62.5),
        (False, True, 24, 1.0, None, None, 82.5),
        (False, True, 8, 0.1, None, True, 90.0),
    ],
)
def test_combined_similarity(spark, sha, kind, distance, correlation, structure, person, expected):
    lit = lambda v: None if v is None else F.lit(v)
    r = one(spark, s=fn.combined_similarity(F.lit(sha), F.lit(kind), fn.similarity_pct(F.lit(distance)), F.lit(True), lit(correlation), lit(structure), lit(person)))
    assert r.s == pytest.approx(expected)


def test_median_hash_like_numpy(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 64)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "i int, v array<float>")
    got = {r.i: r for r in frame.select("i", fn.median_hash("v").alias("h"), fn.orientation_hashes("v").alias("o")).collect()}
    for i, v in enumerate(rows):
        assert got[i].h == vision.hash_of(v.astype(float)) and got[i].o[0] == got[i].h and len(set(got[i].o)) == 8


def test_orientations_of_a_picture_are_those_of_its_coefficients(spark):
    picture = np.random.default_rng(2).uniform(0, 255, (32, 32))
    values = vision.coefficients(picture)
    from_values = one(spark, o=fn.orientation_hashes(F.array(*map(F.lit, values.tolist())))).o
    assert set(from_values) == set(vision.orientations(picture))


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(k)).cast("float") for k in x))
    r = one(spark, same=fn.cosine(v(1, 2), v(1, 2)), zero=fn.cosine(v(0, 0), v(1, 2)), length=fn.cosine(v(1), v(1, 2)), corr=fn.histogram_correlation(v(1, 2, 3), v(2, 4, 6), 3), wrong=fn.histogram_correlation(v(1, 2), v(1, 2), 3), flat=fn.histogram_correlation(v(1, 1, 1), v(2, 4, 6), 3), inverse=fn.histogram_correlation(v(1, 2, 3), v(3, 2, 1), 3))
    assert tuple(r) == pytest.approx((1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0))


def test_displays(spark):
    r = one(
        spark,
        mb=fn.format_bytes(F.lit(5 * 2**20)),
        gb=fn.format_bytes(F.lit(3 * 2**30)),
        long=fn.format_seconds(F.lit(3900)),
        short=fn.format_seconds(F.lit(65)),
        dropped=fn.duration_display(F.lit(3900)),
        unknown=fn.duration_display(F.lit(None).cast("long")),
        day=fn.relative_age(F.lit(90_000)),
        days=fn.relative_age(F.lit(200_000)),
        eta=fn.eta_text(F.lit(10), F.lit(20), F.lit(100.0)),
        early=fn.eta_text(F.lit(2), F.lit(20), F.lit(100.0)),
        name=fn.folder_display_name(F.lit("C:\\media\\cats\\")),
        kind=fn.media_kind(F.lit("/a.b/X.JPeG")),
        none=fn.media_kind(F.lit("/a.jpg/readme")),
        mode=fn.scan_mode(F.lit(None).cast("string"), F.lit(True)),
        rate=fn.probed_bit_rate(F.lit(0), F.lit(7)),
        rank=fn.codec_rank(F.lit("HEVC")),
        match=fn.match_display(F.lit(87.25)),
        times=fn.sample_times(F.lit(60)),
        fraction=fn.frame_fraction(F.lit(4), F.lit(5)),
    )
    assert tuple(r) == ("5.0 MB", "3.00 GB", "1:05:00", "1:05", "5:00", "—", "1 day ago", "2 days ago", "1m 40s", None, "cats", "photo", None, "VideosContained", 7, 1.0, r.match, [10.0, 20.0, 30.0, 40.0, 50.0], pytest.approx(0.98))


def test_bar_and_clamp(spark):
    start, end = fn.clamped_span(F.lit(-5), F.lit(30), F.lit(20))
    offset, width = fn.bar_geometry(F.lit(0), F.lit(1), F.lit(1000))
    assert tuple(one(spark, s=start, e=end, o=offset, w=width)) == (0, 20, 0.0, 3.0)


def test_fingerprint_kernel():
    rng = random.Random(3)
    frame = np.full((64, 64), 0.0)
    frame[8:56] = [[rng.randrange(60, 255) for _ in range(64)] for _ in range(48)]
    h, m, usable = vision.fingerprint(frame)
    assert usable and vision.fingerprint(frame[:, ::-1].copy())[:2] == (m, h)
    assert not vision.fingerprint(np.full((64, 64), 7.0))[2]
