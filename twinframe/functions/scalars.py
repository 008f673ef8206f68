"""Scalar functions of the media engine, as Column expressions without Python in the data path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by kind, codec ranks, score bands and display formats.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tiff", "tif", "webp", "heic", "heif")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "wmv", "m4v", "webm", "flv")
CODEC_RANKS = {"hevc": 1.0, "h265": 1.0, "av1": 1.0, "h264": 0.6, "avc": 0.6, "png": 0.8, "jpeg": 0.3, "jpg": 0.3, "mjpeg": 0.3}
QUALITY_WEIGHTS = (0.5, 0.3, 0.15, 0.05)
HISTOGRAM_BAND, HISTOGRAM_BONUS = (60.0, 92.0), 20.0
STRUCTURE_BAND = (35.0, 92.0)
PERSON_BAND, PERSON_BONUS, PERSON_CEILING = (40.0, 90.0), 10.0, 90.0
THUMBNAIL_BAND, THUMBNAIL_HISTOGRAM = (45.0, 97.0), 0.9
HASH_BITS, HISTOGRAM_LENGTH, BAR_PIXELS, LEAST_BAR = 64, 960, 220.0, 3.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- hashes -------------------------------------------------------------------------


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def similarity_pct(distance) -> Column:
    return 100.0 * (1.0 - _c(distance) / float(HASH_BITS))


def orientation_min(a, b) -> Column:
    """Least distance over all pairs of two arrays of hashes; null if one is empty."""
    b = _c(b)
    return F.array_min(F.flatten(F.transform(_c(a), lambda x: F.transform(b, lambda y: hamming(x, y)))))


def orientation_min_fixed(a, b, n: int = 8) -> Column:
    """The same for arrays of n hashes at most, as one flat expression that Spark compiles."""
    return F.least(*(hamming(F.get(_c(a), F.lit(i)), F.get(_c(b), F.lit(k))) for i in range(n) for k in range(n)))


def frame_pct(a, b) -> Column:
    """Second best of a's frames, each by its best frame of b, in percent; not symmetric.

    a and b are arrays of frames, a frame an array of hashes. One frame counts as it is; no frames give 0.
    """
    b = _c(b)
    best = F.array_sort(F.filter(F.transform(_c(a), lambda f: F.array_min(F.transform(b, lambda g: orientation_min(f, g)))), lambda d: d.isNotNull()))
    return F.when(F.size(best) > 0, similarity_pct(F.try_element_at(best, F.least(F.lit(2), F.size(best))))).otherwise(0.0)


def median_hash(values) -> Column:
    """64 coefficients to a hash: bit i is set where value i exceeds the median of values 1 to 63."""
    values = _c(values)
    middle = F.element_at(F.array_sort(F.slice(values, 2, HASH_BITS - 1)), HASH_BITS // 2)
    none = F.lit(0).cast("long")

    def packed(row: Column) -> Column:
        bits = F.transform(row["values"], lambda x, i: F.when(x > row["middle"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(none))
        return F.aggregate(bits, none, lambda acc, x: acc.bitwiseOR(x))

    # as a row of its own the median is found once, not for every bit
    return F.transform(F.array(F.struct(values.alias("values"), middle.alias("middle"))), packed)[0]


def orientation_coefficients(values, transpose: bool, flip_rows: bool, flip_columns: bool) -> Column:
    """An 8 by 8 block of cosine coefficients as the flipped or turned picture would have it."""
    values = _c(values)
    grid = [(u, v) for u in range(8) for v in range(8)]
    places = F.array(*(F.lit((v * 8 + u) if transpose else (u * 8 + v)) for u, v in grid))
    signs = F.array(*(F.lit(-1 if (flip_rows and u % 2) != (flip_columns and v % 2) else 1) for u, v in grid))
    return F.zip_with(places, signs, lambda k, s: s * values[k])


def orientation_hashes(values) -> Column:
    return F.array(*(median_hash(orientation_coefficients(values, t, r, c)) for t in (False, True) for r in (False, True) for c in (False, True)))


# --- vectors ------------------------------------------------------------------------


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Products in float32, sums in double; 0 for unequal lengths, empty or zero vectors."""
    a, b = _c(a), _c(b)

    def dot(x, y):
        return _total(F.zip_with(x, y, lambda p, q: (p * q).cast("double")))

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def histogram_correlation(a, b, length: int = HISTOGRAM_LENGTH) -> Column:
    """Pearson correlation, no less than 0; 0 where a length is wrong, 1 where a histogram is constant."""
    a, b = _c(a), _c(b)
    n = float(length)

    def total(x, f):
        return _total(F.transform(x, lambda p: f(p.cast("double"))))

    sa, sb = total(a, lambda p: p), total(b, lambda p: p)
    sab = _total(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))
    va, vb = total(a, lambda p: p * p) - sa * sa / n, total(b, lambda p: p * p) - sb * sb / n
    r = F.when((va > 0) & (vb > 0), (sab - sa * sb / n) / F.sqrt(va * vb)).otherwise(1.0)
    return F.when((F.size(a) == length) & (F.size(b) == length), F.greatest(F.lit(0.0), r)).otherwise(0.0)


# --- scores -------------------------------------------------------------------------


def _between(x: Column, band: tuple[float, float]) -> Column:
    return (x > band[0]) & (x < band[1])


def combined_similarity(same_sha, same_kind, hash_pct, photo, correlation=None, structure=None, shared_person=None) -> Column:
    """Digest, then kind, then the hash score raised by histogram, structure and shared person within their bands."""
    base = F.coalesce(_c(hash_pct), F.lit(0.0))
    best = base
    if correlation is not None:
        raised = F.least(F.least(F.greatest(_c(correlation), F.lit(0.0)), F.lit(1.0)) * 100.0, base + HISTOGRAM_BONUS)
        best = F.when(_c(photo) & _between(base, HISTOGRAM_BAND) & _c(correlation).isNotNull(), F.greatest(best, raised)).otherwise(best)
    if structure is not None:
        best = F.when(_c(photo) & _between(base, STRUCTURE_BAND), F.greatest(best, _c(structure))).otherwise(best)
    if shared_person is not None:
        best = F.when(_c(shared_person) & _between(best, PERSON_BAND), F.least(best + PERSON_BONUS, F.lit(PERSON_CEILING))).otherwise(best)
    return F.when(_c(same_sha), 100.0).when(~_c(same_kind), 0.0).otherwise(best)


def thumbnail_similarity(same_path, hash_pct, correlation, structure=None) -> Column:
    score = F.greatest(F.coalesce(_c(hash_pct), F.lit(0.0)), THUMBNAIL_HISTOGRAM * 100.0 * _c(correlation))
    if structure is not None:
        score = F.when(_between(score, THUMBNAIL_BAND) & (_c(structure) > 0), F.greatest(score, _c(structure))).otherwise(score)
    return F.when(_c(same_path), 100.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def codec_rank(codec) -> Column:
    codec = F.lower(_c(codec))
    return F.coalesce(reduce(lambda acc, kv: acc.when(codec == kv[0], kv[1]), CODEC_RANKS.items(), F), F.lit(0.0))


def quality_score(width, height, bit_rate, size, codec) -> Column:
    a, b, c, d = QUALITY_WEIGHTS
    pixels = _c(width).cast("long") * _c(height).cast("long")
    return a * pixels + b * F.coalesce(_c(bit_rate), F.lit(0)) + c * _c(size) + d * codec_rank(codec)


# --- keys ---------------------------------------------------------------------------


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./\\]+)$", 1))


def media_kind(path) -> Column:
    """photo, video, or null for other files."""
    e = extension(path)
    return F.when(e.isin(*PHOTO_EXTENSIONS), "photo").when(e.isin(*VIDEO_EXTENSIONS), "video")


def hash_hex(sha) -> Column:
    return F.upper(F.substring(_c(sha), 1, 16))


def content_digest(content) -> Column:
    return F.upper(F.sha2(_c(content), 256))


def cache_key(path, size, ticks) -> Column:
    return F.concat_ws("|", F.lower(_c(path)), _c(size).cast("string"), _c(ticks).cast("string"))


def folder_hash(folder) -> Column:
    return content_digest(F.lower(_c(folder)))


def fingerprint_key(key) -> Column:
    return F.substring(content_digest(key), 1, 32)


def thumbnail_key(key, count, index) -> Column:
    return F.concat(content_digest(F.concat_ws("|", _c(key), _c(count).cast("string"), _c(index).cast("string"))), F.lit(".jpg"))


# --- times and displays -------------------------------------------------------------


def frame_fraction(index, count) -> Column:
    return F.when(_c(count) <= 1, 0.02).otherwise(0.02 + 0.96 * _c(index) / (_c(count) - 1))


def sample_times(duration) -> Column:
    duration = _c(duration)
    return F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: duration * i / 6.0)


def probed_bit_rate(video, container) -> Column:
    positive = lambda x: F.when(_c(x) > 0, _c(x))
    return F.coalesce(positive(video), positive(container))


def format_bytes(size) -> Column:
    mb = _c(size) / 1048576.0
    return F.when(mb >= 1024, F.format_string("%.2f GB", mb / 1024)).otherwise(F.format_string("%.1f MB", mb))


def format_seconds(seconds) -> Column:
    s = _c(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def duration_display(seconds) -> Column:
    """Minutes and seconds alone: hours don't show. A dash where the duration is unknown."""
    s = _c(seconds).cast("long")
    return F.when(s.isNull(), "—").otherwise(F.format_string("%d:%02d", F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))))


def resolution_display(width, height) -> Column:
    return F.when(_c(width) > 0, F.format_string("%d×%d", _c(width), _c(height))).otherwise("—")


def bit_rate_display(rate) -> Column:
    return F.when(_c(rate).isNull(), "—").otherwise(F.format_string("%.1f Mbps", _c(rate) / 1000000.0))


def audio_display(rate) -> Column:
    return F.when(_c(rate).isNull(), "—").otherwise(F.format_string("%d kHz", F.floor(_c(rate) / 1000)))


def match_display(pct) -> Column:
    return F.format_string("%.1f%%", _c(pct))


def relative_age(seconds) -> Column:
    s = _c(seconds)
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return (
        F.when(s < 60, "just now")
        .when(minutes < 60, F.format_string("%d min ago", minutes))
        .when(hours < 24, F.format_string("%d h ago", hours))
        .when(days < 31, F.format_string("%d day%s ago", days, F.when(days == 1, "").otherwise("s")))
        .when(days < 365, F.format_string("%d mo ago", F.floor(days / 30)))
        .otherwise(F.format_string("%d yr ago", F.floor(days / 365)))
    )


def folder_display_name(path) -> Column:
    last = F.element_at(F.split(F.regexp_replace(_c(path), r"[/\\]+$", ""), r"[/\\]"), -1)
    return F.when(F.length(last) > 0, last).otherwise(_c(path))


def eta_text(done, total, elapsed_s) -> Column:
    """Time left from the rate so far; null before three files or one second, and at the end."""
    done, total, elapsed = _c(done), _c(total), _c(elapsed_s)
    left = F.floor((total - done) / (done / elapsed))
    text = (
        F.when(left >= 3600, F.format_string("%dh %dm", F.floor(left / 3600), F.floor(F.pmod(left, F.lit(3600)) / 60)))
        .when(left >= 60, F.format_string("%dm %ds", F.floor(left / 60), F.pmod(left, F.lit(60))))
        .otherwise(F.format_string("%ds", F.greatest(left, F.lit(1).cast("long"))))
    )
    return F.when((done >= 3) & (done < total) & (elapsed >= 1), text)


def bar_geometry(start, end, total) -> tuple[Column, Column]:
    """(offset, width) in pixels of a span on its source's bar; null where the source has no length."""
    total = _c(total)
    offset = BAR_PIXELS * _c(start) / total
    width = F.greatest(F.lit(LEAST_BAR), BAR_PIXELS * (_c(end) - _c(start)) / total)
    return F.when(total > 0, offset), F.when(total > 0, width)


def clip_note(source_name, start, end, mirrored) -> Column:
    """The sentence under a clip that lies in a source."""
    # The wording.
    turned = F.when(_c(mirrored), ", espelhado").otherwise("")
    return F.concat(F.lit("Este vídeo está dentro do "), _c(source_name), F.lit(" (de "), format_seconds(start), F.lit(" até "), format_seconds(end), turned, F.lit(")."))


def source_note(n_clips) -> Column:
    """The sentence under a source that holds clips."""
    # The wording.
    several = F.concat(F.lit("Este é o vídeo original. Os "), _c(n_clips).cast("string"), F.lit(" vídeos abaixo estão dentro dele."))
    return F.when(_c(n_clips) == 1, "Este é o vídeo original. O vídeo abaixo está dentro dele.").otherwise(several)


def compilation_note(n_sources) -> Column:
    """The sentence under a compilation."""
    # The wording.
    several = F.concat(F.lit("Este vídeo foi montado com pedaços dos "), _c(n_sources).cast("string"), F.lit(" vídeos abaixo."))
    return F.when(_c(n_sources) == 1, "Este vídeo foi montado com pedaços do vídeo abaixo.").otherwise(several)


def clamped_span(offset, length, limit) -> tuple[Column, Column]:
    start = F.least(F.greatest(_c(offset), F.lit(0)), _c(limit))
    return start, F.least(F.greatest(_c(offset) + _c(length), start), _c(limit))


def folder_displays(last_scanned, scanning, last_modified, calculating, items) -> tuple[Column, Column, Column]:
    """(last scan, last change, number of files) of a managed folder, as shown."""
    # Formats and words.
    scanned = F.when(_c(scanning), "Scanning...").otherwise(F.coalesce(F.date_format(_c(last_scanned), "MMM d, HH:mm"), F.lit("Never")))
    modified = F.coalesce(F.date_format(_c(last_modified), "MMM d, yyyy HH:mm"), F.when(_c(calculating), "Calculating...").otherwise("—"))
    return scanned, modified, F.when(_c(items) > 0, F.concat(F.format_number(_c(items), 0), F.lit(" files"))).otherwise("—")


def filmstrip_width(height, count) -> Column:
    """Room for a video's thumbnails: the first takes more than the others."""
    height = _c(height).cast("double")
    return F.when(_c(count) <= 1, height).otherwise(height * (1.15 + 0.5 * (_c(count) - 1)))


def clamped(x, low: int, high: int) -> Column:
    """A setting within its limits: 1 to 7 thumbnails a video, columns of 48 to 400."""
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def scan_mode(stored, legacy) -> Column:
    modes = ("All", "Videos", "VideosContained")
    return F.coalesce(F.when(_c(stored).isin(*modes), _c(stored)), F.when(_c(legacy), "VideosContained"), F.lit("All"))


def changed_since_scan(modified, scanned) -> Column:
    return F.coalesce(_c(modified) > _c(scanned), F.lit(False))
