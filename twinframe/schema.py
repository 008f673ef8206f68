"""Row types of the media engine."""

from __future__ import annotations

from pyspark.sql import types as T

HASHES = T.ArrayType(T.LongType())
VECTOR = T.ArrayType(T.FloatType())

#: 64-bit hashes are bit patterns in signed longs; never order by them.
MEDIA_ITEMS = T.StructType.fromDDL(
    "folder string, item_id long, full_path string, file_name string, kind string, size_bytes long, last_write_ticks long, width int, height int, codec string, bit_rate_bps long, duration_s long, audio_sample_rate_hz int, sha256 string"
)
FINGERPRINTS = T.StructType.fromDDL("folder string, video_id long, sec int, hash long, mirror_hash long, usable boolean")
EDGES = T.StructType.fromDDL("folder string, item_a long, item_b long, best_pct double")
GROUPS = T.StructType.fromDDL("folder string, leader long, item_id long, is_reference boolean, member_rank int, similarity_pct double")
PERSON_CLUSTERS = T.StructType.fromDDL("folder string, cluster_id int, centroid array<float>, sample_count int")
CONTAINED = T.StructType.fromDDL("clip_id long, source_id long, start_s int, end_s int, matched_s long, coverage_pct double, mirrored boolean")
SEGMENTS = T.StructType.fromDDL("clip_id long, source_id long, clip_start int, clip_end int, src_start int, src_end int, mirrored boolean")
