"""Queries against the same rows in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CHOSEN = ["exact_groups_members", "quality_rank", "best_copy", "identical_copy_colors", "keep_worst_selection", "sort_by_bitrate", "cache_rewrite", "groups_after_delete", "relative_age", "usable_frame_choice", "orientation_hashes", "banded_near_pairs", "leader_group_members", "video_leader_groups", "person_resolution", "thumb_nn_chain", "fp_contained", "fp_segments", "fp_compilations", "cached_row_projection", "reuse_selection", "folder_displays"]


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, values made alike."""
    same = lambda v: "" if v is None or pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(same, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_like_sql(spark, name):
    with duckdb.connect() as con:
        for t in os.listdir(DATA):
            con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{t}')")
        wanted = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns) and rows(got) == rows(wanted)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
