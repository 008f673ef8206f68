"""Orders of the result views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered

ORDERS = ("file", "size", "length", "resolution", "bitrate", "audio", "match", "hash")


def order_keys(key: str) -> list[Column]:
    """Sort columns of a folder filter; an unknown key leaves the order as it is."""
    down = lambda c: F.coalesce(F.col(c), F.lit(0)).desc()
    return {
        "file": [F.lower("file_name")],
        "size": [F.col("size_bytes").desc()],
        "length": [down("duration_s")],
        "resolution": [(F.col("width").cast("long") * F.col("height").cast("long")).desc()],
        "bitrate": [down("bit_rate_bps")],
        "audio": [down("audio_sample_rate_hz")],
        "match": [down("similarity_pct")],
        "hash": [F.lower(F.substring("sha256", 1, 16))],
    }.get(key, [])


def ordered(items: DataFrame, key: str) -> DataFrame:
    """items with `pos` from 1 within their folder, stable by item_id; folders of one item keep none."""
    several = items.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("folder")
    return numbered(items.join(several, "folder", "left_semi"), ["folder"], [*order_keys(key), F.col("item_id")], "pos")


def restored(items: DataFrame, detected: str) -> DataFrame:
    """items with `pos` from 1 within their folder as they were found: by the place of their set, then by item_id."""
    return numbered(items, ["folder"], [F.col(detected), F.col("item_id")], "pos")


def nearest_chain(scored: DataFrame, items: DataFrame) -> DataFrame:
    """(folder, item_id, pos): from a folder's first item always on to the most similar one left, first on ties.

    scored: (folder, item_a, item_b, pct) both ways round. Each step depends on the last, so a folder is one task.
    """

    def run(key, pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        left = sorted(int(i) for i in rows.item_id)
        pct = {(int(a), int(b)): p for a, b, p in zip(pairs.item_a, pairs.item_b, pairs.pct, strict=True)}
        chain = left[:1]
        left = left[1:]
        while left:
            best, at = -1.0, left[0]
            for b in left:
                if (p := pct.get((chain[-1], b), 0.0)) > best:
                    best, at = p, b
            chain.append(at)
            left.remove(at)
        return pd.DataFrame({"folder": key[0], "item_id": chain, "pos": range(1, len(chain) + 1)})

    return scored.groupBy("folder").cogroup(items.select("folder", "item_id").groupBy("folder")).applyInPandas(run, "folder string, item_id long, pos int")
