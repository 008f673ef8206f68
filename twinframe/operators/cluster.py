"""Leader clustering, selections and group summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import dropped, written
from .ranking import numbered

COLOURS = 6


def quality_ranked(items: DataFrame, score: Column, name: str = "rank") -> DataFrame:
    """Items numbered from 1 within their folder by falling score; ties by item_id."""
    return numbered(items, ["folder"], [score.desc(), F.col("item_id")], name)


def leader_clusters(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(folder, rank, leader) of items in groups, for a symmetric similarity; leader is a rank too.

    ranks: (folder, rank); edges: (folder, low, high) with low < high, the ranks of pairs
    that reach the threshold. An item leads if no earlier leader is adjacent, and others join
    their earliest adjacent leader; leaders without members go. Each round settles every
    item whose earlier neighbours are settled, so rounds follow the longest chain of
    undecided neighbours and no folder needs to fit one task.
    """
    state = written(edges.select("folder", "low", "high"), "edges")
    ends = lambda c, name="rank": state.select("folder", F.col(c).alias(name))
    open_nodes, leaders = written(ends("low").union(ends("high")).distinct(), "open"), None
    while open_nodes.take(1):
        # nodes without an undecided earlier neighbour lead, and cover their later neighbours
        new = written(open_nodes.join(ends("high"), ["folder", "rank"], "left_anti"), "leaders")
        leaders = new if leaders is None else leaders.union(new)
        covered = state.join(new.withColumnRenamed("rank", "low"), ["folder", "low"], "left_semi").select("folder", F.col("high").alias("rank"))
        before = open_nodes, state
        open_nodes = written(open_nodes.join(new.union(covered), ["folder", "rank"], "left_anti"), "open")
        for c in ("low", "high"):
            state = state.join(open_nodes.withColumnRenamed("rank", c), ["folder", c], "left_semi").select("folder", "low", "high")
        state = written(state, "edges")
        dropped(*before)
    if leaders is None:
        return ranks.select("folder", "rank", F.col("rank").alias("leader")).limit(0)
    both = edges.select("folder", "low", "high").union(edges.select("folder", F.col("high").alias("low"), F.col("low").alias("high")))
    led = both.join(leaders.select("folder", F.col("rank").alias("low")), ["folder", "low"], "left_semi").join(leaders.select("folder", F.col("rank").alias("high")), ["folder", "high"], "left_anti")
    members = led.groupBy("folder", F.col("high").alias("rank")).agg(F.min("low").alias("leader"))
    heads = members.select("folder", F.col("leader").alias("rank"), "leader").distinct()
    return members.unionByName(heads)


def leader_clusters_asymmetric(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for a similarity that depends on the order of its items: (folder, reference, candidate) edges.

    Leaders take all free candidates, earlier ones too, so items must be visited one by
    one: a folder is one task here.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for r, c in zip(pdf.reference, pdf.candidate, strict=True):
            near.setdefault(int(r), []).append(int(c))
        taken: dict[int, int] = {}
        for r in sorted(near):
            if r not in taken and (free := [c for c in near[r] if c not in taken and c != r]):
                taken[r] = r
                taken.update(dict.fromkeys(free, r))
        return pd.DataFrame({"folder": pdf.folder.iloc[0], "rank": list(taken), "leader": list(taken.values())})

    return edges.groupBy("folder").applyInPandas(run, "folder string, rank long, leader long")


def kept_and_selected(groups: DataFrame, by: list[str], score: Column, keep: str) -> DataFrame:
    """groups with `selected`: all but the best (or the worst) of each group; ties by item_id."""
    best_first = Window.partitionBy(*by).orderBy(score.desc(), "item_id")
    place = F.row_number().over(best_first)
    if keep == "best":
        return groups.withColumn("selected", place != 1)
    return groups.withColumn("place", place).withColumn("selected", F.col("place") != F.max("place").over(Window.partitionBy(*by))).drop("place")


def selection_totals(items: DataFrame) -> DataFrame:
    """Number and bytes of selected files, each path once."""
    once = items.groupBy("full_path").agg(F.max("selected").alias("selected"), F.max("size_bytes").alias("size_bytes"))
    return once.agg(F.count_if("selected").alias("n_selected"), F.sum(F.when(F.col("selected"), F.col("size_bytes")).otherwise(0)).alias("bytes_selected"))


def copy_colours(items: DataFrame, by: list[str]) -> DataFrame:
    """items with `colour`: equal digests within a group share one of six colours, in order of first place; single ones have none."""
    digests = items.groupBy(*by, "sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("item_id").alias("first_place"))
    shared = numbered(digests.where("copies > 1").select(*by, "sha256", "first_place"), by, [F.col("first_place")], "place")
    colours = shared.select(*by, "sha256", F.pmod(F.col("place") - 1, F.lit(COLOURS)).cast("int").alias("colour"))
    return items.join(digests.drop("first_place"), [*by, "sha256"]).join(colours, [*by, "sha256"], "left")
