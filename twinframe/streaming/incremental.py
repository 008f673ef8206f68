"""Incremental forms: new files against the cache, and identity clusters as stream state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.persons import FACE_THRESHOLD, Identities
from ..sources import store


def incremental_scan(spark: SparkSession, items: DataFrame, cache_path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Streamed scan rows whose cache key is new are extracted and appended to the cache.

    Rows of a batch that is run again have the same keys, so they are found in the cache
    and not appended twice.
    """

    def take(batch: DataFrame, _: int) -> None:
        fresh = store.with_key(batch).dropDuplicates(["cache_key"])
        reader = batch.sparkSession.read.schema(fresh.schema)
        try:
            fresh = store.cache_misses(fresh, reader.parquet(cache_path))
        except Exception as e:  # the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(e):
                raise
        (extract(fresh) if extract else fresh).write.mode("append").parquet(cache_path)

    return items.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_clusters(detections: DataFrame, threshold: float = FACE_THRESHOLD) -> DataFrame:
    """(folder, item_id, cluster_id, sample_count) of a stream: clusters live in the folder's state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        people = Identities(*pickle.loads(state.get[0])) if state.exists else Identities()
        rows = pd.concat(list(batches)).sort_values("item_id", kind="stable")
        ids = [people.assign(e, threshold)[0] for e in rows.embedding]
        state.update((pickle.dumps(([c.tolist() for c in people.centroids], people.counts)),))
        yield pd.DataFrame({"folder": key[0], "item_id": rows.item_id, "cluster_id": ids, "sample_count": [people.counts[k] for k in ids]})

    return detections.groupBy("folder").applyInPandasWithState(step, "folder string, item_id long, cluster_id int, sample_count int", "clusters binary", "append", GroupStateTimeout.NoTimeout)
