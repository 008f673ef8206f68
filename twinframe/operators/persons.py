"""Identity clusters that grow with every embedding: running means per folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACE_THRESHOLD, BODY_THRESHOLD = 0.6, 0.8


class Identities:
    """Clusters of one folder: an embedding joins the most similar centroid, or founds a cluster.

    Products are taken in float32 and summed in double; embeddings of another length, or of zeros, are not similar.
    """

    def __init__(self, centroids=(), counts=()):
        self.counts: list[int] = []
        self._of: dict[int, list[int]] = {}  # length -> cluster ids
        self._matrix: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length -> room for rows, and for their norms
        self.centroids: list[np.ndarray] = []
        for c, n in zip(centroids, counts, strict=True):
            self._found(np.asarray(c, np.float32), n)

    @staticmethod
    def _norm(x: np.ndarray) -> float:
        return float(np.sqrt((x * x).astype(np.float64).sum()))

    def _found(self, e: np.ndarray, count: int = 1) -> None:
        ids = self._of.setdefault(len(e), [])
        rows, norms = self._matrix.get(len(e), (np.empty((0, len(e)), np.float32), np.empty(0)))
        if len(ids) == len(rows):
            more = max(16, len(rows))
            rows, norms = np.concatenate([rows, np.zeros((more, len(e)), np.float32)]), np.concatenate([norms, np.zeros(more)])
            self._matrix[len(e)] = rows, norms
        rows[len(ids)], norms[len(ids)] = e, self._norm(e)
        ids.append(len(self.counts))
        self.centroids.append(e.copy())
        self.counts.append(count)

    def assign(self, embedding, threshold: float) -> tuple[int, float]:
        """(cluster, similarity to its centroid before): clusters count from 0."""
        e = np.asarray(embedding, np.float32)
        ids = self._of.get(len(e), [])
        best, at = 0.0, -1
        norm = self._norm(e)
        if ids and norm > 0:
            rows, norms = self._matrix[len(e)]
            dots = (rows[: len(ids)] * e).astype(np.float64).sum(axis=1)
            scale = norms[: len(ids)] * norm
            similar = np.divide(dots, scale, out=np.zeros(len(ids)), where=scale > 0)
            at = int(similar.argmax())
            best = float(similar[at])
        if at >= 0 and best > 0 and best >= threshold:
            k = ids[at]
            self.counts[k] += 1
            c = self.centroids[k]
            self.centroids[k] = c + (e - c) / np.float32(self.counts[k])
            rows[at], norms[at] = self.centroids[k], self._norm(self.centroids[k])
            return k, best
        self._found(e)
        return len(self.counts) - 1, max(best, 0.0)


def person_clusters(detections: DataFrame, threshold: float = FACE_THRESHOLD) -> DataFrame:
    """(folder, item_id, cluster_id, sample_count): detections in order of item_id within their folder.

    Every assignment depends on the ones before it, so a folder is one sequence, and one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id", kind="stable")
        people = Identities()
        ids = [people.assign(e, threshold)[0] for e in pdf.embedding]
        return pd.DataFrame({"folder": pdf.folder, "item_id": pdf.item_id, "cluster_id": ids, "sample_count": [people.counts[k] for k in ids]})

    return detections.select("folder", "item_id", "embedding").groupBy("folder").applyInPandas(run, "folder string, item_id long, cluster_id int, sample_count int")


def resolved(items: DataFrame, face_threshold: float = FACE_THRESHOLD, body_threshold: float = BODY_THRESHOLD) -> DataFrame:
    """(folder, item_id, used, person_ids): the clusters of an item's faces or, where it has none, of its bodies.

    items: (folder, item_id, faces, bodies), both arrays of embeddings. Faces and bodies share the clusters of a
    folder; items without either have no ids. A folder is one sequence, in order of item_id.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id", kind="stable")
        people = Identities()
        used, ids = [], []
        for faces, bodies in zip(pdf.faces, pdf.bodies, strict=True):
            some = lambda x: x is not None and len(x) > 0
            kind, threshold, found = ("face", face_threshold, faces) if some(faces) else ("body", body_threshold, bodies) if some(bodies) else (None, 0, ())
            used.append(kind)
            ids.append(sorted({people.assign(e, threshold)[0] for e in found}))
        return pd.DataFrame({"folder": pdf.folder, "item_id": pdf.item_id, "used": used, "person_ids": ids})

    return items.select("folder", "item_id", "faces", "bodies").groupBy("folder").applyInPandas(run, "folder string, item_id long, used string, person_ids array<int>")


def share_person(a: Column, b: Column) -> Column:
    """Whether two sets of person ids overlap; empty or missing ones share nobody."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
