"""Approximate neighbours: inverted file cells, and the library's random projections."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.functions.vector import as_double
from quillhawk.operators.codebook import assign, centroid_table, kmeans_codebook
from quillhawk.operators.search import best_stored, check_k, top_k
from quillhawk.runtime import stage


def _probed(q: np.ndarray, clusters: np.ndarray, centres: np.ndarray, probes: int) -> dict[int, np.ndarray]:
    """For each cluster the positions of the queries that have it among their ``probes`` nearest, ties to the smaller cluster."""
    if q.shape[1] != centres.shape[1]:
        raise ValueError("vectors must have the same length")
    near, step = np.empty((len(q), min(probes, len(centres))), dtype=np.int64), max(1, 4_000_000 // centres.size)
    for a in range(0, len(q), step):
        d = ((q[a : a + step, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        near[a : a + step] = np.argsort(d, axis=1, kind="stable")[:, :probes]
    return {int(c): np.nonzero((near == i).any(axis=1))[0] for i, c in enumerate(clusters)}


class CellIndex:
    """Vectors placed in the cell of their nearest k-means centroid."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, cells: int, fit_rows: int = 100_000, seed: int = 42) -> None:
        """The centroids are fitted on at most ``fit_rows`` rows, those first by hashed id; every row is indexed."""
        self.rows = df.select(F.col(id_col).alias("id"), as_double(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
        some = stage(self.rows.orderBy(F.xxhash64(F.lit(seed), "id")).limit(fit_rows), "fit", "zstd")  # the fit reads it three times
        self.centroids = centroid_table(kmeans_codebook(some, "v", cells, seed), df.sparkSession)
        placed = assign(self.rows, "id", F.col("v"), self.centroids, keep="v").select("id", "v", "cluster")
        self.placed = placed.sortWithinPartitions("cluster")  # so that a task meets whole cells

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int = 3) -> DataFrame:
        """(query_id, rank, id, score): the k nearest in the ``probes`` nearest cells of each query.

        The queries are sent to the executors as in ``vector_search`` and meet the rows of their cells in matrix
        products; no pair of vectors becomes a row.
        """
        check_k(k)
        asked = queries.select(F.col(id_col).alias("id"), as_double(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
        book = sorted((r["cluster"], r["centroid"]) for r in self.centroids.collect())  # k rows
        clusters, centres = np.array([c for c, _ in book]), np.array([v for _, v in book], dtype=np.float64)
        return best_stored(asked, self.placed, k, probe=partial(_probed, clusters=clusters, centres=centres, probes=probes))


def projection_search(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, k: int, radius: float, bucket: float = 0.5, tables: int = 4, seed: int = 42) -> DataFrame:
    """The same from the library's bucketed random projections, within ``radius``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def data(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), array_to_vector(as_double(F.col(vector_col))).alias("f"))

    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(data(base))
    pairs = model.approxSimilarityJoin(data(queries), data(base), radius, distCol="d")
    scored = pairs.select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("id"), F.round("d", 8).alias("score"))
    return top_k(scored, "query_id", F.asc("score"), "id", k).select("query_id", "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, neighbours, found, recall) of an approximate answer against the exact one."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    joined = exact.join(hit, ["query_id", "id"], "left")
    return joined.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
