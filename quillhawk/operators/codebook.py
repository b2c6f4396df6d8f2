"""Text and vector codebooks, and the histograms over them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillhawk.functions.vector import as_double
from quillhawk.operators.tfidf import codebook_idf, tf_weight
from quillhawk.runtime import map_arrow, stage


def text_codebook(tf: DataFrame, items: int, top_k: int) -> DataFrame:
    """(term, idx, df, idf): the ``top_k`` terms in most items, ties by term; IDF over all items, empty ones included."""
    top = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(top_k)
    idx = F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1  # at most top_k rows
    return top.select("term", idx.alias("idx"), "df", codebook_idf(F.lit(items), F.col("df")).alias("idf"))


def text_histogram(tf: DataFrame, codebook: DataFrame, id_col: str, weighting: str = "log") -> DataFrame:
    """(id, idx, weight) of the non-zero components: ``log`` gives (1 + ln c) * idf, ``raw`` gives c * idf at unit length.

    The codebook is a top-k table, so it is broadcast.
    """
    rows = tf.join(F.broadcast(codebook), "term")
    if weighting == "log":
        return rows.select(id_col, "idx", (tf_weight(F.col("count")) * F.col("idf")).alias("weight"))
    rows = rows.select(id_col, "idx", (F.col("count") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return rows.select(id_col, "idx", (F.col("w") / F.nullif(norm, F.lit(0.0))).alias("weight"))


def dense(histogram: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, histogram) with ``size`` components."""
    maps = histogram.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
    return maps.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("histogram"))


def kmeans_codebook(df: DataFrame, vector_col: str, k: int, seed: int = 42, max_iter: int = 20, minibatch: bool = False, batch_rows: int = 1024, **options):
    """A k-means model of the library over a vector column; further ``options`` go to it (``tol``, ``initSteps``, ...).

    With ``minibatch`` the model starts from a fit of a sample and takes ``max_iter`` steps of about ``batch_rows`` rows
    each, every centre moving to the mean of all rows it has met: an array of centres comes back.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k < 1:
        raise ValueError("k must be positive")
    data = df.select(array_to_vector(as_double(F.col(vector_col))).alias("features"))
    if not minibatch:
        return KMeans(k=k, seed=seed, maxIter=max_iter, **options).fit(data)
    vectors = df.select(as_double(F.col(vector_col)).alias("v")).where("v is not null").withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 40)))
    vectors = stage(vectors, "minibatch")
    total = vectors.count()
    share = min(1.0, max(batch_rows, 3 * k) / max(total, 1))
    model = None
    for i in range(max_iter + 1):
        low = (i * share) % 1.0
        x = np.array([r.v for r in vectors.where((F.col("h") >= int(low * (1 << 40))) & (F.col("h") < int(min(1.0, low + share) * (1 << 40)))).select("v").collect()])  # about batch_rows rows
        if not len(x):
            continue
        if model is None:
            rng = np.random.default_rng(seed)
            model, met = x[rng.permutation(len(x))[:k]].copy(), np.zeros(min(k, len(x)))
        near = ((model * model).sum(axis=1) - 2 * (x @ model.T)).argmin(axis=1)
        for c in np.unique(near):
            part = x[near == c]
            met[c] += len(part)
            model[c] += (part.mean(axis=0) - model[c]) * (len(part) / met[c])
    if model is None:
        raise ValueError("there are no vectors")
    return model


def centroid_table(model, spark) -> DataFrame:
    """(cluster, centroid) of a k-means model or an array of centres."""
    centres = model if isinstance(model, np.ndarray) else model.clusterCenters()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


def mean_centroids(df: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    """(cluster, centroid): the mean vector of every label."""
    parts = df.select(F.col(label_col).alias("cluster"), F.posexplode(as_double(F.col(vector_col))).alias("i", "x"))
    means = parts.groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def _nearest(batches: Iterable[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    clusters, book = shared.value
    sizes = (book * book).sum(axis=1)
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            if x.shape[1] != book.shape[1]:
                raise ValueError("vectors must have the same length")
            rough = sizes - 2 * (x @ book.T)
            own = (x * x).sum(axis=1)
            i, j = np.nonzero(rough <= rough.min(axis=1, keepdims=True) + 1e-6 * (1 + own[:, None]))
            d = np.round(np.sqrt(((x[i] - book[j]) ** 2).sum(axis=1)), 8)
            order = np.lexsort((clusters[j], d, i))
            first = order[np.unique(i[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(clusters[j[first]]), pa.array(d[first])], names=[*names, "cluster", "distance"])


def assign(df: DataFrame, id_col: str, vector: Column, centroids: DataFrame, keep: str | None = None) -> DataFrame:
    """(id, cluster, distance): the nearest centroid, ties to the smaller cluster; null vectors are left out.

    With ``keep`` the vector stands under that name after the id, as doubles.

    The centroids are k rows and sent to the executors; vectors meet them in matrix products, and what may be nearest is
    compared by exact differences.
    """
    book = sorted((r["cluster"], r["centroid"]) for r in centroids.select("cluster", "centroid").collect())  # k rows
    kind, cluster = df.schema[id_col].dataType.simpleString(), centroids.schema["cluster"].dataType.simpleString()
    names = [id_col, keep] if keep else [id_col]
    schema = f"`{id_col}` {kind}, {f'`{keep}` array<double>, ' if keep else ''}cluster {cluster}, distance double"
    if not book:
        return df.sparkSession.createDataFrame([], schema)
    clusters = np.array([c for c, _ in book], dtype=np.int32 if cluster == "int" else np.int64)
    shared = df.sparkSession.sparkContext.broadcast((clusters, np.array([c for _, c in book], dtype=np.float64)))
    rows = df.select(F.col(id_col), as_double(vector).alias("__v")).where("__v is not null")
    return map_arrow(rows, partial(_nearest, shared=shared, names=names), schema)


def word_histogram(assigned: DataFrame, item: Column, cluster: str = "cluster") -> DataFrame:
    """(item, cluster, weight): counts of visual or acoustic words at unit length."""
    counts = assigned.groupBy(item.alias("item"), cluster).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("item")))
    return counts.select("item", cluster, (F.col("n") / norm).alias("weight"))


def descriptor_sample(df: DataFrame, group: str, order: Column, tie: str, most: int, files: int | None = None) -> DataFrame:
    """At most ``most`` rows of each of the first ``files`` groups (all without), those first in ``order``, then ``tie``.

    The ranks are cut to ``most`` before the shuffle, so a large group isn't sorted as a whole.
    """
    rows = df
    if files:
        rows = df.join(F.broadcast(df.select(group).distinct().orderBy(group).limit(files)), group, "left_semi")  # ``files`` rows
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(order, tie))).where(F.col("__rank") <= most).drop("__rank")
