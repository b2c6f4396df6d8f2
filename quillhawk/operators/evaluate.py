"""Retrieval effectiveness, latency summaries and samples."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillhawk.operators.selection import exact_quantile, first_of_groups
from quillhawk.runtime import broadcast_if_small, stage

T = TypeVar("T")


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("items"))


def eligible(df: DataFrame, label: str, unknown: str = "unknown") -> DataFrame:
    """Rows whose label is known and held by more than one row; all rows if there are none. Only labels are counted and joined."""
    known = label_counts(df, label).where((F.col("items") > 1) & (F.col(label).cast("string") != unknown)).select(label)
    known = stage(known, "labels")
    n = known.count()
    return df.join(broadcast_if_small(known, n), label, "left_semi") if n else df


def precision_recall(queries: DataFrame, hits: DataFrame, items: DataFrame, id_col: str, label: str) -> DataFrame:
    """(query_id, tp, fp, fn, precision, recall) per query; queries without hits count as zero.

    ``hits`` has (query_id, id); an item is relevant if it carries the query's label. Label counts are small per label
    and joined by label; hits are few per query.
    """
    counts = items.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    q = queries.select(F.col(id_col).alias("query_id"), F.col(label).alias("ql")).join(counts.withColumnRenamed(label, "ql"), "ql", "left")
    found = hits.select("query_id", "id").join(items.select(F.col(id_col).alias("id"), F.col(label).alias("il")), "id")
    per = q.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.coalesce(F.sum((F.col("ql") == F.col("il")).cast("bigint")), F.lit(0)).alias("tp"), F.count("id").alias("hits"))
    per = per.select("query_id", "tp", (F.col("hits") - F.col("tp")).alias("fp"), F.greatest(F.greatest(F.col("n") - 1, F.lit(0)) - F.col("tp"), F.lit(0)).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return per.select("query_id", "tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def mean_effectiveness(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("tp"), 2).alias("tp"), F.round(F.avg("fp"), 2).alias("fp"), F.round(F.avg("fn"), 2).alias("fn"),
    )


def latency(df: DataFrame, ms: str, *by: str) -> DataFrame:
    """Mean, interpolated 95th percentile and queries per second."""
    tail = exact_quantile(df, ms, 0.95, *by).withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    means = df.groupBy(*by).agg(F.round(F.avg(ms), 6).alias("mean_ms"))
    out = means.join(tail, same, "left").select(*by, "mean_ms", F.round("quantile", 6).alias("p95_ms"))
    return out.withColumn("qps", F.round(F.try_divide(F.lit(1000.0), F.col("mean_ms")), 4))


def balanced_sample(df: DataFrame, label: str, n: int, order: str, tie: str) -> DataFrame:
    """n rows spread evenly over the labels, the remainder to the first labels by name; rows by the number ``order``, then ``tie``."""
    labels = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.lit(1).alias("one"))
    k = F.count(F.lit(1)).over(Window.partitionBy("one"))
    place = F.row_number().over(Window.partitionBy("one").orderBy(label))  # one row a label
    quota = labels.select(label, (F.floor(F.lit(n) / k) + (place <= F.lit(n) % k).cast("int")).alias("__quota"))
    return first_of_groups(df, label, order, tie, quota)


def asked_texts(df: DataFrame, id_col: str, text_col: str, n: int = 20, chars: int = 200) -> DataFrame:
    """(query_id, text): the first ``n`` queries by id, their text cut to ``chars``; blank ones are left out after the cut."""
    first = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.substring(F.coalesce(text_col, F.lit("")), 1, chars).alias("text")).orderBy("query_id").limit(n)
    return first.where(F.trim("text") != "")


def answered_only(per_query: DataFrame, hits: DataFrame) -> DataFrame:
    """Effectiveness rows of the queries that have an answer; the mean over them leaves empty answers out."""
    return per_query.join(hits.select("query_id").distinct(), "query_id", "left_semi")


def measured(spark: SparkSession, run: Callable[[], T]) -> tuple[T, dict[str, float]]:
    """What ``run`` returns, with its seconds, the driver's peak heap in MB and the bytes read from file systems meanwhile."""
    heap = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    read = lambda: sum(s.getBytesRead() for s in files.getAllStatistics())
    for pool in heap:
        pool.resetPeakUsage()
    began, before = time.perf_counter(), read()
    out = run()
    peak = sum(p.getPeakUsage().getUsed() for p in heap if p.getType().toString() == "Heap memory")
    return out, {"seconds": round(time.perf_counter() - began, 3), "peak_mb": round(peak / 1048576, 1), "read_bytes": float(read() - before)}


def codebook_sweep(spark: SparkSession, sizes: list[int], run: Callable[[int], DataFrame]) -> DataFrame:
    """(size, seconds, queries, precision, recall): effectiveness for each codebook size; ``run(size)`` gives rows per query."""
    rows = []
    for size in sizes:
        (mean, figures) = measured(spark, lambda: mean_effectiveness(run(size)).first())  # one row
        rows.append((size, figures["seconds"], int(mean.queries), float(mean.precision or 0), float(mean.recall or 0)))
    return spark.createDataFrame(rows, "size int, seconds double, queries bigint, precision double, recall double")


def seeded_order(id_col: str, seed: int = 42) -> F.Column:
    """A scrambled order of whole numbers by arithmetic that any SQL can repeat: multiplication modulo a prime."""
    prime = 2_147_483_647
    return F.pmod(F.pmod(F.col(id_col).cast("bigint"), F.lit(prime)) * F.lit(48_271 + 2 * seed), F.lit(prime))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, those first in the seeded order of a whole-number id."""
    return df.orderBy(seeded_order(id_col, seed), id_col).limit(n)
