"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.runtime import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every end of a link; ``component`` is the smallest id reached. Loops and repeats do no harm.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star) and its smaller neighbours on
    the smallest (small star). A node with many neighbours is met by aggregation and a join on its smallest neighbour,
    never by a list, so a hot node stays spread. Rounds are staged in the shared folder; links never reach the driver.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stage(small, "star")
        after = state(edges)
        if after == now:
            break
        now = after
    return nodes.join(edges.groupBy("u").agg(F.min("v").alias("m")), F.col("id") == F.col("u"), "left").select("id", F.coalesce("m", "id").alias("component"))
