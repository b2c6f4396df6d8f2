"""Seeded prefixes of groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group fall into 2**BITS ranges of their hash; only the range that holds the border is sorted.
BITS = 12


def seeded_hash(seed: int, column: str) -> F.Column:
    """A non-negative 63-bit hash of a column, the order in which rows are drawn."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column)), 1)


def take_prefix(df: DataFrame, group: str, order: str, tie: str, weight: str, budgets: dict[str, float]) -> DataFrame:
    """Adds ``taken``: whether the row lies in its group's prefix of about ``budgets[group]`` total weight.

    Rows follow ``order`` (a 63-bit hash), then ``tie``; a row is taken while the weight before it and half its own stay
    within the budget, so unit weights give exact counts. ``budgets`` has one entry per group and is the only thing sent
    to every executor; groups without one take nothing. Weights per group and hash range are summed first, whole ranges
    are then taken or left, and only the rows of each group's border range meet in a window.
    """
    spark = df.sparkSession
    plan = spark.createDataFrame(list(budgets.items()) or [("", 0.0)], f"{group} string, __budget double")
    marked = df.withColumn("__range", F.shiftright(order, 63 - BITS).cast("int"))
    sums = marked.groupBy(group, "__range").agg(F.sum(F.col(weight).cast("double")).alias("w"))
    before = F.sum("w").over(Window.partitionBy(group).orderBy("__range")) - F.col("w")
    border = (
        sums.withColumn("__before", before).join(F.broadcast(plan), group)
        .where("__before < __budget").groupBy(group)
        .agg(F.max("__range").alias("__border"), F.max("__before").alias("__base"), F.first("__budget").alias("__budget"))
    )
    known = [tuple(r) for r in border.select(group, "__border", "__base", "__budget").collect()]  # one row a group
    at = spark.createDataFrame(known or [("", -1, 0.0, 0.0)], f"{group} string, __border int, __base double, __budget double")
    rows = marked.join(F.broadcast(at), group, "left")
    outside = rows.where("__border is null or __range <> __border").withColumn("taken", F.coalesce(F.col("__range") < F.col("__border"), F.lit(False)))
    w = Window.partitionBy(group).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__base") + F.sum(F.col(weight).cast("double")).over(w) - F.col(weight) / 2
    inside = rows.where("__range = __border").withColumn("taken", upto <= F.col("__budget"))
    return outside.unionByName(inside).drop("__range", "__border", "__base", "__budget")
