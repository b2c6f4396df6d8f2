"""First rows of groups, in an order, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillhawk.runtime import broadcast_if_small, stage

#: Ranges of the order within a group; only the range that holds a border is sorted.
RANGES = 4096


def _ranged(df: DataFrame, group: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their range ``__range`` of ``order`` between their group's least and greatest value; rows per group and range.

    Rows with a null order fall out. The ranges of a group with one value only are one range.
    """
    rows = df.where(F.col(order).isNotNull())
    span = stage(rows.groupBy(*group).agg(F.min(F.col(order).cast("double")).alias("__low"), F.max(F.col(order).cast("double")).alias("__high")), "spans")
    names = [f"__g{i}" for i in range(len(group))]
    span = span.withColumnsRenamed(dict(zip(group, names)))
    same = F.lit(True)
    for g, n in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    joined = rows.join(broadcast_if_small(span, span.count()), same).drop(*names)
    at = F.floor(F.try_divide(F.col(order).cast("double") - F.col("__low"), F.col("__high") - F.col("__low")) * RANGES)
    marked = joined.withColumn("__range", F.least(F.coalesce(at, F.lit(0)), F.lit(RANGES - 1)).cast("int")).drop("__low", "__high")
    return marked, marked.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__rows"))


def first_of_groups(df: DataFrame, group: str, order: str, tie: str, quota: DataFrame) -> DataFrame:
    """The rows of each group that come first by ``order``, then ``tie``; ``quota`` has (group, __quota), one row a group.

    Rows per group and range of ``order`` are counted first, whole ranges are taken or left, and only each group's border
    range is sorted. Groups without a quota, null groups and rows with a null order give nothing.
    """
    marked, counts = _ranged(df.where(F.col(group).isNotNull()), [group], order)
    before = F.sum("__rows").over(Window.partitionBy(group).orderBy("__range")) - F.col("__rows")  # RANGES rows a group
    border = counts.withColumn("__before", before).join(quota, group).where("__before < __quota")
    border = border.groupBy(group).agg(F.max("__range").alias("__border"), F.max("__before").alias("__before"), F.first("__quota").alias("__quota"))
    border = stage(border, "borders")
    rows = marked.join(broadcast_if_small(border, border.count()), group)
    whole = rows.where("__range < __border")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, tie))
    part = rows.where("__range = __border").withColumn("__rank", rank).where("__before + __rank <= __quota").drop("__rank")
    return whole.unionByName(part).drop("__range", "__border", "__before", "__quota")


def exact_quantile(df: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """(by..., quantile): the linearly interpolated quantile of every group's non-null values, exact.

    Counts per range of values find the range of each of the two rows around the rank; only the distinct values of those
    ranges are ranked. Rows with a null group form a group.
    """
    marked, counts = _ranged(df.select(*by, F.col(value).cast("double").alias("__v")).where(~F.isnan("__v")), list(by), "__v")
    window = Window.partitionBy(*by)
    upto = F.sum("__rows").over(window.orderBy("__range"))
    placed = counts.withColumns({"__upto": upto, "__n": F.sum("__rows").over(window)})  # RANGES rows a group
    rank = F.lit(q) * (F.col("__n") - 1)
    wanted = placed.where((F.col("__upto") > F.floor(rank)) & (F.col("__upto") - F.col("__rows") <= F.ceil(rank)))
    wanted = stage(wanted.select(*by, "__range", (F.col("__upto") - F.col("__rows")).alias("__before"), "__n"), "ranks")
    names = [f"__g{i}" for i in range(len(by))]
    keys = wanted.withColumnsRenamed({**dict(zip(by, names)), "__range": "__r"})
    same = F.col("__range") == F.col("__r")
    for g, n in zip(by, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    values = marked.join(broadcast_if_small(keys, keys.count()), same).groupBy(*by, "__range", "__v").agg(F.count(F.lit(1)).alias("__c"), F.first("__before").alias("__before"), F.first("__n").alias("__n"))
    last = F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__range").orderBy("__v"))
    held = values.withColumn("__last", last)
    at = F.lit(q) * (F.col("__n") - 1)
    holds = lambda r: (F.col("__last") > r) & (F.col("__last") - F.col("__c") <= r)
    ends = held.groupBy(*by).agg(F.max(F.when(holds(F.floor(at)), F.col("__v"))).alias("__a"), F.max(F.when(holds(F.ceil(at)), F.col("__v"))).alias("__b"), F.first(at - F.floor(at)).alias("__f"))
    return ends.select(*by, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("quantile"))
