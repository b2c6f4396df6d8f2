"""Numeric song features: first rows, min-max scaling and nearest songs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillhawk.functions.vector import min_max

FEATURES = ("danceability", "energy", "pitch_key", "loudness", "scale_mode", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo", "duration_ms")

#: Decimals shown of a feature, where not three.
DECIMALS = {"tempo": 1}


def first_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; null keys are left out."""
    ranked = df.where(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def complete(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows whose features are all present."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok)


def metadata(df: DataFrame, id_col: str, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(id, features...) as doubles for display: tempo to one decimal, all others to three; missing ones stay null."""
    return df.select(id_col, *[F.round(F.col(c).cast("double"), DECIMALS.get(c, 3)).alias(c) for c in columns])


def scaled(df: DataFrame, id_col: str, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(id, features): each column scaled to 0..1 over the table; the one row of ranges is broadcast."""
    ranges = df.agg(*[x for c in columns for x in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))])
    values = [min_max(F.col(c).cast("double"), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns]
    return df.join(F.broadcast(ranges)).select(id_col, F.array(*values).alias("features"))
