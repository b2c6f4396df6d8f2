"""Table schemas, first-wins loads and other writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillhawk.runtime import first_wins

SCHEMAS = {
    "pg_text_docs": "id bigint, chunk_id string, title string, snippet string, source string, content string, indexed_at timestamp",
    "pg_image_docs": "id bigint, chunk_id string, filename string, image_url string, title string, embedding array<float>, indexed_at timestamp",
    "pg_audio_docs": "id bigint, chunk_id string, filename string, genre string, title string, audio_url string, embedding array<float>, indexed_at timestamp",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def full_refresh(df: DataFrame, path: str, order: str = "id") -> int:
    """Replaces the table at ``path`` with the first row of every ``chunk_id``; returns the rows written."""
    rows = first_wins(df, "chunk_id", order, df.columns)
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_postings(rows: DataFrame, path: str) -> None:
    """A postings table in codeword order, so that a scan can skip row groups."""
    rows.repartitionByRange("codeword").sortWithinPartitions("codeword").write.mode("overwrite").parquet(path)


def write_blocks(blocked: DataFrame, path: str) -> None:
    """Blocks (block_id, codeword, postings) as one JSON object a block, in a directory per block."""
    objects = blocked.groupBy("block_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("codeword").cast("string"), "postings"))).alias("postings"))
    objects.withColumn("block", F.col("block_id")).write.mode("overwrite").partitionBy("block").json(path)


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def unique_ids(df: DataFrame, id_col: str, order: str, suffix: str | None = None) -> DataFrame:
    """Later rows with an id get ``id__dup{n}_{suffix}`` (``order`` without one); the id before is kept as ``source_{id}``."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(order)) - 1
    out = df.withColumn(f"source_{id_col}", F.col(id_col)).withColumn("__n", n)
    again = F.concat(F.col(id_col), F.lit("__dup"), F.col("__n").cast("string"), F.lit("_"), F.col(suffix or order).cast("string"))
    return out.withColumn(id_col, F.when(F.col("__n") > 0, again).otherwise(F.col(id_col))).drop("__n")


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_category_texts(df: DataFrame, path: str, category: str, text: str) -> None:
    """``category``, a blank line and the text as text files, in a directory per category."""
    value = F.concat(F.col(category), F.lit("\n\n"), F.col(text))
    df.select(value.alias("value"), F.col(category).alias("category")).write.mode("overwrite").partitionBy("category").text(path)
