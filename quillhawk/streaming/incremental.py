"""Postings kept up to date from a stream of histogram records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillhawk.operators.index import postings, split_records


def index_stream(records: DataFrame, path: str, checkpoint: str, watermark_col: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Appends the postings of valid records to ``path``, partitioned by a range of codewords, once per id within ``delay``."""
    good, _ = split_records(records)
    if watermark_col:
        good = good.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark(["chunk_id"])
    rows = postings(good).withColumn("codeword_range", F.floor(F.col("codeword") / 64))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("codeword_range").trigger(availableNow=True).start()
