"""Histogram records, inverted indexes and their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhawk.runtime import number_rows

MODALITIES = ("text", "image", "audio")


def record_problem(id_col: str = "chunk_id", modality_col: str = "modality", vector_col: str = "histogram", meta_col: str = "metadata") -> Column:
    """The first rule that a record breaks, null if none."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(F.coalesce(F.col(id_col), F.lit("")) == "", "id")
        .when(~F.coalesce(F.col(modality_col).isin(*MODALITIES), F.lit(False)), "modality")
        .when(F.col(meta_col).isNull(), "metadata")
        .when(v.isNull() | (F.size(v) == 0), "histogram")
        .when(bad, "not finite")
    )


def split_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the others with the broken rule as ``problem``."""
    checked = df.withColumn("problem", record_problem())
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def require_modality(df: DataFrame, modality: str) -> None:
    if df.where(F.col("modality") != modality).limit(1).count():
        raise ValueError(f"all records must be of modality {modality}")


def require_unique(df: DataFrame, id_col: str = "chunk_id") -> None:
    if df.groupBy(id_col).count().where("count > 1").limit(1).count():
        raise ValueError(f"{id_col} occurs more than once")


def postings(df: DataFrame, id_col: str = "chunk_id", vector_col: str = "histogram") -> DataFrame:
    """(codeword, id, frequency) of the components above zero."""
    return df.select(id_col, F.posexplode(vector_col).alias("codeword", "frequency")).where("frequency > 0").select("codeword", id_col, "frequency")


def clustered(rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Postings placed and sorted by codeword and id, the layout to write: one shuffle and an external sort merge the blocks.

    Ranges are of codeword and id together, so a frequent codeword takes several partitions.
    """
    return rows.repartitionByRange("codeword", id_col).sortWithinPartitions("codeword", id_col)


def blocks(df: DataFrame, block_size: int, id_col: str = "chunk_id", vector_col: str = "histogram") -> DataFrame:
    """(block_id, codeword, postings): consecutive groups of ``block_size`` records by id, postings sorted by id."""
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    numbered = number_rows(df.select(id_col, vector_col), [id_col], "position")
    rows = numbered.select(F.floor(F.col("position") / block_size).cast("bigint").alias("block_id"), id_col, F.posexplode(vector_col).alias("codeword", "frequency")).where("frequency > 0")
    return rows.groupBy("block_id", "codeword").agg(F.array_sort(F.collect_list(F.struct(id_col, "frequency"))).alias("postings"))


def merge_blocks(blocked: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(codeword, id, frequency): the postings of all blocks in order of codeword and id, one row each.

    No list of a codeword is ever gathered: a frequent one spans partitions.
    """
    return clustered(blocked.select("codeword", F.explode("postings").alias("p")).select("codeword", f"p.{id_col}", "p.frequency"), id_col)


def build(df: DataFrame, path: str, block_size: int = 1000, id_col: str = "chunk_id", vector_col: str = "histogram") -> int:
    """Validates records, writes their merged postings in ``clustered`` layout to ``path`` and returns the number of blocks."""
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    good, bad = split_records(df)
    if bad.limit(1).count():
        raise ValueError("a record is not valid")
    require_unique(good, id_col)
    clustered(postings(good, id_col, vector_col), id_col).write.mode("overwrite").parquet(path)
    return -(-good.count() // block_size)


class Index:
    """The accessors of a built index: postings of a codeword, histogram and metadata of a record, number of records."""

    def __init__(self, records: DataFrame, postings_path: str, id_col: str = "chunk_id") -> None:
        self.records, self.id_col = records, id_col
        self.stored = records.sparkSession.read.parquet(postings_path)

    def __len__(self) -> int:
        return self.records.count()

    def postings(self, codeword: int) -> list[tuple[str, float]]:
        """Sorted by id; empty for an unknown codeword."""
        return [(r[0], r[1]) for r in self.stored.where(F.col("codeword") == codeword).select(self.id_col, "frequency").orderBy(self.id_col).toLocalIterator()]

    def histogram(self, key: str) -> list[float]:
        found = self.records.where(F.col(self.id_col) == key).select("histogram").first()
        if found is None:
            raise KeyError(key)
        return found.histogram

    def metadata(self, key: str) -> dict[str, str]:
        """Empty for an unknown record."""
        found = self.records.where(F.col(self.id_col) == key).select("metadata").first()
        return dict(found.metadata or {}) if found else {}


def statistics(df: DataFrame, vector_col: str, block_size: int | None = None) -> DataFrame:
    """One row: stored vectors, their dimension, megabytes at four bytes a component, and blocks if a size is given."""
    out = df.agg(F.count(F.lit(1)).alias("n_comparisons"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("vector_dim"))
    out = out.withColumn("index_mb", F.round(F.col("n_comparisons") * F.col("vector_dim") * 4 / 1048576, 3))
    return out.withColumn("spimi_blocks", F.ceil(F.col("n_comparisons") / block_size)) if block_size else out
