"""Term counts, vocabularies and TF-IDF weights in long form (one row per item and term)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillhawk.functions.stem import stem_tokens, stemmed
from quillhawk.functions.text import stopwords, tokens
from quillhawk.runtime import broadcast_if_small


@dataclass(frozen=True)
class Preprocess:
    """One definition for documents and queries: stop words of ``language`` and ``custom`` ones, stemming if asked."""

    language: str | None = None
    custom: tuple[str, ...] = ()
    stem: bool = False

    def stop(self, df: DataFrame) -> list[str]:
        return stopwords(df.sparkSession, self.language, custom=self.custom) if self.language else list(self.custom)

    def tokens(self, df: DataFrame, text: str) -> Column:
        found = tokens(F.col(text), self.stop(df))
        return stem_tokens(found, self.language or "") if self.stem else found


def token_rows(df: DataFrame, id_col: str, text_col: str, how: Preprocess = Preprocess()) -> DataFrame:
    """(id, position, term)."""
    return df.select(id_col, F.posexplode(how.tokens(df, text_col)).alias("position", "term"))


def term_frequency(df: DataFrame, id_col: str, text_col: str, how: Preprocess = Preprocess()) -> DataFrame:
    """(id, term, count); texts without terms have no rows here, so keep the item table beside it.

    An item's terms arise in one task, so the partial aggregation already ends with one row per item and term. Stop words
    are dropped by a hash lookup, stems are taken of the distinct terms.
    """
    words = df.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))
    stop = how.stop(df)
    if stop:
        words = words.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in stop], "term string")), "term", "left_anti")  # a fixed list
    counts = words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("count"))
    if not how.stem:
        return counts
    return stemmed(counts, "term", how.language or "").groupBy(id_col, "term").agg(F.sum("count").alias("count"))


def term_maps(items: DataFrame, tf: DataFrame, id_col: str) -> DataFrame:
    """(id, tf): a map per item, empty where the item has no terms."""
    maps = tf.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "count")))).alias("tf"))
    return items.select(id_col).join(maps, id_col, "left").withColumn("tf", F.coalesce("tf", F.create_map().cast("map<string,bigint>")))


def tf_weight(count: Column) -> Column:
    return F.when(count > 0, 1 + F.ln(count)).otherwise(F.lit(0.0))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def codebook_idf(n: Column, df: Column) -> Column:
    return F.round(F.ln(n / df) + 1, 4)


@dataclass
class TfidfModel:
    """A fitted vocabulary (term, idx, df, idf) and the transforms over it."""

    vocabulary: DataFrame
    size: int

    def transform(self, tf: DataFrame, id_col: str) -> DataFrame:
        """(id, term, idx, weight): unit length per item; unknown terms are left out, items without terms have no rows."""
        weighted = tf.join(broadcast_if_small(self.vocabulary, self.size), "term").select(id_col, "term", "idx", (tf_weight(F.col("count")) * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
        return weighted.withColumn("weight", F.col("w") / F.nullif(norm, F.lit(0.0))).drop("w")

    def feature_names(self) -> DataFrame:
        return self.vocabulary.select("idx", "term").orderBy("idx")


def fit_tfidf(tf: DataFrame, documents: int, id_col: str, max_features: int | None = None) -> TfidfModel:
    """Vocabulary with smoothed IDF: all terms in alphabetical order, or the ``max_features`` in most documents (ties: term)."""
    if documents == 0:
        raise ValueError("the corpus is empty")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(documents)
    if max_features:
        df = df.orderBy(F.desc("df"), "term").limit(max_features)
        order = Window.orderBy(F.desc("df"), "term")  # at most max_features rows
        vocabulary = df.withColumn("idx", F.row_number().over(order) - 1)
    else:
        from quillhawk.runtime import number_rows

        vocabulary = number_rows(df, ["term"], "idx")
    vocabulary = vocabulary.select("term", F.col("idx").cast("int").alias("idx"), "df", smooth_idf(n, F.col("df")).alias("idf"))
    return TfidfModel(vocabulary, max_features or vocabulary.count())
