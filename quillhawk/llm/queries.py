"""The pN_ queries: each operator with its production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillhawk.llm.clusters import similarity_clusters
from quillhawk.llm.distinctive import term_scores
from quillhawk.llm.frequencies import mark_frequencies, ngram_frequencies
from quillhawk.llm.leakage import clean_documents, leaked_items, leaked_spans
from quillhawk.llm.mixing import mix_sources
from quillhawk.llm.nearduplicates import NearDuplicates, near_duplicates
from quillhawk.llm.neighbours import all_neighbours, near_neighbours, scan_neighbours
from quillhawk.llm.proportional import Target, clean_labels, proportional_sample
from quillhawk.llm.spam import spam_pages
from quillhawk.llm.splitting import split_oversized
from quillhawk.llm.sql import oracle_sql  # noqa: F401
from quillhawk.runtime import first_wins, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return first_wins(_table(spark, sf_dir, name), "chunk_id", "id", ["id", *columns])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "pg_text_docs", "content")


def _genre_sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labelled = clean_labels(_records(spark, sf_dir, "pg_audio_docs", "genre"), "genre", _table(spark, sf_dir, "genre_aliases"), "raw_label", "genre", "meaning")
    targets = [Target(r.genre, r.target_share, r.min_rows) for r in _table(spark, sf_dir, "genre_targets").orderBy("genre").collect()]  # a fixed table
    return proportional_sample(labelled.select("id", F.col("meaning").alias("genre")), "id", {"genre": targets}, 0.2)


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the audio records, genres in their target shares."""
    return _genre_sample(spark, sf_dir)[0]


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share reached per genre, and the genres that fell short."""
    return _genre_sample(spark, sf_dir)[1].withColumns({"needed": F.round("needed", 6), "share": F.round("share", 6)})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres with fewer records than their target or floor."""
    return p1_report(spark, sf_dir).where("short").select(F.col("category").alias("genre"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every distinct term of every text record."""
    return term_scores(_texts(spark, sf_dir), "id", "content").drop("p_value").withColumn("score", F.round("score", 2))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of 4 letters and more, 3 times and more in their record, in 2 to 6 records in all."""
    return p2_scores(spark, sf_dir).where("length(term) >= 4 and count >= 3 and records between 2 and 6").select("id", "term")


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return near_duplicates(_texts(spark, sf_dir), "id", "content", similarity=0.5, run=3, least_words=30)


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs of class representatives with their similarity."""
    return _near(spark, sf_dir).links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text record that takes part with its class of copies and its group."""
    return _near(spark, sf_dir).groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of text records whose word-run sets are at least half the same."""
    return _near(spark, sf_dir).pairs().select("id_a", "id_b")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and marks."""
    table, records, _ = ngram_frequencies(_texts(spark, sf_dir), "id", "content", 1)
    return mark_frequencies(table, records).select("term", "occurrences", "records", F.array_join("marks", ",").alias("mark"))


def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-gram of up to three terms with its occurrences and records."""
    table, _, _ = ngram_frequencies(_texts(spark, sf_dir), "id", "content", 3)
    return table.select("n", "term", "occurrences", "records")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    table, records, _ = ngram_frequencies(_texts(spark, sf_dir), "id", "content", 1)
    return mark_frequencies(table, records).select("term", F.explode("marks").alias("mark"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 800 characters of every longer text record."""
    return split_oversized(_texts(spark, sf_dir), "id", "content", 800, 80)


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every split record: no piece over 800 characters, no overlap over 80, and all letters and digits kept."""
    own = F.substring("text", F.col("overlap") + 1, F.length("text"))
    per = p6_pieces(spark, sf_dir).groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("own")))), lambda p: p["own"]), "").alias("whole"),
        (F.max(F.length("text")) <= 800).alias("within_limit"), (F.max("overlap") <= 80).alias("within_overlap"), F.max("stop").alias("chars"), F.min("kind").alias("kind"),
    )  # a record's pieces are as large as the record
    return per.select("id", "chars", "kind", "within_limit", "within_overlap", F.md5(F.regexp_replace("whole", r"[^\p{L}\p{N}]", "")).alias("kept"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over 800 characters, and whether natural boundaries suffice."""
    return p6_pieces(spark, sf_dir).where("piece = 0").select("id", "kind")


def _modalities(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [(m, _records(spark, sf_dir, f"pg_{m}_docs", "embedding")) for m in ("image", "audio")]


def _by_modality(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    named = [df.select(F.lit(m).alias("modality"), "*") for m, df in parts]
    return named[0].unionByName(named[1])


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means clusters with their size and their five most typical records."""
    return _by_modality([(m, similarity_clusters(df, "id", "embedding").typical(5)) for m, df in _modalities(spark, sf_dir)])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records joined to others by steps of at most 0.40, with the smallest id of their cluster."""
    return _by_modality([(m, similarity_clusters(df, "id", "embedding").close(0.40)) for m, df in _modalities(spark, sf_dir)]).select("modality", "cluster_id", "id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of close records with their size and their records nearest to the k-means centre."""
    parts = []
    for m, df in _modalities(spark, sf_dir):
        model = similarity_clusters(df, "id", "embedding")
        joined = stage(model.close(0.40).join(model.cells(), "id"), "clusters")
        size = joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", "id"))  # cut to five before the shuffle
        parts.append((m, joined.withColumn("rank", rank).where("rank <= 5").join(size, "cluster_id").select("cluster_id", "size", "rank", "id", "distance")))
    return _by_modality(parts)


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest records of every record."""
    return _by_modality([(m, all_neighbours(df, "id", "embedding", 5)) for m, df in _modalities(spark, sf_dir)])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of which one is among the five nearest of the other and all five lie within 0.40."""
    near = _by_modality([(m, near_neighbours(df, "id", "embedding", 5)) for m, df in _modalities(spark, sf_dir)])  # the tables reach all that is close
    fifth = F.max(F.when(F.col("rank") == 5, F.col("distance"))).over(Window.partitionBy("modality", "id"))
    rows = near.withColumn("fifth", fifth).where("fifth <= 0.40")
    return rows.select("modality", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact five nearest of every record whose id is divisible by 100, among all records."""
    found = _by_modality([(m, scan_neighbours(df, "id", "embedding", F.col("id") % 100 == 0, 5)) for m, df in _modalities(spark, sf_dir)])
    return found.withColumn("distance", F.round("distance", 8))


def p7_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact five nearest of the divisible ids, however far, that p7_near has."""
    truth = p7_neighbours(spark, sf_dir).select("modality", "id", "neighbour")
    found = p7_near(spark, sf_dir).where("id % 100 = 0").select("modality", "id", "neighbour", F.lit(1).alias("hit"))
    return truth.join(found, ["modality", "id", "neighbour"], "left").groupBy("modality").agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item, with its longest span and the words covered."""
    return leaked_items(_spans(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, leaked items and their share, per task."""
    items = _table(spark, sf_dir, "eval_items").select("item_id", "task")
    leaked = _spans(spark, sf_dir).groupBy("item_id").agg(F.lit(1).alias("hit"))
    return items.join(leaked, "item_id", "left").groupBy("task").agg(F.count(F.lit(1)).alias("items"), F.count("hit").alias("leaked"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("share"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with leaked passages, without them."""
    return clean_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", _spans(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", "category", "lang", _table(spark, sf_dir, "mix_targets"))


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the named sources with their number of uses."""
    return _mix(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached per source."""
    return _mix(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot supply their weight within their repeats."""
    return p9_report(spark, sf_dir).where("short").select("source")


def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the shares of its labels and whether it is spam."""
    return spam_pages(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of keywords, links or tags rather than sentences."""
    return p10_pages(spark, sf_dir).where("spam").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}

