"""Retrieval pipelines as plain objects: index, search, statistics and response envelopes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhawk.functions import media
from quillhawk.functions import text as T
from quillhawk.functions import vector as V
from quillhawk.operators import codebook as cb
from quillhawk.operators import extractors, fulltext, index, search, tfidf
from quillhawk.runtime import put_shared, stage
from quillhawk.sources import files

HITS = "rank int, chunk_id string, score double"


def health() -> dict[str, str]:
    return {"status": "ok"}


def check_request(query: str, k: int) -> None:
    if not query:
        raise ValueError("the query is empty")
    check_k(k)


class TextPipeline:
    """Chunks, codebook and weighted postings of documents; searched by text."""

    def __init__(self, how: tfidf.Preprocess = tfidf.Preprocess(), top_k: int = 200, weighting: str = "log") -> None:
        self.how, self.top_k, self.weighting, self.ready = how, top_k, weighting, False

    def index(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Without any chunk the pipeline stays not ready."""
        self.chunks = stage(T.chunks(df, id_col, text_col), "chunks")
        n = self.chunks.count()
        if not n:
            return
        tf = stage(tfidf.term_frequency(self.chunks, "chunk_id", "content", self.how), "tf")
        self.book = stage(cb.text_codebook(tf, n, self.top_k), "book")
        self.items = stage(cb.text_histogram(tf, self.book, "chunk_id", self.weighting).sortWithinPartitions("idx"), "postings")
        self.size, self.ready = n, True

    def search(self, spark: SparkSession, query: str, k: int = 10) -> DataFrame:
        """(rank, chunk_id, score): the best chunk of each document, of the best 3k chunks."""
        if not self.ready:
            return spark.createDataFrame([], HITS)
        q = spark.createDataFrame([("q", query)], "query_id string, text string")
        weights = cb.text_histogram(tfidf.term_frequency(q, "query_id", "text", self.how), self.book, "query_id", self.weighting)
        hits = search.text_search(weights, self.items, "query_id", "chunk_id", 3 * k)
        return search.first_per_document(hits, "query_id", "chunk_id", F.regexp_extract("chunk_id", "^(.*)_text_", 1), k).select("rank", "chunk_id", "score").orderBy("rank")

    def postings(self, codeword: int) -> DataFrame:
        return self.items.where(F.col("idx") == codeword).select("chunk_id", "weight")

    def statistics(self) -> dict:
        n, dim = (self.size, self.book.count()) if self.ready else (0, 0)
        return {"n_comparisons": n, "vector_dim": dim, "index_mb": round(n * dim * 4 / 1048576, 3), "spimi_blocks": -(-n // 1000)}


class VectorPipeline:
    """Histograms of images or recordings; searched by a histogram."""

    def __init__(self) -> None:
        self.ready = False

    def index(self, df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """Keeps usable vectors; returns the others with the reason (missing, not finite, zero)."""
        rows = df.select(F.col(id_col).alias("chunk_id"), V.as_double(F.col(vector_col)).alias("histogram"))
        v = F.col("histogram")
        reason = (
            F.when(F.col("chunk_id").isNull() | v.isNull() | (F.size(v) == 0), "missing")
            .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
            .when(~F.exists(v, lambda x: x != 0), "zero")
        )
        marked = rows.withColumn("reason", reason)
        self.rows = stage(marked.where("reason is null").drop("reason"), "histograms")
        index.require_unique(self.rows)
        self.ready = self.rows.limit(1).count() > 0
        return marked.where("reason is not null").select("chunk_id", "reason")

    def search(self, spark: SparkSession, query: list[float], k: int = 10) -> DataFrame:
        """(rank, chunk_id, score) with the similarity 1 - d*d/2 as score."""
        if not self.ready:
            return spark.createDataFrame([], HITS)
        q = spark.createDataFrame([("\u0000query", query)], "chunk_id string, histogram array<double>")
        hits = search.vector_search(q, self.rows, "chunk_id", "histogram", k)
        return hits.select("rank", F.col("id").alias("chunk_id"), V.similarity_from_distance(F.col("score")).alias("score")).orderBy("rank")

    def statistics(self) -> dict:
        return index.statistics(self.rows, "histogram").first().asDict() if self.ready else {"n_comparisons": 0, "vector_dim": 0, "index_mb": 0.0}


class WordPipeline(VectorPipeline):
    """From local features of files to searchable histograms of words; the codebook is fitted on a bounded sample of features.

    Subclasses say how files become (doc_id, feature) rows and how word counts become a histogram. Files without any
    feature are left out and named with the reason; without usable files the pipeline stays not ready.
    """

    def __init__(self, words: int = 64, per_file: int = 30, files: int = 5000, seed: int = 42) -> None:
        super().__init__()
        self.words, self.per_file, self.files, self.seed = words, per_file, files, seed

    def features(self, files: DataFrame) -> DataFrame:
        """(doc_id, position, feature) of files."""
        raise NotImplementedError

    def histograms(self, files: DataFrame, features: DataFrame) -> DataFrame:
        """(doc_id, histogram) of the files that have features."""
        words = cb.assign(features, "doc_id", F.col("feature"), self.book)
        counts = cb.word_histogram(words, F.col("doc_id")).select(F.col("item").alias("doc_id"), F.col("cluster").alias("idx"), "weight")
        return cb.dense(counts, "doc_id", self.words)

    def index_files(self, files: DataFrame, metadata: list[str] | None = None) -> DataFrame:
        """Indexes (doc_id, ...) files; ``metadata`` columns come back with results. Returns (doc_id, reason) of those left out."""
        features = stage(self.features(files), "features")
        sample = cb.descriptor_sample(features, "doc_id", F.xxhash64(F.lit(self.seed), "doc_id", "position"), "position", self.per_file, self.files)
        if sample.limit(1).count():
            self.book = stage(cb.centroid_table(cb.kmeans_codebook(sample, "feature", self.words, self.seed), files.sparkSession), "book")
            made = stage(self.histograms(files, features), "made")
            self.index(made, "doc_id", "histogram")
            self.details = stage(files.select(F.col("doc_id").alias("chunk_id"), *(metadata or [])), "details")
        found = features.select("doc_id").distinct()
        return files.select("doc_id").join(found, "doc_id", "left_anti").select("doc_id", F.lit("no features").alias("reason"))

    def search_file(self, spark: SparkSession, query: DataFrame, k: int = 10) -> DataFrame:
        """(rank, chunk_id, score, metadata...) for one query file, given as a table of one row like the indexed ones."""
        check_k(k)
        if not self.ready:
            return spark.createDataFrame([], HITS)
        made = self.histograms(query, stage(self.features(query), "asked")).first()
        if made is None:
            return spark.createDataFrame([], HITS)
        hits = self.search(spark, made.histogram, k)
        return hits.join(F.broadcast(hits.select("chunk_id").join(self.details, "chunk_id")), "chunk_id", "left").select("rank", "chunk_id", "score", *self.details.columns[1:]).orderBy("rank")  # k rows


class AudioPipeline(WordPipeline):
    """Recordings as histograms of acoustic words: WAV bytes (doc_id, content), windows, cepstral frames."""

    def __init__(self, words: int = 64, per_file: int = 10, files: int = 2000, window_seconds: float = 1.0, hop_seconds: float = 0.5, max_seconds: float | None = None, seed: int = 42) -> None:
        super().__init__(words, per_file, files, seed)
        self.window, self.hop, self.max_seconds = window_seconds, hop_seconds, max_seconds

    def features(self, files: DataFrame) -> DataFrame:
        signals = files.select("doc_id", media.clean_audio(media.wav_samples(F.col("content"), self.max_seconds)).alias("signal")).where(F.size("signal") > 0)
        windows = media.audio_windows(signals, "doc_id", "signal", media.SAMPLE_RATE, self.window, self.hop)
        frames = extractors.FrameExtractor().extract(windows)
        return frames.select("doc_id", F.concat_ws("/", "chunk_id", F.col("position").cast("string")).alias("position"), F.col("frame").alias("feature"))

    def search_bytes(self, spark: SparkSession, content: bytes, k: int = 10) -> DataFrame:
        return self.search_file(spark, spark.createDataFrame([("query", bytearray(content))], "doc_id string, content binary"), k)


class ImagePipeline(WordPipeline):
    """Images as histograms of visual words beside colours: RGB pixels (doc_id, height, width, data), patches, descriptors."""

    def __init__(self, words: int = 64, per_file: int = 30, files: int = 5000, detect: Callable = media.grid_descriptors, patch: int = 224, stride: int = 112, seed: int = 42) -> None:
        super().__init__(words, per_file, files, seed)
        self.detect, self.patch, self.stride = detect, patch, stride

    def features(self, files: DataFrame) -> DataFrame:
        corners = media.patch_grid(files.select("doc_id", "width", "height"), "doc_id", "width", "height", self.patch, self.stride)
        patches = files.join(corners, "doc_id").select("doc_id", "patch_index", media.patch_pixels(F.col("height"), F.col("width"), F.col("data"), F.col("x"), F.col("y"), self.patch).alias("data"))
        found = patches.select("doc_id", "patch_index", media.descriptors(F.lit(self.patch), F.lit(self.patch), F.col("data"), self.detect).alias("descriptors"))
        rows = extractors.stacked(found, ["doc_id", "patch_index"], "descriptors", "feature")
        return rows.select("doc_id", F.concat_ws("/", F.col("patch_index").cast("string"), F.col("position").cast("string")).alias("position"), "feature")

    def histograms(self, files: DataFrame, features: DataFrame) -> DataFrame:
        words = super().histograms(files, features)
        colours = files.select("doc_id", media.color_histograms(F.col("height"), F.col("width"), F.col("data")).cast("array<double>").alias("colours"))
        return words.join(colours, "doc_id").select("doc_id", V.l2_normalize(V.weighted_concat(F.col("histogram"), F.col("colours"))).alias("histogram"))

    def search_bytes(self, spark: SparkSession, content: bytes, k: int = 10, name: str = "query.png") -> DataFrame:
        """The bytes of an image file, decoded by Spark's image source from the shared folder."""
        path = put_shared(spark, name, content)
        return self.search_file(spark, files.read_images(spark, [path.rsplit("/", 1)[0]]).select("doc_id", "height", "width", "data"), k)


class LyricsPipeline(TextPipeline):
    """Lyrics by text, with the song of each hit."""

    def index_songs(self, songs: DataFrame) -> None:
        """``songs`` has (track_id, track_name, track_artist, playlist_genre, lyrics_lang, lyrics); only English lyrics count."""
        kept = songs.where("track_id is not null and lyrics_lang = 'en' and lyrics is not null")
        self.songs = stage(song_details(kept), "songs")
        self.index(kept, "track_id", "lyrics")

    def search_lyrics(self, spark: SparkSession, query: str, k: int = 10) -> DataFrame:
        """(rank, track_id, chunk_id, score, title, artist, genre); unknown songs have empty strings."""
        check_k(k)
        hits = self.search(spark, query, k).withColumn("track_id", F.regexp_extract("chunk_id", "^(.*)_text_", 1))
        return with_songs(hits, getattr(self, "songs", None)).orderBy("rank")


def song_details(songs: DataFrame) -> DataFrame:
    """(track_id, title, artist, genre) with empty strings for what is missing."""
    text = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    return songs.select("track_id", text("track_name", "title"), text("track_artist", "artist"), text("playlist_genre", "genre"))


def with_songs(rows: DataFrame, songs: DataFrame | None) -> DataFrame:
    """Rows with a ``track_id`` and their songs; of a hit list, which is small, the songs are looked up by a join."""
    names = ("title", "artist", "genre")
    if songs is None:
        return rows.select("*", *[F.lit("").alias(n) for n in names])
    joined = rows.join(songs, "track_id", "left")
    return joined.select(*rows.columns, *[F.coalesce(n, F.lit("")).alias(n) for n in names])


def check_k(k: int) -> None:
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")


def stateless_search(records: DataFrame, query: list[float], k: int, modality: str) -> dict:
    """The envelope of a search over records that come with the request; k from 1 to 100."""
    check_k(k)
    return envelope(lambda: search.search_records(records, query, k, modality), {"n_comparisons": records.count(), "vector_dim": len(query)})


class FulltextTable:
    """Stored full-text postings of a table and the search surface over them; rows with blank texts are left out."""

    def __init__(self, df: DataFrame, path: str, how: fulltext.Analysis = fulltext.Analysis()) -> None:
        rows = df.where("chunk_id is not null and trim(coalesce(content, '')) <> ''")
        self.how = how
        fulltext.write_postings(fulltext.postings(rows, "chunk_id", "content", how), path)
        self.postings = df.sparkSession.read.parquet(path)
        self.rows = stage(rows.select("chunk_id", F.coalesce(F.nullif("title", F.lit("")), "chunk_id").alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet")), "rows")

    def search(self, query: str, k: int = 10) -> dict:
        """The envelope of the k best rows: chunk_id, title, snippet and score."""
        check_request(query, k)
        top = fulltext.search_postings(self.postings, query, self.how, k).withColumnRenamed("id", "chunk_id")
        shown = lambda: top.join(self.rows, "chunk_id").select("chunk_id", "title", "snippet", "score").orderBy(F.desc("score"), "chunk_id")
        return envelope(shown, {"n_rows": self.rows.count()})


def status(text: TextPipeline, image: VectorPipeline, audio: VectorPipeline) -> dict:
    parts = {"text": text, "image": image, "audio": audio}
    return {f"{name}_{what}": value for name, p in parts.items() for what, value in (("ready", p.ready), ("count", p.statistics()["n_comparisons"]))}


def envelope(run: Callable[[], DataFrame], statistics: dict) -> dict:
    """Results of at most k rows with the statistics and the time taken in milliseconds."""
    began = time.perf_counter()
    results = [r.asDict(recursive=True) for r in run().collect()]  # k rows
    return {"results": results, "stats": {"query_ms": round((time.perf_counter() - began) * 1000, 3), **statistics}}
