"""Scans of text, image, audio, manifest, song and index files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillhawk.functions.media import wav_samples
from quillhawk.functions.text import file_stem

TEXT_KINDS, IMAGE_KINDS, AUDIO_KINDS = ("txt", "md", "pdf"), ("jpg", "jpeg", "png", "webp"), ("wav", "mp3", "flac", "ogg", "m4a")
SONG_SCHEMA = (
    "track_id string, track_name string, track_artist string, lyrics string, language string, playlist_genre string, playlist_subgenre string, danceability double, energy double, "
    "pitch_key int, loudness double, scale_mode int, speechiness double, acousticness double, instrumentalness double, liveness double, valence double, tempo double, duration_ms bigint"
)


def _placed(df: DataFrame, dirs: list[str], limit: int | None) -> DataFrame:
    """Files in the order of their directories, then by path, to ``limit`` (None or 0: all)."""
    rank = F.coalesce(*[F.when(F.col("path").contains("/" + d.strip("/") + "/"), F.lit(i)) for i, d in enumerate(dirs)], F.lit(len(dirs)))
    ordered = df.withColumn("dir_rank", rank)
    return ordered.orderBy("dir_rank", "path").limit(limit) if limit else ordered


def read_texts(spark: SparkSession, dirs: list[str], max_files: int | None = None, glob: str = "*.{txt,md}") -> DataFrame:
    """(path, doc_id, text, dir_rank): whole UTF-8 files of the directories, not of their subdirectories."""
    raw = spark.read.option("pathGlobFilter", glob).text(dirs, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _placed(raw.select("path", file_stem(F.col("path")).alias("doc_id"), "text"), dirs, max_files)


def read_document(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(doc_id, page, text) of one file: text and Markdown as page 1, paged documents by ``decode``.

    A missing file is a ``FileNotFoundError``, a file of another kind a ``ValueError``.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in ("txt", "md"):
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        return text.select(file_stem(F.col("path")).alias("doc_id"), F.lit(1).alias("page"), F.col("value").alias("text"))
    if kind == "pdf":
        raw = spark.read.format("binaryFile").load(path)
        return read_pages(raw.select(file_stem(F.col("path")).alias("doc_id"), "content"), decode)
    raise ValueError(f"files of kind {kind!r} are not read")


def read_binaries(spark: SparkSession, dirs: list[str], kinds: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """(path, doc_id, content, dir_rank) of the directories and all below them, by extension in any case."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(dirs)
    raw = raw.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*kinds))
    return _placed(raw.select("path", file_stem(F.col("path")).alias("doc_id"), "content"), dirs, limit)


def read_images(spark: SparkSession, dirs: list[str], limit: int | None = None) -> DataFrame:
    """(path, doc_id, height, width, data, dir_rank): RGB bytes of the images that Spark's image source can decode."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(dirs).select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"))

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        def one(b, c):
            x = np.frombuffer(b, dtype=np.uint8).reshape(-1, c)
            return (x[:, [2, 1, 0]] if c >= 3 else np.repeat(x[:, :1], 3, axis=1)).tobytes()

        return pd.Series([one(b, c) for b, c in zip(data, channels)])

    return _placed(raw.select("path", file_stem(F.col("path")).alias("doc_id"), "height", "width", rgb("bgr", "channels").alias("data")), dirs, limit)


def read_audio(spark: SparkSession, dirs: list[str], limit: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """(path, doc_id, audio): mono samples at 22,050 Hz of PCM WAV files; other codecs give null and need a decoder of their own."""
    return read_binaries(spark, dirs, AUDIO_KINDS, limit).select("path", "doc_id", wav_samples(F.col("content"), max_seconds).alias("audio"), "dir_rank")


def read_pages(files: DataFrame, decode: Callable[[bytes], list[str]] | None) -> DataFrame:
    """(doc_id, page, text) of paged documents, by a decoder that returns the pages of a file's bytes."""
    if decode is None:
        raise ValueError("no decoder for paged documents is installed; pass one, or start from a (doc_id, page, text) table")

    @F.pandas_udf("array<string>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(decode)

    return files.select("doc_id", F.posexplode(run("content")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def page_chunks(chunks: DataFrame) -> DataFrame:
    """Renumbers the chunks of pages (doc_id, page, chunk_index, ...) over their document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "chunk_index")) - 1
    out = chunks.withColumn("chunk_index", n)
    return out.withColumn("chunk_id", F.concat("doc_id", F.lit("_text_"), F.col("chunk_index").cast("string")))


def page_query(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each query document joined by line feeds; blank ones are left out."""
    joined = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return joined.where(F.trim("text") != "")


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SONG_SCHEMA)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, codeword, postings) of block files: JSON objects keyed by codeword."""
    raw = spark.read.schema("block_id bigint, postings map<string, array<struct<chunk_id: string, frequency: double>>>").json(path)
    return raw.select("block_id", F.explode("postings").alias("codeword", "postings")).withColumn("codeword", F.col("codeword").cast("int"))
