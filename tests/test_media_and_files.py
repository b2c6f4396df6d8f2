import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhawk.functions import media
from quillhawk.runtime import first_wins, number_rows
from quillhawk.sources import files, tables


def starts(spark, n, size, step, keep=True):
    return spark.createDataFrame([(n,)], "n int").select(media.positions(F.col("n"), size, step, keep).alias("p")).first().p


def test_positions(spark):
    assert starts(spark, 10, 4, 2) == [0, 2, 4, 6]
    assert starts(spark, 11, 4, 2) == [0, 2, 4, 6, 7]
    assert starts(spark, 11, 4, 2, False) == [0, 2, 4, 6]
    assert starts(spark, 3, 4, 2) == [0]
    with pytest.raises(ValueError):
        media.positions(F.lit(3), 0, 1)


def test_audio_windows(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(10)]), ("b", [1.0]), ("c", None)], "id string, s array<float>")
    rows = media.audio_windows(df, "id", "s", 10, 0.4, 0.2).orderBy("doc_id", "chunk_index").collect()
    assert [(r.start_sample, r.end_second) for r in rows if r.doc_id == "a"] == [(0, 0.4), (2, 0.6), (4, 0.8), (6, 1.0)]
    assert [(r.content, r.padded) for r in rows if r.doc_id == "b"] == [([1.0, 0.0, 0.0, 0.0], True)]


def test_patch_grid(spark):
    df = spark.createDataFrame([("i", 4, 4), ("s", 1, 1)], "id string, w int, h int")
    rows = media.patch_grid(df, "id", "w", "h", 2, 2).orderBy("id", "patch_index").collect()
    assert [(r.x, r.y) for r in rows if r.id == "i"] == [(0, 0), (2, 0), (0, 2), (2, 2)]
    assert [r.padded for r in rows if r.id == "s"] == [True]
    assert media.cut_patch(np.ones((1, 1, 3), np.uint8), 0, 0, 2).sum() == 3


def test_mfcc():
    t = np.arange(22050) / 22050
    low, high = (media.mfcc(np.sin(2 * np.pi * f * t)) for f in (440, 880))
    assert low.shape == (44, 20)
    assert np.linalg.norm(low.mean(0) - high.mean(0)) > 1
    assert media.mfcc(np.zeros(100)).shape == (0, 20)
    assert media.mfcc(None).shape == (0, 20)
    with pytest.raises(ValueError):
        media.mfcc(t, n_mfcc=0)
    assert len(media.mfcc_names()) == 40


def test_frame_statistics(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 2.0]],), ([],)], "f array<array<float>>")
    got = [r.s for r in df.select(media.frame_statistics(F.col("f"), 2).alias("s")).collect()]
    assert got == [[2.0, 2.0, 1.0, 0.0], [0.0] * 4]


def test_colour():
    red = np.zeros((32, 32, 3), np.uint8)
    red[..., 0] = 255
    h = media.hsv_histogram(red)
    assert h.shape == (16,)
    assert np.linalg.norm(h) == pytest.approx(1)
    assert h[0] == h[15] > 0
    assert media.hsv_histogram(np.full((32, 32, 3), 255, np.uint8))[12] > 0
    assert media.grey(np.zeros((2, 2, 1), np.uint8)).shape == (2, 2)


def wav_bytes(samples, rate=22050):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "doc1.txt").write_text("uno\n\ndos")
    (tmp_path / "t" / "sub").mkdir()
    (tmp_path / "t" / "sub" / "x.txt").write_text("below")
    assert [(r.doc_id, r.text) for r in files.read_texts(spark, [str(tmp_path / "t")]).collect()] == [("doc1", "uno\n\ndos")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.wav").write_bytes(wav_bytes([0.0, 0.5, -0.5], 22050))
    (tmp_path / "a" / "bad.wav").write_bytes(b"no")
    rows = {r.doc_id: r.audio for r in files.read_audio(spark, [str(tmp_path / "a")]).collect()}
    assert [round(x, 2) for x in rows["x"]] == [0.0, 0.5, -0.5]
    assert rows["bad"] is None
    with pytest.raises(ValueError):
        files.read_pages(spark.createDataFrame([], "doc_id string, content binary"), None)
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("e", 1, " ")], "doc_id string, page int, text string")
    assert [(r.doc_id, r.text) for r in files.page_query(pages).collect()] == [("d", "a\nb")]


def test_blocks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, [("a", 2.0)]), (1, 1, [("b", 1.0)])], "block_id bigint, codeword int, postings array<struct<chunk_id: string, frequency: double>>")
    tables.write_blocks(rows, str(tmp_path / "b"))
    back = files.read_blocks(spark, str(tmp_path / "b"))
    assert sorted((r.block_id, r.codeword, r.postings[0].chunk_id) for r in back.collect()) == [(0, 1, "a"), (1, 1, "b")]


def test_first_wins(spark, tmp_path):
    rows = [(2, "a", "late"), (1, "a", "first"), (3, "b", "only"), (3, "b", "only"), (4, None, "none"), (None, "c", "none")]
    df = spark.createDataFrame(rows, "id bigint, chunk_id string, keep string")
    assert sorted(tuple(r) for r in first_wins(df, "chunk_id", "id", ["id", "keep"]).collect()) == [(1, "first"), (3, "only")]
    assert first_wins(df.limit(0), "chunk_id", "id", ["id"]).count() == 0
    assert tables.full_refresh(df, str(tmp_path / "t")) == 2


def test_tables(spark):
    assert tables.empty_table(spark, "pg_text_docs").count() == 0
    df = spark.createDataFrame([("x", 1), ("x", 2)], "id string, n int")
    assert sorted(r.id for r in tables.unique_ids(df, "id", "n").collect()) == ["x", "x__dup1_2"]
    assert tables.merge_by_key(df, spark.createDataFrame([("x", 9)], "id string, n int"), "id").collect()[0].n == 9


def test_number_rows(spark):
    rows = number_rows(spark.range(100).select((99 - F.col("id")).alias("k")), ["k"], "n").collect()
    assert all(r.k == r.n for r in rows)


def test_stream_of_records(spark, tmp_path):
    from quillhawk.streaming.incremental import index_stream

    schema = "chunk_id string, modality string, histogram array<double>, metadata map<string,string>"
    spark.createDataFrame([("a", "text", [1.0, 0.0], {}), ("b", "bad", [1.0], {})], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.codeword, r.chunk_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, "a")]
