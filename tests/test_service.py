import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhawk.functions import media
from quillhawk.plans import service


def test_text_pipeline(spark):
    p = service.TextPipeline(top_k=50)
    assert p.search(spark, "anything").count() == 0
    docs = [("d1", "The cat sat on the mat and looked at the other cat again."), ("d2", "A dog ran through the park and met another dog at the gate."), ("d3", None)]
    p.index(spark.createDataFrame(docs, "id string, t string"), "id", "t")
    out = service.envelope(lambda: p.search(spark, "dog park", 5), p.statistics())
    assert [r["chunk_id"] for r in out["results"]] == ["d2_text_0"]
    assert out["stats"]["n_comparisons"] == 2 and out["stats"]["spimi_blocks"] == 1
    assert p.postings(0).count() >= 1


def test_vector_pipeline(spark):
    p = service.VectorPipeline()
    assert p.statistics()["n_comparisons"] == 0 and p.search(spark, [1.0]).count() == 0
    rows = [("exact", [1.0, 0.0]), ("near", [0.8, 0.6]), ("zero", [0.0, 0.0]), ("bad", [float("nan"), 1.0]), ("none", None)]
    rest = p.index(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v")
    assert {r.chunk_id: r.reason for r in rest.collect()} == {"zero": "zero", "bad": "not finite", "none": "missing"}
    assert [(r.chunk_id, r.score) for r in p.search(spark, [1.0, 0.0], 2).collect()] == [("exact", 1.0), ("near", 0.8)]
    empty = service.VectorPipeline()
    assert service.status(service.TextPipeline(), p, empty) == {"text_ready": False, "text_count": 0, "image_ready": True, "image_count": 2, "audio_ready": False, "audio_count": 0}
    with pytest.raises(ValueError, match="more than once"):
        service.VectorPipeline().index(spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "id string, v array<double>"), "id", "v")


def test_requests():
    for bad in (("", 5), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            service.check_request(*bad)
    assert service.health() == {"status": "ok"}


def test_descriptors(spark):
    df = spark.createDataFrame([(2, 2, bytes(range(12))), (2, 2, None)], "h int, w int, d binary")
    got = df.select(media.descriptors(F.col("h"), F.col("w"), F.col("d"), lambda g: np.full((1, 4), 1.0)).alias("x")).collect()
    assert got[0].x[0] == pytest.approx([0.5] * 4, abs=1e-4) and got[1].x == []
    with pytest.raises(ValueError, match="detector"):
        media.descriptors(F.col("h"), F.col("w"), F.col("d"), None)
