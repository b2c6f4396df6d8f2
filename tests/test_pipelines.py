import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhawk.functions import media
from quillhawk.operators import evaluate, extractors, fulltext, index, tabular, tfidf
from quillhawk.plans import service
from quillhawk.sources import files, tables


def tone(f, seconds=2.0):
    t = np.arange(int(media.SAMPLE_RATE * seconds)) / media.SAMPLE_RATE
    return media.encode_wav(0.5 * np.sin(2 * np.pi * f * t))


def stripes(period, tint):
    i, j = np.indices((240, 240))
    on = ((i + 2 * j) // period) % 2
    out = np.zeros((240, 240, 3), np.uint8)
    out[..., tint] = 60 + 150 * on
    out[..., (tint + 1) % 3] = 30
    return out


def png(rgb):
    rows = b"".join(b"\x00" + r.tobytes() for r in rgb)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_audio_bytes_to_results(spark):
    rows = [(f"low{i}", bytearray(tone(200 + 3 * i)), "low") for i in range(3)] + [(f"high{i}", bytearray(tone(3000 + 40 * i)), "high") for i in range(3)]
    rows += [("broken", bytearray(b"RIFFnothing"), "x"), ("empty", None, "x"), ("short", bytearray(tone(300, 0.0)), "x")]
    df = spark.createDataFrame(rows, "doc_id string, content binary, genre string")
    p = service.AudioPipeline(words=6)
    assert p.search_bytes(spark, tone(200)).count() == 0
    left = p.index_files(df, ["genre"])
    assert {r.doc_id for r in left.collect()} == {"broken", "empty", "short"}
    hits = p.search_bytes(spark, tone(201), 3).collect()
    assert [r["rank"] for r in hits] == [1, 2, 3] and {r.genre for r in hits} == {"low"}
    assert hits[0].score > 0.9
    assert {r.genre for r in p.search_bytes(spark, tone(3020), 3).collect()} == {"high"}
    assert p.search_bytes(spark, b"no sound").count() == 0
    with pytest.raises(ValueError):
        p.search_bytes(spark, tone(201), 101)
    none = service.AudioPipeline()
    none.index_files(df.where("genre = 'x'"))
    assert not none.ready and none.search_bytes(spark, tone(201)).count() == 0


def test_image_bytes_to_results(spark):
    rows = [(f"{'rgb'[t]}{p}", 240, 240, bytearray(stripes(p, t).tobytes())) for t in range(3) for p in (12, 40)]
    flat = np.full((240, 240, 3), 9, np.uint8)
    rows.append(("flat", 240, 240, bytearray(flat.tobytes())))
    df = spark.createDataFrame(rows, "doc_id string, height int, width int, data binary")
    p = service.ImagePipeline(words=8)
    assert {r.doc_id for r in p.index_files(df).collect()} == {"flat"}
    hits = p.search_bytes(spark, png(stripes(12, 0)), 2).collect()
    assert hits[0].chunk_id == "r12" and hits[0].score > 0.95
    assert p.search_bytes(spark, png(stripes(40, 2)), 1).first().chunk_id == "b40"
    assert p.search_bytes(spark, png(flat), 2).count() == 0


def test_features_of_descriptors_and_frames(spark):
    assert media.grid_descriptors(np.zeros((40, 40))).shape == (0, 128)
    found = media.grid_descriptors(np.add.outer(np.arange(48), np.arange(32)).astype(float))
    assert found.shape == (6, 128) and (found >= 0).all()
    df = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", []), ("c", None)], "doc_id string, d array<array<float>>")
    assert [(r.doc_id, r.position, r.x) for r in extractors.stacked(df, ["doc_id"], "d", "x").collect()] == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])]


def test_extractor_interface(spark):
    df = spark.createDataFrame([("a", "red hat"), ("b", "red coat"), ("c", None)], "id string, t string")
    e = extractors.TfidfExtractor("id", "t")
    with pytest.raises(ValueError):
        e.transform(df)
    rows = e.fit_transform(df).collect()
    assert {(r.id, r.term) for r in rows} == {("a", "red"), ("a", "hat"), ("b", "red"), ("b", "coat")}
    assert e.feature_names() == ["coat", "hat", "red"]
    assert extractors.FrameExtractor().fit(df) is not None
    with pytest.raises(TypeError):
        extractors.Extractor()


def test_lyrics(spark):
    songs = spark.createDataFrame(
        [("t1", "Blue", "Ann", "pop", "en", "The river runs under the silver bridge and the river sings to me at night."), ("t2", None, None, None, "en", "A mountain of stones was standing over the valley and nobody climbed it."), ("t3", "x", "y", "z", "es", "la luna"), ("t4", "n", "n", "n", "en", None)],
        "track_id string, track_name string, track_artist string, playlist_genre string, lyrics_lang string, lyrics string",
    )
    p = service.LyricsPipeline(top_k=50)
    assert p.search_lyrics(spark, "river").count() == 0
    p.index_songs(songs)
    hit = p.search_lyrics(spark, "silver river", 5).first()
    assert (hit.track_id, hit.title, hit.artist, hit.genre) == ("t1", "Blue", "Ann", "pop")
    hit = p.search_lyrics(spark, "mountain stones", 5).first()
    assert (hit.track_id, hit.title, hit.artist) == ("t2", "", "")


def test_stored_fulltext(spark, tmp_path):
    rows = [("a", "Title", "s", "The red cats were running"), ("b", None, None, "A cat runs. Red dog"), ("c", "", "x", "   "), ("d", "D", "d", None), ("e", "E", "e", "the the the")]
    df = spark.createDataFrame(rows, "chunk_id string, title string, snippet string, content string")
    how = fulltext.Analysis(stop=("the", "a", "were"), stem_language="english")
    t = service.FulltextTable(df, str(tmp_path / "p"), how)
    out = t.search("running cat", 5)
    assert {r["chunk_id"] for r in out["results"]} == {"a", "b"} and out["stats"]["n_rows"] == 3
    assert {r["chunk_id"]: r["title"] for r in out["results"]} == {"a": "Title", "b": "b"}
    stored = {(r.term, r.id): (r.positions, r.terms) for r in t.postings.collect()}
    assert stored["cat", "a"] == ([2], 5) and ("the", "a") not in stored
    web = {r.id: r.web for r in fulltext.search_postings(t.postings, '"red cats" or "cats were running"', how).collect()}
    assert web["a"] is True and not web.get("b")
    assert fulltext.search_postings(t.postings, "the", how).count() == 0
    assert fulltext.search_postings(t.postings, "-red", how).where("web").count() == 0
    with pytest.raises(ValueError):
        t.search("", 5)


def test_documents_by_kind(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hé\nline", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "c.doc").write_text("x")
    assert [tuple(r) for r in files.read_document(spark, str(tmp_path / "a.md")).collect()] == [("a", 1, "# hé\nline")]
    pages = files.read_document(spark, str(tmp_path / "b.pdf"), lambda b: bytes(b).decode().split("\f")).orderBy("page").collect()
    assert [(r.page, r.text) for r in pages] == [(1, "one"), (2, "two")]
    with pytest.raises(FileNotFoundError):
        files.read_document(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError, match="doc"):
        files.read_document(spark, str(tmp_path / "c.doc"))


def test_small_repairs(spark):
    df = spark.createDataFrame([("i", 4, 4), ("s", 1, 1)], "id string, w int, h int")
    assert {r.id for r in media.patch_grid(df, "id", "w", "h", 2, 2, keep_borders=False).collect()} == {"i"}
    px = spark.createDataFrame([(1, 1, bytearray(b"\x01\x02\x03")), (1, 1, None)], "h int, w int, d binary")
    got = [r.p for r in px.select(media.patch_pixels(F.col("h"), F.col("w"), F.col("d"), F.lit(0), F.lit(0), 2).alias("p")).collect()]
    assert bytes(got[0]) == b"\x01\x02\x03" + b"\x00" * 9 and got[1] is None
    channels = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0, 9.0]],), (None,), ([],)], "c array<array<float>>")
    assert [r.m for r in channels.select(media.mixed_channels(F.col("c")).alias("m")).collect()] == [[2.0, 4.0], [], []]
    ids = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q")], "chunk_id string, n int, stem string")
    assert sorted(r.chunk_id for r in tables.unique_ids(ids, "chunk_id", "n", "stem").collect()) == ["x", "x__dup1_q"]
    same = spark.range(2).select(media.noise(F.lit(7), 50).alias("x")).collect()
    assert same[0].x == same[1].x and min(same[0].x) < -0.2 and max(same[0].x) > 0.2 and len(set(same[0].x)) == 50
    assert "indexed_at" in tables.empty_table(spark, "pg_text_docs").columns
    song = spark.createDataFrame([("t", 120.126, 0.12345)], "id string, tempo double, energy double")
    assert tuple(tabular.metadata(song, "id", ("tempo", "energy")).first()) == ("t", 120.1, 0.123)


def test_index_build_and_accessors(spark, tmp_path):
    records = spark.createDataFrame([("b", "text", [1.0, 0.0], {"k": "v"}), ("a", "text", [2.0, 3.0], {})], "chunk_id string, modality string, histogram array<double>, metadata map<string,string>")
    path = str(tmp_path / "index")
    assert index.build(records, path, 1) == 2
    found = index.Index(records, path)
    assert len(found) == 2 and found.postings(0) == [("a", 2.0), ("b", 1.0)] and found.postings(9) == []
    assert found.histogram("a") == [2.0, 3.0] and found.metadata("b") == {"k": "v"} and found.metadata("zz") == {}
    with pytest.raises(KeyError):
        found.histogram("zz")
    with pytest.raises(ValueError):
        index.build(records.union(records), path)


def test_stateless_search(spark):
    records = spark.createDataFrame([("a", "image", [1.0, 0.0], {}), ("b", "image", [0.0, 1.0], {"k": "v"})], "chunk_id string, modality string, histogram array<double>, metadata map<string,string>")
    out = service.stateless_search(records, [0.0, 1.0], 1, "image")
    assert [(r["chunk_id"], r["score"], r["metadata"]) for r in out["results"]] == [("b", 0.0, {"k": "v"})] and out["stats"]["vector_dim"] == 2
    for k in (0, 101):
        with pytest.raises(ValueError):
            service.stateless_search(records, [0.0, 1.0], k, "image")


def test_evaluation_helpers(spark):
    df = spark.createDataFrame([(i, "x" * 300 if i % 2 else " ", "one") for i in range(60)], "id int, t string, label string")
    asked = evaluate.asked_texts(df, "id", "t").collect()
    assert [r.query_id for r in asked] == list(range(1, 20, 2)) and {len(r.text) for r in asked} == {200}
    lone = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, label string")
    assert evaluate.eligible(lone, "label").count() == 3  # none is eligible: all stay
    assert evaluate.eligible(lone.union(spark.createDataFrame([(4, "a"), (5, "unknown"), (6, "unknown")], lone.schema)), "label").count() == 2
    out, figures = evaluate.measured(spark, lambda: df.count())
    assert out == 60 and figures["seconds"] >= 0 and figures["peak_mb"] > 0
    per = spark.createDataFrame([(1, 1, 1, 1, 0.5, 0.5)], "query_id int, tp int, fp int, fn int, precision double, recall double")
    assert [(r["size"], r.precision) for r in evaluate.codebook_sweep(spark, [4, 8], lambda n: per).collect()] == [(4, 0.5), (8, 0.5)]


def test_quantiles_and_quotas_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [("g%d" % (i % 3), float(v)) for i, v in enumerate(np.concatenate([rng.exponential(size=400), np.full(100, 2.0)]))] + [("one", 5.0), (None, 1.0), (None, 3.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.p95_ms for r in evaluate.latency(df, "v", "g").collect()}
    for g in {g for g, _ in rows}:
        values = [v for h, v in rows if h == g and v is not None]
        assert got[g] == (pytest.approx(np.quantile(values, 0.95), abs=1e-6) if values else None)
    numbered = spark.createDataFrame([(i, "a" if i < 900 else "b", (i * 37) % 101) for i in range(1000)], "id int, label string, o int")
    taken = evaluate.balanced_sample(numbered, "label", 101, "o", "id").collect()
    for label, n in (("a", 51), ("b", 50)):
        want = sorted((r for r in numbered.collect() if r.label == label), key=lambda r: (r.o, r.id))[:n]
        assert sorted(r.id for r in taken if r.label == label) == sorted(r.id for r in want)


def test_minibatch_codebook(spark):
    from quillhawk.operators import codebook as cb

    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.1 * rng.normal(size=(200, 4)) for c in (np.zeros(4), np.full(4, 5.0), np.full(4, -5.0))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, v array<double>")
    centres = cb.kmeans_codebook(df, "v", 12, minibatch=True, batch_rows=128, max_iter=10)
    assert centres.shape == (12, 4)
    assert cb.assign(df, "id", F.col("v"), cb.centroid_table(centres, spark)).agg(F.avg("distance")).first()[0] < 2
    again = cb.kmeans_codebook(df, "v", 3, tol=1e-3, initSteps=3)
    assert len(again.clusterCenters()) == 3
