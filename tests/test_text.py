import pytest
from pyspark.sql import functions as F

from quillhawk.functions import text as T
from quillhawk.functions.stem import stem, stem_english, stem_spanish
from quillhawk.operators import codebook as cb
from quillhawk.operators import tfidf


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "clean"), [(None, ""), ("a\r\nb\rc", "a\nb\nc"), ("•\n  uno", "• uno"), ("top-\n k", "top-k"), ("a \t b", "a b"), ("  x \n", "x"), ("", "")])
def test_clean(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


def test_two_paragraphs_give_two_chunks(spark):
    df = spark.createDataFrame([("doc1", "first paragraph.\n\nsecond paragraph."), ("none", None)], "id string, text string")
    rows = T.chunks(df, "id", "text", 0, 200).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.chunk_index, r.num_chars, r.content) for r in rows] == [("doc1_text_0", 0, 16, "first paragraph."), ("doc1_text_1", 1, 17, "second paragraph.")]


def test_packing_and_cutting(spark):
    assert one(spark, "aaaa. bbbb. cccc.", lambda c: T.split_large(c, 11)) == ["aaaa. bbbb.", "cccc."]
    assert one(spark, "aa. " + "x" * 25 + ". bb.", lambda c: T.split_large(c, 10)) == ["aa.", "x" * 10, "x" * 10, "x" * 5 + ".", "bb."]
    assert one(spark, "short", lambda c: T.split_large(c, 10)) == ["short"]


def test_tokens(spark):
    assert one(spark, "Top-K don't FUSS 123 año", lambda c: T.tokens(c)) == ["topk", "dont", "fuss", "año"]
    assert one(spark, "the a of", lambda c: T.tokens(c, ["the", "of"])) == []
    assert one(spark, None, lambda c: T.tokens(c)) == []


def test_names(spark):
    assert one(spark, "a b/c..", T.safe_name) == "a_b_c"
    assert one(spark, "...", T.safe_name) == "unknown"
    assert one(spark, "Hola, ¿k?", T.or_query) == "hola | k"
    assert one(spark, "¿?", T.or_query) == "emptyqueryterm"
    assert one(spark, "/x/y/a.b.txt", T.file_stem) == "a.b"
    assert one(spark, "a b/c.mp3", lambda c: T.static_url("/audio", c)) == "/audio/a%20b/c.mp3"
    assert one(spark, "/old/data/full/x.txt", T.repaired_path) == "data/full/x.txt"


def test_title_and_snippet(spark):
    title = lambda c: T.title_of(c, F.lit("stem"))
    assert one(spark, "\nA first line here\nrest", title) == "A first line here"
    assert one(spark, "short\nrest", title) == "stem"
    assert one(spark, "A first line here\nrest\nmore", lambda c: T.snippet_of(c, title(c))) == "rest more"
    assert one(spark, "A first line here", lambda c: T.snippet_of(c, title(c))) == "A first line here"


@pytest.mark.parametrize(("word", "want"), [("consigned", "consign"), ("kneeling", "kneel"), ("generously", "generous"), ("hoping", "hope"), ("hopping", "hop"), ("cries", "cri"), ("happily", "happili"), ("skies", "sky")])
def test_english_stems(word, want):
    assert stem_english(word) == want


def test_spanish_stems():
    assert stem_spanish("datos") == stem_spanish("dato")
    assert stem_spanish("rápidamente") == "rapid"
    assert stem("libros", "klingon") == "libros"


CORPUS = [("a", "base base datos"), ("b", "datos datos busqueda busqueda"), ("c", ""), ("d", None)]


def test_term_maps_keep_empty_items(spark):
    df = spark.createDataFrame(CORPUS, "id string, text string")
    rows = {r.id: r.tf for r in tfidf.term_maps(df, tfidf.term_frequency(df, "id", "text"), "id").collect()}
    assert rows == {"a": {"base": 2, "datos": 1}, "b": {"datos": 2, "busqueda": 2}, "c": {}, "d": {}}


def test_codebook_counts_items_and_breaks_ties_by_term(spark):
    df = spark.createDataFrame(CORPUS, "id string, text string")
    book = cb.text_codebook(tfidf.term_frequency(df, "id", "text"), 2, 2).orderBy("idx").collect()
    assert [(r.term, r.idx, r.df) for r in book] == [("datos", 0, 2), ("base", 1, 1)]
    assert book[0].idf == 1.0
    assert book[1].idf >= 1


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame(CORPUS, "id string, text string")
    tf = tfidf.term_frequency(df, "id", "text")
    for top in (None, 2):
        model = tfidf.fit_tfidf(tf, 4, "id", top)
        norms = model.transform(tf, "id").groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
        assert {r.id for r in norms} == {"a", "b"}
        assert all(abs(r.n - 1) < 1e-9 for r in norms)
    with pytest.raises(ValueError, match="empty"):
        tfidf.fit_tfidf(tf, 0, "id")


def test_tf_weight(spark):
    row = spark.createDataFrame([(0,), (1,), (5,)], "c int").select(tfidf.tf_weight(F.col("c")).alias("w")).collect()
    assert [round(r.w, 6) for r in row] == [0.0, 1.0, 2.609438]


def test_stems_of_all_languages(spark, tmp_path):
    from quillhawk.plans.text_queries import stem_tokens_languages

    rows = [(1, "en", "running houses"), (2, "ES-mx", "casas"), (3, "fr", "les maisons"), (4, "de", "und katzen"), (5, None, "the running"), (6, "xx", "running")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.stem) for r in stem_tokens_languages(spark, str(tmp_path)).collect())
    assert got == [(1, "hous"), (1, "run"), (2, "cas"), (3, "maisons"), (4, "katz"), (5, "running"), (5, "the"), (6, "running")]


def test_file_ids_and_urls(spark):
    paths = ["x/data/full/a b/c.d.wav", "data/samples/audio/t.wav", "other/dir/n.wav", "n", "data/.hidden"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: (r.i, r.u) for r in df.select("p", T.file_id(F.col("p")).alias("i"), T.media_url(F.col("p"), {"data/samples/audio": "/s", "data/full": "/f"}).alias("u")).collect()}
    assert got == {"x/data/full/a b/c.d.wav": ("full_a b_c.d", "/f/a%20b/c.d.wav"), "data/samples/audio/t.wav": ("samples_audio_t", "/s/t.wav"), "other/dir/n.wav": ("dir_n", ""), "n": ("n", ""), "data/.hidden": (".hidden", "")}


def test_german_stems():
    from quillhawk.functions.stem import stem

    known = {"häuser": "haus", "bedeutungen": "bedeut", "aufeinander": "aufeinand", "kategorien": "kategori", "freundlichkeit": "freundlich", "ergebnisse": "ergebnis", "größer": "gross", "jahre": "jahr", "reinheit": "reinheit", "neuigkeit": "neuig", "ei": "ei", "": ""}
    assert {w: stem(w, "german") for w in known} == known


def test_counts_drop_stop_words_and_join_stems(spark):
    df = spark.createDataFrame([(1, "The running runs and the run"), (2, None)], "id int, term string")
    how = tfidf.Preprocess(language="english", stem=True)
    assert [tuple(r) for r in tfidf.term_frequency(df, "id", "term", how).collect()] == [(1, "run", 3)]
