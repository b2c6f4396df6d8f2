from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhawk.functions import vector as V
from quillhawk.operators import ann
from quillhawk.operators import codebook as cb
from quillhawk.operators import evaluate, fulltext, index, search, tabular

PAIR = "a array<double>, b array<double>"
RECORD = "chunk_id string, modality string, histogram array<double>, metadata map<string,string>"


def pair(spark, a, b, f):
    return spark.createDataFrame([(a, b)], PAIR).select(f(F.col("a"), F.col("b")).alias("x")).first().x


def test_metrics(spark):
    assert pair(spark, [1.0, 0.0], [1.0, 1.0], V.cosine) == pytest.approx(0.70710678)
    assert pair(spark, [0.0, 0.0], [1.0, 1.0], V.cosine) == 0.0
    assert pair(spark, [1.0, 2.0], [4.0, 6.0], V.l2_distance) == 5.0
    assert pair(spark, [3.0, 4.0], [0.0, 0.0], lambda a, b: V.l2_normalize(a)) == [0.6, 0.8]
    assert pair(spark, [3.0, 4.0], [0.0, 0.0], lambda a, b: V.l2_normalize(b)) == [0.0, 0.0]
    assert pair(spark, [0.1, 2.0], [], lambda a, b: V.vector_literal(a)) == "[0.100000,2.000000]"
    with pytest.raises(Exception, match="same length"):
        pair(spark, [1.0, 2.0], [1.0, 2.0, 3.0], V.l2_distance)


def rec(i, v, modality="text"):
    return (i, modality, v, {})


def test_validation(spark):
    bad = [(None, "text", [1.0], {}), ("a", "video", [1.0], {}), ("b", "text", [], {}), ("c", "text", [float("nan")], {}), ("d", "text", [1.0, None], {}), ("e", "text", [1.0], None)]
    df = spark.createDataFrame([*bad, rec("ok", [1.0, 0.0])], RECORD)
    good, rest = index.split_records(df)
    assert [r.chunk_id for r in good.collect()] == ["ok"]
    assert sorted(r.problem for r in rest.collect()) == ["histogram", "id", "metadata", "modality", "not finite", "not finite"]
    with pytest.raises(ValueError, match="modality"):
        index.require_modality(df, "text")
    with pytest.raises(ValueError, match="more than once"):
        index.require_unique(spark.createDataFrame([rec("x", [1.0]), rec("x", [2.0])], RECORD))


def test_postings_and_candidates(spark):
    df = spark.createDataFrame([rec("a", [1.0, 0.0, 0.0]), rec("b", [0.0, 2.0, 0.0]), rec("c", [0.0, 0.0, 3.0]), rec("n", [-1.0, 0.0, 0.0])], RECORD)
    posts = index.postings(df)
    assert sorted((r.codeword, r.chunk_id) for r in posts.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert index.clustered(posts).count() == 3
    items = posts.select("chunk_id", F.col("codeword").alias("idx"), F.col("frequency").alias("weight"))
    query = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 1.0), ("q", 2, 0.0)], "query string, idx int, weight double")
    assert sorted(r.chunk_id for r in search.candidates(query, items, "query", "chunk_id").collect()) == ["a", "b"]


def test_blocks_and_merge(spark):
    df = spark.createDataFrame([rec("b", [1.0, 0.0]), rec("a", [2.0, 3.0]), rec("c", [0.0, 0.0])], RECORD)
    blocked = index.blocks(df, 1)
    assert sorted((r.block_id, r.codeword) for r in blocked.collect()) == [(0, 0), (0, 1), (1, 0)]
    assert [(r.codeword, r.chunk_id, r.frequency) for r in index.merge_blocks(blocked).collect()] == [(0, "a", 2.0), (0, "b", 1.0), (1, "a", 3.0)]
    with pytest.raises(ValueError, match="positive"):
        index.blocks(df, 0)
    stats = index.statistics(df, "histogram", 2).first()
    assert (stats.n_comparisons, stats.vector_dim, stats.spimi_blocks) == (3, 2, 2)


def test_stateless_search(spark):
    df = spark.createDataFrame([rec("exact", [2.0, 0.0, 0.0]), rec("partial", [1.0, 1.0, 0.0]), rec("miss", [0.0, 0.0, 3.0])], RECORD)
    hits = search.search_records(df, [1.0, 0.0, 0.0], 2, "text").collect()
    assert [(r.chunk_id, round(r.score, 4)) for r in hits] == [("exact", 1.0), ("partial", 0.7071)]
    images = spark.createDataFrame([rec("exact", [1.0, 0.0], "image"), rec("near", [2.0, 0.0], "image"), rec("far", [5.0, 0.0], "image")], RECORD)
    assert [(r.chunk_id, r.score) for r in search.search_records(images, [1.0, 0.0], 2, "image").collect()] == [("exact", 0.0), ("near", 1.0)]
    for bad in (lambda: search.search_records(df, [1.0], 2, "text"), lambda: search.search_records(df, [1.0, 0.0, 0.0], 0, "text"), lambda: search.search_records(df, [1.0, 0.0, 0.0], 1, "audio")):
        with pytest.raises(ValueError):
            bad()


def test_zero_scores_are_dropped_after_the_cut_and_documents_once(spark):
    items = spark.createDataFrame([("d_text_0", 0, 1.0), ("d_text_1", 0, 2.0), ("e_text_0", 0, 1.0), ("e_text_0", 1, 1.0)], "item string, idx int, weight double")
    query = spark.createDataFrame([("q", 0, 1.0)], "query string, idx int, weight double")
    hits = search.text_search(query, items, "query", "item", 3)
    assert [r["item"] for r in hits.orderBy("rank").collect()] == ["d_text_0", "d_text_1", "e_text_0"]
    docs = search.first_per_document(hits, "query", "item", F.regexp_extract("item", "^(.*)_text_", 1), 5).orderBy("rank").collect()
    assert [(r.document, r["item"]) for r in docs] == [("d", "d_text_0"), ("e", "e_text_0")]


def test_ties_go_by_id(spark):
    base = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [1.0])], "id int, v array<double>")
    rows = search.vector_search(base.where("id = 3"), base, "id", "v", 2, exclude_self=True).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 2]


def test_queries_in_blocks_give_the_same(spark):
    df = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5), 1.0]) for i in range(60)], "id int, v array<double>")
    for metric in ("l2", "cosine"):
        whole, parts = (sorted(map(tuple, search.vector_search(df, df, "id", "v", 3, metric, True, block=b).collect())) for b in (1000, 7))
        assert whole == parts and len(whole) == 180


def test_kmeans_codebook_assigns_nearest(spark):
    df = spark.createDataFrame([(i, [float(i % 2 * 10), float(i)]) for i in range(20)], "id int, v array<double>")
    table = cb.centroid_table(cb.kmeans_codebook(df, "v", 3), spark)
    assert table.count() == 3
    assert {r.cluster for r in cb.assign(df, "id", F.col("v"), table).collect()} <= {0, 1, 2}


def test_cells_are_searched_without_a_row_for_each_pair(spark):
    x = np.random.default_rng(5).normal(size=(400, 6))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, v array<double>")
    index = ann.CellIndex(df, "id", "v", 8)
    centres = np.array([r.centroid for r in index.centroids.orderBy("cluster").collect()])
    far = np.sqrt(((x[:, None, :] - centres) ** 2).sum(axis=2))
    own, want = far.argmin(axis=1), set()
    for i in range(0, 400, 10):
        inside = np.nonzero(np.isin(own, np.argsort(far[i], kind="stable")[:3]))[0]
        d = np.round(np.sqrt(((x[inside] - x[i]) ** 2).sum(axis=1)), 8)
        want |= {(i, rank + 1, int(inside[j]), float(d[j])) for rank, j in enumerate(np.lexsort((inside, d))[:5])}
    asked = df.where("id % 10 = 0")
    found = index.search(asked, "id", "v", 5, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert set(map(tuple, found.collect())) == want and len(want) == 200
    probe = partial(ann._probed, clusters=np.arange(8), centres=centres, probes=3)
    assert set(map(tuple, search.best_stored(asked, index.placed, 5, block=7, probe=probe).collect())) == want


def test_rows_that_share_an_id_have_a_cell_each(spark):
    df = spark.createDataFrame([(7, [0.0, 0.0]), (7, [9.0, 9.0]), (8, [0.0, 1.0]), (9, [9.0, 8.0])], "id int, v array<double>")
    placed = ann.CellIndex(df, "id", "v", 2).placed.collect()
    assert sorted((r.id, r.v) for r in placed) == sorted((r.id, r.v) for r in df.collect())
    assert len({(r.v[0], r.cluster) for r in placed}) == 2


def test_web_queries(spark):
    q = fulltext.parse_web_query('red "blue sky" -rain or snow')
    assert q.groups == [([["red"], ["blue", "sky"]], [["rain"]]), ([["snow"]], [])]
    df = spark.createDataFrame([(1, "Red under a blue sky"), (2, "red blue sky rain"), (3, "snow"), (4, "blue"), (5, None)], "id int, t string")
    rows = {r.id: r.web for r in fulltext.fulltext_search(df, "id", "t", 'red "blue sky" -rain or snow').collect()}
    assert rows == {1: True, 2: False, 3: True, 4: False}


def test_effectiveness_counts_empty_queries(spark):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, label string")
    hits = spark.createDataFrame([(1, 2), (1, 3)], "query_id int, id int")
    per = {r.query_id: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.precision_recall(items, hits, items, "id", "label").collect()}
    assert per == {1: (1, 1, 0, 0.5, 1.0), 2: (0, 0, 1, 0.0, 0.0), 3: (0, 0, 0, 0.0, 0.0)}


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "id string, x double, y double")
    assert {r.id: r.features for r in tabular.scaled(df, "id", ("x", "y")).collect()} == {"a": [0.0, 0.0], "b": [1.0, 0.0]}
