import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhawk.llm.mixing import budgets, fill, mix_sources
from quillhawk.llm.proportional import Target, clean_labels, plan_counts, proportional_sample, random_start
from quillhawk.llm.selection import seeded_hash, take_prefix


def test_plan_is_optimal_on_small_cases():
    rng = np.random.default_rng(0)
    for _ in range(30):
        available = rng.integers(0, 9, 3)
        size = int(rng.integers(1, max(2, available.sum() + 1)))
        size = min(size, int(available.sum()))
        target = rng.dirichlet(np.ones(3)) * size
        got = plan_counts(available, np.eye(3), target, np.zeros(3), size, 1)
        assert got.sum() == size and (got <= available).all()
        best = min(
            ((np.array([a, b, size - a - b]) - target) ** 2).sum()
            for a in range(available[0] + 1) for b in range(available[1] + 1) if 0 <= size - a - b <= available[2]
        )
        assert ((got - target) ** 2).sum() == pytest.approx(best)


def test_floors_and_two_attributes():
    # signatures: (x, p), (x, q), (y, p), (y, q); categories x, y, p, q
    member = np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1]], dtype=float)
    got = plan_counts(np.array([50, 50, 50, 50]), member, np.array([15.0, 5.0, 10.0, 10.0]), np.zeros(4), 20, 3)
    assert (got @ member == [15, 5, 10, 10]).all()
    got = plan_counts(np.array([100, 4]), np.eye(2), np.array([10.0, 0.0]), np.array([0.0, 3.0]), 10, 3)
    assert got.tolist() == [7, 3]


def test_start_is_random_and_holds_floors():
    available, member, floor = np.array([500, 40, 3, 200]), np.eye(4), np.array([0.0, 20.0, 5.0, 10.0])
    starts = [random_start(available, member, np.minimum(floor, available), 100, np.random.default_rng(s)) for s in range(40)]
    for x in starts:
        assert x.sum() == 100 and (x <= available).all() and x[1] >= 20 and x[2] == 3 and x[3] >= 10
    assert len({tuple(x) for x in starts}) > 20
    mean = np.mean([random_start(np.array([600, 300, 100]), np.eye(3), np.zeros(3), 100, np.random.default_rng(s)) for s in range(300)], axis=0)
    assert mean == pytest.approx([60, 30, 10], abs=2)
    assert random_start(np.array([2_000_000_000, 10]), np.eye(2), np.array([0.0, 4.0]), 1000, np.random.default_rng(1)).sum() == 1000


def test_many_signatures_end_at_a_point_no_exchange_improves():
    rng = np.random.default_rng(3)
    available = rng.integers(0, 30, 150)
    member = np.zeros((150, 15))
    for i in range(3):
        member[np.arange(150), 5 * i + rng.integers(0, 5, 150)] = 1
    target = np.concatenate([rng.dirichlet(np.ones(5)) * 300 for _ in range(3)])
    got = plan_counts(available, member, target, np.zeros(15), 300, 5)
    now = ((got @ member - target) ** 2).sum()
    for u in np.flatnonzero(got > 0):
        for v in np.flatnonzero(got < available):
            x = got.copy()
            x[u] -= 1
            x[v] += 1
            assert ((x @ member - target) ** 2).sum() >= now - 1e-9


def test_sample_and_report(spark):
    rows = [(i, "a") for i in range(60)] + [(100 + i, "b") for i in range(30)] + [(200 + i, None) for i in range(9)] + [(None, "a")]
    df = spark.createDataFrame(rows, "id int, genre string").withColumns({"taken": F.lit(1), "n": F.lit(2), "__h": F.lit(3)})
    sample, report = proportional_sample(df, "id", {"genre": [Target("a", 0.5, 1), Target("b", 0.5, 1), Target("c", 0.0, 2)]}, 0.2)
    got = sample.collect()
    assert sorted(r.genre for r in got) == ["a"] * 10 + ["b"] * 10
    assert len({r.id for r in got}) == 20
    by = {r.category: r for r in report.collect()}
    assert by["c"].short and not by["a"].short
    assert (by["a"].available, by["a"].sampled, by["a"].share) == (61, 10, 0.5)
    again = proportional_sample(df, "id", {"genre": [Target("a", 0.5, 1), Target("b", 0.5, 1)]}, 0.2)[0]
    assert {r.id for r in again.collect()} == {r.id for r in got}


def test_empty_sample(spark):
    sample, report = proportional_sample(spark.createDataFrame([], "id int, g string"), "id", {"g": [Target("a", 1.0, 2)]}, 0.5)
    assert sample.count() == 0
    assert [(r.available, r.short) for r in report.collect()] == [(0, True)]


def test_labels(spark):
    df = spark.createDataFrame([(1, "Hip Hop!"), (2, None), (3, "??"), (4, "other")], "id int, form string")
    aliases = spark.createDataFrame([("hip-hop", "HH"), ("HIP HOP", "AA"), ("??", "no"), (None, "no")], "raw string, means string")
    assert {r.id: r.m for r in clean_labels(df, "form", aliases, "raw", "means", "m").collect()} == {1: "AA", 2: None, 3: None, 4: None}


def test_prefix_takes_exact_counts(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.lit(1).alias("w")).withColumn("h", seeded_hash(1, "id"))
    out = take_prefix(df, "g", "h", "id", "w", {"a": 100.0, "b": 7777.0})
    counts = {(r.g, r.taken): r.n for r in out.groupBy("g", "taken").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (counts["a", True], counts["b", True]) == (100, 7777)
    assert sum(counts.values()) == 20_000
    border = out.where("g = 'a'").groupBy("taken").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
    by = {r.taken: r for r in border}
    assert by[True].hi < by[False].lo


def test_budgets_prefer_siblings():
    assert fill(10, [1, 1], [2, 100]) == [2, 8]
    leaves = [(("d1", "en", "a"), 0.25, 10.0), (("d1", "en", "b"), 0.25, 100.0), (("d2", "en", "c"), 0.5, 100.0)]
    assert budgets(leaves, 100) == pytest.approx([10, 40, 50])
    leaves[1] = (("d1", "en", "b"), 0.25, 20.0)
    assert budgets(leaves, 100) == pytest.approx([10, 20, 70])
    assert budgets([], 5) == []


def test_mix(spark):
    rows = [(i, "word " * 10, " Big ", "m", "en") for i in range(80)] + [(100 + i, "word " * 10, "small", "m", "EN-us") for i in range(5)] + [(200, None, "small", None, None), (201, "x", None, "m", "en"), (None, "x", "big", "m", "en")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, category string, lang string").withColumns({"tokens": F.lit(0), "uses": F.lit("x")})
    targets = spark.createDataFrame([("big", 0.5, 1), ("SMALL", 0.4, 3), ("absent", 0.1, 2)], "source string, weight double, max_repeats int")
    usage, report = mix_sources(docs, "doc_id", "text", "source", "category", "lang", targets)
    by = {r.source: r for r in report.collect()}
    assert by["absent"].short and by["small"].short and not by["big"].short
    uses = {r.doc_id: r.uses for r in usage.collect()}
    assert len(uses) == 86
    assert all(uses[100 + i] == 3 for i in range(5))
    assert max(uses[i] for i in range(80)) == 1
    assert sum(r.share for r in by.values()) == pytest.approx(1)
    empty, report = mix_sources(docs.limit(0), "doc_id", "text", "source", "category", "lang", targets)
    assert empty.count() == 0 and report.count() == 3


def test_sizes_are_tokens_and_shortages_follow_the_documents(spark):
    """A short source with documents in two domains leaves its shortage to the siblings of each in equal parts."""
    from quillhawk.llm.mixing import VOCABULARY, _encoding

    encode = _encoding(VOCABULARY).encode_ordinary
    text = "Die Katze sat on the mat, and 12 ratones ran! " * 3
    rows = [(i, text, "short", "a" if i % 2 else "b", "en") for i in range(4)]
    rows += [(100 + i, text, "in_a", "a", "en") for i in range(60)] + [(200 + i, text, "in_b", "b", "EN") for i in range(60)] + [(300 + i, text + str(i), "apart", "c", "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, category string, lang string")
    targets = spark.createDataFrame([("short", 0.4, 2), ("in_a", 0.2, 4), ("in_b", 0.2, 4), ("apart", 0.2, 4)], "source string, weight double, max_repeats int")
    usage, report = mix_sources(docs, "doc_id", "text", "source", "category", "lang", targets)
    by = {r.source: r for r in report.collect()}
    sizes = {s: sum(len(encode(t)) for _, t, x, _, _ in rows if x == s) for s in by}
    assert {s: r["size"] for s, r in by.items()} == sizes
    whole = sum(sizes.values())
    missing = 0.4 * whole - 2 * sizes["short"]
    assert by["short"].planned == pytest.approx(2 * sizes["short"]) and by["short"].short
    assert by["apart"].planned == pytest.approx(0.2 * whole)
    assert by["in_a"].planned == pytest.approx(0.2 * whole + missing / 2) and by["in_b"].planned == pytest.approx(by["in_a"].planned)
    tokens = {i: len(encode(t)) for i, t, *_ in rows}
    used = {}
    for r in usage.collect():
        assert r.tokens == tokens[r.doc_id]
        used[r.source] = used.get(r.source, 0) + r.uses * r.tokens
    longest = max(tokens.values())
    for s, r in by.items():
        assert r.used == used[s] and abs(r.used - r.planned) <= longest


def test_found_rows_need_the_plan(spark, monkeypatch):
    """Without the exchanges of counts or the budgets the reports name other rows."""
    from quillhawk.llm import mixing, proportional

    df = spark.createDataFrame([(i, "a") for i in range(80)] + [(100 + i, "b") for i in range(5)], "id int, g string")
    goals = {"g": [Target("a", 0.5, 1), Target("b", 0.5, 1)]}
    assert {r.category for r in proportional_sample(df, "id", goals, 0.4)[1].where("short").collect()} == {"b"}
    monkeypatch.setattr(proportional, "plan_counts", lambda available, member, target, floor, size, seed: np.minimum(available, size // len(available) // 4))
    assert proportional_sample(df, "id", goals, 0.4)[1].where("short").count() == 0
    docs = spark.createDataFrame([(i, "word " * 10, "big" if i else "tiny", "m", "en") for i in range(30)], "doc_id int, text string, source string, category string, lang string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("tiny", 0.5, 2)], "source string, weight double, max_repeats int")
    assert {r.source for r in mix_sources(docs, "doc_id", "text", "source", "category", "lang", targets)[1].where("short").collect()} == {"tiny"}
    monkeypatch.setattr(mixing, "budgets", lambda leaves, amount: [0.0] * len(leaves))
    assert mix_sources(docs, "doc_id", "text", "source", "category", "lang", targets)[1].where("short").count() == 0
