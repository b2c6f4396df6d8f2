import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhawk.llm.clusters import Clusters, component_weights, feature_count, hashed_features, similarity_clusters
from quillhawk.llm.neighbours import Hashing, all_neighbours, near_neighbours, probe_sets, scan_neighbours, sign_limit
from quillhawk.llm.vectors import packed, unpacked

DIM = 24


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, DIM))
    x = np.concatenate([c + 0.03 * rng.normal(size=(8, DIM)) for c in centres] + [rng.normal(size=(200, DIM))]).astype(np.float32)
    x[5] = x[3] * 1.0
    return x


def table(spark, x):
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [(9000, None), (9001, [0.0] * DIM), (9002, [float("nan")] * DIM), (9003, [1.0]), (None, [1.0] * DIM), (9004, [None] * DIM)]
    return spark.createDataFrame(rows + bad, "key int, v array<float>").withColumns({"id": F.lit("x"), "cell": F.lit(1), "distance": F.lit(2.0)})


def exact(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


def test_packing():
    x = np.random.default_rng(0).normal(size=(7, 5)).astype(np.float32)
    assert (unpacked(packed(x), 5) == x).all()


def test_hashed_features_never_stretch():
    x = np.random.default_rng(0).normal(size=(30, 100))
    weights = component_weights(50, np.random.default_rng(1).integers(0, 51, 100).astype(float))
    assert weights.max() == 1 and weights.min() > 0
    assert [feature_count(d) for d in (1, 2, 24, 116, 512, 4096)] == [1, 1, 16, 64, 256, 512]
    y = hashed_features(x, 16, weights)
    assert y.shape == (30, 16)
    assert (np.linalg.norm(y[:, None] - y[None], axis=-1) <= np.linalg.norm(x[:, None] - x[None], axis=-1) + 1e-9).all()
    assert not np.allclose(y, hashed_features(x, 16, np.ones(100)))


def test_cells_follow_planted_groups(spark):
    """Eight well separated groups become eight cells, each of one group, and typical members lie nearest the centre."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64))
    x = np.concatenate([c + 0.1 * rng.normal(size=(50, 64)) for c in centres])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "key int, v array<float>")
    model = Clusters(df, "key", "v", cells=8)
    cells = model.cells().collect()
    held = {}
    for r in cells:
        held.setdefault(r.cell, []).append(r)
    assert len(held) == 8 and all(len({r.id // 50 for r in rows}) == 1 for rows in held.values())
    for r in model.typical(1).collect():
        assert r.distance == min(m.distance for m in held[r.cell]) and r.size == 50


def test_probes_are_distinct_and_consistent():
    found = probe_sets(20, 30)
    assert len(set(found)) == 30 and found[0] == (0,)
    assert not any(39 - i in s for s in found for i in s)


@pytest.mark.parametrize("block_rows", [2000, 3])
def test_neighbours_equal_brute_force(spark, groups, block_rows):
    d = exact(groups)
    want = {}
    for i in range(len(groups)):
        order = sorted(range(len(groups)), key=lambda j: (round(d[i, j], 12), j))[:5]
        if d[i, order[4]] <= 0.4:
            want[i] = order
    out = near_neighbours(table(spark, groups), "key", "v", 5, block_rows=block_rows).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.neighbour)
    assert len(want) >= 300
    assert {i: got.get(i) for i in want} == want


def test_large_tables_are_not_sent_through_the_driver(spark, groups, monkeypatch):
    """Beyond the limit of rows no side is hinted for broadcast, the rows stay the same, and the steps' tables are deleted."""
    from quillhawk import runtime
    from quillhawk.llm import neighbours

    df, sent, hinted = table(spark, groups), neighbours.broadcast_if_small, []

    def watched(side, rows, *limit):
        hinted.append(rows <= (*limit, runtime.BROADCAST_ROWS)[0])
        return sent(side, rows, *limit)

    monkeypatch.setattr(neighbours, "broadcast_if_small", watched)
    small = {tuple(r) for r in near_neighbours(df, "key", "v", 5).collect()}
    assert all(hinted)
    hinted.clear()
    since = len(runtime._staged)
    large = {tuple(r) for r in near_neighbours(df, "key", "v", 5, sent_rows=100).collect()}
    assert large == small and len(large) > 1000
    assert hinted and not any(hinted)
    assert len(runtime._staged) - since == 1  # the result's
    hinted.clear()
    monkeypatch.setattr(neighbours, "broadcast_if_small", lambda side, rows, *limit: watched(side, 300_000, *limit))  # as if of so many rows
    assert {tuple(r) for r in near_neighbours(df, "key", "v", 5).collect()} == small
    assert hinted and not any(hinted)


def test_every_row_has_its_neighbours(spark, groups):
    d = exact(groups)
    for block in (20_000, 60):
        out = all_neighbours(table(spark, groups), "key", "v", 5, block=block).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.id, r["rank"])):
            got.setdefault(r.id, []).append(r.neighbour)
        assert got == {i: sorted(range(len(groups)), key=lambda j: (round(d[i, j], 12), j))[:5] for i in range(len(groups))}
    few = all_neighbours(table(spark, groups).where("key < 3"), "key", "v", 5)
    assert sorted((r.id, r.neighbour) for r in few.collect()) == [(i, j) for i in range(3) for j in range(3) if i != j]
    assert all_neighbours(table(spark, groups).limit(0), "key", "v").count() == 0


def test_scan_and_empty_tables(spark, groups):
    d = exact(groups)
    df = table(spark, groups)
    out = scan_neighbours(df, "key", "v", F.col("key") % 50 == 0, 3, block=4).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.neighbour)
    for i in range(0, len(groups), 50):
        assert got[i] == sorted(range(len(groups)), key=lambda j: (round(d[i, j], 12), j))[:3]
    assert 9000 not in got
    none = df.limit(0)
    assert near_neighbours(none, "key", "v").count() == 0
    assert scan_neighbours(none, "key", "v", F.lit(True)).count() == 0


def test_clusters_equal_chains(spark, groups):
    d = exact(groups)
    label = list(range(len(groups)))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(d <= 0.4)):
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    want = {i: c for i, c in enumerate(label) if (d[i] <= 0.4).any()}
    model = similarity_clusters(table(spark, groups), "key", "v")
    for block_rows in (2000, 5):
        assert {r.id: r.cluster_id for r in model.close(0.4, block_rows=block_rows).collect()} == want
    cells = model.cells().collect()
    assert sorted(r.id for r in cells) == list(range(len(groups)))
    typical = model.typical(2).collect()
    assert sum({r.cell: r.size for r in typical}.values()) == len(groups)
    assert max(r["rank"] for r in typical) == 2
    empty = similarity_clusters(table(spark, groups).limit(0), "key", "v")
    assert empty.close(0.4).count() == 0 and empty.typical().count() == 0


def test_steps_across_cell_borders(spark):
    """Steps of 0.35 along an arc in 512 dimensions, ten rows a stop: one chain, whatever the cells."""
    angle = np.repeat(np.arange(16) * 0.35, 10)
    x = np.zeros((160, 512))
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    x[:, 2:] = 0.001 * np.random.default_rng(1).normal(size=(160, 510))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "key int, v array<float>")
    model = Clusters(df, "key", "v", cells=16)
    assert model.cells().select("cell").distinct().count() > 4
    for scan_rows in (10_000, 7):
        assert {r.id: r.cluster_id for r in model.close(0.4, scan_rows=scan_rows).collect()} == {i: 0 for i in range(160)}


def test_tables_and_probes_decide_what_is_found(spark, groups):
    """One table without probes misses neighbours that the full set of tables and probes finds."""
    d = exact(groups)
    near = {(i, j) for i, j in zip(*np.nonzero(d <= 0.4))}

    def found(h):
        return {(r.id, r.neighbour) for r in near_neighbours(table(spark, groups), "key", "v", 7, hashing=h).collect()} & near

    few, many = found(Hashing(tables=1, probes=0)), found(Hashing())
    assert len(few) < 0.9 * len(near) and few < many
    assert len(many) >= 0.999 * len(near)
    assert sign_limit(0.4) < sign_limit(0.6) < 256
