"""Similarity clusters: hashed weighted features, distributed k-means with parallel oversampled seeding.

Every component gets a weight from the share of rows that have it (as rare terms do), and the weighted components are
hashed into half as many signed features or fewer. The clusters of ``cells`` and ``typical`` are those of k-means over
these features, about the square root of the number of rows: their number grows with the data, and both the distances to
centres and the pairs within cells grow with its power of 1.5 only.

Seeding draws, in each of a few rounds, as many centres as wanted clusters with probability proportional to the squared
distance from those drawn so far (one pass, every task keeps its own best draws), weighs the draws by the rows nearest to
them and reduces them to k on the driver, whose work is bounded by k. The k-means cells then bound the search for close
pairs: rows meet those of their own cell, and those of every cell whose border is within half the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillhawk.llm.components import components
from quillhawk.llm.textarrays import mix64
from quillhawk.llm.vectors import BLOCK_ROWS, block_pairs, exact_squares, matrices, packed, unit, unpacked, usual_length
from quillhawk.runtime import map_arrow, stage

#: Most hashed features.
FEATURES = 512
#: Parts of a cell by the hash of the id.
_PARTS = 1 << 20


def feature_count(dim: int, most: int = FEATURES) -> int:
    """The largest power of two below ``dim``, at least 1 and at most ``most``."""
    return min(most, 1 << max(0, (max(dim, 1) - 1).bit_length() - 1))


def component_weights(rows: int, held: np.ndarray) -> np.ndarray:
    """Smoothed inverse row frequency of each component, the greatest being 1; ``held`` counts the rows with a non-zero value."""
    w = np.log((1 + rows) / (1 + held)) + 1
    return w / w.max() if len(w) else w


@lru_cache(maxsize=8)
def _hashing(dim: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components in order of their buckets, the factor of each, where each used bucket starts, and the used buckets."""
    h = mix64(np.arange(dim, dtype=np.uint64))
    bucket, sign = ((h >> np.uint64(1)) % np.uint64(features)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)
    factor = sign / np.sqrt(np.bincount(bucket, minlength=features)[bucket])
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    return order, factor[order], starts, used


def hashed_features(x: np.ndarray, features: int, weights: np.ndarray) -> np.ndarray:
    """Weighted components hashed into ``features`` signed buckets, each divided by the root of its load.

    The columns of this map are orthonormal and no weight exceeds 1, so distances never grow.
    """
    order, factor, starts, used = _hashing(x.shape[1], features)
    out = np.zeros((len(x), features), dtype=x.dtype)
    if len(x):
        out[:, used] = np.add.reduceat(x[:, order] * (factor * weights[order]).astype(x.dtype), starts, axis=1)
    return out


class Features:
    """The map from raw rows to features, sent to the tasks."""

    def __init__(self, dim: int, weights: np.ndarray) -> None:
        self.width, self.weights = feature_count(dim), weights

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return hashed_features(unit(raw).astype(np.float32), self.width, self.weights)


def _held(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows, and for each component the rows with a non-zero value: one row a task."""
    rows, held = 0, np.zeros(dim, dtype=np.int64)
    for _, raw in _parts(batches, dim):
        rows += len(raw)
        held += (raw != 0).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([held.tolist()], pa.list_(pa.int64()))], names=["rows", "held"])


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0)


def _pack(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for ids, raw in matrices(batches, dim):
        yield pa.RecordBatch.from_arrays([ids, packed(raw)], names=["id", "v"])


def _parts(batches: Iterable[pa.RecordBatch], dim: int, rows: int = 2000) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for a in range(0, b.num_rows, rows):
            some = b.slice(a, rows)
            yield some.column(0), unpacked(some.column(1), dim)


def _draw(batches: Iterable[pa.RecordBatch], dim: int, features: Features, shared, want: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The task's ``want`` smallest exponential variates of rate squared distance: together, a weighted draw."""
    centres = shared.value if shared else None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for ids, raw in _parts(batches, dim):
        x = features(raw)
        h = mix64(mix64(x.view(np.uint32).astype(np.uint64).sum(axis=1) + np.uint64(seed)) + np.asarray(ids.to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64))
        u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        rate = squares(x, centres).min(axis=1).astype(np.float64) if centres is not None else np.ones(len(x))
        rate[rate < 1e-9] = 0
        some = np.flatnonzero(rate > 0)
        if len(some):
            held.append((-np.log(u[some]) / rate[some], x[some]))
            if sum(len(k) for k, _ in held) > 4 * want + 4000:
                held = [_least(held, want)]
    if held:
        key, x = _least(held, want)
        yield pa.RecordBatch.from_arrays([pa.array(key), packed(x)], names=["key", "v"])


def _least(held: list[tuple[np.ndarray, np.ndarray]], want: int) -> tuple[np.ndarray, np.ndarray]:
    key, x = np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held])
    best = np.argsort(key)[:want]
    return key[best], x[best]


def _sums(batches: Iterable[pa.RecordBatch], dim: int, features: Features, shared) -> Iterator[pa.RecordBatch]:
    """Rows, summed squared distances and vector sums of the cells that the task meets."""
    centres = shared.value
    count, total, far = np.zeros(len(centres), dtype=np.int64), np.zeros(centres.shape), np.zeros(len(centres))
    for _, raw in _parts(batches, dim):
        x = features(raw)
        d = squares(x, centres)
        near = d.argmin(axis=1)
        far += np.bincount(near, weights=d[np.arange(len(near)), near], minlength=len(centres))
        order = np.argsort(near, kind="stable")
        cell, first = np.unique(near[order], return_index=True)
        total[cell] += np.add.reduceat(x[order], first, axis=0)
        count[cell] += np.diff(np.append(first, len(near)))
    met = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(far[met]), packed(total[met]) if len(met) else pa.array([], pa.binary())], names=["cell", "rows", "far", "v"])


def _add(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = {}
    far: dict[int, float] = {}
    total: dict[int, np.ndarray] = {}
    for b in batches:
        x = unpacked(b.column(3), width)
        for c, n, d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), x):
            count[c], far[c] = count.get(c, 0) + n, far.get(c, 0.0) + d
            total[c] = total[c] + v if c in total else v
    cells = sorted(count)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([count[c] for c in cells], pa.int64()), pa.array([far[c] for c in cells], pa.float64()), packed(np.stack([total[c] for c in cells])) if cells else pa.array([], pa.binary())], names=["cell", "rows", "far", "v"])


def _reduce(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ choice of k points."""
    rng = np.random.default_rng(seed)
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    d = squares(points, points[chosen])[:, 0]
    while len(chosen) < k:
        p = weight * d
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=p / p.sum())))
        d = np.minimum(d, squares(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


_SUMS = "cell bigint, rows bigint, far double, v binary"


def fit_kmeans(vectors: DataFrame, dim: int, features: Features, k: int, rounds: int = 3, iterations: int = 10, settled: float = 0.01, seed: int = 11) -> np.ndarray:
    """Centres of ``vectors`` (id, v packed) in feature space, by seeding and Lloyd's steps over all rows.

    The steps end when the summed squared distances fall by less than the share ``settled``, or after ``iterations``.
    """
    spark, width = vectors.sparkSession, features.width
    share = spark.sparkContext.broadcast
    centres: np.ndarray | None = None
    for r in range(rounds + 1):
        want = k if r else 1
        drawn = map_arrow(vectors, partial(_draw, dim=dim, features=features, shared=share(centres) if r else None, want=want, seed=seed + r), "key double, v binary")
        got = drawn.orderBy("key").limit(want).toArrow()  # at most k centres
        new = unpacked(got.column("v"), width).astype(np.float32)
        centres = new if centres is None else np.concatenate([centres, new])
        if not len(new):
            break
    if not len(centres):
        return centres.reshape(0, width)

    def step() -> pa.Table:
        sums = map_arrow(vectors, partial(_sums, dim=dim, features=features, shared=share(centres)), _SUMS)
        parts = max(1, min(64, len(centres) * width * 4 >> 20))  # a task's sums of all centres, in megabytes
        return map_arrow(sums.repartition(parts, "cell"), partial(_add, width=width), _SUMS).toArrow()  # one row a centre

    weight, got = np.zeros(len(centres)), step()
    weight[got.column("cell").to_numpy()] = got.column("rows").to_numpy()
    centres, before = _reduce(centres, weight, k, seed), np.inf
    for _ in range(iterations):
        got = step()
        centres = centres.copy()
        centres[got.column("cell").to_numpy()] = unpacked(got.column("v"), width) / got.column("rows").to_numpy()[:, None]
        now = float(got.column("far").to_numpy().sum())
        if before - now < settled * now:
            break
        before = now
    return centres


def _assign(batches: Iterable[pa.RecordBatch], dim: int, features: Features, shared) -> Iterator[pa.RecordBatch]:
    """Each row with its cell and the distance from the centre."""
    for ids, raw in _parts(batches, dim):
        d = squares(features(raw), shared.value)
        cell = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cell), pa.array(np.sqrt(d[np.arange(len(cell)), cell].astype(np.float64))), packed(raw)], names=["id", "cell", "distance", "v"])


def _light(batches: Iterable[pa.RecordBatch], dim: int, features: Features, shared) -> Iterator[pa.RecordBatch]:
    for b in _assign(batches, dim, features, shared):
        yield b.drop_columns(["v"])


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place in the component of each of n places that the pairs (i, j) join."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
        if (label == before).all():
            return label


def _close_links(x: np.ndarray, some: np.ndarray, y: np.ndarray, rough_x: np.ndarray, rough_y: np.ndarray, radius: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows of x among ``some`` and rows of y, of unit length, at most ``radius`` apart.

    Rows of y are counted on from those of x; with ``same`` y is x and every pair is looked at once. Products are taken in
    single precision (``rough_x``, ``rough_y``), pairs in doubt are compared by double-precision differences.
    """
    least, shift = 1 - radius * radius / 2, 0 if same else len(x)
    cosine = rough_x[some] @ rough_y.T
    i, j = np.divmod(np.flatnonzero(cosine >= np.float32(least - 1e-5)), len(y))
    if same:
        i, j = i[i < j], j[i < j]
    doubt = np.flatnonzero(cosine[i, j] < least + 1e-5)
    if len(doubt):
        far = np.concatenate([np.sqrt(exact_squares(x[some[i[d]]], y[j[d]])) > radius for d in np.array_split(doubt, 1 + len(doubt) // 20_000)])
        i, j = np.delete(i, doubt[far]), np.delete(j, doubt[far])
    if not len(i):
        return i, j
    ends, place = np.unique(np.concatenate([some[i], j + shift]), return_inverse=True)
    label = _labels(len(ends), place[: len(i)], place[len(i) :])
    rest = np.flatnonzero(label != np.arange(len(ends)))
    return ends[rest], ends[label[rest]]


def _close(table: pa.Table, dim: int, radius: float) -> pa.Table:
    """Within a block of a cell, or between two blocks, links of rows at most ``radius`` apart."""
    ids, x = table.column("id").combine_chunks(), unit(unpacked(table.column("v"), dim))
    rough = x.astype(np.float32)
    if table.column("left")[0].as_py() == table.column("right")[0].as_py():
        a, b = _close_links(x, np.arange(len(x)), x, rough, rough, radius, same=True)
    else:
        left = table.column("is_left").to_numpy(zero_copy_only=False)
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        place = np.concatenate([one, two])
        a, b = (place[e] for e in _close_links(x[one], np.arange(len(one)), x[two], rough[one], rough[two], radius))
    return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])


def _members(files: list[str], low: int, high: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
    """Ids, cells and packed vectors of the rows of cells low to high, of one part of their hashes, sorted by cell."""
    found = [fs.FileSystem.from_uri("file:///" + f.removeprefix("file:").lstrip("/") if f.startswith("file:") else f) for f in files]
    system, paths = found[0][0], [path for _, path in found]
    of = ds.field
    wanted = (of("cell") >= low) & (of("cell") <= high) & (of("part") >= part * _PARTS // parts) & (of("part") < (part + 1) * _PARTS // parts)
    some = ds.dataset(paths, format="parquet", filesystem=system).to_table(columns=["id", "cell", "v"], filter=wanted, use_threads=False, batch_size=4096).sort_by("cell")
    return some.column("id").to_numpy(), some.column("cell").to_numpy(), some.column("v")


def _raw_sums(batches: Iterable[pa.RecordBatch], dim: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Rows and sums of unit vectors of the cells that the task meets; columns id, cell, v."""
    count, total = np.zeros(cells, dtype=np.int64), np.zeros((cells, dim))
    for b in batches:
        cell, x = b.column("cell").to_numpy(), unit(unpacked(b.column("v"), dim))
        order = np.argsort(cell, kind="stable")
        some, first = np.unique(cell[order], return_index=True)
        if len(some):
            total[some] += np.add.reduceat(x[order], first, axis=0)
            count[some] += np.diff(np.append(first, len(cell)))
    met = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(np.zeros(len(met))), packed(total[met]) if len(met) else pa.array([], pa.binary())], names=["cell", "rows", "far", "v"])


def _borders(batches: Iterable[pa.RecordBatch], dim: int, shared, block: tuple[list[str], int, int, int, int], radius: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Links of rows to close members of other cells, a spanning forest for each part of rows and cell.

    Take the means c and e of two cells' vectors. If x of the first and y of the second are at most ``radius`` apart, the
    signed distances of x and y from the plane halfway between c and e, each counted away from the other's side, add up to
    at most that, so one of them is within half of it: (|x-e|^2 - |x-c|^2) <= radius |c-e| for x, or the like for y, which
    has its turn as a row. That holds for any two points c and e, however rows came to their cells.
    """
    means, (m_ids, m_cell, m_packed) = shared.value, _members(*block)
    if not len(m_ids):
        return
    cells, first = np.unique(m_cell, return_index=True)
    last = np.append(first[1:], len(m_cell))
    apart = np.sqrt(squares(means.astype(np.float64), means[cells].astype(np.float64)))
    sizes, turned = (means * means).sum(axis=1), np.ascontiguousarray(means[cells].T)
    y = unit(unpacked(m_packed, dim))
    rough_y = y.astype(np.float32)
    for b in batches:
        for a in range(0, b.num_rows, 2000):
            some = b.slice(a, 2000)
            ids, own = some.column("id").to_numpy(zero_copy_only=False), some.column("cell").to_numpy()
            x = unit(unpacked(some.column("v"), dim))
            rough_x = x.astype(np.float32)
            gap = (sizes[cells][None] - 2 * (rough_x @ turned)) - (sizes[own] - 2 * (rough_x * means[own]).sum(axis=1))[:, None]
            enter = (gap <= (radius + 2e-3) * apart[own] + 1e-5) & (own[:, None] != cells)  # with room for single precision
            for c in np.flatnonzero(enter.any(axis=0)):
                i = np.flatnonzero(enter[:, c])
                for low in range(first[c], last[c], 2000):
                    high = min(low + 2000, last[c])
                    p, q = _close_links(x, i, y[low:high], rough_x, rough_y[low:high], radius)
                    if len(p):
                        names = np.concatenate([ids, m_ids[low:high]])
                        yield pa.RecordBatch.from_arrays([pa.array(names[p], kind), pa.array(names[q], kind)], names=["a", "b"])


class Clusters:
    """The k-means cells of a vector column and the clusters of close rows."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, cells: int | None = None, seed: int = 11) -> None:
        source = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        self.dim, self.id_type = usual_length(source, "v"), source.schema["id"].dataType.simpleString()
        self.vectors = stage(map_arrow(source, partial(_pack, dim=self.dim), f"id {self.id_type}, v binary"), "vectors", "zstd")
        dim = max(self.dim, 1)
        counted = map_arrow(self.vectors, partial(_held, dim=dim), "rows bigint, held array<bigint>").select("rows", F.posexplode("held").alias("at", "n"))
        found = counted.groupBy("at").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n")).orderBy("at").collect()  # one row a component
        self.rows = found[0].rows if found else 0
        self.features = Features(dim, component_weights(self.rows, np.array([r.n for r in found], dtype=np.float64)) if found else np.ones(dim))
        k = max(1, cells or round(self.rows**0.5))
        self.centres = fit_kmeans(self.vectors, dim, self.features, k, seed=seed)
        self.shared = df.sparkSession.sparkContext.broadcast(self.centres)

    def cells(self) -> DataFrame:
        """(id, cell, distance): every valid row with its cell and the distance from the centre."""
        if not self.rows:
            return self.vectors.select("id", F.lit(0).cast("bigint").alias("cell"), F.lit(0.0).alias("distance"))
        return map_arrow(self.vectors, partial(_light, dim=self.dim, features=self.features, shared=self.shared), f"id {self.id_type}, cell bigint, distance double")

    def typical(self, most: int = 5) -> DataFrame:
        """(cell, size, rank, id, distance): every cell's size and its ``most`` rows nearest to the centre."""
        cells = stage(self.cells(), "cells")
        size = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "id"))
        return cells.withColumn("rank", rank).where(F.col("rank") <= most).join(size, "cell").select("cell", "size", "rank", "id", "distance")

    def close(self, radius: float, block_rows: int = BLOCK_ROWS, scan_rows: int = 10_000) -> DataFrame:
        """(id, cluster_id) of the rows that a chain of steps of at most ``radius`` joins to another row.

        ``cluster_id`` is the smallest id of the cluster. Rows are compared within their cell: cells over ``block_rows``
        rows are cut into blocks and every pair of blocks is a group of its own, so a hot cell is spread and none is
        capped. Steps between cells are found exactly by ``_borders``: tasks read the members of whole cells, about
        ``scan_rows`` at once, from the shared folder, and each row meets those cells whose border is near enough; no
        vectors are copied.
        """
        spark = self.vectors.sparkSession
        if not self.rows:
            return self.vectors.select("id", F.col("id").alias("cluster_id"))
        dim, link = self.dim, f"a {self.id_type}, b {self.id_type}"
        rows = stage(map_arrow(self.vectors, partial(_assign, dim=dim, features=self.features, shared=self.shared), f"id {self.id_type}, cell bigint, distance double, v binary").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(_PARTS))), "assigned", "zstd")
        counts = sorted((r.cell, r.n) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a cell
        many = spark.createDataFrame([(c, -(-n // block_rows)) for c, n in counts if n > 1], "cell bigint, blocks int")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        sums = map_arrow(rows.select("id", "cell", "v"), partial(_raw_sums, dim=dim, cells=len(self.centres)), _SUMS)
        got = map_arrow(sums.repartition(max(1, min(64, len(self.centres) * dim * 4 >> 20)), "cell"), partial(_add, width=dim), _SUMS).toArrow()  # one row a cell
        means = np.zeros((len(self.centres), dim), dtype=np.float32)
        means[got.column("cell").to_numpy()] = unpacked(got.column("v"), dim) / got.column("rows").to_numpy()[:, None]
        self.means = spark.sparkContext.broadcast(means)
        pairs = rows.join(F.broadcast(many), "cell").select("id", "v", "cell", F.explode(block_pairs(block, F.col("blocks"))).alias("p")).select("id", "v", "cell", "p.left", "p.right", "p.is_left")
        links = pairs.groupBy("cell", "left", "right").applyInArrow(lambda t: _close(t, dim, radius), link)
        for found in self._between(rows, counts, radius, scan_rows, link) if len(counts) > 1 else []:
            links = links.unionByName(found)
        links = stage(links, "close", shuffled=4 * dim * self.rows)
        return components(links, "a", "b").withColumnRenamed("component", "cluster_id")

    def _between(self, rows: DataFrame, counts: list[tuple[int, int]], radius: float, scan_rows: int, link: str) -> list[DataFrame]:
        """Links between cells, one pass over ``rows`` for each block of cells; a cell over ``scan_rows`` takes several."""
        from pyspark.sql.pandas.types import to_arrow_type

        spark, kind = rows.sparkSession, to_arrow_type(rows.schema["id"].dataType)
        spans: list[tuple[int, int, int, int]] = []  # cells low to high, part, parts
        full = 0
        for cell, n in counts:
            if n > scan_rows:
                parts, full = -(-n // scan_rows), 0
                spans += [(cell, cell, p, parts) for p in range(parts)]
            elif full and full + n <= scan_rows:
                spans[-1], full = (spans[-1][0], cell, 0, 1), full + n
            else:
                spans.append((cell, cell, 0, 1))
                full = n
        files = rows
        if len(spans) > 8:  # sorted, so that a reader skips what isn't its own; fewer may each read all
            files = stage(rows.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part"), "members", "zstd")
        files = files.inputFiles()
        slices = max(-(-self.rows // 200_000), -(-2 * spark.sparkContext.defaultParallelism // len(spans)))
        return [map_arrow(rows.coalesce(slices), partial(_borders, dim=self.dim, shared=self.means, block=(files, *x), radius=radius, kind=kind), link) for x in spans]


def similarity_clusters(df: DataFrame, id_col: str, vector_col: str) -> Clusters:
    """Clusters of a vector column.

    Valid vectors have the table's most frequent length, finite components and are not all zero; they are scaled to unit
    length. Others and rows with a null id take no part; ids are taken as unique. Copies share cell and cluster; ties in
    typical rows go to the smaller id; an empty table gives empty results.
    """
    return Clusters(df, id_col, vector_col)
