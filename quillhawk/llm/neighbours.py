"""The most similar vectors of every vector, by multi-probe p-stable hashing.

Vectors are scaled to unit length. In each of several tables a vector falls into the bucket of its quantised projections
on Gaussian directions; it is stored there and looks into the buckets that a small move would reach, in the order of
their estimated success. Every member of every bucket looked into is a candidate. So that vectors aren't copied once per
table and probe, each vector is placed once, beside the smallest id among its close bucket mates (its leader), and visits
the other leaders whose members it met; exact distances are taken wherever a vector is placed or visits, and the k best
of all places are merged. The tables reach close vectors only; ``all_neighbours`` scans all vectors for those without k
close ones.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillhawk.llm.textarrays import mix64
from quillhawk.llm.vectors import BLOCK_ROWS, block_pairs, exact_squares, matrices, matrix, packed, unit, unpacked, usual_length
from quillhawk.runtime import broadcast_if_small, map_arrow, stage, unstage


@dataclass(frozen=True)
class Hashing:
    """Tables, projections and bucket width; further buckets probed."""

    tables: int = 12
    projections: int = 24
    width: float = 2.0
    probes: int = 5
    seed: int = 7


#: A side of a join is broadcast up to so many rows: the driver holds it as a hash table of about 100 bytes a row.
SENT_ROWS = 200_000
#: Signs of random projections in a sketch, in four 64-bit words.
SIGNS = 256


def sign_limit(radius: float, deviations: float = 7.0) -> int:
    """Differing signs allowed to unit vectors at most ``radius`` apart: the mean at that distance and seven deviations."""
    p = 2 * math.asin(min(radius, 2.0) / 2) / math.pi
    return math.ceil(SIGNS * p + deviations * math.sqrt(SIGNS * p * (1 - p)))


@lru_cache(maxsize=4)
def probe_sets(projections: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (of the 2M distances to bucket borders, ascending) to cross, by expected squared distance."""
    m = projections
    z = [i * (i + 1) / (4 * (m + 1) * (m + 2)) if i <= m else 1 - (2 * m + 1 - i) / (m + 1) + (2 * m + 1 - i) * (2 * m + 2 - i) / (4 * (m + 1) * (m + 2)) for i in range(1, 2 * m + 1)]
    out, heap = [], [(z[0], (0,))]
    while heap and len(out) < probes:
        cost, s = heapq.heappop(heap)
        if not any(2 * m - 1 - i in s for i in s):
            out.append(s)
        if (last := s[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*s, last + 1)))
    return out


@lru_cache(maxsize=4)
def _directions(dim: int, h: Hashing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(h.seed)
    n = h.tables * h.projections
    return rng.normal(size=(dim, n)), rng.uniform(0, 1, n), rng.integers(1, 2**62, n), rng.normal(size=(dim, SIGNS))


def _rows(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and raw rows of valid vectors, given as lists or packed."""
    for b in batches:
        if pa.types.is_binary(b.schema.field(1).type):
            yield b.column(0), unpacked(b.column(1), dim)
        else:
            yield from matrices([b], dim)


def _keys(batches: Iterable[pa.RecordBatch], dim: int, h: Hashing, probes: int) -> Iterator[pa.RecordBatch]:
    a, shift, odd, _ = _directions(dim, h)
    m = h.projections
    for ids, raw in _rows(batches, dim):
        y = unit(raw) @ a / h.width + shift
        low = np.floor(y)
        part, cell = y - low, low.astype(np.int64)
        keys = []
        for t in range(h.tables):
            at = slice(t * m, (t + 1) * m)
            r = odd[at]
            key = (cell[:, at] * r).sum(axis=1) + t
            keys.append(key)
            if probes:
                p = part[:, at]
                order = np.argsort(np.concatenate([p, 1 - p], axis=1), axis=1)
                move = np.concatenate([-r, r])[order]
                keys += [key + move[:, list(s)].sum(axis=1) for s in probe_sets(m, probes)]
        flat = mix64(np.stack(keys, axis=1).view(np.uint64).ravel()).view(np.int64)
        for i in range(0, len(ids), 4096):
            some = ids.slice(i, 4096)
            yield pa.RecordBatch.from_arrays([pa.array(flat[i * len(keys) : (i + len(some)) * len(keys)]), some.take(pa.array(np.repeat(np.arange(len(some)), len(keys))))], names=["key", "id"])


def _signs(batches: Iterable[pa.RecordBatch], dim: int, h: Hashing) -> Iterator[pa.RecordBatch]:
    s = _directions(dim, h)[3]
    for ids, raw in _rows(batches, dim):
        bits = np.packbits(unit(raw) @ s > 0, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))], names=["id", "s0", "s1", "s2", "s3"])


def _pack(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for ids, raw in matrices(batches, dim):
        yield pa.RecordBatch.from_arrays([ids, packed(raw)], names=["id", "v"])


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``q`` its up to k nearest rows of ``x`` with another id (ties: smaller id): positions in q and x, squares."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(q), 500):
        part = q[a : a + 500]
        near = 2 - 2 * (part @ x.T)
        near[q_ids[a : a + 500][:, None] == x_ids[None, :]] = np.inf
        cut = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
        i, j = np.nonzero((near <= cut[:, None] + 1e-9) & np.isfinite(near))
        d = exact_squares(part[i], x[j])
        order = np.lexsort((x_ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, i, side="left")
        keep = np.arange(len(i)) - first < k
        out.append((i[keep] + a, j[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _rank(table: pa.Table, dim: int, k: int) -> pa.Table:
    """The k nearest per vector within a pair of blocks of one place; visitors ask but are no answers there."""
    flag = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    ids, v, left, visits = table.column("id").combine_chunks(), unit(unpacked(table.column("v"), dim)), flag("is_left"), flag("visits")
    plain = ids.to_numpy(zero_copy_only=False)
    one_block = table.column("left")[0].as_py() == table.column("right")[0].as_py()
    sides = [(np.ones(len(plain), bool), ~visits)] if one_block else [(left, ~left), (~left, left)]
    parts = []
    for a, b in sides:
        qa, xb = np.flatnonzero(a), np.flatnonzero(b)
        if not len(qa) or not len(xb):
            continue
        i, j, d = nearest(v[qa], plain[qa], v[xb], plain[xb], k)
        parts.append(pa.table([ids.take(pa.array(qa[i])), ids.take(pa.array(xb[j])), pa.array(np.sqrt(d))], names=["id", "neighbour", "distance"]))
    return pa.concat_tables(parts) if parts else pa.table([ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=["id", "neighbour", "distance"])


def _best(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _close_signs(limit: int) -> F.Column:
    """Whether the sketches (s0..s3) and (r0..r3) differ in at most ``limit`` signs."""
    return sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"r{i}"))) for i in range(1, 4)), F.bit_count(F.col("s0").bitwiseXOR(F.col("r0")))) <= limit


def near_neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 5, radius: float = 0.40, hashing: Hashing = Hashing(), block_rows: int = BLOCK_ROWS, dim: int | None = None, sent_rows: int = SENT_ROWS) -> DataFrame:
    """The k nearest of every vector among those its hash tables reach: (id, neighbour, distance, rank).

    Valid vectors have the table's most frequent length, finite components and are not all zero; others take no part,
    nor do null ids; ids are taken as unique. Distances are Euclidean between unit vectors in double precision, ties go
    to the smaller id. Copies are neighbours at distance 0. A pair met in a bucket counts as a candidate unless its sign
    sketches differ by seven deviations more than those of vectors ``radius`` apart do on average, so what is within
    ``radius`` isn't dropped. Nothing is capped: a place of more than ``block_rows`` vectors is cut into blocks, every
    pair of blocks is a task's group, and a visitor meets every block. Vectors with fewer than k others near them may
    come out with fewer than k rows or none: see ``all_neighbours``. With ``dim`` the vectors are packed ones of that
    length, all valid. Tables of up to ``sent_rows`` are broadcast, larger ones joined by shuffles whose files are deleted
    after each step; both ways give equal rows.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    id_type, is_packed = source.schema["id"].dataType.simpleString(), dim is not None
    dim = dim if is_packed else usual_length(source, "v")
    keys = lambda probes: map_arrow(source, partial(_keys, dim=dim, h=hashing, probes=probes), f"key bigint, id {id_type}")
    signs = stage(map_arrow(source, partial(_signs, dim=dim, h=hashing), f"id {id_type}, s0 bigint, s1 bigint, s2 bigint, s3 bigint"), "signs")
    rows = signs.count()
    ours = broadcast_if_small(signs, rows, sent_rows)
    theirs = broadcast_if_small(signs.select(F.col("id").alias("mate"), *[F.col(f"s{i}").alias(f"r{i}") for i in range(4)]), rows, sent_rows)
    close = _close_signs(sign_limit(radius))
    first = keys(0).groupBy("key").agg(F.min("id").alias("mate"), F.count(F.lit(1)).alias("n"))
    asked = rows * hashing.tables * (1 + hashing.probes)
    met = stage(keys(hashing.probes).join(first, "key").where("n > 1 or id <> mate").select("key", "id", "mate"), "met", shuffled=24 * asked, tidy=True)
    links = met.where("id <> mate").groupBy("id").agg(F.collect_set("mate").alias("mates"))  # at most tables * (1 + probes) of them
    links = links.select("id", F.explode("mates").alias("mate")).join(ours, "id").join(theirs, "mate").where(close)
    lead = stage(links.groupBy("id").agg(F.min("mate").alias("m")).select("id", F.least("id", "m").alias("leader")), "lead", shuffled=24 * asked, tidy=True)
    jump = lead.select(F.col("id").alias("leader"), F.col("leader").alias("top"))
    placed = signs.select("id").join(lead, "id", "left").select("id", F.coalesce("leader", "id").alias("leader")).join(jump, "leader", "left").select("id", F.coalesce("top", "leader").alias("leader"))
    placed = stage(placed, "placed", shuffled=16 * rows, tidy=True)
    unstage(lead)
    at = broadcast_if_small(placed, rows, sent_rows)
    home = keys(0).join(at, "id")
    span = home.groupBy("key").agg(F.min("leader").alias("low"), F.max("leader").alias("high"))
    strays = met.select("key", "id").join(at, "id").join(span, "key").where("low <> leader or high <> leader").select("key", "id", "leader")  # a bucket of the own place only has nothing to visit
    held = [met]
    if rows > sent_rows:  # the joins so far shuffle; their files go before the next
        strays = stage(strays, "strays", shuffled=24 * asked, tidy=True)
        unstage(met)
        held = [strays]
    hosts = home.select("key", F.col("id").alias("mate"), F.col("leader").alias("host"))
    visits = strays.join(ours, "id").join(hosts.join(theirs, "mate"), "key").where((F.col("host") != F.col("leader")) & close).select("id", F.col("host").alias("leader")).distinct()
    visits = stage(visits, "visits", shuffled=48 * asked, tidy=True)
    unstage(*held)
    sizes = placed.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).join(visits.select("leader").distinct().withColumn("visited", F.lit(True)), "leader", "left")
    places = sizes.where("n > 1 or visited").select("leader", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    alone = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(j.alias("left"), j.alias("right"), F.lit(True).alias("is_left")))
    stay = placed.join(places, "leader").select("id", "leader", F.explode(block_pairs(block, F.col("blocks"))).alias("p"), F.lit(False).alias("visits"))
    come = visits.join(places, "leader").select("id", "leader", F.explode(alone).alias("p"), F.lit(True).alias("visits"))
    seats = stage(stay.unionByName(come).select("id", "leader", "p.left", "p.right", "p.is_left", "visits"), "seats", shuffled=32 * rows, tidy=True)
    vectors = source if is_packed else map_arrow(source, partial(_pack, dim=dim), f"id {id_type}, v binary")
    out = vectors.join(broadcast_if_small(seats, seats.count(), sent_rows), "id").groupBy("leader", "left", "right").applyInArrow(lambda t: _rank(t, dim, k), f"id {id_type}, neighbour {id_type}, distance double")
    out = stage(out, "near", shuffled=(4 * dim + 40) * rows, tidy=True)
    unstage(signs, placed, visits, seats)
    return _best(out, k)


def _exact(q: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squares of the distances of the pairs (i, j), ``q`` raw and ``x`` of unit length, in parts of bounded size."""
    out = np.empty(len(i))
    for a in range(0, len(i), 10_000):
        at = slice(a, a + 10_000)
        out[at] = exact_squares(unit(q[i[at]].astype(np.float64)), x[j[at]])
    return out


def _scan_short(batches: Iterable[pa.RecordBatch], shared, dim: int, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The task's k nearest rows per query. Single precision finds what may be among them, double precision ranks."""
    q_ids, raw = shared.value
    rough = np.concatenate([unit(raw[a : a + 2000].astype(np.float64)).astype(np.float32) for a in range(0, len(raw), 2000)])
    bound = np.full(len(raw), np.inf)
    held = (np.zeros(0, np.int64), np.zeros(0, q_ids.dtype), np.zeros(0))
    for b in batches:
        for c in range(0, b.num_rows, 4000):
            some = b.slice(c, 4000)
            plain, x = some.column(0).to_numpy(zero_copy_only=False), unit(unpacked(some.column(1), dim))
            turned = np.ascontiguousarray(x.T, dtype=np.float32)
            found = [held]
            for a in range(0, len(raw), 1000):
                near = 2 - 2 * (rough[a : a + 1000] @ turned)
                cut = bound[a : a + 1000]
                if np.isinf(cut).any() and len(plain) > k:  # one more than k: the query itself may be there
                    cut = np.minimum(cut, np.partition(near, k, axis=1)[:, k])
                i, j = np.nonzero(near <= (cut + 1e-5).astype(np.float32)[:, None])
                other = q_ids[i + a] != plain[j]
                i, j = i[other] + a, j[other]
                found.append((i, plain[j], _exact(raw, i, x, j)))
            i, mate, d = (np.concatenate(f) for f in zip(*found))
            order = np.lexsort((mate, d, i))
            i, mate, d = i[order], mate[order], d[order]
            at = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            held = (i[at < k], mate[at < k], d[at < k])
            bound[i[at == k - 1]] = d[at == k - 1]
    i, mate, d = held
    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i], kind), pa.array(mate, kind), pa.array(np.sqrt(d))], names=["id", "neighbour", "distance"])


def all_neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 5, sure: float = 0.40, hashing: Hashing = Hashing(), block: int = 10_000, slice_rows: int = 200_000) -> DataFrame:
    """The k nearest of every valid vector: (id, neighbour, distance, rank).

    A vector with k neighbours within ``sure`` among those of ``near_neighbours`` keeps them. Every other vector is
    compared with all vectors: such vectors are sent to the executors in blocks of ``block`` rows, one after the other, each
    one pass over the packed table in slices of about ``slice_rows``, so the cost grows as their number times the rows. Validity,
    distances and ties as in ``near_neighbours``; fewer than k rows come out only if there are no k other valid vectors.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    dim, kind = usual_length(source, "v"), source.schema["id"].dataType
    schema = f"id {kind.simpleString()}, neighbour {kind.simpleString()}, distance double"
    vectors = stage(map_arrow(source, partial(_pack, dim=dim), f"id {kind.simpleString()}, v binary"), "vectors", "zstd")
    near = stage(near_neighbours(vectors, "id", "v", k, sure, hashing, dim=dim), "near", tidy=True)
    done = near.where(F.col("distance") <= sure).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id")
    short = stage(vectors.select("id").join(done, "id", "left_anti"), "short", tidy=True)
    rows, asked = vectors.count(), short.count()
    passes = -(-asked // block)
    out = near.join(done, "id", "left_semi")
    if not passes:
        return out
    queries = vectors.join(broadcast_if_small(short, asked, SENT_ROWS), "id", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(passes)).cast("int"))
    if passes > 8:  # a block's rows together; fewer passes may each read all
        queries = queries.repartitionByRange("block").sortWithinPartitions("block")
    queries = stage(queries, "queries", "zstd", tidy=True)
    slices = max(-(-rows // slice_rows), 2 * spark.sparkContext.defaultParallelism)
    for p in range(passes):
        some = queries.where(F.col("block") == p).select("id", "v").toArrow()  # about ``block`` rows
        if some.num_rows:
            sent = spark.sparkContext.broadcast((some.column("id").to_numpy(), unpacked(some.column("v"), dim, np.float32)))
            found = map_arrow(vectors.coalesce(slices), partial(_scan_short, shared=sent, dim=dim, k=k, kind=to_arrow_type(kind)), schema)
            out = out.unionByName(stage(_best(found, k), "scanned", tidy=True))
            sent.destroy()  # one block is held at a time
    return out


def _scan(batches: Iterable[pa.RecordBatch], shared, dim: int, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    q_ids, q = shared.value
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best() -> tuple[np.ndarray, ...]:
        i, other, d = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((other, d, i))
        i, other, d = i[order], other[order], d[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        return i[keep], other[keep], d[keep]

    for ids, raw in matrices(batches, dim):
        plain = ids.to_numpy(zero_copy_only=False)
        x = unit(raw)
        for a in range(0, len(x), 4000):
            i, j, d = nearest(q, q_ids, x[a : a + 4000], plain[a : a + 4000], k)
            held.append((i, plain[a : a + 4000][j], d))
            held = [best()]
    if held:
        i, other, d = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i], kind), pa.array(other, kind), pa.array(np.sqrt(d))], names=["id", "neighbour", "distance"])


def scan_neighbours(df: DataFrame, id_col: str, vector_col: str, queries: F.Column, k: int = 5, block: int = 20_000) -> DataFrame:
    """The exact k nearest of a stated set of queries among all valid vectors: (id, neighbour, distance, rank).

    The queries are sent to the executors in blocks of ``block`` rows, each block one pass over the table; every task
    keeps k rows per query. Validity, distances and ties as in ``near_neighbours``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    dim, kind = usual_length(source, "v"), source.schema["id"].dataType
    asked = df.where(queries).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    parts, held = [], []

    def close() -> None:
        nonlocal held
        sent = spark.sparkContext.broadcast((np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])))
        found = map_arrow(source, partial(_scan, shared=sent, dim=dim, k=k, kind=to_arrow_type(kind)), f"id {kind.simpleString()}, neighbour {kind.simpleString()}, distance double")
        parts.append(stage(_best(found, k), "scanned"))
        sent.destroy()  # one block is held at a time
        held = []

    n_parts = max(1, -(-asked.count() // block))
    for p in range(n_parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_parts)) == p).toArrow()  # about ``block`` rows
        for b in some.to_batches():
            ids, raw = matrix(b.column(0), b.column(1), dim)
            if len(ids):
                held.append((ids.to_numpy(zero_copy_only=False), unit(raw)))
        if held:
            close()
    if not parts:
        return spark.createDataFrame([], f"id {kind.simpleString()}, neighbour {kind.simpleString()}, distance double, rank int")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
