"""Batched ranked retrieval: sparse cosine over postings and exact vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillhawk.functions.vector import as_double, cosine, l2_distance
from quillhawk.runtime import broadcast_if_small, map_arrow, stage

#: Queries that are sent to every executor at once; more are taken in blocks, each one pass over the vectors.
MOST_QUERIES = 20_000


def check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def top_k(scored: DataFrame, query: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k best rows of each query with their ``rank``; equal scores go by ``tie``. Partial ranks run before the shuffle."""
    check_k(k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(score, F.col(tie)))).where(F.col("rank") <= k)


def candidates(queries: DataFrame, postings: DataFrame, query: str, item: str) -> DataFrame:
    """(query, item) pairs that share a codeword in which the query is above zero."""
    q = queries.where("weight > 0").select(query, "idx")
    return postings.where("weight > 0").select(item, "idx").join(broadcast_if_small(q, q.count()), "idx").select(query, item).distinct()


def sparse_cosine(queries: DataFrame, items: DataFrame, query: str, item: str) -> DataFrame:
    """(query, item, score): cosine over shared components of (id, idx, weight) tables with weights above zero."""
    rows_q, rows_i = stage(queries.where("weight > 0").select(query, "idx", "weight"), "asked"), items.where("weight > 0")

    def norms(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(name))

    q = rows_q.join(norms(rows_q, query, "nq"), query).select(query, "idx", (F.col("weight") / F.col("nq")).alias("wq"))
    i = rows_i.select(item, "idx", F.col("weight").alias("wi"))
    dots = i.join(broadcast_if_small(q, rows_q.count()), "idx").groupBy(query, item).agg(F.sum(F.col("wq") * F.col("wi")).alias("dot"))
    return dots.join(norms(rows_i, item, "ni"), item).select(query, item, F.round(F.col("dot") / F.col("ni"), 8).alias("score"))


def text_search(queries: DataFrame, items: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, rank, item, score): the k best by cosine; scores of zero are dropped after the cut, not before."""
    ranked = top_k(sparse_cosine(queries, items, query, item), query, F.desc("score"), item, k)
    return ranked.where("score > 0").select(query, "rank", item, "score")


def first_per_document(hits: DataFrame, query: str, item: str, document: Column, k: int) -> DataFrame:
    """(query, rank, document, item, score): of 3k hits the best item of each document, then the first k."""
    w = Window.partitionBy(query)
    best = hits.withColumn("document", document).withColumn("__n", F.row_number().over(Window.partitionBy(query, "document").orderBy("rank"))).where("__n = 1")
    ranked = best.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), item))).where(F.col("rank") <= k)
    return ranked.select(query, "rank", "document", item, F.round("score", 4).alias("score"))


def _plain(ids: pa.Array) -> np.ndarray:
    """Ids as a sortable array: numbers, or text in code-point order."""
    return np.array(ids.to_pylist(), dtype=str) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else ids.to_numpy(zero_copy_only=False)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if len(column) and pc.min(pc.list_value_length(column)).as_py() != pc.max(pc.list_value_length(column)).as_py() or len(column) and len(column[0]) != dim:
        raise ValueError("vectors must have the same length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(q: np.ndarray, x: np.ndarray, same: np.ndarray | None, x_ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in q and x and the rounded scores of the k best rows of x for every row of q."""
    if metric == "l2":
        rough = q @ x.T  # in place: fresh blocks cost more than their sums
        rough *= -2
        rough += (q * q).sum(axis=1)[:, None]
        rough += (x * x).sum(axis=1)
    else:
        n = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))
        rough = -np.divide(q @ x.T, n, out=np.zeros((len(q), len(x))), where=n > 0)
    if same is not None:
        rough = np.where(same, np.inf, rough)
    cut = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
    scale = 1e-6 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
    at = np.flatnonzero(rough <= (cut + scale)[:, None])
    i, j = np.divmod(at[np.isfinite(rough.ravel()[at])], len(x))
    if metric == "l2":
        d = q[i] - x[j]
        score = np.round(np.sqrt((d * d).sum(axis=1)), 8)
    else:
        score = np.round(-rough[i, j], 8)
    order = np.lexsort((x_ids[j], score if metric == "l2" else -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[keep], j[keep], score[keep]


def _meetings(part: pa.RecordBatch, probed: dict[int, np.ndarray] | None, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of queries and of the part's rows that meet: all, or those of each cell."""
    if probed is None:
        yield np.arange(queries), np.arange(part.num_rows)
        return
    cells = part.column(2).to_numpy(zero_copy_only=False)
    for c in np.unique(cells):
        if len(asked := probed.get(int(c), ())):
            yield asked, np.nonzero(cells == c)[0]


def _scan(batches: Iterable[pa.RecordBatch], shared, k: int, metric: str, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    """The task's k best rows per query."""
    q_arrow, q_ids, q, probed = shared.value
    held: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            ids, x = part.column(0), _vectors(part.column(1), q.shape[1])
            plain = _plain(ids)
            for asked, rows in _meetings(part, probed, len(q)):
                for b in range(0, len(asked), 500):
                    few = asked[b : b + 500]
                    same = q_ids[few][:, None] == plain[rows][None, :] if exclude_self else None
                    i, j, score = _best(q[few], x[rows], same, plain[rows], k, metric)
                    held.append((few[i], ids.take(pa.array(rows[j])), plain[rows[j]], score))
            if not held:
                continue
            i, some, plain, score = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            order = np.lexsort((plain, score if metric == "l2" else -score, i))
            order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order], side="left") < k]
            held = [(i[order], some.take(pa.array(order)), plain[order], score[order])]
    if held:
        i, some, _, score = held[0]
        yield pa.RecordBatch.from_arrays([q_arrow.take(pa.array(i)), some, pa.array(score)], names=["query_id", "id", "score"])


def vector_search(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "l2", exclude_self: bool = False, block: int = MOST_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): exact neighbours of a stated set of queries among all vectors.

    The queries are sent to the executors in blocks of about ``block`` rows and meet every stored vector in matrix
    products; each task keeps its k best per query, so the shuffle is of k rows a query and task. ``l2`` ranks by distance,
    ``cosine`` by similarity (0 for a zero vector); scores have eight places, ties go to the smaller id. Null ids and null
    vectors take no part; vectors of another length than the queries are an error.
    """
    check_k(k)
    rows = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
    asked = queries.where(rows).select(F.col(id_col).alias("id"), as_double(F.col(vector_col)).alias("v"))
    stored = base.where(rows).select(F.col(id_col).alias("id"), as_double(F.col(vector_col)).alias("v"))
    return best_stored(asked, stored, k, metric, exclude_self, block)


def best_stored(asked: DataFrame, stored: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, block: int = MOST_QUERIES, probe: Callable[[np.ndarray], dict[int, np.ndarray]] | None = None) -> DataFrame:
    """``vector_search`` of (id, v) among stored (id, v), both without nulls.

    With ``probe`` the stored rows have a cell as third column, and a query meets only those of its own cells: ``probe``
    gives, for a matrix of queries, the positions of those that meet each cell.
    """
    spark, kind = stored.sparkSession, stored.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, score double"
    best = F.asc("score") if metric == "l2" else F.desc("score")
    parts = max(1, -(-asked.count() // block))
    if parts > 1:
        asked = stage(asked, "asked")
    scored = spark.createDataFrame([], schema)
    for p in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p) if parts > 1 else asked
        held = some.toArrow().combine_chunks()  # about ``block`` rows
        if not held.num_rows:
            continue
        ids, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (held.column("id"), held.column("v")))
        ids, v = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, v))
        q = _vectors(v, len(v[0]))
        shared = spark.sparkContext.broadcast((ids, _plain(ids), q, probe(q) if probe else None))
        found = map_arrow(stored, partial(_scan, shared=shared, k=k, metric=metric, exclude_self=exclude_self), schema)
        if parts > 1:  # one block of queries is held at a time
            found = stage(top_k(found, "query_id", best, "id", k).drop("rank"), "scored")
            shared.destroy()
        scored = found if p == 0 else scored.unionByName(found)
    ranked = top_k(scored, "query_id", best, "id", k)
    return ranked.select("query_id", "rank", "id", "score")


def search_records(records: DataFrame, query: list[float], k: int, modality: str) -> DataFrame:
    """Stateless search: validates the records, then ranks them for one query (text by cosine, others by distance)."""
    from quillhawk.operators.index import require_modality, require_unique, split_records

    check_k(k)
    good, bad = split_records(records)
    if bad.limit(1).count():
        raise ValueError("a record is not valid")
    require_modality(records, modality)
    require_unique(records)
    if good.where(F.size("histogram") != len(query)).limit(1).count():
        raise ValueError("the query has another length than the records")
    q = F.array(*[F.lit(float(x)) for x in query])
    if modality == "text":
        shared = F.exists(F.zip_with("histogram", q, lambda a, b: (a > 0) & (b > 0)), lambda x: x)
        scored = good.where(shared).select("chunk_id", "metadata", F.round(cosine(q, F.col("histogram")), 8).alias("score"))
        return scored.orderBy(F.desc("score"), "chunk_id").limit(k).where("score > 0")
    return good.select("chunk_id", "metadata", F.round(l2_distance(q, F.col("histogram")), 8).alias("score")).orderBy("score", "chunk_id").limit(k)
