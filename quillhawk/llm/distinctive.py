"""How characteristic each term is of its record: hypergeometric enrichment, adjusted for false discoveries.

Of N term occurrences in the collection K are the term; a record of n occurrences holds it k times. The p-value is
P(X >= k) for X hypergeometric (N, K, n), summed exactly from log-gamma differences. Within each record the p-values of
its terms are adjusted by Benjamini and Hochberg; the score is the negative decimal logarithm of the adjusted value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillhawk.llm.frequencies import ngram_frequencies
from quillhawk.llm.textarrays import blocks, text_batches, tokens
from quillhawk.runtime import broadcast_if_small, map_arrow, stage

#: Statistics of up to so many terms are sent to every executor (24 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
#: In that join a term held by more records than this is spread over several keys.
SPREAD_RECORDS = 100_000

_FACT = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 4096, dtype=np.float64)))))


def _stirling(x: np.ndarray) -> np.ndarray:
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def ln_fact(x: np.ndarray) -> np.ndarray:
    """ln x! of whole numbers, from a table below 4,096 and by Stirling's series above."""
    x = np.asarray(x, dtype=np.float64)
    big = np.maximum(x, 4095.0)
    return np.where(x < 4096, _FACT[np.minimum(x, 4095).astype(np.int64)], (big + 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + _stirling(big))


def ln_fall(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln (a! / (a - n)!), precise also where a is much larger than n."""
    a, n = np.broadcast_arrays(np.asarray(a, dtype=np.float64), np.asarray(n, dtype=np.float64))
    out = np.empty(a.shape)
    small = a < 4096
    out[small] = _FACT[a[small].astype(np.int64)] - _FACT[(a - n)[small].astype(np.int64)]
    a, n = a[~small], n[~small]
    rest = a - n
    far = rest >= 64
    big = np.where(far, rest, 64.0)
    m = np.where(far, n, a - 64.0)
    top = m * np.log(a) - (big + 0.5) * np.log1p(-m / a) - m + _stirling(a) - _stirling(big)
    out[~small] = top + np.where(far, 0.0, _FACT[64] - _FACT[np.minimum(rest, 64).astype(np.int64)])
    return out


def ln_upper_tail(total: int, term: np.ndarray, length: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ln P(X >= count) for X hypergeometric with ``total`` items, ``term`` marked ones and ``length`` draws."""
    N, K, n, k = float(total), *(np.asarray(x, dtype=np.float64) for x in (term, length, count))

    def pmf(j: np.ndarray, K: np.ndarray, n: np.ndarray) -> np.ndarray:
        return ln_fall(K, j) - ln_fact(j) + ln_fall(n, j) + ln_fall(N - K, n - j) - ln_fall(np.full_like(K, N), n)

    out = np.zeros(len(k))
    sure = (k <= 0) | (k <= n + K - N)
    low = ~sure & ((k <= 1) | (k <= n * K / N))
    high = ~sure & ~low
    for at, up in ((np.flatnonzero(low), False), (np.flatnonzero(high), True)):
        if not len(at):
            continue
        K1, n1 = K[at], n[at]
        j = k[at] - (not up)
        start = pmf(j, K1, n1)
        total_1, t, go = np.ones(len(at)), np.ones(len(at)), np.arange(len(at))
        j = j.copy()
        while len(go):
            i, a, b = j[go], K1[go], n1[go]
            if up:
                r = (a - i) * (b - i) / ((i + 1) * (N - a - b + i + 1))
            else:
                r = i * (N - a - b + i) / ((a - i + 1) * (b - i + 1))
            t[go] *= np.maximum(r, 0)
            total_1[go] += t[go]
            j[go] += 1 if up else -1
            go = go[t[go] > 1e-17 * total_1[go]]
        value = start + np.log(total_1)
        out[at] = value if up else np.log(np.maximum(-np.expm1(np.minimum(value, 0.0)), 1e-300))
    return np.minimum(out, 0.0)


def adjust(ln_p: np.ndarray, record: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg within each record, of logarithms; ``record`` is grouped (equal values stand together)."""
    if not len(ln_p):
        return ln_p
    order = np.lexsort((ln_p, record))
    rec = record[order]
    first = np.concatenate(([True], rec[1:] != rec[:-1]))
    at = np.flatnonzero(first)
    width = np.diff(np.append(at, len(rec)))
    group = np.cumsum(first) - 1
    v = ln_p[order] + np.log(width[group]) - np.log(np.arange(len(rec)) - at[group] + 1)
    step = 1
    while step < width.max():
        same = rec[step:] == rec[:-step]
        v[:-step] = np.where(same, np.minimum(v[:-step], v[step:]), v[:-step])
        step *= 2
    out = np.empty(len(v))
    out[order] = np.minimum(v, 0.0)
    return out


_SCORED = "count bigint, length bigint, occurrences bigint, records bigint, p_value double, score double"


def _scored(batches: Iterable[pa.RecordBatch], shared, total: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    known, occurrences, records = shared.value
    for ids, texts in blocks(text_batches(batches)):
        tok = tokens(texts)
        if not len(tok.hash):
            continue
        idx = np.searchsorted(known, tok.hash)
        pair, at, count = np.unique(tok.doc * len(known) + idx, return_index=True, return_counts=True)
        doc, idx = pair // len(known), pair % len(known)
        length = tok.counts()[doc]
        ln_p = ln_upper_tail(total, occurrences[idx], length, count)
        score = -adjust(ln_p, doc) / np.log(10)
        used, example, back = np.unique(idx, return_index=True, return_inverse=True)
        words = pa.array([tok.word(i) for i in at[example].tolist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind).take(pa.array(doc)), words.take(pa.array(back)), *(pa.array(x) for x in (count.astype(np.int64), length.astype(np.int64), occurrences[idx], records[idx], np.exp(ln_p), score + 0.0))],
            names=["id", "term", "count", "length", "occurrences", "records", "p_value", "score"],
        )


def _pairs(batches: Iterable[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Terms with their counts; ``text_key`` tells rows of one id apart."""
    keyed = ((list(zip(b.column(0).to_pylist(), b.column(2).to_pylist())), [t or "" for t in b.column(1).to_pylist()]) for b in batches)
    for keys, texts in blocks(keyed):
        ids, text_keys = zip(*keys)
        tok = tokens(texts)
        if not len(tok.hash):
            continue
        used, idx = np.unique(tok.hash, return_inverse=True)
        pair, at, count = np.unique(tok.doc * len(used) + idx, return_index=True, return_counts=True)
        doc = pair // len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind).take(pa.array(doc)), pa.array(text_keys, pa.int64()).take(pa.array(doc)), pa.array([tok.word(i) for i in at.tolist()], pa.string()), pa.array(count.astype(np.int64)), pa.array(tok.counts()[doc].astype(np.int64))],
            names=["id", "text_key", "term", "count", "length"],
        )


def _tails(batches: Iterable[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ln_p = ln_upper_tail(total, *(b.column(c).to_numpy() for c in ("occurrences", "length", "count")))
        yield b.append_column("ln_p", pa.array(ln_p))


def term_scores(df: DataFrame, id_col: str, text_col: str, broadcast_terms: int = BROADCAST_TERMS, spread_records: int = SPREAD_RECORDS) -> DataFrame:
    """Every distinct term of every record with its score: (id, term, count, length, occurrences, records, p_value, score).

    ``count`` is within the record, ``length`` the record's term occurrences, ``occurrences`` and ``records`` those of the
    whole collection. Texts that are null or without letters give no rows; each row is a record, so a repeated id is
    scored once for each of its rows; equal p-values share the better rank's adjustment. Up to ``broadcast_terms``
    distinct terms their statistics are sent to the executors and no pair is shuffled (terms are told apart by 64-bit
    hashes); beyond, pairs meet the statistics in a shuffle join, in which frequent terms are spread over several keys.
    Both ways give equal scores; rows of one id and one text count as one another's copies in the second, which changes no
    adjusted value.
    """
    df = df.where(F.col(id_col).isNotNull())
    table, _, total = ngram_frequencies(df, id_col, text_col, 1)
    spark, n_terms = df.sparkSession, table.count()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(source.schema["id"].dataType)
    if n_terms <= broadcast_terms:
        stats = table.select("term", "occurrences", "records").toArrow()
        terms = stats.column("term").to_pylist()
        h = np.concatenate([tokens(terms[i : i + 50_000]).hash for i in range(0, len(terms), 50_000)] or [np.zeros(0, np.uint64)])
        order = np.argsort(h)
        arrays = (h[order], *(stats.column(c).to_numpy()[order] for c in ("occurrences", "records")))
        shared = spark.sparkContext.broadcast(arrays)
        return map_arrow(source, partial(_scored, shared=shared, total=total, kind=kind), f"id {id_type}, term string, {_SCORED}")
    pairs = map_arrow(source.withColumn("text_key", F.xxhash64("text")), partial(_pairs, kind=kind), f"id {id_type}, text_key bigint, term string, count bigint, length bigint")
    salts = F.ceil(F.col("records") / spread_records).cast("int")
    hot = stage(table.where(F.col("records") > spread_records).select("term", salts.alias("salts")), "hot")  # few: each is held by many records
    pairs = pairs.join(broadcast_if_small(hot, hot.count()), "term", "left").withColumn("salt", F.pmod(F.xxhash64("id", "text_key"), F.coalesce("salts", F.lit(1))).cast("int"))
    stats = table.select("term", "occurrences", "records", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    joined = pairs.join(stats, ["term", "salt"]).select("id", "text_key", "term", "count", "length", "occurrences", "records")
    joined = map_arrow(joined, partial(_tails, total=total), StructType([*joined.schema.fields, StructField("ln_p", DoubleType())]))
    w = Window.partitionBy("id", "text_key")
    ranked = joined.withColumn("v", F.col("ln_p") + F.log(F.count(F.lit(1)).over(w)) - F.log(F.row_number().over(w.orderBy("ln_p", "term"))))
    best = F.min("v").over(w.orderBy("ln_p", "term").rowsBetween(0, Window.unboundedFollowing))
    return ranked.select("id", "term", "count", "length", "occurrences", "records", F.exp("ln_p").alias("p_value"), (-F.least(best, F.lit(0.0)) / F.log(F.lit(10.0))).alias("score"))
