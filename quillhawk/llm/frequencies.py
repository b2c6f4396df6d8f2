"""Occurrences and record counts of every n-gram, from suffix arrays of blocks of records.

Each task sorts the suffixes of a block of whole records (prefix doubling up to ``max_n`` tokens). Runs of suffixes whose
common prefix holds at least n tokens are the intervals of the n-grams: an interval's width is the occurrences, its width
less the adjacent suffixes of one record within it is the number of records. Records never span blocks, so the counts of
all blocks add up; they are summed per block before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.llm.textarrays import Tokens, blocks, text_batches, tokens
from quillhawk.runtime import map_arrow, stage

_SCHEMA = "n int, term string, occurrences bigint, records bigint"
_BLOCK = 2_000_000


def suffix_array(tok: Tokens, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``max_n`` tokens, and the tokens each shares with the one before (to max_n)."""
    size = len(tok.hash)
    order = np.argsort(tok.hash, kind="stable")
    word = np.empty(size, dtype=np.int64)
    word[order] = np.cumsum(np.concatenate(([1], tok.hash[order][1:] != tok.hash[order][:-1])))
    left = np.cumsum(tok.counts())[tok.doc] - np.arange(size)
    rank, depth = word, 1
    while depth < max_n:
        then = np.zeros(size, dtype=np.int64)
        has = np.flatnonzero(left > depth)
        then[has] = rank[has + depth]
        order = np.lexsort((then, rank))
        new = (rank[order][1:] != rank[order][:-1]) | (then[order][1:] != then[order][:-1])
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], new)))
        depth *= 2
    common = np.zeros(size, dtype=np.int64)
    same = np.ones(max(size - 1, 0), dtype=bool)
    for d in range(max_n):
        a, b = order[:-1], order[1:]
        same &= (left[a] > d) & (left[b] > d)
        at = np.flatnonzero(same)
        same[at] = word[a[at] + d] == word[b[at] + d]
        common[1:] += same
    return order, common


def block_counts(tok: Tokens, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n: n, where an example of each n-gram starts, its occurrences and its records."""
    if not len(tok.hash):
        return
    order, common = suffix_array(tok, max_n)
    left = (np.cumsum(tok.counts())[tok.doc] - np.arange(len(order)))[order]
    doc = tok.doc[order]
    by_doc = np.argsort(doc, kind="stable")
    before, after = by_doc[:-1], by_doc[1:]
    one_doc = doc[before] == doc[after]
    before, after = before[one_doc], after[one_doc]
    for n in range(1, max_n + 1):
        first = common < n
        first[0] = True
        run = np.cumsum(first) - 1
        wide = np.bincount(run[left >= n], minlength=run[-1] + 1)
        again = run[before] == run[after]
        twice = np.bincount(run[after[again]], minlength=len(wide))
        keep = wide > 0
        yield n, order[np.flatnonzero(first)][keep], wide[keep], (wide - np.where(keep, twice, 0))[keep]


def _counts(batches: Iterable[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in blocks(text_batches(batches), _BLOCK):
        tok = tokens(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([None], pa.string()), pa.array([len(tok.hash)], pa.int64()), pa.array([len(ids)], pa.int64())],
            names=["n", "term", "occurrences", "records"],
        )
        for n, at, wide, records in block_counts(tok, max_n):
            words = [" ".join(tok.word(i + j) for j in range(n)) for i in at.tolist()] if n > 1 else [tok.word(i) for i in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(words, pa.string()), pa.array(wide.astype(np.int64)), pa.array(records.astype(np.int64))],
                names=["n", "term", "occurrences", "records"],
            )


def ngram_frequencies(df: DataFrame, id_col: str, text_col: str, max_n: int = 1) -> tuple[DataFrame, int, int]:
    """Every n-gram of terms up to ``max_n`` with its occurrences and the number of records that hold it.

    A term is a longest run of letters of the lower-cased text; an n-gram's terms are joined by one blank. Returns the
    staged table (n, term, occurrences, records), the number of records and the number of term occurrences. Null and
    empty texts count as records without terms; each input row is a record, so repeated rows count again. An empty table
    gives an empty result.
    """
    found = map_arrow(df.select(F.col(id_col), F.col(text_col)), partial(_counts, max_n=max_n), _SCHEMA)
    summed = found.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    table = stage(summed, "ngrams")
    total = table.where("n = 0").select("records", "occurrences").first()
    return table.where("n > 0"), *(total or (0, 0))


def mark_frequencies(table: DataFrame, records: int, rare_records: int = 2, common_share: float = 0.35) -> DataFrame:
    """Adds ``marks``: ``rare`` (at most ``rare_records`` records), ``common`` (more than ``common_share`` of all), both or none."""
    rare = F.when(F.col("records") <= rare_records, F.lit("rare"))
    common = F.when(F.col("records") > common_share * records, F.lit("common"))
    return table.withColumn("marks", F.array_compact(F.array(rare, common)))
