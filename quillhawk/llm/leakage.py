"""Evaluation items inside training documents, by a generalised suffix automaton of the items.

The automaton holds every run of words of every item; it is built once and sent to the executors, which stream their
documents through it and track the longest match. Items with more words than ``MOST_WORDS`` together are taken in shards
of that size, one automaton each, and ``TOGETHER`` of them take one pass over the documents, so what is sent and held for a
pass stays bounded; the spans of a pass are staged and its automata given up before the next are built.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.llm.textarrays import blocks, text_batches, tokens
from quillhawk.runtime import map_arrow, stage

#: Words of the items of one automaton (about 1 kB each at the worst), and automata taken through the documents together.
MOST_WORDS, TOGETHER = 50_000, 4
#: Soft hyphen, zero-width space, non-joiner, joiner, byte order mark: fixed values of the task.
_INVISIBLE = re.compile("[­​‌‍﻿]")


def _bare(text: str) -> str:
    return _INVISIBLE.sub("", text)


class Automaton:
    """States as parallel lists: transitions by word, suffix link, longest length, items that hold the state's runs."""

    def __init__(self, items: list[tuple[int, list[int]]], run: int) -> None:
        self.run = run
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        holds: list[set[int]] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w, holds)
                holds[last].add(item)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[v] > 0:
                holds[self.link[v]] |= holds[v]
        up = [0] * len(self.size)
        shorts: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for item, words in items:
            if 0 < len(words) < run:
                v = 0
                for w in words:
                    v = self.next[v][w]
                shorts[v].append((len(words), item))
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            up[v] = v if self.size[self.link[v]] < run else up[self.link[v]]
            shorts[v] = shorts[v] + shorts[self.link[v]]
        self.found = [tuple(sorted(holds[up[v]])) if self.size[v] >= run else () for v in range(len(self.size))]
        self.shorts = [tuple(s) for s in shorts]

    def _extend(self, last: int, w: int, holds: list[set[int]]) -> int:
        nxt, link, size = self.next, self.link, self.size

        def clone(p: int, q: int) -> int:
            c = len(size)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            holds.append(set())
            link[q] = c
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            return c

        q = nxt[last].get(w)
        if q is not None:
            return q if size[q] == size[last] + 1 else clone(last, q)
        new = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        holds.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if size[q] == size[p] + 1 else clone(p, q)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(item, first word, word after the last) of every shared run of ``run`` words and of every whole short item."""
        nxt, link, size, run, found, shorts = self.next, self.link, self.size, self.run, self.found, self.shorts
        v = n = 0
        for at, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = size[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            if n >= run:
                for item in found[v]:
                    yield item, at + 1 - run, at + 1
            if shorts[v]:
                for k, item in shorts[v]:
                    if n >= k:
                        yield item, at + 1 - k, at + 1


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(batches: Iterable[pa.RecordBatch], shared, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Every block of documents is tokenised once and streamed through all automata in ``shared``."""
    for ids, texts in blocks(text_batches(batches)):
        texts = [_bare(t) for t in texts]
        tok = tokens(texts, digits=True)
        rows: list[tuple] = []
        for known, automaton, least in (s.value for s in shared) if len(tok.hash) else ():
            at = np.minimum(np.searchsorted(known, tok.hash), len(known) - 1)
            word = np.where(known[at] == tok.hash, at, -1)
            cut = (word < 0) | np.concatenate(([True], tok.doc[1:] != tok.doc[:-1]))
            starts = np.flatnonzero(cut)
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(word)).tolist()):
                a += word[a] < 0
                if b - a < least:
                    continue
                spans = defaultdict(list)
                for item, x, y in automaton.matches(word[a:b].tolist()):
                    spans[item].append((a + x, a + y))
                d = int(tok.doc[a])
                for item, s in spans.items():
                    rows += [(ids[d], d, item, x, y) for x, y in _joined(s)]
        first = np.cumsum(tok.counts()) - tok.counts()
        out = [(i, item, x - int(first[d]), y - int(first[d]), int(tok.counts()[d])) for i, d, item, x, y in rows] if rows else []
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
            names=["doc_id", "item_id", "start", "stop", "words"],
        )


def leaked_spans(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, run: int = 12, most_words: int = MOST_WORDS) -> DataFrame:
    """Spans of document words shared with an item: (doc_id, item_id, start, stop, words), words counted from 0.

    A span is a union of overlapping runs of ``run`` words that occur in the item, or the whole item if it has fewer
    words; ``words`` is the document's length. Null and empty texts match nothing, items without words neither; repeated
    document rows each come out, repeated item rows once per item id; no items give an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    kind = source.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, item_id bigint, start int, stop int, words int"
    shard: list[tuple[int, np.ndarray]] = []
    held, automata, parts = 0, [], []

    def scan() -> None:
        """One pass with the automata at hand, which are then given up."""
        parts.append(stage(map_arrow(source, partial(_scan, shared=list(automata), kind=to_arrow_type(kind)), schema), "spans"))
        for sent in automata:
            sent.destroy()
        automata.clear()

    def close() -> None:
        nonlocal shard, held
        known = np.unique(np.concatenate([h for _, h in shard]))
        words = [(i, np.searchsorted(known, h).tolist()) for i, h in shard]
        value = (known, Automaton(words, run), min(min(len(w) for _, w in words), run))
        automata.append(spark.sparkContext.broadcast(value))
        if len(automata) == TOGETHER:
            scan()
        shard, held = [], 0

    for r in items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        h = tokens([_bare(r.t)], digits=True).hash
        if len(h):
            shard.append((r.i, h))
            held += len(h)
            if held >= most_words:
                close()
    if shard:
        close()
    if automata:
        scan()
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaked_items(spans: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest, covered): the longest span and the document words in spans of the item."""
    return spans.groupBy("doc_id", "item_id").agg(F.max(F.col("stop") - F.col("start")).alias("longest"), F.sum(F.col("stop") - F.col("start")).alias("covered"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    tok = tokens([_bare(text)], digits=True)
    bare, out, at = _bare(text), [], 0
    if len(bare) + 1 != len(tok.text):  # lower case changed the length: cut the lower-cased text
        bare = tok.text[:-1]
    for a, b in _joined(spans):
        out.append(bare[at : tok.start[a]])
        at = int(tok.end[b - 1])
    return "".join(out) + bare[at:]


def _clean(batches: Iterable[pa.RecordBatch], most_share: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text, spans, words in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans", "words"))):
            merged = _joined([(s["start"], s["stop"]) for s in spans])
            share = sum(y - x for x, y in merged) / words
            rows.append((i, share, share > most_share, None if share > most_share else _cut(text, merged)))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.float64(), pa.bool_(), pa.string()))], names=["doc_id", "share", "dropped", "text"])


def clean_documents(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame, most_share: float = 0.5) -> DataFrame:
    """Documents with leaked spans, without them: (doc_id, share, dropped, text).

    ``share`` is the share of words in spans of any item; above ``most_share`` the document is dropped and its text null.
    The other texts lose the characters from each span's first word to its last.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    per_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.max("words").alias("words"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(per_doc, "doc_id")
    kind = source.schema["doc_id"].dataType
    return map_arrow(source, partial(_clean, most_share=most_share, kind=to_arrow_type(kind)), f"doc_id {kind.simpleString()}, share double, dropped boolean, text string")
