"""Near-duplicate texts by covering locality-sensitive hashing of min-wise sketches.

A text's set of word runs becomes a sketch of 48 independent minima; two texts of similarity J agree in each position
with probability J. The 48 masks select three positions each, all triples within twelve blocks of four, so by the pigeon
hole any two sketches within Hamming distance 23 of 48 agree on some whole mask and collide in its table. Unlike texts that
share a few phrases collide too, and their number grows with the square of the texts; so a byte of every minimum goes with
each key, and colliding texts whose sketches agree in too few positions for the similarity are no candidates. The
candidates are verified on the exact sets. Tables and candidates are taken in passes, so that what lies on disk at once
is a part of the texts' size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.llm.components import components
from quillhawk.llm.textarrays import Tokens, blocks, mix64, text_batches, tokens
from quillhawk.llm.vectors import block_pairs
from quillhawk.runtime import broadcast_if_small, map_arrow, stage, unstage

POSITIONS, BLOCK, TAKEN = 48, 4, 3
#: A mask value of more texts is cut into blocks of so many, and every pair of blocks is joined by itself.
KEY_ROWS = 2_000
#: Times a mask value must occur in one task to be counted as a frequent one.
_SEEN = 20
#: Masks of a pass over the sketches, and candidates of a pass over the sets as a share of the texts.
MASKS_PASS, SHARE_PASS = 6, 1 / 6
#: 64-bit words that hold the lowest byte of every position.
WORDS = POSITIONS // 8


def masks(positions: int = POSITIONS, block: int = BLOCK, taken: int = TAKEN) -> list[tuple[int, ...]]:
    """All choices of ``taken`` positions within each block of ``block``: positions/block*(taken-1)+1 agreements force one."""
    return [tuple(start + i for i in c) for start in range(0, positions, block) for c in combinations(range(block), taken)]


def radius(positions: int = POSITIONS, block: int = BLOCK, taken: int = TAKEN) -> int:
    """The Hamming distance up to which some mask is sure to be free of differences."""
    return positions - (positions // block) * (taken - 1) - 1


def least_agreeing(similarity: float, lost: float = 5e-6) -> int:
    """The most positions whose bytes may be asked to agree, if of pairs of ``similarity`` that collide by a mask a share of at most ``lost`` agrees in fewer."""
    p, n = similarity + (1 - similarity) / 256, POSITIONS - TAKEN
    below, k = 0.0, 0
    while k < n and (below := below + comb(n, k) * p**k * (1 - p) ** (n - k)) <= lost:
        k += 1
    return TAKEN + k


def _agreeing() -> F.Column:
    """Positions whose bytes agree in (m0, m1, ...) and (r0, r1, ...)."""

    def differing(x: F.Column) -> F.Column:
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(POSITIONS) - sum((differing(F.col(f"m{i}").bitwiseXOR(F.col(f"r{i}"))) for i in range(1, WORDS)), differing(F.col("m0").bitwiseXOR(F.col("r0"))))


@lru_cache(maxsize=2)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250301)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_sets(tok: Tokens, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with at least ``least`` words, where their set starts, and all sets' distinct 64-bit hashes, in order."""
    counts = tok.counts()
    ok = counts >= max(least, run)
    left = (np.cumsum(counts)[tok.doc] - np.arange(len(tok.doc))) if len(tok.doc) else np.zeros(0, np.int64)
    at = np.flatnonzero(ok[tok.doc] & (left >= run)) if len(tok.doc) else np.zeros(0, np.int64)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(run):
        h = mix64(h * np.uint64(31) + tok.hash[at + j] + np.uint64(j + 1))
    doc = tok.doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    which, starts = np.unique(doc, return_index=True)
    return which, starts, h


def _sketches(batches: Iterable[pa.RecordBatch], run: int, least: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    mul, add = _hashes(POSITIONS)
    for ids, texts in blocks(text_batches(batches)):
        which, starts, h = shingle_sets(tokens(texts), run, least)
        if not len(which):
            continue
        sketch = np.empty((len(which), POSITIONS), dtype=np.int32)
        for i in range(POSITIONS):
            sketch[:, i] = np.minimum.reduceat((h * mul[i] + add[i]) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
        sums, xors = np.add.reduceat(h, starts).view(np.int64), np.bitwise_xor.reduceat(mix64(h), starts).view(np.int64)
        sizes = np.diff(np.append(starts, len(h))).astype(np.int32)
        low = sketch.astype(np.uint8).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind).take(pa.array(which)), pa.array(sizes), pa.array(sums), pa.array(xors), pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), POSITIONS).cast(pa.list_(pa.int32())), *(pa.array(np.ascontiguousarray(low[:, i])) for i in range(WORDS))],
            names=["id", "size", "set_sum", "set_xor", "sketch", *(f"m{i}" for i in range(WORDS))],
        )


def _sets(batches: Iterable[pa.RecordBatch], run: int, least: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, texts in blocks(text_batches(batches)):
        which, starts, h = shingle_sets(tokens(texts), run, least)
        if len(which):
            offsets = pa.array(np.append(starts, len(h)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(which)), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["id", "set"])


def _frequent(batches: Iterable[pa.RecordBatch], seen: int, kept: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Mask values that the task meets at least about ``seen`` times, with the times, in bounded memory.

    Counts of frequent items by decrement: when more than twice ``kept`` values are held, all lose the count of the one at
    place ``kept``. A value loses at most the task's rows divided by ``kept``; that share is added to every count at the end,
    so none that is frequent is missed.
    """
    keys, times, lost = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    waiting: list[np.ndarray] = []

    def merge() -> None:
        nonlocal keys, times, lost
        some, n = np.unique(np.concatenate([keys[:0], *waiting]), return_counts=True)
        waiting.clear()
        keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
        times = np.bincount(back, weights=np.concatenate([times, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > 2 * kept:
            cut = int(np.partition(times, len(times) - kept)[len(times) - kept])
            lost += cut
            keys, times = keys[times > cut], times[times > cut] - cut

    for b in batches:
        waiting.append(b.column(0).to_numpy())
        if sum(map(len, waiting)) >= 4 * kept:
            merge()
    merge()
    found = times + lost >= seen
    yield pa.RecordBatch.from_arrays([pa.array(keys[found]), pa.array(times[found] + lost)], names=["key", "n"])


class NearDuplicates:
    """``classes``: (id, class_id, set_size), texts with equal sets share the smallest id. ``links``: (a, b, similarity), a < b, class ids."""

    def __init__(self, classes: DataFrame, links: DataFrame) -> None:
        self.classes, self.links = classes, links

    def pairs(self) -> DataFrame:
        """(id_a, id_b, similarity) of all record pairs, those within a class included."""
        members = self.classes.select("id", "class_id")
        one = members.withColumnsRenamed({"id": "x", "class_id": "a"})
        two = members.withColumnsRenamed({"id": "y", "class_id": "b"})
        across = self.links.join(one, "a").join(two, "b").select("x", "y", "similarity")
        many = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id")
        inside = members.join(many, "class_id")
        within = inside.select(F.col("class_id"), F.col("id").alias("x")).join(inside.select("class_id", F.col("id").alias("y")), "class_id").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
        return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")

    def groups(self) -> DataFrame:
        """One row per record: (id, class_id, copies, links, group_id): copies in its class, links of the class, group of linked classes."""
        copies = self.classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
        ends = self.links.select(F.col("a").alias("class_id")).union(self.links.select("b")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
        group = components(self.links, "a", "b").withColumnsRenamed({"id": "class_id", "component": "group_id"})
        about = copies.join(ends, "class_id", "left").join(group, "class_id", "left")
        return self.classes.select("id", "class_id").join(about, "class_id").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, run: int = 5, least_words: int = 30, key_rows: int = KEY_ROWS, masks_pass: int = MASKS_PASS, share_pass: float = SHARE_PASS) -> NearDuplicates:
    """Classes of equal word-run sets, and links between classes of at least ``similarity`` (Jaccard).

    Words are longest runs of letters of the lower-cased text, the set holds all runs of ``run`` words. Null texts and
    texts of fewer than ``least_words`` words take no part; null ids neither; ids are taken as unique. An empty table
    gives empty results. No bucket is capped: classes collapse copies first, and a mask value of more than ``key_rows``
    texts is joined in pairs of blocks, each a key of its own. (Values are counted in the tasks that meet them ``_SEEN``
    times or more; one spread thinner than that over the tasks is left to adaptive execution.) Pairs within the covering radius are found surely given the sketch; a pair of similarity 0.55 lies in reach of
    some mask with probability above 0.99, one of 0.6 above 0.999. Of the pairs that collide, at most five in a million of exactly
    ``similarity`` agrees in fewer positions than asked, and fewer of those above it. ``masks_pass`` tables are joined at a
    time, and the sets are compared for about ``share_pass`` times the texts candidates at a time; neither changes the result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    id_type = source.schema["id"].dataType
    kind, name = to_arrow_type(id_type), id_type.simpleString()
    words = [f"m{i}" for i in range(WORDS)]
    sketches = stage(map_arrow(source, partial(_sketches, run=run, least=least_words, kind=kind), f"id {name}, size int, set_sum bigint, set_xor bigint, sketch array<int>, {', '.join(f'{m} bigint' for m in words)}"), "sketches")
    shared = sketches.groupBy("set_sum", "set_xor", "size").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = stage(shared, "classes", tidy=True)
    n_shared = shared.count()
    known = sketches.join(broadcast_if_small(shared, n_shared), ["set_sum", "set_xor", "size"], "left") if n_shared else sketches.withColumn("class_id", F.lit(None).cast(name))
    classes = known.select("id", F.coalesce("class_id", "id").alias("class_id"), F.col("size").alias("set_size"))
    reps = known.where("class_id is null or class_id = id")
    texts_in, words_in = sketches.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    def rows_of(some: list[int], *more: str) -> DataFrame:
        keys = F.array(*[F.xxhash64(F.lit(m), *[F.get("sketch", i) for i in masks()[m]]) for m in some])
        return reps.select("id", "size", *more, F.explode(keys).alias("key"))

    everything = list(range(len(masks())))
    hot = map_arrow(rows_of(everything).select("key"), partial(_frequent, seen=min(_SEEN, key_rows)), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > key_rows)
    hot = stage(hot.select("key", F.ceil(F.col("n") / key_rows).cast("int").alias("blocks")), "hot", tidy=True)
    n_hot = hot.count()
    sized = (F.least("sa", "sb") >= similarity * F.greatest("sa", "sb")) & (F.col("a") < F.col("b"))
    alike = _agreeing() >= least_agreeing(similarity)
    met = []
    for at in range(0, len(everything), masks_pass):
        some = everything[at : at + masks_pass]
        rows = rows_of(some, *words)
        if n_hot:
            blocks_of = F.coalesce("blocks", F.lit(1))
            spread = rows.join(broadcast_if_small(hot, n_hot), "key", "left").select("id", "size", *words, "key", F.explode(block_pairs(F.pmod(F.xxhash64("id"), blocks_of).cast("int"), blocks_of)).alias("p"))
            rows = spread.select("id", "size", *words, F.xxhash64("key", "p.left", "p.right").alias("key"))  # two blocks that meet twice give a pair twice; distinct follows
        a, b = rows.withColumnsRenamed({"id": "a", "size": "sa"}), rows.withColumnsRenamed({"id": "b", "size": "sb"} | {m: f"r{m[1:]}" for m in words})
        met.append(stage(a.join(b, "key").where(sized & alike).select("a", "b").distinct(), "met", shuffled=texts_in * len(some) * (24 + 8 * WORDS), tidy=True))
    candidates = met[0]
    for x in met[1:]:
        candidates = candidates.unionByName(x)
    candidates = stage(candidates.distinct(), "candidates", shuffled=texts_in * 16, tidy=True)
    unstage(*met)
    n_candidates = candidates.count()
    passes = max(1, ceil(n_candidates / max(texts_in * share_pass, 1)))
    weight = 16 * n_candidates * words_in // max(texts_in, 1) // passes
    near = []
    for p in range(passes):
        part = candidates.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == p) if passes > 1 else candidates
        ends = stage(part.select(F.col("a").alias("id")).union(part.select("b")).distinct(), "ends", tidy=True)
        texts = source.join(broadcast_if_small(ends, ends.count()), "id", "left_semi")
        sets = stage(map_arrow(texts, partial(_sets, run=run, least=least_words, kind=kind), f"id {name}, set array<bigint>"), "sets", tidy=True)
        both = part.join(sets.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "y"}), "b")
        common = F.size(F.array_intersect("x", "y"))
        scored = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n")).select("a", "b", (F.col("c") / (F.col("n") - F.col("c"))).alias("similarity"))
        near.append(stage(scored.where(F.col("similarity") >= similarity), "near", shuffled=weight, tidy=True))
        unstage(ends, sets)
    links = near[0]
    for x in near[1:]:
        links = links.unionByName(x)
    return NearDuplicates(classes, links)
