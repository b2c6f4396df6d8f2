"""Sources mixed to target weights of tokens, by hierarchical budgets and seeded epochs.

A leaf is what one source has in one domain and language, by its documents' own category and language; a source's weight
is divided among its leaves by their size. The budget of all tokens flows down the domain, language, source tree in
proportion to the weights. What a leaf cannot supply within its repeats goes to its siblings, the other sources of the same
domain and language, then to the domain's other languages, and to other domains only when the domain is exhausted. Each
leaf then gives whole epochs of its documents and a seeded prefix of one more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.llm.selection import seeded_hash, take_prefix
from quillhawk.runtime import map_arrow, ship_file, shipped, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SEP = "\u001f"
#: Pre-tokenisation of the byte-level vocabulary: a fixed value that goes with the file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(shipped(name)).encode_ordinary
    for b in batches:
        sizes = [len(encode(t)) if t else 0 for t in b.column("__text").to_pylist()]
        yield b.drop_columns(["__text"]).append_column("tokens", pa.array(sizes, pa.int64()))


def count_tokens(df: DataFrame, text_col: str, keep: list[F.Column], path: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and ``tokens``, the length of the text in tokens of a public vocabulary; null texts have none.

    The vocabulary file is read on the driver and sent to the executors through the shared folder.
    """
    source = df.select(*keep, F.col(text_col).alias("__text"))
    schema = source.drop("__text").schema
    return map_arrow(source, partial(_sizes, name=ship_file(df.sparkSession, path)), schema.add("tokens", "long"))


def fill(amount: float, weights: list[float], capacity: list[float]) -> list[float]:
    """Shares of ``amount`` in proportion to ``weights``, none above its capacity; what is cut goes to the others."""
    out, left = [0.0] * len(weights), amount
    open_ = [i for i, (w, c) in enumerate(zip(weights, capacity)) if w > 0 and c > 0]
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        full = [i for i in open_ if out[i] + share[i] >= capacity[i]]
        if not full:
            for i in open_:
                out[i] += share[i]
            break
        for i in full:
            left -= capacity[i] - out[i]
            out[i] = capacity[i]
        open_ = [i for i in open_ if i not in full]
    return out


def budgets(leaves: list[tuple[tuple[str, ...], float, float]], amount: float) -> list[float]:
    """Budget of each leaf (path, weight, capacity); shortages go to the nearest relatives that have room."""
    out = [0.0] * len(leaves)

    def down(members: list[int], depth: int, given: float) -> None:
        if len(members) == 1:
            out[members[0]] = min(given, leaves[members[0]][2])
            return
        groups: dict[str, list[int]] = {}
        for i in members:
            path = leaves[i][0]
            groups.setdefault(path[depth] if depth < len(path) else str(i), []).append(i)
        parts = list(groups.values())
        given_to = fill(given, [sum(leaves[i][1] for i in g) for g in parts], [sum(leaves[i][2] for i in g if leaves[i][1] > 0) for g in parts])
        for g, x in zip(parts, given_to):
            down(g, depth + 1, x)

    if leaves:
        down(list(range(len(leaves))), 0, min(amount, sum(c for _, w, c in leaves if w > 0)))
    return out


def _used_up(planned: float, most: float) -> bool:
    return planned >= most * (1 - 1e-12)


def _name(c: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def mix_sources(docs: DataFrame, id_col: str, text_col: str, source_col: str, domain_col: str, lang_col: str, targets: DataFrame, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Documents with their number of uses, and the shares reached.

    ``targets`` has (source, weight, max_repeats), one row per source; sources are compared trimmed and in lower case.
    Returns (doc_id, source, tokens, uses) of the documents of the named sources, unused ones with 0, and the report
    (source, weight, max_repeats, documents, size, target, planned, used, share, short): ``target`` is weight times the
    size of all documents of named sources, ``planned`` the budget its leaves got, ``short`` says that all its leaves are
    used up to ``max_repeats`` and their budget is still below the target. A document's domain and language are its own
    (trimmed, lower case, two letters of the language; null counts as a value). Null ids and null sources take no part,
    null texts have size 0, repeated rows count each, a source named twice counts by its first row, absent sources have
    size 0 and leave their weight to the whole tree.
    """
    spark = docs.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(_name(F.col("source")).alias("s"), "weight", "max_repeats").where("s is not null").orderBy("s", F.desc("weight"), "max_repeats").collect():  # one row a source
        wanted.setdefault(r.s, (float(r.weight or 0), int(r.max_repeats or 0)))
    keep = [F.col(id_col).alias("doc_id"), _name(F.col(source_col)).alias("source"), F.coalesce(_name(F.col(domain_col)), F.lit("")).alias("domain"), F.coalesce(F.substring(_name(F.col(lang_col)), 1, 2), F.lit("")).alias("lang")]
    named = docs.where(F.col(id_col).isNotNull() & _name(F.col(source_col)).isin(list(wanted)))
    sized = stage(count_tokens(named, text_col, keep, vocabulary).withColumn("leaf", F.concat_ws(_SEP, "domain", "lang", "source")), "sizes")
    found = [r for r in sized.groupBy("domain", "lang", "source", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()]  # one row a leaf
    found.sort(key=lambda r: r.leaf)
    names = list(wanted)
    docs_of, size_of = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for r in found:
        docs_of[r.source] += r.n
        size_of[r.source] += r.tokens
    whole = sum(size_of.values())
    leaves = [((r.domain, r.lang, r.source), wanted[r.source][0] * r.tokens / size_of[r.source] if size_of[r.source] else 0.0, float(r.tokens * wanted[r.source][1])) for r in found]
    leaves += [((_SEP + s,), wanted[s][0], 0.0) for s in names if not size_of[s]]  # a domain of its own with nothing in it
    plan = budgets(leaves, float(whole))
    epochs, rest, planned = {}, {}, dict.fromkeys(names, 0.0)
    for r, budget in zip(found, plan):
        most = wanted[r.source][1]
        planned[r.source] += budget
        epochs[r.leaf] = min(most, int(budget / r.tokens + 1e-9)) if r.tokens else 0
        if r.tokens and epochs[r.leaf] < most and budget > epochs[r.leaf] * r.tokens:
            rest[r.leaf] = budget - epochs[r.leaf] * r.tokens
    used = take_prefix(sized.withColumn("__h", seeded_hash(seed, "doc_id")), "leaf", "__h", "doc_id", "tokens", rest)
    base = spark.createDataFrame(list(epochs.items()) or [("", 0)], "leaf string, __epochs int")  # one row a leaf
    usage = used.join(F.broadcast(base), "leaf", "left").select("doc_id", "source", "tokens", (F.coalesce("__epochs", F.lit(0)) + F.col("taken").cast("int")).alias("uses"))
    usage = stage(usage, "usage")
    reached = {r.source: r.used for r in usage.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("used")).collect()}  # one row a source
    total = sum(reached.values()) or 1
    report = [
        (s, wanted[s][0], wanted[s][1], docs_of[s], size_of[s], wanted[s][0] * whole, planned[s], int(reached.get(s, 0)), reached.get(s, 0) / total, _used_up(planned[s], wanted[s][1] * size_of[s]) and planned[s] < wanted[s][0] * whole)
        for s in names
    ]
    schema = "source string, weight double, max_repeats int, documents bigint, size bigint, target double, planned double, used bigint, share double, short boolean"
    return usage, spark.createDataFrame(report, schema)
