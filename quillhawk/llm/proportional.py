"""A sample whose category shares follow targets, by swap repair over category signatures.

Records with equal categories are interchangeable, so the sample is planned on counts per signature: records drawn at
random for each floor and then for the rest of the sample, then exchanges of counts between two signatures, each the one
that lowers the squared deviation from the targets most, until none does. The counts are then drawn at random within each
signature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.llm.selection import seeded_hash, take_prefix
from quillhawk.runtime import broadcast_if_small

#: Signatures are planned on the driver; more than this is refused.
MOST_SIGNATURES = 20_000
_SEP = "\u001f"


@dataclass(frozen=True)
class Target:
    category: str
    share: float
    floor: int


def clean_labels(df: DataFrame, label_col: str, aliases: DataFrame, raw_col: str, meaning_col: str, out: str) -> DataFrame:
    """Adds ``out``: what the label means, null for none. Labels are compared in lower case, letters and digits only.

    Aliases whose cleaned form is empty or null match nothing; of several meanings of one form the smallest counts.
    """

    def bare(c: str) -> F.Column:
        return F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]", "")

    table = aliases.select(bare(raw_col).alias("__form"), F.col(meaning_col).alias("__means")).where("__form <> ''")
    table = table.groupBy("__form").agg(F.min("__means").alias("__means"))
    joined = df.withColumn("__form", bare(label_col)).join(broadcast_if_small(table, table.count()), "__form", "left")
    return joined.withColumn(out, F.col("__means")).drop("__form", "__means")


def _draw(rng: np.random.Generator, available: np.ndarray, n: int) -> np.ndarray:
    """Counts per signature of n records drawn at random without replacement."""
    total = int(available.sum())
    if n >= total:
        return available.copy()
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(available, n, method="marginals")
    count = np.minimum(rng.multinomial(n, available / total), available)  # above a thousand million the two differ little
    while (rest := n - int(count.sum())) > 0:
        room = available - count
        count += np.minimum(rng.multinomial(rest, room / room.sum()), room)
    return count


def random_start(available: np.ndarray, member: np.ndarray, floor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of a random sample that holds the floors where size and records allow: floors first, in random order."""
    count = np.zeros(len(available), dtype=np.int64)
    for c in rng.permutation(len(floor)):
        missing = int(np.ceil(floor[c] - count @ member[:, c]))
        if missing > 0:
            room = np.where(member[:, c] > 0, available - count, 0)
            count += _draw(rng, room, min(missing, size - int(count.sum())))
    return count + _draw(rng, available - count, size - int(count.sum()))


#: Givers and takers first tried for an exchange; all are tried before the search ends.
_TRIED = 64


def plan_counts(available: np.ndarray, member: np.ndarray, target: np.ndarray, floor: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Counts per signature. ``member[s, c]`` says that signature s has category c; targets and floors are per category."""
    rng = np.random.default_rng(seed)
    size = min(size, int(available.sum()))
    if not size:
        return np.zeros(len(available), dtype=np.int64)
    floor = np.minimum(floor, available @ member)
    count = random_start(available, member, floor, size, rng)

    def cost(x: np.ndarray) -> np.ndarray:
        """Squared deviation, with missing floors far above it."""
        return ((x - target) ** 2).sum(-1) + 1e6 * (np.maximum(floor - x, 0) ** 2).sum(-1) * max(1, size)

    def best(givers: np.ndarray, takers: np.ndarray) -> tuple[float, int, int, int] | None:
        found, now, block = None, cost(held), max(1, 2_000_000 // max(1, len(takers) * member.shape[1]))
        for a in range(0, len(givers), block):
            u = givers[a : a + block]
            change = member[takers][None] - member[u][:, None]
            norm = (change**2).sum(-1)
            most = np.minimum(count[u][:, None], (available - count)[takers][None])
            ideal = np.clip(np.floor((change @ (target - held)) / np.maximum(norm, 1) + 0.5), 1, np.maximum(most, 1))
            for step in (ideal, np.ones_like(ideal)):
                gain = np.where((norm > 0) & (most > 0), now - cost(held + change * step[..., None]), -np.inf)
                i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[i, j] > 1e-9 and (found is None or gain[i, j] > found[0]):
                    found = (float(gain[i, j]), int(u[i]), int(takers[j]), int(step[i, j]))
        return found

    while True:
        held = count @ member
        pull = member @ (target - held + 1e6 * size * np.maximum(floor - held, 0))
        givers, takers = np.flatnonzero(count > 0), np.flatnonzero(count < available)
        if not len(givers) or not len(takers):
            return count
        some = best(givers[np.argsort(pull[givers], kind="stable")[:_TRIED]], takers[np.argsort(-pull[takers], kind="stable")[:_TRIED]])
        if some is None and (len(givers) > _TRIED or len(takers) > _TRIED):
            some = best(givers, takers)
        if some is None:
            return count
        _, u, v, step = some
        count[u] -= step
        count[v] += step


def proportional_sample(df: DataFrame, id_col: str, targets: dict[str, list[Target]], fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A sample of about ``fraction`` of all rows that follows ``targets`` (category column -> its targets).

    Returns the sample (id, then the category columns) and a report with one row per target: (attribute, category,
    target_share, min_rows, available, needed, sampled, share, short). ``needed`` is the greater of the target share of
    the sample size and the floor; ``short`` says that the sample holds all rows of the category and still fewer. Rows whose value in some category column is null
    or has no target count for the size but are not drawn; rows with a null id are not drawn either. Repeated ids are
    rows of their own. An empty table gives an empty sample and a report of zeros. If targets cannot be met, the nearest
    sample of full size is taken; if the floors need more than that size, the sample is as large as they need.
    """
    spark = df.sparkSession
    names = list(targets)
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)])
    valid = F.lit(True)
    for i, c in enumerate(names):
        valid = valid & F.coalesce(F.col(f"__c{i}").isin([t.category for t in targets[c]]), F.lit(False))
    rows = rows.withColumn("__sig", F.when(valid, F.concat_ws(_SEP, *[f"__c{i}" for i in range(len(names))])))
    found = rows.groupBy("__sig").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SIGNATURES + 2).collect()  # bounded by the targets
    if len(found) > MOST_SIGNATURES + 1:
        raise ValueError(f"more than {MOST_SIGNATURES} combinations of categories")
    everything = sum(r.n for r in found)
    sigs = sorted((r["__sig"].split(_SEP), r.n) for r in found if r["__sig"] is not None)
    flat = [(i, t) for i, c in enumerate(names) for t in targets[c]]
    size = fraction * everything
    available = np.array([n for _, n in sigs], dtype=np.int64)
    member = np.array([[float(s[i] == t.category) for i, t in flat] for s, _ in sigs], dtype=np.float64).reshape(len(sigs), len(flat))
    needs = [min(float(t.floor), float(available @ member[:, j])) for j, (_, t) in enumerate(flat)]
    drawn = max([round(size), *(math.ceil(sum(x for x, (k, _) in zip(needs, flat) if k == i)) for i in range(len(names)))])
    target = np.array([t.share * min(drawn, available.sum()) for _, t in flat])
    count = plan_counts(available, member, target, np.array([t.floor for _, t in flat], dtype=np.float64), drawn, seed)
    budgets = {_SEP.join(s): float(k) for (s, _), k in zip(sigs, count)}
    sample = take_prefix(rows.where("__sig is not null and id is not null").withColumns({"__h": seeded_hash(seed, "id"), "__one": F.lit(1)}), "__sig", "__h", "id", "__one", budgets)
    sample = sample.where("taken").select("id", *[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
    have, got, n = available @ member, count @ member, max(int(count.sum()), 1)
    report = [
        (names[i], t.category, float(t.share), int(t.floor), int(have[j]), float(max(t.share * size, t.floor)), int(got[j]), float(got[j] / n), bool(got[j] == have[j] < max(t.share * size, t.floor)))
        for j, (i, t) in enumerate(flat)
    ]
    schema = "attribute string, category string, target_share double, min_rows int, available bigint, needed double, sampled bigint, share double, short boolean"
    return sample, spark.createDataFrame(report, schema)
