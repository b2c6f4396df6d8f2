"""Pages of stuffed keywords, link lists, menus and tags, by a hidden Markov model over their lines.

A page is cut into line units (lines, sentences, and windows of a dozen words in longer ones). Each unit shows eight
signs, all from counts over character classes and word hashes of the whole batch: function words, addresses, labels,
separators, commas, capitals, a sentence's end, and words the page keeps repeating. A model of four states (prose, link
list, tag list, menu) is estimated from all pages without labels and labels every unit in the context of its page;
pages whose characters lie mostly in units that are not prose are flagged. For the estimation a page is the sequence of its
units' signs, and equal sequences are counted; every round sums expected counts over the tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhawk.llm.textarrays import blocks, text_batches, tokens
from quillhawk.runtime import map_arrow, stage, unstage

#: Hidden states and the label of each: prose comes in whole sentences or in wrapped and broken lines.
LABELS = ("prose", "link list", "tag list", "menu")
STATES = ("prose", "prose", "link list", "tag list", "menu")
#: Words of a window, and the characters above which a line is cut into windows.
WINDOW, LONG = 12, 120
#: Values of each sign: function words (no words, none, few, some, many), addresses, labels, separators and commas (none,
#: few, many), capitals (few, many, all), sentence end (no, yes), repetition (none, some, most).
LEVELS = (5, 3, 3, 3, 3, 3, 2, 3)
#: Units whose expected counts are taken at once; a longer page is by itself.
BLOCK_UNITS = 100_000
_INVISIBLE = re.compile("[­​‌‍﻿]")
_BLANK, _BREAK, _LETTER, _DIGIT, _UPPER, _END, _OTHER = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Class bits of every code point, from its Unicode category."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            out[c] = _LETTER | (_UPPER if cat in ("Lu", "Lt") else 0)
        elif cat[0] == "N":
            out[c] = _DIGIT
        elif ch.isspace():
            out[c] = _BLANK | (_BREAK if ch == "\n" else 0)
        else:
            out[c] = _OTHER | (_END if ch in ".!?" else 0)
    return out


def function_words(spark: SparkSession) -> np.ndarray:
    """Sorted word hashes of the stop words that Spark ships for the collection's languages; lone consonants are remains of contractions."""
    from pyspark.ml.feature import StopWordsRemover

    words = [w for lang in ("english", "spanish", "french", "german") for w in StopWordsRemover.loadDefaultStopWords(lang)]
    tok = tokens([" ".join(words)])
    return np.unique(tok.hash[[len(w := tok.word(i)) > 1 or w in "aeiouyà" for i in range(len(tok.hash))]])


@dataclass
class Units:
    """Line units of a block of pages, page by page: characters, words and signs of each; units per page."""

    chars: np.ndarray
    words: np.ndarray
    signs: np.ndarray
    length: np.ndarray


def _share_level(part: np.ndarray, whole: np.ndarray, cut: float) -> np.ndarray:
    """0 for none, 1 for a share below ``cut``, 2 for more."""
    return (part > 0).astype(np.int64) + ((part > 0) & (part >= cut * whole))


def _pieces(kind: np.ndarray, codes: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without blanks, and the unit of each."""
    solid = np.zeros(len(codes) + 1, dtype=np.int8)
    solid[1:] = (kind & _BLANK) == 0
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return start, end, start
    breaks = np.concatenate(([0], np.cumsum((kind & _BREAK) > 0)))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (breaks[start[1:]] > breaks[end[:-1]]) | ((kind[end[:-1] - 1] & _END) > 0) | (doc_of[start[1:]] != doc_of[start[:-1]])
    first = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    count = np.diff(np.append(first, len(start)))
    wide = end[first + count - 1] - start[first] > LONG
    place = np.arange(len(start)) - first[line]
    tail = count % WINDOW
    window = np.minimum(place // WINDOW, np.maximum(count // WINDOW - ((tail > 0) & (tail < 4)) - (tail == 0), 0)[line])
    window = np.where(wide[line], window, 0)
    cut = new.copy()
    cut[1:] |= window[1:] != window[:-1]
    return start, end, np.cumsum(cut) - 1


def units(texts: list[str], common: np.ndarray) -> Units:
    """The line units of a block of pages and their signs."""
    texts = [_INVISIBLE.sub("", t) for t in texts]
    tok = tokens(texts)
    plain = "\n".join(texts) + "\n"
    if len(plain) != len(tok.text):  # lower case changed the length of some text
        texts = [t if len(t.lower()) == len(t) else "".join(c if len(c.lower()) == 1 else c.lower() for c in t) for t in texts]
        plain = "\n".join(texts) + "\n"
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[codes]
    doc_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    start, end, unit = _pieces(kind, codes, doc_of)
    n = int(unit[-1]) + 1 if len(unit) else 0
    count = lambda at, weights=None: np.bincount(at, weights=weights, minlength=n)
    first = np.searchsorted(unit, np.arange(n), side="left")
    last = np.searchsorted(unit, np.arange(n), side="right") - 1
    runs = count(unit)
    length = np.bincount(doc_of[start[first]], minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    # an address: a letter or digit, a mark, and a letter or slash without a blank between; or the start of a markup tag
    mark = np.isin(codes, [ord(c) for c in "./:=@&?"])
    letter = (kind & _LETTER) > 0
    inner = np.zeros(len(codes), dtype=bool)
    inner[1:-1] = mark[1:-1] & (letter[:-2] | ((kind[:-2] & _DIGIT) > 0)) & (letter[2:] | (codes[2:] == ord("/")))
    inner[:-1] |= (codes[:-1] == ord("<")) & (letter[1:] | (codes[1:] == ord("/")))
    inner_sum = np.concatenate(([0], np.cumsum(inner)))
    address = inner_sum[end] > inner_sum[start]
    solid = np.concatenate(([0], np.cumsum((kind & (_LETTER | _DIGIT)) > 0)))
    bare = solid[end] == solid[start]
    close = codes[end - 1] if len(end) else codes[:0]
    label = ((codes[start] == ord("#")) & ~bare) | (np.isin(close, [ord(":"), ord(";")]) & ~bare)
    comma = close == ord(",")
    # words outside addresses, with their unit
    run_of = np.searchsorted(start, tok.start, side="right") - 1
    keep = ~address[run_of] if len(run_of) else np.zeros(0, bool)
    w_unit, w_hash, w_doc, w_start = unit[run_of[keep]], tok.hash[keep], tok.doc[keep], tok.start[keep]
    at = np.minimum(np.searchsorted(common, w_hash), max(len(common) - 1, 0))
    few = common[at] == w_hash if len(common) else np.zeros(len(w_hash), bool)
    words = count(w_unit)
    functional = count(w_unit[few])
    # words the page repeats: four times or more, or twice with the same word after it
    _, key = np.unique(w_hash, return_inverse=True)
    width = int(key.max()) + 1 if len(key) else 1
    _, back, times = np.unique(w_doc * width + key, return_inverse=True, return_counts=True)
    often = times[back] >= 4
    follows = np.zeros(len(key), dtype=bool)
    if len(key) > 1:
        pair_ok = (w_doc[1:] == w_doc[:-1]) & ~few[1:] & ~few[:-1]
        i = np.flatnonzero(pair_ok)
        _, pair_back, pair_times = np.unique((w_doc[i] * width + key[i]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key[i + 1].astype(np.uint64), return_inverse=True, return_counts=True)
        twice = np.zeros(len(key), dtype=bool)
        some = i[pair_times[pair_back] > 1]
        twice[some] = twice[some + 1] = True
        marked = np.zeros(len(times), dtype=bool)
        marked[back[twice]] = True
        follows = marked[back]
    again = count(w_unit[~few & (often | follows)])
    upper = count(w_unit[(kind[w_start] & _UPPER) > 0])
    shouted = count(w_unit, np.asarray((kind[np.minimum(w_start + 1, len(kind) - 1)] & _UPPER) > 0, dtype=float)) > 0.5 * np.maximum(words, 1)
    share = functional / np.maximum(words, 1)
    signs = np.stack([
        np.where(words == 0, 0, np.where(functional == 0, 1, np.where(share <= 0.15, 2, np.where(share <= 0.28, 3, 4)))),
        _share_level(count(unit[address]), runs, 1 / 8),
        _share_level(count(unit[label]), runs, 1 / 6),
        _share_level(count(unit[bare]), runs, 1 / 6),
        _share_level(count(unit[comma]), runs, 1 / 5),
        np.where(shouted | (upper * 2 < words) | (words == 0), 0, np.where(upper < words, 1, 2)),
        ((kind[end[last] - 1] & _END) > 0).astype(np.int64) if n else np.zeros(0, np.int64),
        _share_level(again, words, 0.3),
    ], axis=1) if n else np.zeros((0, len(LEVELS)), np.int64)
    chars = end[last] - start[first] if n else np.zeros(0, np.int64)
    return Units(chars, words.astype(np.int64), signs.astype(np.int64), length)


@dataclass(frozen=True)
class Model:
    """Probabilities: of the first state, of state after state, and of each sign's values in a state (rows are states)."""

    start: np.ndarray
    step: np.ndarray
    signs: tuple[np.ndarray, ...]


def first_model() -> Model:
    """Where the estimation starts: all values alike, but each state leans to the value that gives it its name.

    Prose leans to many function words, with a sentence's end or without, the others to none: link lists to addresses,
    tag lists to labels and repetition, menus to separators and capitals. Neighbouring units lean to the same state.
    """
    lean = [{0: 4, 1: 0, 6: 1, 7: 0}, {0: 4, 1: 0, 6: 0, 7: 0}, {0: 1, 1: 2, 6: 0}, {0: 1, 2: 2, 6: 0, 7: 2}, {0: 1, 3: 2, 5: 2, 6: 0}]
    signs = []
    for s, n in enumerate(LEVELS):
        t = np.ones((len(STATES), n))
        for state, favoured in enumerate(lean):
            if s in favoured:
                t[state, favoured[s]] = 4.0 * n
        signs.append(t / t.sum(axis=1, keepdims=True))
    k = len(STATES)
    return Model(np.full(k, 1 / k), np.full((k, k), 0.4 / k) + 0.6 * np.eye(k), tuple(signs))


def _log_emit(m: Model, signs: np.ndarray) -> np.ndarray:
    return sum((np.log(t).T[signs[:, s]] for s, t in enumerate(m.signs)), np.zeros((len(signs), len(m.start))))


def _by_step(length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For t = 0, 1, ...: the places of the t-th units of all pages that have one, longer pages first, and those pages."""
    first = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    n = length[order]
    t = 0
    while live := int(np.searchsorted(-n, -t, side="left")):
        yield first[order[:live]] + t, order[:live]
        t += 1


def label(m: Model, signs: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Most probable states of many pages at once; pages follow each other in ``signs``, ``length`` units each."""
    e, step = _log_emit(m, signs), np.log(m.step)
    best, back = e + np.log(m.start), np.zeros(e.shape, dtype=np.int8)
    steps = list(_by_step(length))
    for (at, _) in steps[1:]:
        score = best[at - 1][:, :, None] + step
        back[at] = score.argmax(axis=1)
        best[at] = score.max(axis=1) + e[at]
    state = best.argmax(axis=1).astype(np.int8)
    for (at, _) in steps[:0:-1]:
        state[at - 1] = back[at, state[at]]
    return state


def label_alone(m: Model, signs: np.ndarray) -> np.ndarray:
    """The best state of every unit without regard to its neighbours, for comparison."""
    return (_log_emit(m, signs) + np.log(m.start)).argmax(axis=1).astype(np.int8)


@lru_cache(maxsize=1)
def _all_signs() -> np.ndarray:
    """The signs of every code that ``sign_codes`` may give."""
    return np.stack(np.unravel_index(np.arange(np.prod(LEVELS)), LEVELS), axis=1)


def sign_codes(signs: np.ndarray) -> np.ndarray:
    """One number for all signs of a unit."""
    return np.ravel_multi_index(tuple(signs.T), LEVELS).astype("<i2")


class Expectation:
    """What Baum-Welch sums over pages under a model: units, log-likelihood, and expected counts of first states, steps and signs."""

    def __init__(self, m: Model) -> None:
        log_e = _log_emit(m, _all_signs())
        self.model, self.top = m, log_e.max(axis=1)
        self.emit = np.exp(log_e - self.top[:, None])
        k = len(m.start)
        self.units, self.likelihood, self.start, self.step, self.codes = 0.0, 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((len(log_e), k))

    def add(self, code: np.ndarray, length: np.ndarray, times: np.ndarray) -> None:
        """Adds pages of ``length`` units each, every page ``times`` over."""
        steps, m = list(_by_step(length)), self.model
        if not steps:
            return
        e, w = self.emit[code], np.repeat(times, length).astype(np.float64)[:, None]
        a, b, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
        for t, (at, _) in enumerate(steps):
            x = (m.start if t == 0 else a[at - 1] @ m.step) * e[at]
            scale[at] = x.sum(axis=1)
            a[at] = x / scale[at][:, None]
        for at, _ in steps[:0:-1]:
            b[at - 1] = (e[at] * b[at]) @ m.step.T / scale[at][:, None]
        g = a * b
        g *= w / g.sum(axis=1, keepdims=True)
        self.units += float(w.sum())
        self.likelihood += float((w[:, 0] * (np.log(scale) + self.top[code])).sum())
        self.start += g[steps[0][0]].sum(axis=0)
        for at, _ in steps[1:]:
            self.step += m.step * ((a[at - 1] * w[at]).T @ (e[at] * b[at] / scale[at][:, None]))
        for j in range(len(m.start)):
            self.codes[:, j] += np.bincount(code, weights=g[:, j], minlength=len(self.codes))

    def sums(self) -> np.ndarray:
        signs = (np.stack([np.bincount(_all_signs()[:, s], weights=c, minlength=n) for c in self.codes.T]).ravel() for s, n in enumerate(LEVELS))
        return np.concatenate([[self.units, self.likelihood], self.start, self.step.ravel(), *signs])


def _estimate(m: Model, expected: Callable[[Model], np.ndarray | None], rounds: int = 40, prior: float = 20.0, least: float = 1e-4) -> Model:
    """Baum-Welch from ``m`` until the log-likelihood per unit grows by less than ``least``; ``expected`` has the sums of ``Expectation`` under a model.

    The tables of the start count as ``prior`` observations of each state, which decides what a state is only where the
    pages hold few units of its kind.
    """
    seen, base, k = -np.inf, m, len(m.start)
    for _ in range(rounds):
        sums = expected(m)
        if sums is None or not sums[0]:
            return m
        units, likelihood, start, step, *tables = np.split(sums, np.cumsum([1, 1, k, k * k, *(k * n for n in LEVELS[:-1])]))
        start, step = prior * base.start + start, prior * base.step + step.reshape(k, k)
        counts = [prior * t + x.reshape(k, -1) for t, x in zip(base.signs, tables)]
        m = Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), tuple(c / c.sum(axis=1, keepdims=True) for c in counts))
        now = float(likelihood[0] / units[0])
        if now - seen < least:
            break
        seen = now
    return m


def fit(m: Model, signs: np.ndarray, length: np.ndarray, rounds: int = 40, prior: float = 20.0, least: float = 1e-4) -> Model:
    """The model estimated from ``m`` on pages in memory, see ``_estimate``."""
    code, once = sign_codes(signs), np.ones(len(length))

    def expected(m: Model) -> np.ndarray:
        found = Expectation(m)
        found.add(code, length, once)
        return found.sums()

    return _estimate(m, expected, rounds, prior, least)


def _sequences(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The sign codes of every page that has units, two bytes a unit."""
    for _, texts in blocks(text_batches(batches)):
        u = units(texts, shared.value)
        data, end = sign_codes(u.signs).tobytes(), 2 * np.cumsum(u.length)
        yield pa.RecordBatch.from_arrays([pa.array([data[e - 2 * n : e] for n, e in zip(u.length.tolist(), end.tolist()) if n], pa.binary())], names=["codes"])


def _expected(batches: Iterable[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    """The task's sums under ``m``, as one row."""
    found = Expectation(m)
    for b in batches:
        codes, times = b.column(0).to_pylist(), b.column(1).to_numpy()
        block = np.cumsum([len(c) // 2 for c in codes]) // BLOCK_UNITS
        for part in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(block)) + 1):
            held = [codes[i] for i in part]
            found.add(np.frombuffer(b"".join(held), dtype="<i2"), np.array([len(c) // 2 for c in held], dtype=np.int64), times[part])
    yield pa.RecordBatch.from_arrays([pa.array([found.sums().tolist()], pa.list_(pa.float64()))], names=["sums"])


def fit_pages(df: DataFrame, text_col: str, common: np.ndarray, m: Model) -> Model:
    """The model estimated from ``m`` on all pages of ``df``.

    Equal sequences of units count together. Each round is one pass over the sequences and sends one row of some hundred
    sums a task to the driver. A page's units are gone through one after the other, so the longest page bounds a round's time.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(common)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    pages = map_arrow(df.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), partial(_sequences, shared=shared), "codes binary")
    pages = stage(pages.groupBy("codes").agg(F.count(F.lit(1)).alias("times")).repartition(tasks), "sequences", tidy=True)

    def expected(m: Model) -> np.ndarray | None:
        rows = map_arrow(pages, partial(_expected, m=m), "sums array<double>").collect()  # one row a task
        return np.sum([r.sums for r in rows], axis=0) if rows else None

    m = _estimate(m, expected)
    unstage(pages)
    return m


_SCHEMA = "units int, words bigint, chars bigint, prose_share double, link_share double, tag_share double, menu_share double, word_share double, spam boolean"
_LABEL_OF = np.array([LABELS.index(s) for s in STATES])


def _label(batches: Iterable[pa.RecordBatch], shared, most: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    common, model = shared.value
    for ids, texts in blocks(text_batches(batches)):
        u = units(texts, common)
        page = np.repeat(np.arange(len(ids)), u.length)
        cell = page * len(LABELS) + _LABEL_OF[label(model, u.signs, u.length)]
        chars, words = (np.bincount(cell, weights=w, minlength=len(ids) * len(LABELS)).reshape(-1, len(LABELS)) for w in (u.chars, u.words))
        total = chars.sum(axis=1)
        share = chars / np.maximum(total, 1)[:, None]
        other = words[:, 1:].sum(axis=1) / np.maximum(words.sum(axis=1), 1)
        spam = share[:, 1:].sum(axis=1) > most
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array(u.length.astype(np.int32)), pa.array(words.sum(axis=1).astype(np.int64)), pa.array(total.astype(np.int64)), *(pa.array(np.ascontiguousarray(share[:, i])) for i in range(len(LABELS))), pa.array(other), pa.array(spam)],
            names=["id", "units", "words", "chars", "prose_share", "link_share", "tag_share", "menu_share", "word_share", "spam"],
        )


def spam_pages(df: DataFrame, id_col: str, text_col: str, most_share: float = 0.5) -> DataFrame:
    """Every page with the shares of its characters by label, and whether it is spam: (id, units, words, chars, prose_share, link_share, tag_share, menu_share, word_share, spam).

    ``spam``: more than ``most_share`` of the characters lie in line units labelled link list, tag list or menu;
    ``word_share`` is the same share of words outside addresses. The model is estimated without labels on all pages, and
    every page is labelled. Null and empty texts have no units and
    are no spam; rows with a null id are left out; repeated rows come out each; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    common = function_words(spark)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    kind = source.schema["id"].dataType
    model = fit_pages(source, "text", common, first_model())
    shared = spark.sparkContext.broadcast((common, model))
    return map_arrow(source, partial(_label, shared=shared, most=most_share, kind=to_arrow_type(kind)), f"id {kind.simpleString()}, {_SCHEMA}")
