"""Cutting long texts into pieces under a limit, at natural boundaries, with a bounded overlap.

The least number of pieces gives equally spaced targets; each target snaps to the strongest boundary nearby (paragraph,
then sentence; words and single characters only inside a stretch that is itself over the limit). Where a piece is still
too long, or leaves no room for the overlap, pieces are added within its stretch in the same way until none is.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.runtime import map_arrow

CHAR, WORD, SENTENCE, PARAGRAPH = 0, 1, 2, 3
_NAMES = ("char", "word", "sentence", "paragraph")
_SENTENCE = re.compile(r"(?:(?<=[.!?])|(?<=[.!?][\"')\]»”]))\s+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_BLANK = re.compile(r"\s+")


def boundaries(text: str) -> list[tuple[int, int, int]]:
    """Natural boundaries (start and end of the white space, strength) of a stripped text, in order."""
    found = {m.start(): (m.start(), m.end(), SENTENCE) for m in _SENTENCE.finditer(text)}
    at = 0
    while m := _PARAGRAPH.search(text, at):
        a, b = m.start(), m.end()
        while a and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        found[a] = (a, b, PARAGRAPH)
        at = b
    return [found[a] for a in sorted(found)]


def _all_cuts(text: str, natural: list[tuple[int, int, int]], limit: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Natural boundaries, with cuts at words or characters inside stretches over the limit; whether there were such."""
    cuts, hard, at = [], False, 0
    for a, b, s in [*natural, (len(text), len(text), PARAGRAPH)]:
        if a - at > limit:
            hard, last = True, at
            for m in [*_BLANK.finditer(text, at, a), None]:
                x = m.start() if m else a
                cuts += [(c, c, CHAR) for c in range(last + limit, x, limit)]
                if m and m.start() > at:
                    cuts.append((m.start(), m.end(), WORD))
                    last = m.end()
        cuts.append((a, b, s))
        at = b
    return cuts[:-1], hard


def cut(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Pieces (start, end, strength of the cut after it, -1 for the last) of a stripped text; whether a hard cut is needed."""
    n = len(text)
    if n <= limit:
        return [(0, n, -1)], False
    cuts, hard = _all_cuts(text, boundaries(text), limit)
    starts = [c[0] for c in cuts]
    chosen: list[tuple[int, int, int]] = []
    room = limit - overlap

    def place(low: int, high: int, pieces: int) -> list[tuple[int, int, int]]:
        """Cuts near the equal targets of ``pieces`` pieces of the text from low to high."""
        found, at, width = [], low, (high - low) / pieces
        for i in range(1, pieces):
            target = low + i * width
            a, b = bisect.bisect_right(starts, max(at, target - width / 2)), bisect.bisect_left(starts, min(high, target + width / 2))
            if a < b:
                found.append(max(cuts[a:b], key=lambda c: (c[2], -abs(c[0] - target))))
                at = found[-1][1]
        return found

    todo = [(0, n, 1 + -(-(n - limit) // room))]  # stretches from the end of a cut to the start of the next
    while todo:
        low, high, pieces = todo.pop()
        found = place(low, high, pieces)
        if not found:
            if high - low <= limit:  # no boundary near: the piece stays and its overlap is shorter
                continue
            middle, a, b = (low + high) / 2, bisect.bisect_right(starts, low), bisect.bisect_left(starts, high)
            found = [max(cuts[a:b], key=lambda c: (c[2] > CHAR, -abs(c[0] - middle)))]
        chosen += found
        for a, b in zip([low, *(c[1] for c in found)], [*(c[0] for c in found), high]):
            if b - a > (limit if a == 0 else room):
                todo.append((a, b, max(2, -(-(b - a) // room))))
    best = sorted(chosen)
    out, at, before = [], 0, 0
    for a, b, s in [*best, (n, n, -1)]:
        start = at
        spare = min(overlap, limit - (a - at))
        if at and spare > 0:
            start = max(before, at - spare)
            gap = _BLANK.search(text, start, at)
            if start > before and not text[start - 1].isspace():
                start = gap.end() if gap else at
            while start < at and text[start].isspace():
                start += 1
        out.append((start, a, s))
        before, at = start, b
    return out, hard


def _split(batches: Iterable[pa.RecordBatch], limit: int, overlap: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = (text or "").strip()
            if len(text) <= limit:
                continue
            parts, _ = cut(text, limit, overlap)
            hard, end = any(s in (CHAR, WORD) for _, _, s in parts), 0
            for piece, (a, b, s) in enumerate(parts):
                rows.append((i, piece, a, b, max(0, end - a), _NAMES[s] if s >= 0 else "end", "hard" if hard else "soft", text[a:b]))
                end = b
        columns = list(zip(*rows)) or [()] * 8
        kinds = (kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "piece", "start", "stop", "overlap", "cut", "kind", "text"])


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 800, overlap: int = 80) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters: (id, piece, start, stop, overlap, cut, kind, text).

    White space at both ends is stripped first; positions count characters of the stripped text. Every piece has at most
    ``limit`` characters and shares at most ``overlap`` with the one before; the pieces cover the text but for white
    space at cuts. ``kind`` is ``hard`` if some stretch between natural boundaries exceeds the limit, else ``soft``, and
    then every cut is natural. Null, empty and short texts give no rows; each input row is split by itself.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than it")
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    kind = source.schema["id"].dataType
    return map_arrow(source, 
        partial(_split, limit=limit, overlap=overlap, kind=to_arrow_type(kind)),
        f"id {kind.simpleString()}, piece int, start int, stop int, overlap int, cut string, kind string, text string",
    )
