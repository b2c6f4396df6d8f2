"""Boolean full text: stored postings, a web-style query grammar, match predicates and a documented rank."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhawk.functions.stem import stem, stemmed
from quillhawk.runtime import stage


@dataclass
class WebQuery:
    """Alternatives of required phrases (lists of adjacent terms) and forbidden phrases."""

    groups: list[tuple[list[list[str]], list[list[str]]]] = field(default_factory=list)


def parse_web_query(text: str) -> WebQuery:
    """Words are all required, quoted words stand together, ``or`` starts an alternative, a hyphen forbids."""
    out = WebQuery([([], [])])
    for minus, phrase, word in re.findall(r"(-?)\"([^\"]*)\"|(\S+)", text.lower()):
        if word == "or" and (out.groups[-1][0] or out.groups[-1][1]):
            out.groups.append(([], []))
            continue
        forbidden = minus == "-" or (not phrase and word.startswith("-"))
        terms = re.findall(r"[^\W_]+", phrase or word)
        if terms:
            out.groups[-1][1 if forbidden else 0].append(terms)
    out.groups = [g for g in out.groups if g[0] or g[1]]
    return out


def terms_of(text: Column) -> Column:
    """Terms in order: runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


@dataclass(frozen=True)
class Analysis:
    """How terms are stored and asked for: stop words that are left out (positions keep counting them) and a stemmer's language."""

    stop: tuple[str, ...] = ()
    stem_language: str = ""

    def word(self, word: str) -> str | None:
        return None if word in self.stop else stem(word, self.stem_language)

    def phrase(self, words: list[str]) -> list[tuple[int, str]]:
        """(offset, term) of the words that are stored."""
        return [(i, t) for i, w in enumerate(words) if (t := self.word(w)) is not None]


def postings(df: DataFrame, id_col: str, text_col: str, how: Analysis = Analysis()) -> DataFrame:
    """(term, id, positions, terms): the stored full-text index, one row per term and record.

    ``positions`` counts from 0 over all terms of the record, stop words too; ``terms`` is that number. Stems are taken of
    the distinct terms only and joined. Null ids give no rows, texts without stored terms neither.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), terms_of(F.col(text_col)).alias("t"))
    flat = rows.select("id", F.size("t").alias("terms"), F.posexplode("t").alias("position", "term"))
    if how.stop:
        stop = df.sparkSession.createDataFrame([(w,) for w in how.stop], "term string")  # a fixed list
        flat = flat.join(F.broadcast(stop), "term", "left_anti")
    if how.stem_language:
        flat = stemmed(flat, "term", how.stem_language)
    # a record's positions of one term are as many as the record holds
    return flat.groupBy("term", "id").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.first("terms").alias("terms"))


def write_postings(found: DataFrame, path: str) -> None:
    """Postings in order of term and id, so that a query reads the row groups of its terms only."""
    found.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def _holds(at: dict[str, Column], phrase: list[tuple[int, str]]) -> Column:
    """Whether the terms of a phrase stand at its offsets; ``at`` has each term's positions, null where it is absent."""
    if not phrase:
        return F.lit(True)
    first, rest = phrase[0], phrase[1:]
    near = lambda p: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(at[t], p + (o - first[0])), F.lit(False)) for o, t in rest], F.lit(True))
    return F.coalesce(F.exists(at[first[1]], near), F.lit(False))


def matches_web(at: dict[str, Column], query: WebQuery, how: Analysis) -> Column:
    result = F.lit(False)
    for must, never in query.groups:
        asked, banned = [how.phrase(p) for p in must], [how.phrase(p) for p in never]
        one = F.lit(bool([p for p in asked if p]))  # of stop words only nothing is asked
        for p in asked:
            one = one & _holds(at, p)
        for p in banned:
            if p:
                one = one & ~_holds(at, p)
        result = result | one
    return result


def text_rank(at: dict[str, Column], terms: Column, words: list[str]) -> Column:
    """Sum over the query's distinct terms of 1 + ln(count), divided by 1 + ln(1 + number of terms); our own rank."""
    total = F.lit(0.0)
    for w in dict.fromkeys(words):
        n = F.coalesce(F.size(at[w]), F.lit(0)) if w in at else F.lit(0)
        total = total + F.when(n > 0, 1 + F.ln(n)).otherwise(0.0)
    return total / (1 + F.ln(1 + terms))


def search_postings(stored: DataFrame, query: str, how: Analysis = Analysis(), k: int | None = None) -> DataFrame:
    """(id, web, score) of the records that match the web query or any of its words: score rank(web) + 0.5 * rank(or).

    Only the postings of the query's terms are read; no text is scanned. A group of the query that asks for nothing but
    stop words matches nothing, nor does one that only forbids.
    """
    parsed = parse_web_query(query)
    web = [t for must, _ in parsed.groups for p in must for _, t in how.phrase(p)]
    any_ = [t for w in re.findall(r"[^\W_]+", query.lower()) if (t := how.word(w)) is not None]
    wanted = sorted({*web, *any_, *(t for _, never in parsed.groups for p in never for _, t in how.phrase(p))})
    rows = stored.where(F.col("term").isin(wanted)) if wanted else stored.where(F.lit(False))
    per = rows.groupBy("id").agg(F.first("terms").alias("terms"), *[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"at{i}") for i, w in enumerate(wanted)])
    at = {w: F.col(f"at{i}") for i, w in enumerate(wanted)}
    some = F.lit(False)
    for w in any_:
        some = some | at[w].isNotNull()
    marked = per.withColumns({"web": matches_web(at, parsed, how), "any": some}).where("web or any")
    score = F.when(F.col("web"), text_rank(at, F.col("terms"), web)).otherwise(0.0) + F.when(F.col("any"), text_rank(at, F.col("terms"), any_)).otherwise(0.0) * 0.5
    out = marked.select("id", "web", F.round(score, 8).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(k) if k else out


def fulltext_search(df: DataFrame, id_col: str, text_col: str, query: str, k: int | None = None, how: Analysis = Analysis()) -> DataFrame:
    """The same over texts that have no stored postings yet: they are staged first."""
    found = stage(postings(df, id_col, text_col, how), "postings")
    return search_postings(found, query, how, k).withColumnRenamed("id", id_col)
