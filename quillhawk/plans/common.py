"""Helpers of the registered queries and pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillhawk.functions.text import LETTERS, MAX_CHARS, MIN_CHARS
from quillhawk.runtime import first_wins

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed stop words of the registered queries (frequent words of the four languages).
STOP = (
    "the", "and", "of", "in", "to", "is", "it", "an", "from", "that", "was", "if", "as", "on", "with", "up", "when", "but", "after", "for", "which",
    "el", "la", "los", "las", "un", "una", "de", "del", "en", "que", "con", "por", "para", "le", "les", "des", "du", "et", "dans", "der", "die", "das", "den", "und", "von", "mit",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return first_wins(table(spark, sf_dir, name), "chunk_id", "id", ["id", "chunk_id", *columns])


def registry() -> tuple[dict[str, tuple[Query, str | None]], Callable]:
    registered: dict[str, tuple[Query, str | None]] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            registered[f.__name__] = (f, sql)
            return f

        return put

    return registered, query


WS = r"[\s\x0B\x{85}\p{Z}]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_clean(x: str) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '•{WS}*\n{WS}*', '• ', 'g')"
    x = rf"regexp_replace({x}, '-{WS}*\n{WS}*', '-', 'g')"
    return sql_strip(rf"regexp_replace({x}, '[ \t]+', ' ', 'g')")


def sql_paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\n{WS}*\n'), lambda p: {sql_strip('p')}), lambda p: p <> '')"


def sql_tokens(x: str, stop: tuple[str, ...] = STOP) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    drop = f" and not list_contains([{listed}], t)" if stop else ""
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^{LETTERS}\s]', '', 'g'), '\s+'), lambda t: length(t) > 1{drop})"


_CUT = f"list_filter(list_transform(range(0, (length(b.cur) + {MAX_CHARS - 1}) // {MAX_CHARS}), lambda i: {sql_strip(f'substring(b.cur, i * {MAX_CHARS} + 1, {MAX_CHARS})')}), lambda x: x <> '')"
_CLOSED = "case when a.cur <> '' then list_append(a.parts, a.cur) else a.parts end"

#: ``chunks``: (doc_id, chunk_index, chunk_id, num_chars, content) of documents.
SQL_CHUNKS = rf"""
paras as (select doc_id, unnest({sql_paragraphs(sql_clean('text'))}) as p, generate_subscripts({sql_paragraphs(sql_clean('text'))}, 1) as n from documents),
kept as (select * from paras where length(p) >= {MIN_CHARS}),
sents as (select doc_id, n, p, list_filter(list_transform(string_split(regexp_replace(p, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '') as ss from kept),
packs as (select doc_id, n, p, list_reduce(list_transform(ss, lambda s: {{'parts': []::varchar[], 'cur': s}}), lambda a, b:
  case when length(b.cur) > {MAX_CHARS} then {{'parts': list_concat({_CLOSED}, {_CUT}), 'cur': ''}}
       when length(a.cur) + length(b.cur) + 1 <= {MAX_CHARS} then {{'parts': a.parts, 'cur': case when a.cur = '' then b.cur else a.cur || ' ' || b.cur end}}
       else {{'parts': {_CLOSED}, 'cur': b.cur}} end, {{'parts': []::varchar[], 'cur': ''}}) as a from sents),
parts as (select doc_id, n, case when length(p) <= {MAX_CHARS} then [p] else {_CLOSED} end as ps from packs),
flat as (select doc_id, n, unnest(ps) as content, generate_subscripts(ps, 1) as m from parts),
chunks as (select doc_id::varchar as doc_id, (row_number() over (partition by doc_id order by n, m) - 1)::int as chunk_index,
  doc_id || '_text_' || (row_number() over (partition by doc_id order by n, m) - 1) as chunk_id, length(content)::int as num_chars, content from flat)
"""

#: ``ctf``: (chunk_id, term, count); ``book``: the 200 most frequent terms with idx and idf.
SQL_BOOK = SQL_CHUNKS + rf""",
ctok as (select chunk_id, unnest({sql_tokens('content')}) as term from chunks),
ctf as (select chunk_id, term, count(*) as count from ctok group by all),
cdf as (select term, count(*) as df from ctf group by all order by df desc, term limit 200),
book as (select term, (row_number() over (order by df desc, term) - 1)::int as idx, df, round(ln((select count(*) from chunks)::double / df) + 1, 4) as idf from cdf)
"""


def sql_first(name: str, columns: str) -> str:
    """First-wins records of a table."""
    return f"(select id, chunk_id, {columns} from {name} where chunk_id is not null qualify row_number() over (partition by chunk_id order by id) = 1)"
