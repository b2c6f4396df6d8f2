"""Queries over texts: splitting, tokens, TF-IDF, codebooks, inverted index, search, full text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhawk.functions import text as T
from quillhawk.functions.stem import stemmed
from quillhawk.operators import codebook as cb
from quillhawk.operators import extractors, fulltext, index, search, tfidf
from quillhawk.plans.common import SQL_BOOK, SQL_CHUNKS, STOP, records, registry, sql_clean, sql_first, sql_paragraphs, sql_strip, sql_tokens, table
from quillhawk.runtime import stage

REGISTERED, query = registry()
HOW = tfidf.Preprocess(custom=STOP)
TOP = 200


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(_docs(spark, sf_dir), "doc_id", "text")


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.term_frequency(_docs(spark, sf_dir), "doc_id", "text", HOW)


@query(f"select doc_id, {sql_clean('text')} as text from documents")
def text_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(f"select doc_id, (generate_subscripts(ps, 1) - 1)::int as paragraph_index, unnest(ps) as paragraph from (select doc_id, {sql_paragraphs(sql_clean('text'))} as ps from documents)")
def text_paragraphs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(T.clean_text(F.col("text")))).alias("paragraph_index", "paragraph"))


@query(f"with {SQL_CHUNKS} select doc_id, chunk_index, chunk_id, 'text' as modality, num_chars, content from chunks")
def text_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query(f"select doc_id, (generate_subscripts(ts, 1) - 1)::int as position, unnest(ts) as term from (select doc_id, {sql_tokens('text')} as ts from documents)")
def text_tokens(spark, sf_dir):
    return tfidf.token_rows(_docs(spark, sf_dir), "doc_id", "text", HOW)


@query()
def stem_tokens_languages(spark, sf_dir):
    """Full preprocessing by the documents' language: the library's stop words where it has them, Snowball stems for English, Spanish and German, other words as they are."""
    lang = F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit(""))
    known = (("en", "english"), ("es", "spanish"), ("fr", "french"), ("de", "german"))
    out = None
    for code, name in (*known, (None, "")):
        rows = _docs(spark, sf_dir).where(lang == code if code else ~lang.isin([c for c, _ in known]))
        words = rows.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("stem"))
        stop = T.stopwords(spark, name)
        if stop:
            words = words.join(F.broadcast(spark.createDataFrame([(w,) for w in stop], "stem string")), "stem", "left_anti")  # a fixed list
        counts = words.groupBy("doc_id", "stem").agg(F.count(F.lit(1)).alias("count"))
        part = stemmed(counts, "stem", name).groupBy("doc_id", "stem").agg(F.sum("count").alias("count"))
        out = part if out is None else out.unionByName(part)
    return out


_TF = f"tf as (select doc_id, term, count(*) as count from (select doc_id, unnest({sql_tokens('text')}) as term from documents) group by all)"


@query(f"with {_TF} select * from tf")
def term_frequency(spark, sf_dir):
    return _tf(spark, sf_dir)


@query(f"with {_TF} select doc_id, term, round(1 + ln(count), 8) as weight from tf")
def tf_weight(spark, sf_dir):
    return _tf(spark, sf_dir).select("doc_id", "term", F.round(tfidf.tf_weight(F.col("count")), 8).alias("weight"))


_FIT = f"{_TF}, vocab as (select term, (row_number() over (order by term) - 1)::int as idx, count(*) as df, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from tf group by term)"


def _model(spark, sf_dir, tf):
    return tfidf.fit_tfidf(tf, _docs(spark, sf_dir).count(), "doc_id")


@query(f"with {_FIT} select term, idx, df, round(idf, 8) as idf from vocab")
def tfidf_fit(spark, sf_dir):
    return _model(spark, sf_dir, _tf(spark, sf_dir)).vocabulary.withColumn("idf", F.round("idf", 8))


@query(f"with {_TF}, top as (select term, count(*) as df from tf group by term order by df desc, term limit 100) select (row_number() over (order by df desc, term) - 1)::int as idx, term from top")
def tfidf_feature_names(spark, sf_dir):
    """Names of the hundred features of a bounded vocabulary."""
    extractor = extractors.TfidfExtractor("doc_id", "text", HOW, 100).fit(_docs(spark, sf_dir))
    return extractor.model.feature_names()


@query(f"""with {_FIT}, w as (select doc_id, term, idx, (1 + ln(count)) * idf as w from tf join vocab using (term))
select doc_id, term, idx, round(w / sqrt(sum(w * w) over (partition by doc_id)), 8) as weight from w""")
def tfidf_transform(spark, sf_dir):
    tf = stage(_tf(spark, sf_dir), "tf")
    return _model(spark, sf_dir, tf).transform(tf, "doc_id").withColumn("weight", F.round("weight", 8))


def _book(spark, sf_dir):
    chunks = stage(_chunks(spark, sf_dir), "chunks")
    tf = stage(tfidf.term_frequency(chunks, "chunk_id", "content", HOW), "tf")
    return chunks, tf, cb.text_codebook(tf, chunks.count(), TOP)


@query(f"with {SQL_BOOK} select * from book")
def text_codebook(spark, sf_dir):
    return _book(spark, sf_dir)[2]


@query(f"with {SQL_BOOK} select chunk_id, idx, round((1 + ln(count)) * idf, 8) as weight from ctf join book using (term)")
def text_histogram_app(spark, sf_dir):
    _, tf, book = _book(spark, sf_dir)
    return cb.text_histogram(tf, book, "chunk_id").withColumn("weight", F.round("weight", 8))


@query(f"with {SQL_BOOK}, w as (select chunk_id, idx, count * idf as w from ctf join book using (term)) select chunk_id, idx, round(w / sqrt(sum(w * w) over (partition by chunk_id)), 8) as weight from w")
def text_histogram_raw(spark, sf_dir):
    _, tf, book = _book(spark, sf_dir)
    return cb.text_histogram(tf, book, "chunk_id", "raw").withColumn("weight", F.round("weight", 8))


_QUERY_SQL = SQL_BOOK + rf""",
qtf as (select query_id, term, count(*) as count from (select doc_id as query_id, unnest({sql_tokens('title')}) as term from documents where doc_id % 100 = 0 and title is not null) group by all),
qh as (select query_id, idx, (1 + ln(count)) * idf as wq from qtf join book using (term)),
ih as (select chunk_id, idx, (1 + ln(count)) * idf as wi from ctf join book using (term)),
qn as (select query_id, sqrt(sum(wq * wq)) as nq from qh group by all), cn as (select chunk_id, sqrt(sum(wi * wi)) as ni from ih group by all),
scored as (select query_id, chunk_id, round(sum(wq * wi / (nq * ni)), 8) as score from qh join ih using (idx) join qn using (query_id) join cn using (chunk_id) group by all)
"""


def _search_tables(spark, sf_dir):
    """The queries are the titles of the documents whose id is divisible by 100; the items all chunks."""
    _, tf, book = _book(spark, sf_dir)
    asked = _docs(spark, sf_dir).where((F.col("doc_id") % 100 == 0) & F.col("title").isNotNull()).select(F.col("doc_id").alias("query_id"), "title")
    queries = cb.text_histogram(tfidf.term_frequency(asked, "query_id", "title", HOW), book, "query_id")
    return queries, cb.text_histogram(tf, book, "chunk_id")


@query(f"with {_QUERY_SQL} select distinct query_id, chunk_id from qh join ih using (idx)")
def text_candidates(spark, sf_dir):
    queries, items = _search_tables(spark, sf_dir)
    return search.candidates(queries, items, "query_id", "chunk_id")


@query(f"with {_QUERY_SQL} select query_id, (row_number() over (partition by query_id order by score desc, chunk_id))::int as rank, chunk_id, score from scored qualify rank <= 10")
def text_search(spark, sf_dir):
    queries, items = _search_tables(spark, sf_dir)
    return search.text_search(queries, items, "query_id", "chunk_id", 10)


_ITEM_SQL = _QUERY_SQL.replace("doc_id as query_id", "item_id as query_id").replace("from documents where doc_id % 100 = 0 and title is not null", "from eval_items").replace(f"unnest({sql_tokens('title')})", f"unnest({sql_tokens('text')})")


@query(f"with {_ITEM_SQL} select query_id, (row_number() over (partition by query_id order by score desc, chunk_id))::int as rank, chunk_id, score from scored qualify rank <= 5")
def item_search(spark, sf_dir):
    """The five best chunks for every evaluation item."""
    _, tf, book = _book(spark, sf_dir)
    asked = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    queries = cb.text_histogram(tfidf.term_frequency(asked, "query_id", "text", HOW), book, "query_id")
    return search.text_search(queries, cb.text_histogram(tf, book, "chunk_id"), "query_id", "chunk_id", 5)


@query(f"""with {_QUERY_SQL}, hits as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from scored qualify r <= 30),
best as (select *, regexp_extract(chunk_id, '^(.*)_text_', 1) as document from hits qualify row_number() over (partition by query_id, document order by r) = 1)
select query_id, (row_number() over (partition by query_id order by score desc, chunk_id))::int as rank, document, chunk_id, round(score, 4) as score from best qualify rank <= 10""")
def text_search_dedup(spark, sf_dir):
    queries, items = _search_tables(spark, sf_dir)
    hits = search.text_search(queries, items, "query_id", "chunk_id", 30)
    return search.first_per_document(hits, "query_id", "chunk_id", F.regexp_extract("chunk_id", "^(.*)_text_", 1), 10)


@query(f"""select c.doc_id, case when length(f) > 10 then f else c.chunk_id end as title from (select doc_id, chunk_id, {sql_strip("coalesce(list_filter(string_split_regex(" + sql_strip('content') + ", '\\r\\n|[\\n\\r\\x0B\\x0C\\x{85}\\x{2028}\\x{2029}]'), lambda x: trim(x) <> '')[1], '')")} as f from (with {SQL_CHUNKS} select * from chunks where chunk_index = 0)) c""")
def document_titles(spark, sf_dir):
    first = _chunks(spark, sf_dir).where("chunk_index = 0")
    return first.select("doc_id", T.title_of(F.col("content"), F.col("chunk_id")).alias("title"))


_LINES = "list_filter(string_split_regex(" + sql_strip("content") + ", '\\r\\n|[\\n\\r\\x0B\\x0C\\x{85}\\x{2028}\\x{2029}]'), lambda x: trim(x) <> '')"


@query(f"""with l as (select id, {sql_strip('content')} as body, {_LINES} as ls from {sql_first('pg_text_docs', 'content')}),
t as (select *, case when length({sql_strip("coalesce(ls[1], '')")}) > 10 then {sql_strip("coalesce(ls[1], '')")} else id::varchar end as title from l),
s as (select *, case when len(ls) > 0 and {sql_strip("coalesce(ls[1], '')")} = title then substring({sql_strip("coalesce(array_to_string(ls[2:], ' '), '')")}, 1, 300) else substring(body, 1, 300) end as cut from t)
select id, title, case when cut = '' then substring(body, 1, 300) else cut end as snippet from s""")
def record_snippets(spark, sf_dir):
    rows = records(spark, sf_dir, "pg_text_docs", "content")
    title = T.title_of(F.col("content"), F.col("id").cast("string"))
    return rows.select("id", title.alias("title"), T.snippet_of(F.col("content"), title).alias("snippet"))


@query("select doc_id, case when title is null or len(regexp_extract_all(lower(title), '[a-z0-9]+')) = 0 then 'emptyqueryterm' else array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' | ') end as or_query from documents")
def or_tsquery(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.or_query(F.col("title")).alias("or_query"))


WEB = "table language or \"central note\" -singer"
_TERMS = r"regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}]+')"


def _sql_rank(words: list[str]) -> str:
    parts = " + ".join(f"case when len(list_filter(t, lambda x: x = '{w}')) > 0 then 1 + ln(len(list_filter(t, lambda x: x = '{w}'))) else 0 end" for w in words)
    return f"(({parts}) / (1 + ln(1 + len(t))))"


_FULLTEXT = f"""with r as (select id, {_TERMS} as t from {sql_first('pg_text_docs', 'content')}),
m as (select id, t, (list_contains(t, 'table') and list_contains(t, 'language')) or ((' ' || array_to_string(t, ' ') || ' ') like '% central note %' and not list_contains(t, 'singer')) as web,
 list_has_any(t, ['table', 'language', 'or', 'central', 'note', 'singer']) as anyw from r)
select id, web, round(case when web then {_sql_rank(['table', 'language', 'central', 'note'])} else 0 end + case when anyw then {_sql_rank(['table', 'language', 'or', 'central', 'note', 'singer'])} else 0 end * 0.5, 8) as score from m where web or anyw"""


@query(_FULLTEXT)
def fulltext_match(spark, sf_dir):
    return fulltext.fulltext_search(records(spark, sf_dir, "pg_text_docs", "content"), "id", "content", WEB)


_STOPPED = fulltext.Analysis(stop=(*STOP, "or"))
_STORED_SQL = f"""p as (select id, len(t) as terms, unnest(t) as term, generate_subscripts(t, 1) - 1 as position from (select id, {_TERMS} as t from {sql_first('pg_text_docs', 'content')})),
kept as (select * from p where term not in ({', '.join(f"'{w}'" for w in _STOPPED.stop)}))"""


@query(f"with {_STORED_SQL} select term, id, array_to_string(list(position order by position), ' ') as positions, any_value(terms)::int as terms from kept group by term, id")
def fulltext_postings(spark, sf_dir):
    """The stored full-text index of the records: positions of every term that is no stop word."""
    found = fulltext.postings(records(spark, sf_dir, "pg_text_docs", "content"), "id", "content", _STOPPED)
    return found.select("term", "id", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"), "terms")


@query(f"""with {_STORED_SQL}, c as (select id, term, any_value(terms) as terms, 1 + ln(count(*)) as w from kept where term in ('table', 'language', 'central', 'note', 'singer') group by all),
near as (select distinct a.id from kept a join kept b on a.id = b.id and b.position = a.position + 1 where a.term = 'central' and b.term = 'note'),
m as (select id, any_value(terms) as terms, (count(*) filter (where term in ('table', 'language')) = 2) or (id in (select id from near) and count(*) filter (where term = 'singer') = 0) as web,
 coalesce(sum(w) filter (where term <> 'singer'), 0) as r, sum(w) as o from c group by id)
select id, web, round((case when web then r else 0 end + 0.5 * o) / (1 + ln(1 + terms)), 8) as score from m""")
def fulltext_stored_search(spark, sf_dir):
    """The web query over stored postings without stop words: only the postings of its terms are read."""
    found = stage(fulltext.postings(records(spark, sf_dir, "pg_text_docs", "content"), "id", "content", _STOPPED), "postings")
    return fulltext.search_postings(found, WEB, _STOPPED)


@query(f"select * from ({_FULLTEXT}) order by score desc, id limit 20")
def fulltext_top(spark, sf_dir):
    return fulltext.fulltext_search(records(spark, sf_dir, "pg_text_docs", "content"), "id", "content", WEB, 20)


_HIST = "(select chunk_id, modality, histogram from histogram_records where chunk_id is not null and chunk_id <> '' and modality = 'text' and histogram is not null and len(histogram) = 24 and metadata is not null and len(list_filter(histogram, lambda x: x is null or isnan(x) or isinf(x))) = 0 qualify row_number() over (partition by chunk_id order by histogram::varchar) = 1)"


def _text_records(spark, sf_dir):
    """Valid text records of the usual length, one per id."""
    good, _ = index.split_records(table(spark, sf_dir, "histogram_records"))
    good = good.where((F.col("modality") == "text") & (F.size("histogram") == 24))
    return good.groupBy("chunk_id").agg(F.min_by("histogram", F.concat(F.lit("["), F.array_join(F.transform("histogram", lambda x: x.cast("string")), ", "), F.lit("]"))).alias("histogram"))


@query("""select coalesce(problem, 'valid') as problem, count(*) as records from (select case when coalesce(chunk_id, '') = '' then 'id' when not coalesce(modality in ('text', 'image', 'audio'), false) then 'modality'
when metadata is null then 'metadata' when histogram is null or len(histogram) = 0 then 'histogram' when len(list_filter(histogram, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'not finite' end as problem from histogram_records) group by all""")
def validate_records(spark, sf_dir):
    checked = table(spark, sf_dir, "histogram_records").select(index.record_problem().alias("problem"))
    return checked.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count(F.lit(1)).alias("records"))


@query(f"select * from (select (generate_subscripts(histogram, 1) - 1)::int as codeword, chunk_id, unnest(histogram) as frequency from {_HIST}) where frequency > 0")
def inverted_postings(spark, sf_dir):
    return index.postings(_text_records(spark, sf_dir))


_BLOCKS = f"""p as (select (row_number() over (order by chunk_id) - 1) // 100 as block_id, chunk_id, histogram from {_HIST}),
f as (select block_id, chunk_id, (generate_subscripts(histogram, 1) - 1)::int as codeword, unnest(histogram) as frequency from p)"""


@query(f"with {_BLOCKS} select block_id, codeword, array_to_string(list(chunk_id order by chunk_id), ' ') as ids, sum(frequency) as total from f where frequency > 0 group by all")
def spimi_blocks(spark, sf_dir):
    return _flat(index.blocks(_text_records(spark, sf_dir), 100), "block_id", "codeword")


@query(f"select chunk_id, histogram[4] as frequency from {_HIST} where histogram[4] > 0")
def index_lookup(spark, sf_dir):
    """The postings of codeword 3 from a stored index."""
    stored = stage(index.clustered(index.postings(_text_records(spark, sf_dir))), "index")
    return stored.where("codeword = 3").select("chunk_id", "frequency")


@query(f"with {_BLOCKS} select codeword, chunk_id, frequency from f where frequency > 0")
def spimi_merge(spark, sf_dir):
    return index.merge_blocks(index.blocks(_text_records(spark, sf_dir), 100))


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    ids = F.array_join(F.transform("postings", lambda p: p["chunk_id"]), " ")
    return df.select(*keys, ids.alias("ids"), F.aggregate("postings", F.lit(0.0), lambda s, p: s + p["frequency"]).alias("total"))


@query(f"select count(*) as n_comparisons, max(len(histogram))::int as vector_dim, round(count(*) * max(len(histogram)) * 4 / 1048576, 3) as index_mb, ceil(count(*) / 100.0)::bigint as spimi_blocks from {_HIST}")
def index_stats(spark, sf_dir):
    return index.statistics(_text_records(spark, sf_dir), "histogram", 100)
