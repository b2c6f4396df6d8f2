"""Queries over the stored tables: first-wins loads, names and paths, songs and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillhawk.functions import text as T
from quillhawk.operators import codebook as cb
from quillhawk.operators import evaluate, search, tabular, tfidf
from quillhawk.plans import service
from quillhawk.plans.common import SQL_BOOK, SQL_CHUNKS, STOP, records, registry, sql_first, sql_tokens, table
from quillhawk.sources.tables import unique_ids

REGISTERED, query = registry()


@query(f"select id, chunk_id, title, source, content from {sql_first('pg_text_docs', 'title, source, content')}")
def upsert_text(spark, sf_dir):
    return records(spark, sf_dir, "pg_text_docs", "title", "source", "content")


@query(f"select id, chunk_id, filename, image_url, len(embedding)::int as dim from {sql_first('pg_image_docs', 'filename, image_url, embedding')}")
def upsert_image(spark, sf_dir):
    return records(spark, sf_dir, "pg_image_docs", "filename", "image_url", "embedding").select("id", "chunk_id", "filename", "image_url", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@query(f"select id, chunk_id, filename, genre, len(embedding)::int as dim from {sql_first('pg_audio_docs', 'filename, genre, embedding')}")
def upsert_audio(spark, sf_dir):
    return records(spark, sf_dir, "pg_audio_docs", "filename", "genre", "embedding").select("id", "chunk_id", "filename", "genre", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@query("select id, case when n > 0 then chunk_id || '__dup' || n || '_' || id else chunk_id end as chunk_id, chunk_id as source_chunk_id from (select id, chunk_id, row_number() over (partition by chunk_id order by id) - 1 as n from pg_text_docs)")
def repair_ids(spark, sf_dir):
    return unique_ids(table(spark, sf_dir, "pg_text_docs").select("id", "chunk_id"), "chunk_id", "id").select("id", "chunk_id", "source_chunk_id")


_STEM = r"case when regexp_matches(filename, '[^/]\.[^./]*$') then regexp_extract(filename, '([^/]+)\.[^./]*$', 1) else regexp_extract(filename, '([^/]*)$', 1) end"


@query(f"select id, case when n > 0 then chunk_id || '__dup' || n || '_' || {_STEM} else chunk_id end as chunk_id from (select id, chunk_id, filename, row_number() over (partition by chunk_id order by id) - 1 as n from pg_image_docs where filename is not null and filename <> '')")
def repair_image_ids(spark, sf_dir):
    """Ids of images that were used before get the file's stem."""
    rows = table(spark, sf_dir, "pg_image_docs").where("filename is not null and filename <> ''").select("id", "chunk_id", T.file_stem(F.col("filename")).alias("stem"))
    return unique_ids(rows, "chunk_id", "id", "stem").select("id", "chunk_id")


_REASON = "case when chunk_id is null or embedding is null or len(embedding) = 0 then 'missing' when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'not finite' when len(list_filter(embedding, lambda x: x <> 0)) = 0 then 'zero' end"


@query(f"select chunk_id, {_REASON} as reason from {sql_first('pg_image_docs', 'embedding')} where {_REASON} is not null")
def rejected_vectors(spark, sf_dir):
    """Images that an index leaves out, with the reason."""
    return service.VectorPipeline().index(records(spark, sf_dir, "pg_image_docs", "embedding"), "chunk_id", "embedding")


@query(f"select id as query_id, substring(coalesce(content, ''), 1, 200) as text from (select id, content from {sql_first('pg_text_docs', 'content')} order by id limit 20) where trim(substring(coalesce(content, ''), 1, 200)) <> ''")
def eval_queries(spark, sf_dir):
    """The first twenty texts, cut to 200 characters, as queries; blank ones are left out."""
    return evaluate.asked_texts(records(spark, sf_dir, "pg_text_docs", "content"), "id", "content")


@query(f"select id, coalesce(nullif(title, ''), chunk_id) as title, coalesce(snippet, '') as snippet, coalesce(content, snippet, '') as content from {sql_first('pg_text_docs', 'title, snippet, content')}")
def null_safe_output(spark, sf_dir):
    rows = records(spark, sf_dir, "pg_text_docs", "title", "snippet", "content")
    return rows.select("id", F.coalesce(F.nullif("title", F.lit("")), "chunk_id").alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("content", "snippet", F.lit("")).alias("content"))


@query(r"select id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(source, ''), '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown') as safe_name from pg_text_docs")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pg_text_docs").select("id", T.safe_name(F.col("source")).alias("safe_name"))


def _url_sql(x: str) -> str:
    return f"replace(url_encode({x}), '%2F', '/')"


@query(f"""with r as (select id, filename, coalesce(genre, 'unknown') as genre, case when regexp_matches(filename, '[^/]\\.[^./]*$') then regexp_extract(filename, '([^/]+)\\.[^./]*$', 1) else regexp_extract(filename, '([^/]*)$', 1) end as stem from {sql_first('pg_audio_docs', 'filename, genre')} where filename is not null and filename <> '')
select id, array_to_string(list_transform(string_split(translate(stem, '._', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title, '/audio-full/' || {_url_sql("genre || '/' || filename")} as url from r""")
def pretty_titles(spark, sf_dir):
    """Display titles and encoded URLs of the audio recordings."""
    rows = records(spark, sf_dir, "pg_audio_docs", "filename", "genre").where("filename is not null and filename <> ''")
    return rows.select("id", T.pretty(T.file_stem(F.col("filename"))).alias("title"), T.static_url("/audio-full", F.concat_ws("/", F.coalesce("genre", F.lit("unknown")), "filename")).alias("url"))


@query(r"select distinct regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', 1) as stem, split_part(regexp_replace(path, '^.*?data/(full|samples)/', ''), '/', 3) as genre, regexp_replace(path, '^.*?/?data/(full|samples)/', 'mnt/\1/') as repaired from audio_manifest where path is not null and path like '%.%'")
def manifest_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "audio_manifest").where("path is not null and path like '%.%'").dropDuplicates(["path"])
    genre = F.split_part(F.regexp_replace("path", r"^.*?data/(full|samples)/", ""), F.lit("/"), F.lit(3))
    return rows.select(T.file_stem(F.col("path")).alias("stem"), genre.alias("genre"), T.repaired_path(F.col("path"), "mnt").alias("repaired")).distinct()


@query(r"""with p as (select distinct path, regexp_extract(path, '^(?:.*?/)?data/(.+)$', 1) as rel, regexp_extract(path, '^(?:.*?/)?data/samples/audio/(.+)$', 1) as sample, regexp_extract(path, '^(?:.*?/)?data/full/(.+)$', 1) as whole from audio_manifest where path is not null)
select path, replace(regexp_replace(case when rel <> '' then rel else regexp_extract(path, '([^/]*/?[^/]*)$', 1) end, '([^/])\.[^./]*$', '\1'), '/', '_') as file_id,
 case when sample <> '' then '/audio-samples/' || replace(url_encode(sample), '%2F', '/') when whole <> '' then '/audio-full/' || replace(url_encode(whole), '%2F', '/') else '' end as url from p""")
def media_urls(spark, sf_dir):
    """Ids and URLs of the recordings of the manifest, from their paths."""
    rows = table(spark, sf_dir, "audio_manifest").where("path is not null").select("path").distinct()
    return rows.select("path", T.file_id(F.col("path")).alias("file_id"), T.media_url(F.col("path"), {"data/samples/audio": "/audio-samples", "data/full": "/audio-full"}).alias("url"))


@query(f"""with m as (select lower(song_id) as stem, min(dataset) as dataset from audio_manifest where song_id is not null group by all)
select id, regexp_extract(filename, '^(.+)\\.[^.]*$', 1) as stem, coalesce(dataset, '') as dataset from {sql_first('pg_audio_docs', 'filename')} a left join m on m.stem = regexp_extract(filename, '^(.+)\\.[^.]*$', 1) where filename is not null and filename like '%.%'""")
def manifest_join(spark, sf_dir):
    rows = records(spark, sf_dir, "pg_audio_docs", "filename").where("filename is not null and filename like '%.%'").select("id", F.regexp_extract("filename", r"^(.+)\.[^.]*$", 1).alias("stem"))
    manifest = table(spark, sf_dir, "audio_manifest").where("song_id is not null").groupBy(F.lower("song_id").alias("stem")).agg(F.min("dataset").alias("dataset"))
    return rows.join(manifest, "stem", "left").select("id", "stem", F.coalesce("dataset", F.lit("")).alias("dataset"))


_ORDER = ("track_name", "track_artist", "lyrics", "playlist_genre", "playlist_subgenre", "lyrics_lang")
_SONGS = f"(select * from songs where track_id is not null qualify row_number() over (partition by track_id order by {', '.join(f'{c} nulls first' for c in (*_ORDER, *tabular.FEATURES))}) = 1)"


def _songs(spark, sf_dir):
    return tabular.first_rows(table(spark, sf_dir, "songs"), "track_id", [F.col(c).asc_nulls_first() for c in (*_ORDER, *tabular.FEATURES)])


@query(f"select track_id, track_name, lyrics_lang from {_SONGS}")
def dedup_first(spark, sf_dir):
    return _songs(spark, sf_dir).select("track_id", "track_name", "lyrics_lang")


@query(f"select track_id, length(lyrics)::int as num_chars, coalesce(track_name, '') as title, coalesce(track_artist, '') as artist from {_SONGS} where lyrics_lang = 'en' and lyrics is not null")
def songs_with_lyrics(spark, sf_dir):
    rows = _songs(spark, sf_dir).where("lyrics_lang = 'en' and lyrics is not null")
    return rows.select("track_id", F.length("lyrics").alias("num_chars"), F.coalesce("track_name", F.lit("")).alias("title"), F.coalesce("track_artist", F.lit("")).alias("artist"))


_LYRICS = f"(select track_id, lyrics as text, track_name, track_artist, playlist_genre from {_SONGS} where lyrics_lang = 'en' and lyrics is not null)"
_LYRIC_CHUNKS = SQL_CHUNKS.replace("doc_id", "track_id").replace("from documents", f"from {_LYRICS}").replace("track_id::varchar as track_id", "track_id")


def _english(spark, sf_dir):
    return _songs(spark, sf_dir).where("lyrics_lang = 'en' and lyrics is not null")


@query(f"""with {_LYRIC_CHUNKS} select track_id, chunk_index, chunk_id, content, coalesce(s.track_name, '') as title, coalesce(s.track_artist, '') as artist, coalesce(s.playlist_genre, '') as genre
from chunks left join {_LYRICS} s using (track_id)""")
def lyrics_chunks(spark, sf_dir):
    """Chunks of the English lyrics with their song."""
    songs = _english(spark, sf_dir)
    chunks = T.chunks(songs, "track_id", "lyrics").withColumnRenamed("doc_id", "track_id")
    return service.with_songs(chunks.select("track_id", "chunk_index", "chunk_id", "content"), service.song_details(songs))


@query(f"""with {SQL_BOOK.replace(SQL_CHUNKS, _LYRIC_CHUNKS)},
qtf as (select track_id as query_id, term, count(*) as count from (select track_id, unnest({sql_tokens('track_name')}) as term from {_LYRICS} where try_cast(substring(track_id, 4) as bigint) % 10 = 0) group by all),
qh as (select query_id, idx, (1 + ln(count)) * idf as wq from qtf join book using (term)),
ih as (select chunk_id, idx, (1 + ln(count)) * idf as wi from ctf join book using (term)),
qn as (select query_id, sqrt(sum(wq * wq)) as nq from qh group by all), cn as (select chunk_id, sqrt(sum(wi * wi)) as ni from ih group by all),
scored as (select query_id, chunk_id, round(sum(wq * wi / (nq * ni)), 8) as score from qh join ih using (idx) join qn using (query_id) join cn using (chunk_id) group by all),
hits as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from scored qualify r <= 30),
best as (select *, regexp_extract(chunk_id, '^(.*)_text_', 1) as track_id from hits qualify row_number() over (partition by query_id, track_id order by r) = 1)
select query_id, (row_number() over (partition by query_id order by score desc, chunk_id))::int as rank, track_id, chunk_id, round(score, 4) as score, coalesce(s.track_name, '') as title, coalesce(s.track_artist, '') as artist, coalesce(s.playlist_genre, '') as genre
from best left join {_LYRICS} s using (track_id) qualify rank <= 10""")
def lyrics_search(spark, sf_dir):
    """The best songs for every tenth song's name, by the best chunk of their lyrics."""
    songs = _english(spark, sf_dir)
    pipeline = service.LyricsPipeline(tfidf.Preprocess(custom=STOP))
    pipeline.index_songs(songs)
    asked = songs.where("try_cast(substring(track_id, 4) as bigint) % 10 = 0").select(F.col("track_id").alias("query_id"), "track_name")
    if not pipeline.ready:
        return spark.createDataFrame([], "query_id string, rank int, track_id string, chunk_id string, score double, title string, artist string, genre string")
    weights = cb.text_histogram(tfidf.term_frequency(asked, "query_id", "track_name", pipeline.how), pipeline.book, "query_id")
    hits = search.text_search(weights, pipeline.items, "query_id", "chunk_id", 30)
    first = search.first_per_document(hits, "query_id", "chunk_id", F.regexp_extract("chunk_id", "^(.*)_text_", 1), 10).withColumnRenamed("document", "track_id")
    return service.with_songs(first, pipeline.songs)


@query(f"select track_id, {', '.join(f'round({c}::decimal(18, 8), {tabular.DECIMALS.get(c, 3)})::double as {c}' for c in tabular.FEATURES)} from {_SONGS}")
def song_metadata(spark, sf_dir):
    """The songs' features rounded for display."""
    return tabular.metadata(_songs(spark, sf_dir), "track_id")


_OK = " and ".join(f"{c} is not null and not isnan({c}::double)" for c in tabular.FEATURES)
_SCALED = f"s as (select * from {_SONGS} where {_OK}), r as (select {', '.join(f'min({c})::double as lo_{c}, max({c})::double as hi_{c}' for c in tabular.FEATURES)} from s), f as (select track_id, [{', '.join(f'({c}::double - lo_{c}) / coalesce(nullif(hi_{c} - lo_{c}, 0), 1)' for c in tabular.FEATURES)}] as features from s, r)"


@query(f"with {_SCALED} select track_id, list_transform(features, lambda x: round(x, 8)) as features from f")
def minmax_scale(spark, sf_dir):
    return tabular.scaled(tabular.complete(_songs(spark, sf_dir)), "track_id").select("track_id", F.transform("features", lambda x: F.round(x, 8)).alias("features"))


@query(f"""with {_SCALED} select q.track_id as query_id, (row_number() over (partition by q.track_id order by round(list_distance(q.features, b.features), 8), b.track_id))::int as rank, b.track_id as id, round(round(list_distance(q.features, b.features), 8), 4) as distance
from (select * from f where try_cast(substring(track_id, 4) as bigint) % 100 = 0) q, f b qualify rank <= 10""")
def feature_knn(spark, sf_dir):
    df = tabular.scaled(tabular.complete(_songs(spark, sf_dir)), "track_id")
    asked = df.where(F.expr("try_cast(substring(track_id, 4) as bigint) % 100 = 0"))
    return search.vector_search(asked, df, "track_id", "features", 10).select("query_id", "rank", "id", F.round("score", 4).alias("distance"))


@query(f"""with w as (select track_id, unnest(string_split_regex(lower(lyrics), '[^\\p{{L}}]+')) as word from {_SONGS} where lyrics is not null)
select word, count(*) as occurrences, count(distinct w.track_id) as songs from w where length(word) > 1 group by all""")
def lyric_terms(spark, sf_dir):
    rows = _songs(spark, sf_dir).where("lyrics is not null").select("track_id", F.explode(F.split(F.lower("lyrics"), r"[^\p{L}]+")).alias("word")).where("length(word) > 1")
    per = rows.groupBy("word", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("songs"))


@query("select modality, len(histogram)::int as dim, count(*) as records, round(avg(list_sum(histogram)), 6) as mean_mass from histogram_records where histogram is not null and len(histogram) > 0 group by all")
def histogram_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "histogram_records").where("histogram is not null and size(histogram) > 0")
    mass = F.aggregate("histogram", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return rows.groupBy("modality", F.size("histogram").alias("dim")).agg(F.count(F.lit(1)).alias("records"), F.round(F.avg(mass), 6).alias("mean_mass"))
