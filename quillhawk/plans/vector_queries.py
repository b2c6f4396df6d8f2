"""Queries over vectors: arithmetic, search, codebooks, evaluation, audio and image features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillhawk.functions import media
from quillhawk.functions import vector as V
from quillhawk.operators import ann
from quillhawk.operators import codebook as cb
from quillhawk.operators import evaluate, extractors, search
from quillhawk.plans.common import records, registry, sql_first, table
from quillhawk.runtime import stage

REGISTERED, query = registry()
E = "embedding::double[]"


_SEEDED = "((vec_id % 2147483647) * 48355) % 2147483647"


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("embedding", V.as_double(F.col("embedding")))


def _asked(df, id_col="vec_id"):
    return df.where(F.col(id_col) % 100 == 0)


def _rounded(c):
    return F.transform(c, lambda x: F.round(x, 8))


_UNIT = "list_transform(v, lambda x: x / n)"


@query(f"select vec_id, list_transform(case when n = 0 then v else {_UNIT} end, lambda x: round(x, 8)) as v from (select vec_id, {E} as v, sqrt(list_dot_product({E}, {E})) as n from embeddings)")
def l2_normalize(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", _rounded(V.l2_normalize(F.col("embedding"))).alias("v"))


@query("select vec_id, list_transform(v, lambda x: round(sqrt(x / (s + 1e-7)), 8)) as v from (select *, list_sum(v) as s from (select vec_id, list_transform(embedding::double[], lambda x: abs(x)) as v from embeddings))")
def rootsift(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", _rounded(V.root_descriptor(F.transform("embedding", lambda x: F.abs(x)))).alias("v"))


@query(f"select vec_id, list_concat(list_transform(({E})[1:48], lambda x: round(x * 0.6::double, 8)), list_transform(({E})[49:64], lambda x: round(x * 0.4::double, 8))) as v from embeddings")
def weighted_concat(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", _rounded(V.weighted_concat(F.slice("embedding", 1, 48), F.slice("embedding", 49, 16))).alias("v"))


@query(f"select id, '[' || array_to_string(list_transform(embedding::double[], lambda x: printf('%.6f', x)), ',') || ']' as literal from {sql_first('pg_image_docs', 'embedding')} where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0")
def vector_literals(spark, sf_dir):
    rows = records(spark, sf_dir, "pg_image_docs", "embedding").where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return rows.select("id", V.vector_literal(V.as_double(F.col("embedding"))).alias("literal"))


def _knn_sql(score: str, order: str, where: str = "true") -> str:
    return f"""select q.vec_id as query_id, (row_number() over (partition by q.vec_id order by {score} {order}, b.vec_id))::int as rank, b.vec_id as id, {score} as score
from (select vec_id, {E} as q from embeddings where vec_id % 100 = 0) q, (select vec_id, {E} as v from embeddings) b where {where} qualify rank <= 10"""


_L2, _COS = "round(list_distance(q, v), 8)", "round(coalesce(list_cosine_similarity(q, v), 0), 8)"


@query(_knn_sql(_L2, "asc"))
def knn_l2(spark, sf_dir):
    df = _emb(spark, sf_dir)
    return search.vector_search(_asked(df), df, "vec_id", "embedding", 10)


@query(_knn_sql(_COS, "desc"))
def knn_cosine(spark, sf_dir):
    df = _emb(spark, sf_dir)
    return search.vector_search(_asked(df), df, "vec_id", "embedding", 10, "cosine")


@query(_knn_sql(_L2, "asc", "q.vec_id <> b.vec_id"))
def knn_exclude_self(spark, sf_dir):
    df = _emb(spark, sf_dir)
    return search.vector_search(_asked(df), df, "vec_id", "embedding", 10, exclude_self=True)


@query(f"select query_id, rank, id, round(greatest(0, 1 - score * score / 2), 4) as similarity from ({_knn_sql(_L2, 'asc')})")
def distance_to_similarity(spark, sf_dir):
    return knn_l2(spark, sf_dir).select("query_id", "rank", "id", V.similarity_from_distance(F.col("score")).alias("similarity"))


def _table_knn_sql(name: str, dim: int) -> str:
    v = sql_first(name, "embedding")
    ok = f"(select id, embedding::double[] as v from {v} where embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0)"
    return f"""select q.id as query_id, (row_number() over (partition by q.id order by round(list_distance(q.v, b.v), 8), b.id))::int as rank, b.id as id, round(list_distance(q.v, b.v), 8) as score
from (select * from {ok} where id % 100 = 0) q, {ok} b qualify rank <= 10"""


def _finite(df, dim):
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return df.where(F.coalesce(F.col("embedding").isNotNull() & ok, F.lit(False)))


@query(_table_knn_sql("pg_image_docs", 116))
def visual_search(spark, sf_dir):
    df = stage(_finite(records(spark, sf_dir, "pg_image_docs", "embedding"), 116), "vectors", "zstd")
    return search.vector_search(_asked(df, "id"), df, "id", "embedding", 10)


@query(_table_knn_sql("pg_audio_docs", 512))
def audio_search(spark, sf_dir):
    df = stage(_finite(records(spark, sf_dir, "pg_audio_docs", "embedding"), 512), "vectors", "zstd")
    return search.vector_search(_asked(df, "id"), df, "id", "embedding", 10)


_MEANS = f"means as (select label, list(m order by i) as c from (select label, i, avg(x) as m from (select label, generate_subscripts({E}, 1) as i, unnest({E}) as x from embeddings) group by all) group by all)"
_ASSIGN = f"{_MEANS}, assigned as (select vec_id, label as cluster, d as distance from (select e.vec_id, m.label, round(list_distance(e.embedding::double[], m.c), 8) as d from embeddings e, means m) qualify row_number() over (partition by vec_id order by d, label) = 1)"


@query(f"with {_ASSIGN} select * from assigned")
def codebook_assign(spark, sf_dir):
    df = _emb(spark, sf_dir)
    return cb.assign(df, "vec_id", F.col("embedding"), cb.mean_centroids(df, "label", "embedding"))


@query(f"with {_ASSIGN}, n as (select vec_id % 50 as item, cluster, count(*) as n from assigned group by all) select item, cluster, round(n / sqrt(sum(n * n) over (partition by item)), 8) as weight from n")
def bovw_histogram(spark, sf_dir):
    return cb.word_histogram(codebook_assign(spark, sf_dir), F.col("vec_id") % 50).withColumn("weight", F.round("weight", 8))


@query()
def codebook_kmeans(spark, sf_dir):
    df = _emb(spark, sf_dir)
    centroids = cb.centroid_table(cb.kmeans_codebook(df, "embedding", 10), spark)
    return cb.assign(df, "vec_id", F.col("embedding"), centroids).groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query(f"select vec_id % 50 as item, vec_id from embeddings where vec_id % 50 < 40 qualify row_number() over (partition by vec_id % 50 order by {_SEEDED}, vec_id) <= 10")
def descriptor_sample(spark, sf_dir):
    """At most ten descriptors of each of the first forty items, a seeded draw."""
    df = _emb(spark, sf_dir).withColumn("item", F.col("vec_id") % 50)
    return cb.descriptor_sample(df, "item", evaluate.seeded_order("vec_id"), "vec_id", 10, 40).select("item", "vec_id")


_HITS = _knn_sql(_L2, "asc", "q.vec_id <> b.vec_id")
_PR = f"""q as (select vec_id as query_id, label as ql, n from (select vec_id, label, count(*) over (partition by label) as n from embeddings) where vec_id % 100 = 0),
h as (select query_id, count(*) as hits, count(*) filter (where label = ql) as tp from ({_HITS}) join q using (query_id) join (select vec_id as id, label from embeddings) using (id) group by all),
per as (select query_id, coalesce(tp, 0)::bigint as tp, (coalesce(hits, 0) - coalesce(tp, 0))::bigint as fp, greatest(greatest(n - 1, 0) - coalesce(tp, 0), 0)::bigint as fn from q left join h using (query_id)),
pr as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall from per)"""


@query(f"with {_PR} select query_id, tp, fp, fn, round(precision, 8) as precision, round(recall, 8) as recall from pr")
def eval_per_query(spark, sf_dir):
    df = _emb(spark, sf_dir)
    hits = search.vector_search(_asked(df), df, "vec_id", "embedding", 10, exclude_self=True)
    per = evaluate.precision_recall(_asked(df), hits, df, "vec_id", "label")
    return per.withColumns({"precision": F.round("precision", 8), "recall": F.round("recall", 8)})


@query(f"with {_PR} select count(*) as queries, round(avg(precision), 4) as precision, round(avg(recall), 4) as recall, round(avg(tp), 2) as tp, round(avg(fp), 2) as fp, round(avg(fn), 2) as fn from pr")
def eval_precision_recall(spark, sf_dir):
    return evaluate.mean_effectiveness(eval_per_query(spark, sf_dir))


@query("select label, count(*) as items from embeddings group by all")
def eval_label_counts(spark, sf_dir):
    return evaluate.label_counts(table(spark, sf_dir, "embeddings"), "label")


@query("select vec_id, label from embeddings qualify count(*) over (partition by label) > 1")
def eval_eligible(spark, sf_dir):
    return evaluate.eligible(table(spark, sf_dir, "embeddings"), "label").select("vec_id", "label")


@query("select event_type, round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, round(1000 / round(avg(value), 6), 4) as qps from events group by all")
def eval_latency(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), "value", "event_type")


@query("""with l as (select label, row_number() over (order by label) as p, count(*) over () as k from (select distinct label from embeddings))
select vec_id, label from (select vec_id, label, row_number() over (partition by label order by (vec_id * 7919) % 10007, vec_id) as r from embeddings) join l using (label) where r <= 123 // k + case when p <= 123 % k then 1 else 0 end""")
def balanced_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", ((F.col("vec_id") * 7919) % 10007).alias("order"))
    return evaluate.balanced_sample(rows, "label", 123, "order", "vec_id").select("vec_id", "label")


@query(f"select vec_id, label from embeddings order by {_SEEDED}, vec_id limit 50")
def query_sample(spark, sf_dir):
    return evaluate.seeded_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 50)


@query(r"""with s as (select vec_id, embedding as x, unnest([0, 16, 32, 44]) as start_sample, generate_subscripts([0, 16, 32, 44], 1) - 1 as i from embeddings)
select vec_id::varchar as doc_id, i::int as chunk_index, vec_id || '_audio_' || i as chunk_id, start_sample::int as start_sample, (start_sample + 20)::int as end_sample, start_sample / 40.0::double as start_second, (start_sample + 20) / 40.0::double as end_second, false as padded,
 round(list_sum(x[start_sample + 1:start_sample + 20]::double[]), 6) as total from s""")
def audio_windows(spark, sf_dir):
    out = media.audio_windows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 40, 0.5, 0.4)
    return out.withColumn("total", F.round(F.aggregate(V.as_double(F.col("content")), F.lit(0.0), lambda s, x: s + x), 6)).drop("content")


@query(f"select vec_id, list_transform({E}, lambda x, i: round(x - 0.97::double * case when i = 1 then 0 else ({E})[i - 1] end, 8)) as y from embeddings")
def pre_emphasis(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", _rounded(media.pre_emphasis(F.col("embedding"))).alias("y"))


@query()
def mfcc_features(spark, sf_dir):
    """Cepstral means and deviations of one tone per song, pitched by its key."""
    songs = table(spark, sf_dir, "songs").where("track_id is not null and pitch_key is not null")
    signal = media.tone(F.lit(220.0) * F.pow(F.lit(2.0), F.col("pitch_key") / 12), 4096)
    frames = songs.select("track_id", "pitch_key", media.mfcc_frames(signal).alias("f"))
    return frames.select("track_id", "pitch_key", F.size("f").alias("frames"), F.transform(media.frame_statistics(F.col("f")), lambda x: F.round(x, 3)).alias("features"))


@query()
def hsv_histograms(spark, sf_dir):
    """Colour histograms of one 32 x 32 gradient per part, tinted by its size."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    hexes = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.lpad(F.hex((i % 256 * 65536 + (F.col("p_size") * 5) % 256 * 256 + F.floor(i / 4)).cast("bigint")), 6, "0"))
    data = F.unhex(F.array_join(hexes, ""))
    out = parts.select("p_partkey", media.color_histograms(F.lit(32), F.lit(32), data).alias("histogram"))
    return out.select("p_partkey", F.transform("histogram", lambda x: F.round(x.cast("double"), 5)).alias("histogram"))


@query("""with g as (select p_partkey, 224 + p_size * 16 as w, 200 + p_size * 9 as h from part),
ys as (select *, unnest(case when h <= 224 then [0] else list_sort(list_distinct(list_append(range(0, h - 224 + 1, 112), h - 224))) end) as y from g),
xs as (select *, unnest(case when w <= 224 then [0] else list_sort(list_distinct(list_append(range(0, w - 224 + 1, 112), w - 224))) end) as x from ys)
select p_partkey, (row_number() over (partition by p_partkey order by y, x) - 1)::int as patch_index, x::int as x, y::int as y, (w < 224 or h < 224) as padded from xs""")
def patch_grid(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (224 + F.col("p_size") * 16).alias("w"), (200 + F.col("p_size") * 9).alias("h"))
    return media.patch_grid(parts, "p_partkey", "w", "h")


@query("""with g as (select p_partkey, 224 + p_size * 16 - 320 as w, 200 + p_size * 9 as h from part), ok as (select * from g where w >= 224 and h >= 224),
ys as (select *, unnest(list_sort(list_distinct(list_append(range(0, h - 224 + 1, 112), h - 224)))) as y from ok),
xs as (select *, unnest(list_sort(list_distinct(list_append(range(0, w - 224 + 1, 112), w - 224)))) as x from ys)
select p_partkey, (row_number() over (partition by p_partkey order by y, x) - 1)::int as patch_index, x::int as x, y::int as y from xs""")
def patch_grid_whole(spark, sf_dir):
    """Patches without those of images smaller than one."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (224 + F.col("p_size") * 16 - 320).alias("w"), (200 + F.col("p_size") * 9).alias("h"))
    return media.patch_grid(parts, "p_partkey", "w", "h", keep_borders=False).drop("padded")


@query(f"select vec_id, list_transform(range(1, 33), lambda i: (({E})[i] / 2 + ({E})[i + 32] / 2)::float::double) as mono from embeddings")
def mixed_channels(spark, sf_dir):
    """Both halves of a vector as channels, mixed to one."""
    df = _emb(spark, sf_dir)
    return df.select("vec_id", V.as_double(media.mixed_channels(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))).alias("mono"))


@query(f"select vec_id, (i // 16)::int as position, round(list_sum(({E})[i + 1:i + 16]), 6) as total from (select *, unnest([0, 16, 32, 48]) as i from embeddings)")
def stacked_parts(spark, sf_dir):
    """Quarters of vectors as stacked descriptors."""
    parts = _emb(spark, sf_dir).select("vec_id", F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)]).alias("parts"))
    rows = extractors.stacked(parts, ["vec_id"], "parts", "x")
    return rows.select("vec_id", "position", F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""with s as (select distinct pitch_key from songs where pitch_key is not null)
select pitch_key, list_transform(range(0, 64), lambda i: round(0.5::double * sin(2 * pi() * (220.0::double * pow(2.0::double, pitch_key / 12.0::double)) * (i / 22050.0::double)), 6)) as samples from s""")
def tones(spark, sf_dir):
    """The first samples of the tone of every key."""
    keys = table(spark, sf_dir, "songs").where("pitch_key is not null").select("pitch_key").distinct()
    return keys.select("pitch_key", F.transform(media.tone(F.lit(220.0) * F.pow(F.lit(2.0), F.col("pitch_key") / 12), 64), lambda x: F.round(x, 6)).alias("samples"))


@query()
def ann_cells(spark, sf_dir):
    """Recall of three of the nearest cells for the images whose id is divisible by 100."""
    df = _finite(records(spark, sf_dir, "pg_image_docs", "embedding"), 116)
    df = stage(df.select("id", V.as_double(F.col("embedding")).alias("embedding")), "vectors", "zstd")  # read several times, cast once
    asked = stage(_asked(df, "id"), "asked")
    found = ann.CellIndex(df, "id", "embedding", 16).search(asked, "id", "embedding", 10, 6)
    return ann.recall(found, search.vector_search(asked, df, "id", "embedding", 10))


@query()
def ann_projections(spark, sf_dir):
    """Recall of the library's bucketed projections for the vectors whose id is divisible by 100."""
    df = _emb(spark, sf_dir)
    found = ann.projection_search(_asked(df), df, "vec_id", "embedding", 10, 2.0)
    return ann.recall(found, search.vector_search(_asked(df), df, "vec_id", "embedding", 10))
