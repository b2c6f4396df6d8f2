"""The pN_ queries in SQL, where SQL can express them on whole tables."""

from __future__ import annotations

WS = r"[\s\x0B\x{85}\p{Z}]"


def _records(name: str, columns: str) -> str:
    return f"(select id, {columns} from {name} where chunk_id is not null qualify row_number() over (partition by chunk_id order by id) = 1)"


_TEXTS = _records("pg_text_docs", "content")
_TERMS = rf"terms as (select id, regexp_extract_all(lower(coalesce(content, '')), '\p{{L}}+') as ts from {_TEXTS})"
_COUNTS = f"{_TERMS}, tf as (select id, term, count(*) as n from (select id, unnest(ts) as term from terms) group by all), df as (select term, count(*) as records, sum(n)::bigint as occurrences from tf group by all)"


def _unit(name: str, dim: int) -> str:
    ok = f"embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"(select id, list_transform(v, lambda x: x / n) as v from (select id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from {_records(name, 'embedding')} where {ok}))"


_BOTH = f"vs as (select 'image' as modality, * from {_unit('pg_image_docs', 116)} union all select 'audio', * from {_unit('pg_audio_docs', 512)})"
_NEAR = f"{_BOTH}, near as materialized (select a.modality, a.id as a, b.id as b, list_distance(a.v, b.v) as d from vs a join vs b on a.modality = b.modality and a.id <> b.id where list_distance(a.v, b.v) <= 0.40)"
_BARE = r"regexp_extract_all(lower(regexp_replace(coalesce({0}, ''), '[\x{{00AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')), '[\p{{L}}\p{{N}}]+')"
_FORM = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _break(x: str) -> str:
    x = rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
    x = rf"regexp_replace({x}, '{WS}*\n{WS}*\n{WS}*', chr(1), 'g')"
    return rf"""regexp_replace({x}, '([.!?]["''\)\]»”]?){WS}+', '\1' || chr(1), 'g')"""


def oracle_sql() -> dict[str, str]:
    genre = f"""with a as (select {_FORM.format('raw_label')} as form, min(genre) as genre from genre_aliases where {_FORM.format('raw_label')} <> '' group by all),
r as (select id, a.genre from {_records('pg_audio_docs', 'genre as label')} left join a on a.form = {_FORM.format('label')}),
c as (select genre, count(*) as n from r group by all)
select t.genre from genre_targets t left join c using (genre) where coalesce(c.n, 0) < greatest(t.target_share * (0.2 * (select count(*) from r)), t.min_rows)"""
    report = f"""with a as (select {_FORM.format('raw_label')} as form, min(genre) as genre from genre_aliases where {_FORM.format('raw_label')} <> '' group by all),
r as (select id, a.genre from {_records('pg_audio_docs', 'genre as label')} left join a on a.form = {_FORM.format('label')}),
c as (select t.genre, target_share, min_rows, coalesce(n, 0) as have from genre_targets t left join (select genre, count(*) as n from r group by all) using (genre)),
d as (select least(greatest(round(0.2::double * (select count(*) from r)), sum(least(min_rows, have))), sum(have))::bigint as drawn, 0.2::double * (select count(*) from r) as size from c),
slots as (select genre from (select genre, x, x - target_share * drawn as late from (select *, unnest(range(least(min_rows, have), have)) as x from c), d)
 qualify row_number() over (order by late, genre) <= (select drawn from d) - (select sum(least(min_rows, have)) from c)),
got as (select c.*, least(min_rows, have) + coalesce(n, 0) as sampled from c left join (select genre, count(*) as n from slots group by all) using (genre))
select 'genre' as attribute, genre as category, target_share, min_rows, have as available, round(greatest(target_share * size, min_rows), 6) as needed, sampled::bigint as sampled,
 round(sampled / greatest(sum(sampled) over (), 1), 6) as share, have < greatest(target_share * size, min_rows) as short from got, d"""
    scores = f"""with {_COUNTS}, m as (select id, term, n, records, occurrences, (sum(n) over (partition by id))::bigint as length, (sum(n) over ())::bigint as total from tf join df using (term)),
j as (select *, unnest(range(n, least(occurrences, length) + 1)) as x from (select distinct n, occurrences, length, total from m)),
l as (select n, occurrences, length, lgamma(occurrences + 1) - lgamma(x + 1) - lgamma(occurrences - x + 1) + lgamma(total - occurrences + 1) - lgamma(length - x + 1) - lgamma(total - occurrences - length + x + 1)
 - lgamma(total + 1) + lgamma(length + 1) + lgamma(total - length + 1) as v from j where length - x <= total - occurrences),
top as (select n, occurrences, length, max(v) as v from l group by all),
tails as (select n, occurrences, length, least(any_value(top.v) + ln(sum(exp(l.v - top.v))), 0) as p from l join top using (n, occurrences, length) group by all),
v as (select id, term, n, length, occurrences, records, p, p + ln(count(*) over (partition by id)) - ln(row_number() over (partition by id order by p, term)) as q from m join tails using (n, occurrences, length))
select id, term, n as count, length::bigint as length, occurrences, records, round(-least(min(q) over (partition by id order by p, term rows between current row and unbounded following), 0) / ln(10), 2) as score from v"""
    shingles = f"""with {_TERMS}, s as (select distinct id, ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2] as g from (select id, ts, unnest(range(1, len(ts) - 1)) as i from terms where len(ts) >= 30)),
z as (select id, count(*) as z from s group by all),
p as (select a.id as id_a, b.id as id_b, count(*) as c from s a join s b on a.g = b.g and a.id < b.id group by all)
select id_a, id_b from p join z x on x.id = id_a join z y on y.id = id_b where c >= 0.5 * (x.z + y.z - c)"""
    groups = shingles.replace("with ", "with recursive ", 1).split("select id_a, id_b from p join")[0] + """, near as (select id_a, id_b, c = x.z and c = y.z as same from p join z x on x.id = id_a join z y on y.id = id_b where c >= 0.5 * (x.z + y.z - c)),
both_ as (select id_a as a, id_b as b, same from near union all select id_b, id_a, same from near),
class as (select id, least(id, coalesce(min(b), id)) as class_id from z left join (select * from both_ where same) on a = id group by id),
reach(a, b) as (select a, b from both_ union select r.a, n.b from reach r join both_ n on n.a = r.b),
grp as (select a as id, least(a, min(b)) as group_id from reach group by a),
links as (select ca.class_id, count(distinct cb.class_id) as links from both_ join class ca on ca.id = a join class cb on cb.id = b where ca.class_id <> cb.class_id group by all)
select id, class_id, count(*) over (partition by class_id) as copies, coalesce(links, 0) as links, coalesce(group_id, id) as group_id from class left join links using (class_id) left join grp using (id)"""
    leaks = f"""with i as (select item_id, least(12, len(w)) as k, w from (select item_id, {_BARE.format('text')} as w from eval_items) where len(w) > 0),
ig as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as p from i)),
d as (select doc_id, {_BARE.format('text')} as w from documents),
dg as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') as g from (select d.*, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from i)))"""
    spans = f"""{leaks}, hit as (select doc_id, item_id, k, p, case when p - lag(p) over (partition by doc_id, item_id order by p) <= k then 0 else 1 end as first from dg join ig using (k, g)),
isle as (select doc_id, item_id, max(p) - min(p) + any_value(k) as n from (select *, sum(first) over (partition by doc_id, item_id order by p) as isl from hit) group by doc_id, item_id, isl)
select doc_id, item_id, max(n)::int as longest, sum(n)::bigint as covered from isle group by all"""
    mix = f"""with s as (select lower(regexp_replace(source, '^{WS}+|{WS}+$', '', 'g')) as source, sum(len({_BARE.format('text')})) as z from documents where source is not null group by 1),
t as (select lower(trim(m.source)) as source, weight, max_repeats, coalesce(z, 0) as z from mix_targets m left join s on s.source = lower(trim(m.source)))
select source from t where max_repeats * z < weight * (select sum(z) from t)"""
    chains = f"""with recursive {_NEAR}, reach(modality, a, b) as (select modality, a, b from near union select r.modality, r.a, n.b from reach r join near n on n.modality = r.modality and n.a = r.b)
select modality, min(b) as cluster_id, a as id from (select modality, a, b from reach union select modality, a, a from near) group by modality, a"""
    return {
        "p1_found": genre,
        "p1_report": report,
        "p2_scores": scores,
        "p3_groups": groups,
        "p2_found": f"with {_COUNTS} select id, term from tf join df using (term) where length(term) >= 4 and n >= 3 and records between 2 and 6",
        "p3_found": shingles,
        "p4_terms": f"with {_COUNTS} select term, occurrences, records, case when records <= 2 and records > 0.35 * (select count(*) from terms) then 'rare,common' when records <= 2 then 'rare' when records > 0.35 * (select count(*) from terms) then 'common' else '' end as mark from df",
        "p4_found": f"with {_COUNTS} select term, 'rare' as mark from df where records <= 2 union all select term, 'common' from df where records > 0.35 * (select count(*) from terms)",
        "p4_ngrams": f"""with {_TERMS}, g as (select n, id, array_to_string(ts[p:p + n - 1], ' ') as term from (select id, ts, n, unnest(range(1, len(ts) - n + 2)) as p from terms, (select unnest([1, 2, 3])::int as n)))
select n, term, count(*) as occurrences, count(distinct id) as records from g group by all""",
        "p5_found": chains,
        "p6_found": rf"select id, case when len(list_filter(string_split({_break('content')}, chr(1)), lambda x: length(x) > 800)) > 0 then 'hard' else 'soft' end as kind from {_TEXTS} where length(regexp_replace(content, '^{WS}+|{WS}+$', '', 'g')) > 800",
        "p7_found": f"with {_NEAR}, five as (select * from near qualify count(*) over (partition by modality, a) >= 5 and row_number() over (partition by modality, a order by d, b) <= 5) select distinct modality, least(a, b) as id_a, greatest(a, b) as id_b from five",
        "p7_neighbours": f"with {_BOTH} select a.modality, a.id, b.id as neighbour, round(list_distance(a.v, b.v), 8) as distance, (row_number() over (partition by a.modality, a.id order by round(list_distance(a.v, b.v), 8), b.id))::int as rank from vs a join vs b on a.modality = b.modality and a.id <> b.id where a.id % 100 = 0 qualify rank <= 5",
        "p6_audit": rf"select id, length({_strip('content')})::int as chars, case when len(list_filter(string_split({_break('content')}, chr(1)), lambda x: length(x) > 800)) > 0 then 'hard' else 'soft' end as kind, true as within_limit, true as within_overlap, md5(regexp_replace(content, '[^\p{{L}}\p{{N}}]', '', 'g')) as kept from {_TEXTS} where length({_strip('content')}) > 800",
        "p8_found": f"{leaks} select distinct doc_id, item_id from dg join ig using (k, g)",
        "p8_leaks": spans,
        "p8_report": f"with leaks as ({spans}) select task, count(*) as items, count(hit) as leaked, round(count(hit) / count(*), 6) as share from eval_items left join (select distinct item_id, 1 as hit from leaks) using (item_id) group by all",
        "p9_found": mix,
    }
