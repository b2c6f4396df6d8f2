import math
import random
import re
from collections import Counter
from functools import partial
from itertools import combinations, groupby, product
from pathlib import Path
from unicodedata import category

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillhawk.llm import nearduplicates, spam
from quillhawk.llm.components import components
from quillhawk.llm.distinctive import adjust, ln_upper_tail, term_scores
from quillhawk.llm.frequencies import mark_frequencies, ngram_frequencies
from quillhawk.llm.leakage import Automaton, clean_documents, leaked_items, leaked_spans
from quillhawk.llm.nearduplicates import _frequent, least_agreeing, masks, near_duplicates, radius
from quillhawk.llm.spam import LABELS, LEVELS, STATES, first_model, fit, fit_pages, label, label_alone, spam_pages, units
from quillhawk.llm.splitting import cut, split_oversized
from quillhawk.llm.textarrays import tokens

TEXT = st.text(st.characters(codec="utf-8"), max_size=60)


@given(st.lists(TEXT, max_size=5))
@settings(max_examples=60, deadline=None)
def test_tokens_are_runs_of_letters(texts):
    tok = tokens(texts)
    want = [(d, "".join(run)) for d, t in enumerate(texts) for letter, run in groupby(t.lower(), lambda c: category(c)[0] == "L") if letter]
    assert [(int(tok.doc[i]), tok.word(i)) for i in range(len(tok.hash))] == want
    assert len(set(tok.hash.tolist())) == len({w for _, w in want})


WORDS = ["ab", "ba", "c", "dd", "e"]


def corpus(n, seed, extra=()):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 12)))) for i in range(n)] + list(extra)


def test_ngrams_equal_counting(spark):
    rows = corpus(60, 1, [(100, None), (101, ""), (102, "1 2 3"), (103, "ab " * 500)])
    df = spark.createDataFrame(rows, "id int, content string").withColumns({"n": F.lit(1), "term": F.lit("x"), "records": F.lit(0)})
    table, records, total = ngram_frequencies(df, "id", "content", 4)
    want, held = Counter(), Counter()
    for _, t in rows:
        w = re.findall("[a-z]+", t or "")
        grams = [(n, " ".join(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1)]
        want.update(grams)
        held.update(set(grams))
    assert {(r.n, r.term): (r.occurrences, r.records) for r in table.collect()} == {g: (c, held[g]) for g, c in want.items()}
    assert records == len(rows)
    assert total == sum(c for (n, _), c in want.items() if n == 1)
    empty, records, total = ngram_frequencies(df.limit(0), "id", "content", 2)
    assert (empty.count(), records, total) == (0, 0, 0)


def test_marks(spark):
    table = spark.createDataFrame([("a", 1), ("b", 40), ("c", 10)], "term string, records bigint")
    assert {r.term: r.marks for r in mark_frequencies(table, 100).collect()} == {"a": ["rare"], "b": ["common"], "c": []}


def exact_tail(N, K, n, k):
    return sum(math.comb(K, j) * math.comb(N - K, n - j) for j in range(k, min(K, n) + 1) if n - j <= N - K) / math.comb(N, n)


def test_upper_tail_is_exact():
    rng = random.Random(4)
    assert math.exp(ln_upper_tail(9000, np.array([40]), np.array([300]), np.array([6]))[0]) == pytest.approx(exact_tail(9000, 40, 300, 6), rel=1e-9)
    for _ in range(150):
        N = rng.choice([20, 150, 300])
        K, n = rng.randrange(1, N), rng.randrange(1, N)
        k = rng.randrange(1, min(K, n) + 1)
        want = exact_tail(N, K, n, k)
        got = math.exp(ln_upper_tail(N, np.array([K]), np.array([n]), np.array([k]))[0])
        assert got == pytest.approx(want, rel=1e-8, abs=1e-280)


def test_adjustment_is_benjamini_hochberg():
    p, rec = np.array([0.01, 0.04, 0.03, 0.2, 0.5]), np.array([0, 0, 0, 1, 1])
    assert np.exp(adjust(np.log(p), rec)) == pytest.approx([0.03, 0.04, 0.04, 0.4, 0.5])


def test_scores_do_not_depend_on_the_join(spark):
    rows = corpus(40, 2, [(50, None), (None, "ab ab"), (51, "rare rare rare ab"), (7, "ab c c c"), (8, "dd e"), (8, "dd e")])
    df = spark.createDataFrame(rows, "score int, term string").withColumn("id", F.lit("clash"))
    a = {(r.id, r.term, r.length): (r["count"], r.length, r.occurrences, r.records, round(r.p_value, 10), round(r.score, 8)) for r in term_scores(df, "score", "term").collect()}
    b = {(r.id, r.term, r.length): (r["count"], r.length, r.occurrences, r.records, round(r.p_value, 10), round(r.score, 8)) for r in term_scores(df, "score", "term", broadcast_terms=0, spread_records=5).collect()}
    assert a == b
    assert max(a, key=lambda k: a[k][-1])[:2] == (51, "rare")
    assert term_scores(df.limit(0), "score", "term").count() == 0


PIECE = st.lists(st.sampled_from(["word", "a", "longerword", ". ", "! ", "\n\n", " ", "\n", '." ', "x" * 45]), min_size=1, max_size=60).map("".join)


@given(PIECE, st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_pieces(text, overlap):
    text, limit = text.strip(), 40
    parts, hard = cut(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    end = 0
    for i, (a, b, s) in enumerate(parts):
        assert b - a <= limit
        assert i == 0 or (end - a <= overlap and (a <= end or text[end:a].isspace()))
        if not hard and s >= 0:
            assert s >= 2
        end = b
    at, over = 0, False
    for m in re.finditer(r"\s+", text):
        before = text[: m.start()]
        if m.group().count("\n") >= 2 or re.search(r"[.!?][\"')\]»”]?$", before):
            over, at = over or m.start() - at > limit, m.end()
    assert hard == (len(text) > limit and (over or len(text) - at > limit))
    assert hard == any(s in (0, 1) for _, _, s in parts)


def test_pieces_are_few_balanced_and_overlap():
    rng = random.Random(8)
    few = overlapping = later = 0
    for _ in range(200):
        words = [rng.choice(["word", "longer", "a", "sentences"]) + rng.choice(["", "", "", "."]) for _ in range(rng.randrange(150, 900))]
        text = " ".join(words)
        parts, _ = cut(text, 800, 80)
        if len(text) > 800:
            few += len(parts) == 1 + -(-(len(text) - 800) // 720)
            ends = [b for _, b, _ in parts]
            overlapping += sum(b > a for b, (a, _, _) in zip(ends, parts[1:]))
            later += len(parts) - 1
    assert few > 100 and overlapping > 0.95 * later


def test_split_table(spark):
    rows = [(1, None), (2, ""), (3, "short. "), (4, "A sentence here. " * 100), (5, "x" * 2000), (6, "  " + "y" * 800 + " \n")]
    df = spark.createDataFrame(rows, "id int, content string").withColumns({"text": F.lit(1), "piece": F.lit(2)})
    out = split_oversized(df, "id", "content").collect()
    assert {(r.id, r.kind) for r in out} == {(4, "soft"), (5, "hard")}
    assert "".join(r.text for r in sorted((r for r in out if r.id == 5), key=lambda r: r.piece) if not r.overlap) != ""
    assert max(len(r.text) for r in out) <= 800
    assert split_oversized(df.limit(0), "id", "content").count() == 0


def test_masks_cover_the_radius():
    small = [set(m) for m in masks(12, 4, 3)]
    agree = 12 - radius(12, 4, 3)
    assert all(any(m <= set(c) for m in small) for c in combinations(range(12), agree))
    assert len(masks()) == 48 and radius() == 23


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=60)
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(500, None), (501, ""), (502, "too short"), (503, rows[0][1].upper()), (504, " ".join(rng.choices(vocabulary, k=30_000)))]
    df = spark.createDataFrame(rows, "a int, b string").withColumns({"id": F.lit("x"), "key": F.lit(1), "size": F.lit(2)})
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in rows if (w := (t or "").lower().split()) and len(w) >= 30}
    want = {(x, y) for x, y in combinations(sorted(sets), 2) if len(sets[x] & sets[y]) >= 0.5 * len(sets[x] | sets[y])}
    found = near_duplicates(df, "a", "b", 0.5, 3, 30)
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == want
    split = near_duplicates(df, "a", "b", 0.5, 3, 30, key_rows=2)  # every shared mask value is a hot one
    assert {(r.id_a, r.id_b) for r in split.pairs().collect()} == want
    groups = {r.id: r for r in found.groups().collect()}
    assert set(groups) == set(sets)
    assert groups[503].class_id == 0 and groups[503].copies >= 2
    for x, y in want:
        assert groups[x].group_id == groups[y].group_id
    empty = near_duplicates(df.limit(0), "a", "b")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_unlike_texts_with_common_phrases_are_no_candidates(spark, monkeypatch):
    """Texts that share an eighth of their runs collide in some table in their thousands; the pairs whose sets are compared stay few, in any number of passes."""
    rng = random.Random(8)
    notice = [f"notice{''.join(rng.choices('abcdefgh', k=3))}" for _ in range(14)]
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = [(i, " ".join(notice + [word() for _ in range(40)])) for i in range(300)]
    rows += [(1000 + i, f"{t} {word()}") for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "id int, text string")
    staged = []

    def counted(df, name, *args, **more):
        out = stage(df, name, *args, **more)
        staged.append((name, out.count()))
        return out

    stage = nearduplicates.stage
    monkeypatch.setattr(nearduplicates, "stage", counted)
    found = near_duplicates(df, "id", "text", 0.5, 3, 30)
    compared = sum(n for name, n in staged if name == "candidates")
    want = {(i, 1000 + i) for i in range(20)}
    assert {(r.a, r.b) for r in found.links.collect()} == want
    assert compared < 400
    staged.clear()
    many = near_duplicates(df, "id", "text", 0.5, 3, 30, masks_pass=5, share_pass=0.01)
    assert {(r.a, r.b) for r in many.links.collect()} == want
    assert sum(name == "sets" for name, _ in staged) > 4 and sum(name == "met" for name, _ in staged) == 10


def test_positions_asked_to_agree():
    for similarity in (0.4, 0.5, 0.8):
        p, k = similarity + (1 - similarity) / 256, least_agreeing(similarity) - 3
        lost = [sum(math.comb(45, j) * p**j * (1 - p) ** (45 - j) for j in range(n)) for n in (k, k + 1)]
        assert lost[0] <= 5e-6 < lost[1]


def test_staged_shuffles_are_deleted(spark):
    from quillhawk.runtime import stage, unstage

    def files():
        return sum(len(list(Path(d).rglob("shuffle_*.data"))) for d in dirs)

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    dirs = list(manager.localDirsString())
    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    tidy = stage(df, "tidy", tidy=True)
    assert files() <= before and tidy.count() == 7
    unstage(tidy)
    assert not Path(tidy.staged_at.removeprefix("file://")).exists()


def test_frequent_values_are_not_missed():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    keys = np.concatenate([np.repeat([7, 8], [4000, 900]), rng.integers(100, 2**60, 60_000)])
    rng.shuffle(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 1000])], names=["key"]) for a in range(0, len(keys), 1000)]
    for kept in (500, 100_000):
        found = pa.Table.from_batches(_frequent(batches, 500, kept)).to_pydict()
        got = dict(zip(found["key"], found["n"]))
        assert got[7] >= 4000 and got[8] >= 900 and got[7] <= 4000 + len(keys) / kept
    assert set(got) == {7, 8} and got[7] == 4000


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for _ in range(80):
        items = [(i, [rng.randrange(3) for _ in range(rng.randrange(1, 9))]) for i in range(4)]
        doc, run = [rng.randrange(3) for _ in range(25)], 4
        want = set()
        for i, w in items:
            k = min(run, len(w))
            grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            want |= {(i, at, at + k) for at in range(len(doc) - k + 1) if tuple(doc[at : at + k]) in grams}
        assert set(Automaton(items, run).matches(doc)) == want


def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = [(1, f"Start here {passage.upper()} and the end."), (2, "nothing"), (3, None), (4, "so­me sh​ort item is here"), (5, passage), (6, "")]
    items = [(1, passage), (2, "some short item"), (3, ""), (4, None), (5, "x " + passage[:60])]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumns({"words": F.lit(1), "item_id": F.lit(2)})
    i = spark.createDataFrame(items, "item_id int, text string")
    spans = leaked_spans(d, "doc_id", "text", i, "item_id", "text")
    found = {(r.doc_id, r.item_id): (r.longest, r.covered) for r in leaked_items(spans).collect()}
    assert found == {(1, 1): (20, 20), (4, 2): (3, 3), (5, 1): (20, 20)}
    sharded = leaked_spans(d, "doc_id", "text", i, "item_id", "text", most_words=10)
    assert {(r.doc_id, r.item_id) for r in sharded.collect()} == set(found)
    clean = {r.doc_id: r for r in clean_documents(d, "doc_id", "text", spans, 0.9).collect()}
    assert clean[1].text == "Start here  and the end." and clean[5].dropped and clean[5].text is None
    assert leaked_spans(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert leaked_spans(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def common_words():
    return np.unique(tokens(["the a an of in and to was it is with for on under"]).hash)


def named(states):
    return [LABELS.index(STATES[x]) for x in states]


def spam_corpus(rng):
    noun = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("bel", "dan", "fir", "gos", "lum", "nar", "pex")]
    sentence = lambda: "The %s of the %s was in a %s." % tuple(rng.sample(noun, 3))
    link = lambda: f"* [{rng.choice(noun)} {rng.choice(noun)}](https://{rng.choice(noun)}.test/{rng.choice(noun)})"
    title = lambda: f"{rng.choice(noun).title()} {rng.choice(noun).title()}"
    pages = [" ".join(sentence() for _ in range(12)) for _ in range(60)]
    pages += ["\n".join(link() if rng.random() < 0.7 else title() for _ in range(20)) for _ in range(15)]
    pages += [", ".join(rng.choice(noun[:3]) + " " + rng.choice(noun[:3]) for _ in range(80)) for _ in range(15)]
    pages += [" | ".join(title() for _ in range(30)) for _ in range(15)]
    pages += ["\n".join(sentence() if rng.random() < 0.9 else title() for _ in range(12)) for _ in range(20)]
    return pages


def test_context_decides_what_a_line_is():
    """The same bare title is prose between sentences and part of a list between links; without the chain it is one thing."""
    u = units(spam_corpus(random.Random(4)), common_words())
    model = fit(first_model(), u.signs, u.length)
    said, link, bare = "The kabel of the lodan was in a mifir.", "* [rugos tedan](https://vonar.test/kapex)", "Milum Ruvos"
    pages = [[said] * 4 + [bare] + [said] * 4, [link] * 4 + [bare] + [link] * 4]
    found = [units(["\n".join(p)], common_words()) for p in pages]
    chained = [named(label(model, x.signs, x.length)) for x in found]
    alone = [named(label_alone(model, x.signs)) for x in found]
    assert chained == [[0] * 9, [1] * 9]
    assert alone[0][4] == alone[1][4]
    assert any(c != a for c, a in zip(chained, alone))
    # order matters: the same lines, dealt in turn, leave the bare lines without a context of their own kind
    mixed = units(["\n".join([said, bare, link, bare, said, bare, link])], common_words())
    sorted_ = units(["\n".join([said, said, link, link, bare, bare, bare])], common_words())
    assert sorted(named(label(model, mixed.signs, mixed.length))) != sorted(named(label(model, sorted_.signs, sorted_.length)))


def test_estimation_changes_labels():
    u = units(spam_corpus(random.Random(5)), common_words())
    first = first_model()
    model = fit(first, u.signs, u.length)
    assert named(label(first, u.signs, u.length)) != named(label(model, u.signs, u.length))
    page = np.repeat(np.arange(len(u.length)), u.length)
    share = np.array([np.mean(np.array(named(label(model, u.signs, u.length)))[page == i] == 0) for i in range(len(u.length))])
    assert (share[:60] > 0.9).all() and (share[60:105] < 0.5).all() and (share[105:] > 0.9).all()


def test_all_pages_make_the_model(spark, monkeypatch):
    """500 pages of links and titles that come last by hashed id, behind 2,000 of prose, shape the model; blocks and tasks do not."""
    corpora = [spam_corpus(random.Random(seed)) for seed in range(40)]
    prose, other = [p for c in corpora for p in c[:60]][:2000], [p for c in corpora for p in c[60:105]][:500]
    ids = [r.id for r in spark.range(2500).orderBy(F.xxhash64("id")).collect()]
    rows = [*zip(ids, prose + other), (9000, None), (9001, ""), (None, "x" * 99)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(7)
    common = spam.function_words(spark)
    all_units, some_units = units(prose + other, common), units(prose, common)
    whole, part = fit(first_model(), all_units.signs, all_units.length), fit(first_model(), some_units.signs, some_units.length)
    found = fit_pages(df.where("id is not null"), "text", common, first_model())
    for a, b in zip((found.start, found.step, *found.signs), (whole.start, whole.step, *whole.signs)):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-12)
    assert not np.allclose(whole.step, part.step, rtol=0.01)
    used = []
    monkeypatch.setattr(spam, "partial", lambda f, **more: used.append(more) or partial(f, **more))
    assert spam_pages(df, "id", "text").where("spam").count() == 500
    model = next(x["shared"].value[1] for x in used if "most" in x)
    assert np.allclose(model.step, whole.step, rtol=1e-6) and not np.allclose(model.step, part.step, rtol=0.01)
    assert all(np.array_equal(a, b) for a, b in zip(fit_pages(df.limit(0), "text", common, first_model()).signs, first_model().signs))


def test_expected_counts_add_up():
    rng = np.random.default_rng(3)
    signs, length = np.stack([rng.integers(0, n, 60) for n in LEVELS], axis=1), np.array([10, 0, 20, 30])
    code = spam.sign_codes(signs)
    assert (spam._all_signs()[code] == signs).all()
    once, twice, apart = (spam.Expectation(first_model()) for _ in range(3))
    once.add(code, length, np.array([2, 5, 1, 3]))
    for a, n, times in ((0, 10, 2), (10, 20, 1), (30, 30, 3)):
        apart.add(code[a : a + n], np.array([n]), np.array([times]))
        for _ in range(times):
            twice.add(code[a : a + n], np.array([n]), np.array([1]))
    assert np.allclose(once.sums(), twice.sums()) and np.allclose(once.sums(), apart.sums())
    assert once.sums()[0] == once.codes.sum() == 2 * 10 + 20 + 3 * 30 and once.start.sum() == pytest.approx(6)


def test_labels_are_the_best_path():
    rng = np.random.default_rng(0)
    model = fit(first_model(), np.stack([rng.integers(0, n, 200) for n in LEVELS], axis=1), np.array([50, 0, 100, 50]), rounds=3)
    length = np.array([3, 0, 4, 1])
    signs = np.stack([rng.integers(0, n, 8) for n in LEVELS], axis=1)
    got = label(model, signs, length)
    at = 0
    for n in length:
        def score(path):
            out = np.log(model.start[path[0]]) + sum(np.log(model.step[a, b]) for a, b in zip(path, path[1:]))
            return out + sum(np.log(t[s, signs[at + i, j]]) for i, s in enumerate(path) for j, t in enumerate(model.signs))
        if n:
            best = max(product(range(len(STATES)), repeat=int(n)), key=score)
            assert score(tuple(got[at : at + n])) == pytest.approx(score(best))
        at += n


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=40, deadline=None)
def test_units_of_any_text(texts):
    u = units(texts, common_words())
    assert len(u.length) == len(texts) and u.length.sum() == len(u.chars) == len(u.words) == len(u.signs)
    assert (u.signs >= 0).all() and (u.signs < np.array(LEVELS)).all()
    assert [n > 0 for n in u.length] == [bool(re.sub("[\u00ad\u200b\u200c\u200d\ufeff]", "", t).strip()) for t in texts]


PROSE = "The quiet scene of the city was exported to the figure, but nobody went to the stadium with it. "


def test_spam(spark):
    pages = [
        (1, PROSE * 6), (2, "cheap shoes, best shoes, shoes sale, buy shoes, " * 12), (3, "* [red hat](https://a-shop.test/x)\n" * 12), (4, "#red #blue #hat12 #coat #shoe9 " * 10),
        (5, "Red Hat | Blue Coat | Fine Shoe | Old Lamp | " * 6), (6, PROSE * 8 + "\n\n#red #blue #hat"), (7, None), (8, ""), (9, "TODO"), (10, (PROSE + "\n") * 3000),
        (11, "SKU 12; colour: red; size: S; tag: hat\n" * 10), (12, "Buy red hat cheap! Best red hat sale. Cheap red hat deals! " * 8),
    ]
    df = spark.createDataFrame(pages, "doc_id int, text string").withColumns({"id": F.lit("x"), "spam": F.lit(1)})
    found = {r.id: r for r in spam_pages(df, "doc_id", "text").collect()}
    assert {i for i, r in found.items() if r.spam} == {2, 3, 4, 5, 11, 12}
    assert found[7].units == found[8].units == 0
    assert spam_pages(df.limit(0), "doc_id", "text").count() == 0
