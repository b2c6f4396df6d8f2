"""Text cleaning, splitting and tokenising as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_CHARS, MAX_CHARS = 40, 800
#: The letters that survive cleaning (lower case, with the accents of the indexed languages).
LETTERS = "a-záéíóúàèìòùâêîôûäëïöüñ"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Null becomes empty; line ends, split bullets and split hyphens are joined; blanks collapse; ends are stripped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    c = F.regexp_replace(c, r"(?U)•\s*\n\s*", "• ")
    c = F.regexp_replace(c, r"(?U)-\s*\n\s*", "-")
    return strip(F.regexp_replace(c, "[ \t]+", " "))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def split_by_size(c: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(c) / size).cast("int") - 1))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(c, i * size + 1, F.lit(size)))), lambda p: p != "")


def split_large(c: Column, size: int) -> Column:
    """A paragraph's parts of at most ``size`` characters: sentences packed greedily, over-long ones cut."""
    empty = F.array().cast("array<string>")
    state = lambda parts, cur: F.struct(parts.alias("parts"), cur.alias("cur"))
    closed = lambda acc: F.when(acc["cur"] != "", F.array_append(acc["parts"], acc["cur"])).otherwise(acc["parts"])

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return (
            F.when(F.length(s) > size, state(F.concat(closed(acc), split_by_size(s, size)), F.lit("")))
            .when(F.length(acc["cur"]) + F.length(s) + 1 <= size, state(acc["parts"], joined))
            .otherwise(state(closed(acc), s))
        )

    sentences = F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")
    packed = F.aggregate(sentences, state(empty, F.lit("")), add, closed)
    return F.when(F.length(c) <= size, F.array(c)).otherwise(packed)


def chunks(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, modality, num_chars, content): the paragraphs of ``min_chars`` and more, cut to ``max_chars``."""
    kept = F.filter(paragraphs(clean_text(F.col(text_col))), lambda p: F.length(p) >= min_chars)
    parts = F.flatten(F.transform(kept, lambda p: split_large(p, max_chars)))
    out = df.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(parts).alias("chunk_index", "content"))
    return out.select("doc_id", "chunk_index", F.concat("doc_id", F.lit("_text_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.lit("text").alias("modality"), F.length("content").alias("num_chars"), "content")


def stopwords(spark: SparkSession, *languages: str, custom: tuple[str, ...] = ()) -> list[str]:
    """Spark's stop words of the languages and custom ones; an unknown language adds none."""
    from pyspark.ml.feature import StopWordsRemover

    out = set(custom)
    for lang in languages:
        try:
            out |= {w.lower() for w in StopWordsRemover.loadDefaultStopWords(lang)}
        except Exception:  # noqa: BLE001 - the JVM's error for a language it has no list of
            continue
    return sorted(out)


def tokens(c: Column, stop: list[str] | tuple[str, ...] = ()) -> Column:
    """Lower case, other characters than letters and blanks deleted (not blanked), split at blanks; single letters and stop words dropped."""
    letters = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"[^{LETTERS}\s]", "")
    words = F.filter(F.split(letters, r"\s+"), lambda t: F.length(t) > 1)
    if not stop:
        return words
    listed = F.array(*[F.lit(w) for w in stop])
    return F.filter(words, lambda t: ~F.array_contains(listed, t))


def lines(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\R"), lambda x: F.trim(x) != "")


def title_of(content: Column, fallback: Column) -> Column:
    """The first line if it has more than ten characters, else the fallback."""
    first = strip(F.get(lines(content), 0))
    return F.when(F.length(first) > 10, first).otherwise(fallback)


def snippet_of(content: Column, title: Column, most: int = 300) -> Column:
    """The content without a first line that equals the title, to ``most`` characters; the content if nothing is left."""
    found = lines(content)
    rest = F.substring(strip(F.array_join(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), " ")), 1, most)
    whole = F.substring(strip(content), 1, most)
    cut = F.when((F.size(found) > 0) & (strip(F.get(found, 0)) == title), rest).otherwise(whole)
    return F.when(cut == "", whole).otherwise(cut)


def pretty(c: Column) -> Column:
    return F.initcap(F.translate(c, "._", "  "))


def safe_name(c: Column) -> Column:
    """Runs outside letters, digits, dot, hyphen and underscore become one underscore; ``unknown`` if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unknown"))


def or_query(c: Column) -> Column:
    found = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1), " | ")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("emptyqueryterm"))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def static_url(prefix: str, path: Column) -> Column:
    """``prefix`` and the path with every segment percent-encoded."""
    return F.concat(F.lit(prefix + "/"), F.array_join(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.url_encode(s), r"\+", "%20")), "/"))


def below(path: Column, root: str) -> Column:
    """The part of a path below the folder ``root`` (its first occurrence), null if the path isn't below it."""
    return F.nullif(F.regexp_extract(path, rf"^(?:.*?/)?{root}/(.+)$", 1), F.lit(""))


def file_id(path: Column, root: str = "data") -> Column:
    """The folders below ``root`` and the stem, joined by underscores; of other paths the last folder and the stem."""
    parts = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", ""), "/", "_")
    return F.coalesce(parts(below(path, root)), parts(F.regexp_extract(path, r"([^/]*/?[^/]*)$", 1)))


def media_url(path: Column, places: dict[str, str]) -> Column:
    """The encoded URL of a file below the first matching folder of ``places`` (folder -> URL prefix), empty for other files."""
    return F.coalesce(*[static_url(prefix, below(path, folder)) for folder, prefix in places.items()], F.lit(""))


def repaired_path(path: Column, root: str = "data") -> Column:
    """A stored path re-rooted at ``full/`` or ``samples/`` under ``root``; other paths stay."""
    return F.regexp_replace(path, r"^.*?/?data/(full|samples)/", f"{root}/$1/")
