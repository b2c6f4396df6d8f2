"""Snowball stemming (English, Spanish and German), from the published descriptions of the algorithms, as an Arrow function."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.runtime import broadcast_if_small, ship, stage

_VOWELS = {"english": "aeiouy", "spanish": "aeiouáéíóúü", "german": "aeiouyäöü"}


def _region(word: str, vowels: str, start: int = 0) -> int:
    """After the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


# Fixed values of the published English algorithm.
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EN_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_EN_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _short_end(w: str) -> bool:
    v = _VOWELS["english"]
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) > 2 and w[-1] not in v + "wxY" and w[-2] in v and w[-3] not in v


def stem_english(word: str) -> str:
    w, v = word.lower().replace("’", "'"), _VOWELS["english"]
    if len(w) <= 2:
        return w
    if w in _EN_WHOLE:
        return _EN_WHOLE[w]
    w = w[1:] if w[0] == "'" else w
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in v) else c for i, c in enumerate(w))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, v)
    r2 = _region(w, v, r1)
    if e := _longest(w, ("'", "'s", "'s'")):
        w = w[: -len(e)]
    e = _longest(w, ("sses", "ied", "ies", "s", "us", "ss"))
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and any(c in v for c in w[:-2]):
        w = w[:-1]
    if w in _EN_KEEP:
        return w.lower()
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(c in v for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    e = _longest(w, (*_EN_2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e in _EN_2:
            w = w[: -len(e)] + _EN_2[e]
        elif e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif w[:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    e = _longest(w, (*_EN_3, "ative"))
    if e and len(w) - len(e) >= r1:
        if e in _EN_3:
            w = w[: -len(e)] + _EN_3[e]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    e = _longest(w, (*_EN_4, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or (w.endswith("ll") and len(w) - 1 >= r2):
        w = w[:-1]
    return w.replace("Y", "y")


# Fixed values of the published Spanish algorithm.
_ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_ES_1A = ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos")
_ES_1B = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
_ES_Y = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_ES_2E = ("en", "es", "éis", "emos")
_ES_2 = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
    "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def stem_spanish(word: str) -> str:
    w, v = word.lower(), _VOWELS["spanish"]
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    if len(w) < 3:
        rv = len(w)
    elif w[1] not in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    elif w[0] in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    else:
        rv = 3
    plain = str.maketrans("áéíóú", "aeiou")

    def ends(e: str | None, at: int) -> bool:
        return e is not None and len(w) - len(e) >= at

    p = _longest(w, _ES_PRONOUNS)
    if ends(p, rv):
        before = w[: -len(p)]
        g = _longest(before, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if g and len(before) - len(g) >= rv and (g != "yendo" or before.endswith("uyendo")):
            w = before[: -len(g)] + g.translate(plain)
    done = False
    e = _longest(w, (*_ES_1A, *_ES_1B, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
    if e == "amente":
        if ends(e, r1):
            w, done = w[:-6], True
            x = _longest(w, ("iv", "os", "ic", "ad"))
            if ends(x, r2):
                w = w[: -len(x)]
                if x == "iv" and w.endswith("at") and ends("at", r2):
                    w = w[:-2]
    elif ends(e, r2):
        done = True
        stem = w[: -len(e)]
        if e in _ES_1A:
            w = stem
        elif e in _ES_1B:
            w = stem
            if w.endswith("ic") and ends("ic", r2):
                w = w[:-2]
        elif e.startswith("log"):
            w = stem + "log"
        elif e.startswith("uc"):
            w = stem + "u"
        elif e.startswith("enc"):
            w = stem + "ente"
        elif e == "mente":
            w = stem
            x = _longest(w, ("ante", "able", "ible"))
            if ends(x, r2):
                w = w[: -len(x)]
        elif e.startswith("idad"):
            w = stem
            x = _longest(w, ("abil", "ic", "iv"))
            if ends(x, r2):
                w = w[: -len(x)]
        else:
            w = stem
            if w.endswith("at") and ends("at", r2):
                w = w[:-2]
    if not done:
        e = _longest(w[rv:], _ES_Y)
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        else:
            e = _longest(w[rv:], (*_ES_2, *_ES_2E))
            if e:
                w = w[: -len(e)]
                if e in _ES_2E and w.endswith("gu"):
                    w = w[:-1]
    e = _longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


# Fixed values of the published German algorithm: letters that may stand before a final s and before a final st.
_DE_S, _DE_ST = "bdfghklmnrt", "bdfghklmnt"


def stem_german(word: str) -> str:
    v = _VOWELS["german"]
    w = word.lower().replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v else c for i, c in enumerate(w))
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    r1 = max(r1, min(3, len(w)))

    def ends(ending: str, region: int) -> bool:
        return w.endswith(ending) and len(w) - len(ending) >= region

    # plurals and cases
    e = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if e and ends(e, r1) and (e != "s" or (len(w) > 1 and w[-2] in _DE_S)):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    # comparison
    e = _longest(w, ("en", "er", "est", "st"))
    if e and ends(e, r1) and (e != "st" or (len(w) > 5 and w[-3] in _DE_ST)):
        w = w[: -len(e)]
    # derivation
    e = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if e and ends(e, r2):
        rest = w[: -len(e)]
        if e in ("end", "ung"):
            w = rest
            if ends("ig", r2) and not w.endswith("eig"):
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif e in ("lich", "heit"):
            w = rest
            if ends("er", r1) or ends("en", r1):
                w = w[:-2]
        else:
            w = rest
            for inner in ("lich", "ig"):
                if ends(inner, r2):
                    w = w[: -len(inner)]
                    break
    return w.lower().translate(str.maketrans("äöü", "aou"))


_STEMMERS = {"english": stem_english, "spanish": stem_spanish, "german": stem_german}


@lru_cache(maxsize=200_000)
def stem(word: str, language: str) -> str:
    """The stem; a language without a stemmer leaves words as they are."""
    f = _STEMMERS.get(language)
    return f(word) if f else word


def stemmed(rows: DataFrame, term: str, language: str) -> DataFrame:
    """``rows`` with stems for terms. Only the distinct terms go through Python; their stems are joined back."""
    if language not in _STEMMERS:
        return rows

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w, language))

    ship(rows.sparkSession)
    book = stage(rows.select(F.col(term).alias("__word")).where("__word is not null").distinct().withColumn("__stem", run("__word")), "stems")
    joined = rows.join(broadcast_if_small(book, book.count()), F.col(term) == F.col("__word"), "left")
    return joined.withColumn(term, F.col("__stem")).drop("__word", "__stem")


def stem_tokens(column: F.Column, language: str) -> F.Column:
    """Stems of an array of tokens."""
    if language not in _STEMMERS:
        return column

    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else [stem(w, language) for w in ws])

    return run(column)
