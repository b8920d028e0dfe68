"""Names: normalisation, tokens, variants, scores and rendering."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave import schema as S


def normalize(s: Column, dotted_i: bool = False) -> Column:
    """Lower case; apostrophes, dots and dashes vanish, other ASCII punctuation is a space; spaces collapse; ends trimmed."""
    s = F.translate(s, "İ", "I") if dotted_i else s
    s = F.regexp_replace(F.lower(s), "['‘’.–]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[!-/:-@\[-`{-~\t]", " "), " +", " "))


def tokens(s: Column) -> Column:
    """The parts between spaces and commas, without empty ones."""
    return F.filter(F.split(s, "[ ,]"), lambda x: x != "")


@F.pandas_udf(T.StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ"))


def deaccent(s: Column | str) -> Column:
    """Canonical decomposition without combining marks of the block U+0300. Plain ASCII never leaves the JVM."""
    s = F.col(s) if isinstance(s, str) else s
    marked = s.rlike(r"[^\x00-\x7F]")
    return F.when(marked, _without_marks(F.when(marked, s))).otherwise(s)


# Greek and Cyrillic letters as Latin ones, one letter each and several.
_SINGLE = ("αβγδεζηικλμνξοπρστυωάέήίόύώςабвгдезийклмнопрстуфыэґії", "abgdeziiklmnxoprstyoaeiioyosabvgdezijklmnoprstufyegii")
_SEVERAL = {"θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "ё": "yo", "є": "ye"}


def transliterate(name: Column) -> Column:
    """Greek and Cyrillic letters by Latin ones, upper case as it was for single letters, capitalised for several; others stay."""
    lower, to = _SINGLE
    out = F.translate(F.translate(name, lower, to), lower.upper(), to.upper())
    for letter, many in _SEVERAL.items():
        out = F.replace(F.replace(out, F.lit(letter), F.lit(many)), F.lit(letter.upper()), F.lit(many.capitalize()))
    return out


def language_of(name: Column) -> Column:
    """The language a name without one counts as: English if it is plain ASCII, else unknown."""
    return F.when(name.rlike(r"^[\x00-\x7F]*$"), "en").otherwise("unk")


def apply_rewrites(name: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """All variants that one rule makes of a name, itself first, without repeats; ß is also ss."""
    made = [F.regexp_replace(name, pattern, to) for pattern, many in rules for to in many]
    return F.array_distinct(F.array(name, *made, F.replace(name, F.lit("ß"), F.lit("ss"))))


def apply_deletes(name: Column, words: list[str]) -> Column:
    """The name without any of the words (longest first, any case, up to a word's end); spaces collapse if it changed."""
    import re

    pattern = "(?i)(?:" + "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"
    cut = F.regexp_replace(name, pattern, "")
    return F.when(cut != name, F.trim(F.regexp_replace(cut, " +", " "))).otherwise(name)


def shortest(name: Column, cc: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The shortest result of the rules (country or *, pattern, replacement) that changes the name, else null; ties by text."""
    made = F.array(*(F.when((F.lit(c) == "*") | (cc == c), F.trim(F.regexp_replace(name, p + r"\b", to))) for c, p, to in rules))
    changed = F.filter(made, lambda x: x.isNotNull() & (x != name) & (x != ""))
    return F.get(F.array_sort(F.transform(changed, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), F.lit(0))["x"]


def country_hack(name: Column, cc: Column, woe: Column) -> Column:
    """Names by local habit: Japanese prefectures, Taiwanese counties, Peruvian regions; else null."""
    return (
        F.when((cc == "JP") & (woe == S.ADMIN1), F.concat(name, F.lit(" Prefecture")))
        .when((cc == "TW") & (woe == S.TOWN), F.concat(name, F.lit(" County")))
        .when((cc == "PE") & name.startswith("Region "), F.concat(F.regexp_replace(name, "^Region ", ""), F.lit(" Region")))
    )


def romanian(name: Column) -> Column:
    """Cedillas to commas below, tilde and caron to breve."""
    return F.translate(name, "ŞşŢţÃãǍǎ", "ȘșȚțĂăĂă")


def polygon_names(name: Column) -> Column:
    """``A (B)`` is both names; commas and slashes part names; all trimmed, without repeats."""
    plain = F.regexp_replace(name, r"\s*\(.*?\)\s*", " ")
    inner = F.regexp_extract_all(name, F.lit(r"\((.*?)\)"), F.lit(1))
    parts = F.flatten(F.transform(F.concat(F.array(plain), inner), lambda x: F.split(x, "[,/]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def prefixes(name: Column, most: int = 5) -> Column:
    """The leading 1 to ``most`` characters; none of an empty name."""
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(name))), lambda i: F.substring(name, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def name_score(lang: Column, flags: Column, want: Column, abbreviations: Column, name: Column) -> Column:
    """How well a name suits a language, by flag."""
    has = lambda f: flags.bitwiseAND(F.lit(f)) != 0
    out = F.when(lang == want, 40.0).when(lang == "en", 20.0).otherwise(-20.0)
    only_colloquial = flags == S.COLLOQUIAL
    for cond, value in (
        (has(S.HISTORIC), -100), (has(S.COLLOQUIAL) & only_colloquial, -1), (has(S.COLLOQUIAL) & ~only_colloquial, 1), (has(S.SHORT_NAME), 11),
        (has(S.NEVER_DISPLAY), -10000), (has(S.LOW_QUALITY), -20), (has(S.PREFERRED), 5), (has(S.ALIAS), -1), (has(S.DEACCENT), -1),
        (has(S.ABBREVIATION) & abbreviations, 1000), (has(S.ALT_NAME), -1), (has(S.LOCAL_LANG), 5),
    ):
        out = out + F.when(cond, float(value)).otherwise(0.0)
    return out - F.length(name) * 0.0001


def best_name(names: Column, want: Column, abbreviations: Column | None = None) -> Column:
    """Of an array of (name, lang, flags): the first with the highest score over 0, else the first."""
    abbreviations = F.lit(False) if abbreviations is None else abbreviations
    scored = F.transform(names, lambda n, i: F.struct(name_score(n["lang"], n["flags"], want, abbreviations, n["name"]).alias("s"), (-i).alias("i"), n["name"].alias("name")))
    top = F.array_max(scored)
    return F.when(top["s"] > 0, top["name"]).otherwise(F.get(names, F.lit(0))["name"])


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings from 0 to 1, prefix weight 0.1 up to four characters."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    head = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + head * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """100 if equal, else 100 times the Jaro-Winkler similarity of the letters, case folded."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else 100.0 if x == y else 100 * jaro_winkler("".join(filter(str.isalpha, x)).casefold(), "".join(filter(str.isalpha, y)).casefold()) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def highlight(name: pd.Series, query: pd.Series) -> pd.Series:
    """Wraps the shortest head of a name whose normal form is the query's in <b></b>; the name as it is if none is."""
    import re

    def normal(s: str) -> str:
        s = re.sub("['‘’.–]", "", s.lower())
        return re.sub(" +", " ", re.sub(r"[!-/:-@\[-`{-~\t]", " ", s)).strip()

    def one(n, q):
        if n is None or not q:
            return n
        q = normal(q)
        for i in range(1, len(n) + 1):
            if normal(n[:i]) == q:
                while i < len(n) and normal(n[: i + 1]) == q and not n[i].isspace():
                    i += 1
                return f"<b>{n[:i]}</b>{n[i:]}"
        return n

    return pd.Series([one(n, q) for n, q in zip(name, query)])


def slug(name: Column) -> Column:
    """Lower case, punctuation but - and / removed, spaces to hyphens; deaccented."""
    s = F.regexp_replace(F.lower(name), "['‘’.–]", "")
    return deaccent(F.replace(F.regexp_replace(s, r"[!-,.:-@\[-`{-~]", ""), F.lit(" "), F.lit("-")))
