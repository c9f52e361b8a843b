"""English stemming (the second Porter algorithm) as column expressions over rule tables, and its stop words.

Words are lower-case letters and digits. Each step takes the longest suffix of its table that a word ends with, and replaces it if
the rest reaches into the step's region.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import bound

#: The published stop words of English text search, and the rules of the published algorithm.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now"
).split()
#: suffix, replacement, letters of which one must stand before it (any if empty).
STEP_2 = (
    ("tional", "tion", ""), ("enci", "ence", ""), ("anci", "ance", ""), ("abli", "able", ""), ("entli", "ent", ""), ("izer", "ize", ""), ("ization", "ize", ""), ("ational", "ate", ""), ("ation", "ate", ""),
    ("ator", "ate", ""), ("alism", "al", ""), ("aliti", "al", ""), ("alli", "al", ""), ("fulness", "ful", ""), ("ousli", "ous", ""), ("ousness", "ous", ""), ("iveness", "ive", ""), ("iviti", "ive", ""),
    ("biliti", "ble", ""), ("bli", "ble", ""), ("ogi", "og", "l"), ("fulli", "ful", ""), ("lessli", "less", ""), ("li", "", "cdeghkmnrt"),
)
STEP_3 = (("tional", "tion", ""), ("ational", "ate", ""), ("alize", "al", ""), ("icate", "ic", ""), ("iciti", "ic", ""), ("ical", "ic", ""), ("ful", "", ""), ("ness", "", ""), ("ative", "", ""))
STEP_4 = tuple((s, "", "") for s in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()) + (("ion", "", "st"),)
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
WHOLE_PREFIXES = ("gener", "commun", "arsen")
#: A syllable that ends a short word: vowel and consonant, behind a consonant or at the start.
SHORT = r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE = r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _cut(word: Column, n: int, then: str = "") -> Column:
    rest = F.substring(word, F.lit(1), F.length(word) - n)
    return F.concat(rest, F.lit(then)) if then else rest


def _by_table(word: Column, table: tuple[tuple[str, str, str], ...], region: dict[str, Column], default: Column) -> Column:
    """The longest of the table's suffixes that the word ends with: replaced if the rest is at least as long as its region starts."""
    out = F
    for suffix, then, before in sorted(table, key=lambda r: -len(r[0])):
        good = F.length(word) - len(suffix) >= region.get(suffix, default)
        if before:
            good &= word.rlike(f"[{before}]{suffix}$")
        out = out.when(word.endswith(suffix), F.when(good, _cut(word, len(suffix), then)).otherwise(word))
    return out.otherwise(word)


def _ends(word: Column, *some: str) -> Column:
    return word.rlike(f"(?:{'|'.join(some)})$")


def _first_region(w: Column) -> Column:
    whole = f"^(?:{'|'.join(WHOLE_PREFIXES)})"
    return F.when(w.rlike(whole), F.length(F.regexp_extract(w, whole, 0))).when(w.rlike(_REGION), F.length(F.regexp_extract(w, _REGION, 0))).otherwise(F.length(w))


def _second_region(w: Column, r1: Column) -> Column:
    rest = F.substring(w, r1 + 1, F.length(w))
    return F.when(rest.rlike(_REGION), r1 + F.length(F.regexp_extract(rest, _REGION, 0))).otherwise(F.length(w))


def _no_plural(w: Column) -> Column:
    some = F.when(_ends(w, "ied", "ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
    vowel = F.substring(w, F.lit(1), F.length(w) - 2).rlike("[aeiouy]")
    return F.when(_ends(w, "sses"), _cut(w, 2)).otherwise(some.when(_ends(w, "us", "ss"), w).when(_ends(w, "s") & vowel, _cut(w, 1)).otherwise(w))


def _without_ending(w: Column) -> Column:
    """What is left by a dropped ed or ing, null where none is dropped."""
    out = F.when(_ends(w, "eedly", "eed"), None)
    for suffix in ("ingly", "edly", "ing", "ed"):
        out = out.when(_ends(w, suffix), F.when(_cut(w, len(suffix)).rlike("[aeiouy]"), _cut(w, len(suffix))))
    return out


def _eed(w: Column, r1: Column) -> Column:
    long, short = F.length(w) - 5 >= r1, F.length(w) - 3 >= r1
    return F.when(_ends(w, "eedly"), F.when(long, _cut(w, 3)).otherwise(w)).when(_ends(w, "eed"), F.when(short, _cut(w, 1)).otherwise(w)).otherwise(w)


def _mended(d: Column, r1: Column) -> Column:
    with_e = F.concat(d, F.lit("e"))
    return F.when(_ends(d, "at", "bl", "iz"), with_e).when(d.rlike(DOUBLE), _cut(d, 1)).when(d.rlike(SHORT) & (r1 >= F.length(d)), with_e).otherwise(d)


def _last_letter(w: Column, r1: Column, r2: Column) -> Column:
    rest = F.length(w) - 1
    return F.when(_ends(w, "e") & ((rest >= r2) | ((rest >= r1) & ~_cut(w, 1).rlike(SHORT))), _cut(w, 1)).when(_ends(w, "ll") & (rest >= r2), _cut(w, 1)).otherwise(w)


def stem(term: Column) -> Column:
    """The stem of a term; a null term has none."""

    def over(state: Column, word: Callable[[Column], Column]) -> Column:
        return bound(state, lambda s: F.struct(word(s).alias("w"), s["r1"].alias("r1"), s["r2"].alias("r2"), s["stop"].alias("stop")))

    marked = F.regexp_replace(F.regexp_replace(term, "^y", "Y"), "([aeiouy])y", "$1Y")  # such a y is no vowel
    s = bound(marked, lambda w: F.struct(w.alias("w"), _first_region(w).alias("r1")))
    s = bound(s, lambda s: F.struct(_no_plural(s["w"]).alias("w"), s["r1"].alias("r1"), _second_region(s["w"], s["r1"]).alias("r2")))
    s = bound(s, lambda s: F.struct(s["w"].alias("w"), _without_ending(s["w"]).alias("d"), s["r1"].alias("r1"), s["r2"].alias("r2"), F.when(s["w"].isin(*KEPT_AFTER_PLURAL), s["w"]).alias("stop")))
    s = over(s, lambda s: F.when(s["d"].isNull(), _eed(s["w"], s["r1"])).otherwise(_mended(s["d"], s["r1"])))
    s = over(s, lambda s: F.when(s["w"].rlike("..*[^aeiouy][yY]$"), _cut(s["w"], 1, "i")).otherwise(s["w"]))
    s = over(s, lambda s: _by_table(s["w"], STEP_2, {}, s["r1"]))
    s = over(s, lambda s: _by_table(s["w"], STEP_3, {"ative": s["r2"]}, s["r1"]))
    s = over(s, lambda s: _by_table(s["w"], STEP_4, {}, s["r2"]))
    own = bound(s, lambda s: F.lower(F.coalesce(s["stop"], _last_letter(s["w"], s["r1"], s["r2"]))))
    special = F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair])
    return F.when((F.length(term) <= 2) | term.isin(*KEPT), term).otherwise(F.coalesce(special[term], own))


def with_stems(rows: DataFrame, term: str = "term", name: str = "stem") -> DataFrame:
    """Adds the stem of a column of terms; meant for a table of distinct terms."""
    return rows.withColumn(name, stem(F.col(term)))
