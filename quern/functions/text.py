"""Text scalars as Column expressions, and the two Unicode forms that Spark lacks as Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A character that may not stand next to an alias.  Indic combining vowel signs are no letters here.
WORD = r"[\p{L}\p{N}_]"
#: Bengali digits, the number words that reports spell out, and the patterns that tell counts of dead and injured.
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "sixteen": 16, "twenty-four": 24, "twenty-five": 25, "forty-eight": 48,
}
NUMBER = r"[0-9]+|" + "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))
PERSONS = "people|persons?|students?|labourers?|workers?|others?"
DEATHS = rf"(?i)\b({NUMBER})\s+(?:(?:{PERSONS})\s+)?(?:were\s+|was\s+)?(?:killed|died|dead|deaths?|fatalities)\b"
INJURIES = rf"(?i)\b({NUMBER})\s+(?:more\s+)?(?:(?:{PERSONS}|friends?|classmates?)\s+)?(?:were\s+|was\s+)?(?:\w+ly\s+)?(?:injured|hurt)\b"
INJURING = rf"(?i)\binjuring\s+(?:his|her|their)\s+({NUMBER})\s+(?:friends?|classmates?|students?|people|persons?)\b"
OF_THEM_INJURED = rf"(?i)\b(?:(?:his|her|their)\s+)?({NUMBER})\s+(?:of\s+(?:his|her|their)\s+)?(?:friends?|classmates?|students?|people|persons?)\s+(?:were\s+)?(?:injured|hurt)\b"
ONE_DEATH = r"(?i)\b(?:a|one)\s+(?:[\w-]+\s+){0,3}(?:was\s+)?(?:killed|died)\b|\b(?:student|man|woman|person|motorcyclist|pedestrian|driver|rider)\s+(?:[\w'-]+\s+){0,3}(?:was\s+)?(?:killed|died)\b|\b(?:killing|death of)\s+(?:[\w'-]+\s+){0,4}[\w'-]+"


#: ASCII, and Latin-1 letters that are their own compatibility form.
ASCII = r"\A[\x00-\x7F]*\z"
PLAIN = r"\A[\x00-\x7F\u00C0-\u00FF]*\z"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(*parts: str | Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *map(_column, parts)), 256), 1, length)


def stable_id(prefix: str, *parts: str | Column) -> Column:
    return F.concat(F.lit(prefix + "_"), content_hash(*parts))


def folded(text: str | Column) -> Column:
    """Lower case with the one full case folding that European text needs."""
    return F.replace(F.lower(_column(text)), F.lit("ß"), F.lit("ss"))


def ascii_digits(text: str | Column) -> Column:
    return F.translate(_column(text), BENGALI_DIGITS, "0123456789")


def nfkc(text: str | Column) -> Column:
    """Compatibility composition.  Spark has no expression for it; text of Latin-1 letters without compatibility forms is its own
    and never leaves the JVM."""
    text = _column(text)
    return F.when(text.rlike(PLAIN), text).otherwise(_nfkc(F.when(~text.rlike(PLAIN), text)))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def unaccented(text: str | Column) -> Column:
    """Compatibility decomposition, case folded, without combining marks; ASCII text is only put in lower case, in the JVM."""
    text = _column(text)
    return F.when(text.rlike(ASCII), F.lower(text)).otherwise(_unaccented(F.when(~text.rlike(ASCII), text)))


@F.pandas_udf(StringType())
def _unaccented(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c)))


def normalized(text: str | Column) -> Column:
    """NFKC, without zero-width space and grapheme joiner, runs of white space as one space, trimmed."""
    plain = F.translate(nfkc(_column(text)), "​͏", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def terms(text: str | Column) -> Column:
    """Distinct sorted letters-and-digits tokens of a folded text."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def lexical_features(title: str | Column, excluded: list[str] | Column, least: int = 4) -> Column:
    """Distinct sorted title tokens of some length that are not excluded."""
    out = F.filter(terms(title), lambda t: F.length(t) >= least)
    gone = F.array(*map(F.lit, excluded)) if isinstance(excluded, list) else excluded
    return F.array_except(out, gone)


def excerpt(text: str | Column, words: int = 25) -> Column:
    """The first words, with an ellipsis if there are more."""
    parts = F.split(F.trim(F.regexp_replace(_column(text), r"[ \t\n\r\f\x0B]+", " ")), " ")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, F.lit("…")).otherwise(F.lit("")))


def jaccard(left: str | Column, right: str | Column) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    a, b = _column(left), _column(right)
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / (F.size(a) + F.size(b) - same))


def number_of(word: Column) -> Column:
    """Digits or a number word as an integer; null for anything else."""
    table = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(word)), F.when(word.rlike("^[0-9]+$"), word.try_cast("int")))


def casualty_counts(text: str | Column) -> Column:
    """struct(fatalities, injuries) from the first match of each; a death told without a number counts one; else null."""
    x = _column(text)
    deaths = number_of(F.nullif(F.regexp_extract(x, DEATHS, 1), F.lit("")))
    injured = F.coalesce(*(number_of(F.nullif(F.regexp_extract(x, p, 1), F.lit(""))) for p in (INJURIES, INJURING, OF_THEM_INJURED)))
    return F.struct(F.coalesce(deaths, F.when(x.rlike(ONE_DEATH), F.lit(1))).alias("fatalities"), injured.alias("injuries"))


def alias_pattern(alias: Column) -> Column:
    """A pattern for the alias between characters that aren't part of words."""
    quoted = F.regexp_replace(folded(alias), r"([\\^$.|?*+()\[\]{}-])", r"\\$1")
    return F.concat(F.lit(f"(?<!{WORD})"), quoted, F.lit(f"(?!{WORD})"))


def strip_publisher(title: str | Column, publisher: str | Column) -> Column:
    """Without a trailing ' - Publisher', in any case."""
    t, suffix = _column(title), F.concat(F.lit(" - "), _column(publisher))
    return F.when(F.lower(t).endswith(F.lower(suffix)), F.trim(F.left(t, F.length(t) - F.length(suffix)))).otherwise(t)


def matches_terms(text: str | Column, terms_: list[str], excluded: list[str]) -> Column:
    """Whether a text holds any of the terms and none of the excluded ones, accents and case aside."""
    t = unaccented(text)
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c))
    any_of = lambda words: reduce(Column.__or__, (F.contains(t, F.lit(plain(w))) for w in words), F.lit(False))
    return any_of(terms_) & ~any_of(excluded)


def compacted(text: str | Column, most: int) -> Column:
    """Without addresses, in single spaces, at most so many characters, cut at a word with an ellipsis."""
    t = F.trim(F.regexp_replace(F.regexp_replace(_column(text), r"https?://\S+", ""), r"\s+", " "))
    cut = F.substring(t, 1, most + 1)
    word = F.when(cut.contains(" "), F.rtrim(F.regexp_replace(cut, r" [^ ]*$", ""))).otherwise(cut)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(word, F.lit("…")))
