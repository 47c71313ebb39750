"""Title and text functions: Column in, Column out."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marquee.tables import ready

# What counts as a promotional suffix, a numbered occurrence, a fixture, a line-up, a status.
PROMO_SUFFIX = (
    r"\s*\|\s*official\s+\w+\s+ticket\s*\+\s*hotel\s+packages\.?\s*$"
    r"|\s*\|\s*official\s+ticket\s*\+\s*hotel\s+packages\.?\s*$"
    r"|\s*\(sold\s+out\)\s*$"
    r"|\s*\*+\s*cancelled\s*\*+\s*$"
)
CITY_STATE = r"\s*[–—-]\s*[A-Za-z .'\-]+,\s*[A-Z]{2}\s*$"
NUMBERED = r"\((?:night|day|part|show|set)\s*\d+\)"
FIXTURE = r"\bvs?\.?\s"
LINEUP = r"\bfeaturing\b|\bfeat\.|\blineup\b|&\s*friends\b|\bin the round\b"
STATUS = r"\bcancell?ed\b|\bsold\s*out\b|\bpostponed\b"
OFF_TOPIC = r"\b(staff meeting|board meeting|private rental|closed for private event|employee training|hoa meeting|city council meeting)\b"
CANCELLED = r"\*+\s*cancelled\s*\*+|^\s*cancelled\s*[:\-]|\bevent\s+cancelled\b"
STOP_WORDS = ("the", "a", "an", "of", "with", "and", "or", "in", "at", "w", "presents", "performs", "live", "tour")
LEAST_TOKENS, LEAST_PREFIX, THRESHOLD = 3, 8, 0.80
#: Pairs of titles that one task rates by the similarity helper, at a fifth of a millisecond each.
RATED_A_TASK = 5_000


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case, with Unicode classes; false for null."""
    return _text(c).rlike("(?iU)" + pattern)


def is_numbered(title: Column) -> Column:
    return has(title, NUMBERED)


def is_fixture(title: Column) -> Column:
    return has(title, FIXTURE)


def is_lineup(title: Column) -> Column:
    return has(title, LINEUP)


def has_status(title: Column) -> Column:
    return has(title, STATUS)


def is_cancelled(title: Column) -> Column:
    return has(title, CANCELLED)


def is_off_topic(title: Column) -> Column:
    """Whether a title is of an event for members of a house alone."""
    return has(title, OFF_TOPIC)


def has_promo_suffix(title: Column) -> Column:
    return has(F.trim(_text(title)), PROMO_SUFFIX)


def normalize_title(title: Column) -> Column:
    """The comparison key of a title: no promotion, place or trailing remark (numbered ones stay), signs spelt out, lower case."""
    t = F.regexp_replace(F.trim(_text(title)), "(?iU)" + PROMO_SUFFIX, "")
    t = F.regexp_replace(t, "(?U)" + CITY_STATE, "")
    t = F.regexp_replace(t, rf"(?iU)(?:\s*\((?!(?:night|day|part|show|set)\s*\d+\))[^()]*\))+\s*$", "")
    t = F.regexp_replace(t, r"(?U)\s@\s", " at ")
    t = F.regexp_replace(t, r"(?U)\s*&\s*", " and ")
    return F.lower(F.trim(t))


def clean_unicode(title: Column) -> Column:
    """Typographic quotes, dashes and dots as ASCII."""
    return F.replace(F.translate(_text(title), "‘’“”–— ", "''\"\"-- "), F.lit("…"), F.lit("..."))


def tokens(norm: Column) -> Column:
    """The distinct tokens of a normalised title, without stop words and single characters."""
    found = F.array_distinct(F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def contains_tokens(a: Column, b: Column) -> Column:
    """Whether the smaller of two token sets, of three tokens at least, lies in the larger."""
    least = F.least(F.size(a), F.size(b))
    return (least >= LEAST_TOKENS) & (F.size(F.array_intersect(a, b)) == least)


def is_headliner_prefix(a: Column, b: Column) -> Column:
    """Whether the shorter title begins the longer one and a word ends there."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    after = F.substring(long, F.length(short) + 1, F.lit(1))
    return (F.length(short) >= LEAST_PREFIX) & F.startswith(long, short) & ((after == "") | after.isin(" ", "|", "(", "-", ":"))


def ratio_bound(a: Column, b: Column) -> Column:
    """No similarity ratio of two texts exceeds this."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    matcher, out = difflib.SequenceMatcher(), []
    last = None
    for x, y in zip(a, b, strict=True):
        if y != last:
            matcher.set_seq2(y or "")
            last = y
        matcher.set_seq1(x or "")
        out.append(matcher.ratio())
    return pd.Series(out)


#: Kept from being evaluated once more for a filter on its result.
_ratio = _ratio.asNondeterministic()


def title_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of a to b."""
    ready()
    return _ratio(a, b)


@F.pandas_udf(StructType([StructField("ratio", DoubleType()), StructField("back", DoubleType())]))
def _ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    matcher, out = difflib.SequenceMatcher(), []
    for x, y in zip(a, b, strict=True):
        each = [0.0, 0.0]
        if x is not None and y is not None:
            for k, (p, q) in enumerate(((x, y), (y, x))):
                matcher.set_seqs(p, q)
                each[k] = matcher.ratio()
        out.append(each)
    return pd.DataFrame(out, columns=["ratio", "back"], dtype="float64")


_ratios = _ratios.asNondeterministic()


def title_ratios(a: Column, b: Column) -> Column:
    """The similarity of a to b and of b to a; 0 where either is null."""
    ready()
    return _ratios(a, b)


def letter_bag(text: str) -> list[int]:
    """How many characters of a text have each remainder of their code by 32; equal letters have equal ones."""
    out = [0] * 32
    for c in text:
        out[ord(c) & 31] += 1
    return out


def subsequence_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, which no similarity ratio exceeds (bit-parallel)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b)) if a or b else 1.0


def slugify(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(_text(text))), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(t, r"(?U)[\s_-]+", "-"), 1, 200)


def fingerprint(title: Column, start: Column, city: Column) -> Column:
    """SHA-256 of normalised title, date and city."""
    return F.sha2(F.concat_ws("|", normalize_title(title), F.substring(F.trim(_text(start)), 1, 10), F.lower(F.trim(_text(city)))), 256)
