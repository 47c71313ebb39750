"""Dates as people write them: fragments of a page's text, and their reading."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marquee.tables import ready

# Names of months and days, and the shapes of dates, times and prices in listings.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DOW = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
MONTH_YEAR = rf"\b({_MONTH})\s+(\d{{4}})\b"
UNDATED = rf"\b{_DOW}[a-z]*,?\s+{_MON}[a-z]*\s+\d{{1,2}}\b"
DATED = rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}(?:\s+\d{{1,2}}:\d{{2}}\s*(?:am|pm))?\b"
RANGE = rf"\b({_MONTH}\s+\d{{1,2}})\s*[-–—]\s*{_MONTH}\s+\d{{1,2}},?\s+(\d{{4}})\b"
SHOW = r"Show:?\s*(\d{1,2}(?::\d{2})?\s*(?:am|pm))"
DOORS = r"Doors:?\s*(\d{1,2}(?::\d{2})?\s*(?:am|pm))"
TRAILING = rf"\s+(?:{_DOW}[a-z]*,?\s+)?{_MON}[a-z]*\s+\d{{1,2}}$"
PRICE = r"\$\s*([\d.]+)(?:\s*to\s*\$?\s*([\d.]+))?"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), "(?iU)" + pattern, group)


def strip_trailing_date(title: Column) -> Column:
    """The title without a date, with or without a weekday, at its end."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), "(?iU)" + TRAILING, ""))


def month_year(text: Column) -> Column:
    """The first month with a year, as written; empty for none."""
    return _found(text, MONTH_YEAR)


def price_text(text: Column) -> Column:
    """$X or $X to $Y; empty for no price."""
    low, high = _found(text, PRICE, 1), _found(text, PRICE, 2)
    return F.when(low == "", F.lit("")).otherwise(F.concat(F.lit("$"), low, F.when(high == "", F.lit("")).otherwise(F.concat(F.lit(" to $"), high))))


def start_time(text: Column) -> Column:
    """The time of the show, else that of the doors; empty for neither."""
    show = _found(text, SHOW, 1)
    return F.when(show != "", show).otherwise(_found(text, DOORS, 1))


def date_text(text: Column) -> Column:
    """What of a text says its date: the start of a range with the range's year, a date with a year, or a weekday's date
    and the start time."""
    begin, year = _found(text, RANGE, 1), _found(text, RANGE, 2)
    dated, loose, time = _found(text, DATED), _found(text, UNDATED), start_time(text)
    shown = F.when(time == "", loose).otherwise(F.concat_ws(" ", loose, time))
    return F.when(begin != "", F.concat_ws(", ", begin, year)).when(dated != "", dated).when(loose != "", shown).otherwise(F.lit(""))


def year_anchor(text: Column, as_of: str) -> Column:
    """The first of January that a date without a year is read against: of as_of's year, or the next if its month has
    passed. Null where the text has a year, or no month."""
    t = F.coalesce(text, F.lit(""))
    month = F.initcap(_found(t, f"({_MON})", 1))
    number = F.array_position(F.array(*[F.lit(m) for m in _MON[3:-1].split("|")]), month).cast("int")
    year = F.lit(int(as_of[:4])) + (number < int(as_of[5:7])).cast("int")
    return F.when(t.rlike(r"\b\d{4}\b") | (month == ""), F.lit(None).cast("string")).otherwise(F.concat(year.cast("string"), F.lit("-01-01")))


# The forms of dates that are read without a parser, and of the times that may follow them.
_DAY, _YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4})"
_NAMED = rf"({_MON})[a-z]*\.?"
_AT = r"(?:,?\s+(?:at\s+)?(?:(\d{1,2})(?::(\d{2}))?\s*(am|pm)|(\d{1,2}):(\d{2})(?::(\d{2}))?))?"
_FRONT = rf"^\s*(?:on\s+)?(?:{_DOW}[a-z]*\.?,?\s+)?"
# Each with its parts in the order year, month, day, hour, minute, half of the day, and hour, minute, second of a whole day.
FORMS = (
    (rf"{_FRONT}{_NAMED}\s+{_DAY},?\s+{_YEAR}{_AT}\s*$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"{_FRONT}{_DAY}\s+{_NAMED},?\s+{_YEAR}{_AT}\s*$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"{_FRONT}(\d{{1,2}})/(\d{{1,2}})/{_YEAR}{_AT}\s*$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^\s*{_YEAR}-(\d{{2}})-(\d{{2}})(?:[T ](\d{{2}}):(\d{{2}})(?::(\d{{2}}))?)?\s*$", "$1|$2|$3||||$4|$5|$6"),
    (rf"{_FRONT}{_NAMED}\s+{_DAY}{_AT}\s*$", "|$1|$2|$3|$4|$5|$6|$7|$8"),
)
#: Months by name where a form names them.
_MONTHS = _MON[3:-1].split("|")


def _by_form(text: Column, anchor: Column) -> Column:
    """The date and time of a text in the first of FORMS that fits, an empty text for a year up to 2020; null where a parser has to look."""
    t = F.coalesce(text, F.lit(""))
    parts = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, order in FORMS:
        parts = parts.when(t.rlike("(?i)" + pattern), F.regexp_replace(t, "(?i)" + pattern, order))

    def whole(p: Column) -> Column:
        number = lambda n: p[n].try_cast("int")
        named = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.initcap(p[1])).cast("int")
        noon = F.when(F.lower(p[5]) == "pm", 12).otherwise(0)
        hour = F.when(p[5] != "", F.when(number(3).between(1, 12), number(3) % 12 + noon)).otherwise(F.coalesce(number(6), F.lit(0)))
        year = F.when(p[0] == "", F.substring(anchor, 1, 4).try_cast("int")).otherwise(number(0))
        # What is no day or hour is left to the parser.
        at = F.try_make_timestamp_ntz(year, F.when(named > 0, named).otherwise(number(1)), number(2), hour, F.coalesce(number(4), number(7), F.lit(0)), F.coalesce(number(8), F.lit(0)))
        return F.when(year > 2020, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(at.isNotNull(), F.lit(""))

    found = F.get(F.transform(F.array(F.split(parts, r"\|", -1)), whole), F.lit(0))  # the parts are found once
    return F.when(t == "", F.lit("")).otherwise(found)


@F.pandas_udf(StringType())
def _read(text: pd.Series, anchor: pd.Series) -> pd.Series:
    from dateutil import parser

    held: dict = {}

    def read(t: str | None, a: str | None) -> str:
        if not t:
            return ""
        if (t, a) not in held:
            base = datetime.datetime.fromisoformat(a) if a else datetime.datetime(1900, 1, 1)
            try:
                found = parser.parse(t, fuzzy=True, default=base)
                held[t, a] = found.strftime("%Y-%m-%d %H:%M:%S") if found.year > 2020 else ""
            except (ValueError, OverflowError, TypeError):
                held[t, a] = ""
        return held[t, a]

    return pd.Series([read(t, a) for t, a in zip(text, anchor.where(anchor.notna(), None), strict=True)], dtype=object)


def parse_loose_date(text: Column, anchor: Column | None = None) -> Column:
    """The date and time of a text, what it doesn't say being filled from anchor (an ISO date).

    Without an anchor a text must carry its own year; years up to 2020 and texts without a date give an empty text. This
    reads every row in Python; ``loose_dates`` only what no form fits."""
    ready()
    return _read(text, F.lit(None).cast("string") if anchor is None else anchor)


def loose_dates(df: DataFrame, text: str, anchor: str | None = None, name: str = "found") -> DataFrame:
    """df with name, the reading of column text as by parse_loose_date: by forms in order, and of what fits none each
    distinct text (and anchor) once by the parser. df needs no column named _text, _anchor or _residue."""
    base = F.lit(None).cast("string") if anchor is None else F.col(anchor)
    rows = df.withColumn(name, _by_form(F.col(text), base))
    rest = df.select(F.col(text).alias("_text"), base.alias("_anchor")).where(_by_form(F.col("_text"), F.col("_anchor")).isNull()).distinct()
    read = rest.withColumn("_residue", parse_loose_date(F.col("_text"), F.col("_anchor")))
    keyed = rows.withColumn("_anchor_key", base)
    same = F.col(name).isNull() & (F.col(text) == F.col("_text")) & F.col("_anchor_key").eqNullSafe(F.col("_anchor"))
    return keyed.join(read, same, "left").withColumn(name, F.coalesce(name, "_residue")).select(rows.columns)
