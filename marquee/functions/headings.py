"""Headings of a page and the links that belong to them: a fold over the page's tags with a stack of open elements.

A frame is an open element: its first link so far, its last three finished children, and headings among its children that still
wait for a link. When an element ends it becomes a child of the one around it; a heading without a link of its own takes
that of the nearest of three siblings before it, else after it, but not past another heading. An end tag closes what is
still open inside its element; one without a start is ignored."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from marquee.functions.dates import MONTH_YEAR
from marquee.tables import ready

# Elements that have no end tag, headings, and parts of a page that hold no content of its own.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADS, CHROME = ("h1", "h2", "h3", "h4"), ("nav", "footer", "header")
#: Siblings to either side that may hold a heading's link.
HOPS = 3

_FOUND = ArrayType(StructType([StructField("at", IntegerType()), StructField("title", StringType()), StructField("href", StringType()), StructField("orphan", BooleanType())]))
_UNSEEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S | re.A)
#: A tag, whether it is an end tag, its name, and what text follows it.
_TAG = re.compile(r"""(<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:[^>"']|"[^"]*"|'[^']*')*>)([^<]*)""", re.A)
_HREF = re.compile(r"""\shref\s*=\s*["']([^"']+)["']""", re.I | re.A)
_BLANKS, _MONTH = re.compile(r"\s+", re.A), re.compile(rf"{MONTH_YEAR}[\x85\u2028\u2029]?\Z", re.I | re.A)


class _Frame:
    """An open element."""

    __slots__ = ("at", "chrome", "href", "inside", "name", "recent", "text", "waits")

    def __init__(self, name: str, at: int, href: str | None, chrome: bool, inside: bool) -> None:
        self.name, self.at, self.href, self.chrome, self.inside = name, at, href, chrome, inside
        self.text, self.recent, self.waits = [], [], []


def _end(stack: list[_Frame], found: list[tuple]) -> None:
    """Ends the last element of the stack."""
    top, outer = stack.pop(), stack[-1]
    head, own = top.name in HEADS, top.href
    if head:
        title = _BLANKS.sub(" ", " ".join(top.text)).strip(" ")
        counts = not top.chrome and not _MONTH.match(title)
        heading, before = next((c for c in reversed(outer.recent) if c[0] or c[1] is not None), (False, None))
        link = own if own is not None or heading else before
        if counts and link is not None:
            found.append((top.at, title, link, own is None))
        outer.waits = [(top.at, title, HOPS)] if counts and link is None else []
    elif own is not None:
        found += [(at, title, own, True) for at, title, _ in outer.waits]
        outer.waits = []
    else:
        outer.waits = [(at, title, left - 1) for at, title, left in outer.waits if left > 1]
    outer.recent = [*outer.recent[1 - HOPS :], (head, own)]
    if outer.href is None:
        outer.href = own
    if outer.inside:
        outer.text += top.text


def _fold(html: str) -> list[tuple]:
    stack, found = [_Frame("", -1, None, False, False)], []
    for at, (tag, close, name, text) in enumerate(_TAG.findall(_UNSEEN.sub(" ", html))):
        name = name.lower()
        if close:
            # The innermost open one; the page itself has no tag's name.
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            for _ in range(len(stack) - k if k else 0):
                _end(stack, found)
        else:
            outer, href = stack[-1], _HREF.search(tag) if name == "a" else None
            stack.append(_Frame(name, at, href and href[1], outer.chrome or name in CHROME, outer.inside or name in HEADS))
            if name in VOID:
                _end(stack, found)
        if stack[-1].inside:
            stack[-1].text.append(text)
    while len(stack) > 1:
        _end(stack, found)
    return sorted(found)


@F.pandas_udf(_FOUND)
def _headings(html: pd.Series) -> pd.Series:
    names = _FOUND.elementType.names
    return html.map(lambda page: [dict(zip(names, h, strict=True)) for h in _fold(page or "")])


def headings(html: Column) -> Column:
    """An array of (at, title, href, orphan): headings with a link of their own or (orphan) that of a sibling, but for months and
    those of navigation, headers and footers. at: the heading's place among the page's tags, by which it is sorted."""
    ready()
    return _headings(html)


def event_headings(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(page_id, at, title, href, orphan): the headings of pages (page_id, html) that lead to events: of three headings with a link or
    more those of the most frequent first path segment (of equally frequent ones the first), if three and half of them have
    it; else the orphans, if they are three or more, for sites whose links share no segment."""
    rows = pages.select("page_id", headings(F.col("html")).alias("found")).select("page_id", F.explode("found").alias("h")).select("page_id", "h.*")
    path = F.regexp_replace("href", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?", "")
    rows = rows.withColumn("segment", F.regexp_extract(path, r"^/*([^/?#]+)", 1))
    each = rows.groupBy("page_id", "segment").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.count_if("orphan").alias("orphans"))
    top = F.max(F.when(F.col("segment") != "", F.struct("n", (-F.col("first")).alias("early"), "segment")))
    of = each.groupBy("page_id").agg(F.sum("n").alias("n"), F.sum("orphans").alias("orphans"), top.alias("top")).where(F.col("n") >= least)
    won = F.coalesce((F.col("top.n") >= F.greatest(F.lit(float(least)), F.col("n") * share)), F.lit(False))
    told = of.select("page_id", F.when(won, F.col("top.segment")).alias("won"), (~won & (F.col("orphans") >= least)).alias("loose")).where("won IS NOT NULL OR loose")
    return rows.join(told, "page_id").where((F.col("segment") == F.col("won")) | (F.col("loose") & F.col("orphan"))).select("page_id", "at", "title", "href", "orphan")
