"""Landed feeds as listings: calendar texts, JSON-LD in pages, and listings in JSON of varying names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.times import SHAPE, known_zone, normalize_datetime


def _get(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a text that isn't empty."""
    tries = [F.try_variant_get(v, p, "string") for p in paths]
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in tries])


def _items(v: Column, *paths: str) -> Column:
    """The first of the paths that holds an array, as an array of variants; null for none."""
    return F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths])


def parse_ical(files: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    """An event a VEVENT of files (source_name, body): title, start and end as local times, description, venue, url.

    Folded lines are joined; days count as midnight; UTC times and those of a named zone are turned into the
    feed's zone; times without one stay. Events without a summary or a start go."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n"), "\n[ \t]", "")
    parts = F.slice(F.split(body, "BEGIN:VEVENT"), 2, 1 << 30)
    events = files.select("source_name", F.explode(parts).alias("e"))

    def value(name: str) -> Column:
        raw = F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)
        return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\\[nN]", "\n"), r"\\([,;\\])", "$1"))

    def time(name: str) -> Column:
        raw = F.regexp_replace(value(name), "^(\\d{4})(\\d{2})(\\d{2})$", "$1$2$3T000000")
        there = known_zone(F.regexp_extract("e", rf"(?m)^{name};[^:\n]*TZID=\"?([^:;\"\n]+)", 1))
        t = F.when(raw.rlike(r"^\d{8}T\d{6}Z?$"), F.try_to_timestamp(F.substring(raw, 1, 15), F.lit("yyyyMMdd'T'HHmmss")))
        named = F.col("e").rlike(rf"(?m)^{name};[^:\n]*TZID=")
        local = F.when(F.endswith(raw, F.lit("Z")), F.from_utc_timestamp(t, zone)).when(named, F.from_utc_timestamp(F.to_utc_timestamp(t, there), zone)).otherwise(t)
        return F.coalesce(F.date_format(local, SHAPE), F.lit(""))

    start, end = time("DTSTART"), time("DTEND")
    out = events.select("source_name", value("SUMMARY").alias("title"), start.alias("start_date"), F.when(end == "", start).otherwise(end).alias("end_date"), value("DESCRIPTION").alias("description"), value("LOCATION").alias("venue_name"), value("URL").alias("ticket_url"))
    return out.where((F.col("title") != "") & (F.col("start_date") != ""))


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """An event a JSON-LD object whose type ends in Event, in pages (page_id, html): alone, in a list, a graph or among sub-events.

    Damaged JSON gives no event; events without a name or a start go."""
    blocks = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1))
    parsed = pages.select("page_id", F.explode(blocks).alias("b")).select("page_id", F.try_parse_json("b").alias("v")).where("v IS NOT NULL")
    inner = lambda df, *paths: df.select("page_id", F.explode(F.coalesce(_items(F.col("v"), *paths), F.array("v"))).alias("v"))
    tops = inner(inner(parsed, "$"), "$['@graph']")
    each = tops.unionByName(tops.select("page_id", F.explode(_items(F.col("v"), "$.subEvent")).alias("v")))
    v = F.col("v")
    kind = F.coalesce(F.try_variant_get(v, "$['@type']", "string"), F.lit(""))
    start = normalize_datetime(_get(v, "$.startDate"))
    end = normalize_datetime(_get(v, "$.endDate"))
    out = each.where(kind.rlike(r"Event\"?\]?$")).select(
        "page_id", F.trim(_get(v, "$.name")).alias("title"), start.alias("start_date"), F.when(end == "", start).otherwise(end).alias("end_date"),
        F.coalesce(_get(v, "$.description"), F.lit("")).alias("description"),
        F.coalesce(_get(v, "$.location.name", "$.location[0].name"), F.lit("")).alias("venue_name"),
        F.coalesce(_get(v, "$.image.url", "$.image[0].url", "$.image[0]"), F.when(F.schema_of_variant(v).isNotNull(), _get(v, "$.image")), F.lit("")).alias("image_url"),
        F.coalesce(_get(v, "$.offers.url", "$.offers[0].url", "$.url"), F.lit("")).alias("ticket_url"),
    )
    return out.where((F.col("title") != "") & (F.col("start_date") != ""))


def normalize_json_api(raw: DataFrame) -> DataFrame:
    """A listing an item of raw (source_name, body): the items lie at the top, or under events, items, data or results.

    Fields go by several names, the first that is filled counts; items without a title go."""
    parsed = raw.select("source_name", F.try_parse_json("body").alias("v"))
    items = parsed.select("source_name", F.explode(_items(F.col("v"), "$", "$.events", "$.items", "$.data", "$.results")).alias("v"))
    v = F.col("v")
    filled = lambda *paths: F.coalesce(_get(v, *paths), F.lit(""))
    start = normalize_datetime(_get(v, "$.start_date", "$.startDate", "$.date", "$.start"))
    end = normalize_datetime(_get(v, "$.end_date", "$.endDate", "$.end"))
    return items.select(
        "source_name", F.trim(filled("$.title", "$.name", "$.event_name")).alias("title"), filled("$.description", "$.summary").alias("description"),
        filled("$.venue.name", "$.location.name", "$.venue", "$.venue_name", "$.location").alias("venue_name"),
        filled("$.image.url", "$.thumbnail.url", "$.image", "$.image_url", "$.thumbnail").alias("image_url"),
        start.alias("start_date"), F.when(end == "", start).otherwise(end).alias("end_date"),
        filled("$.url", "$.ticket_url", "$.link").alias("ticket_url"), filled("$.cost", "$.price").alias("cost"), filled("$.id").alias("external_id"),
    ).where("title <> ''")
