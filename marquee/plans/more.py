"""Registered queries of feeds, pages, dates, reports and folds, and their DuckDB equivalents.

Feeds and pages are made of the given tables' rows, a document a row, so that they grow with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import dates, display, headings, html, pages, urls
from marquee.functions import text as T
from marquee.operators import fold, match, reports, upkeep
from marquee.plans.registry import _FP, _TITLES, register
from marquee.sources import bindings as B
from marquee.sources import feeds, store, ticketing
from marquee.streaming import ingest
from marquee.tables import new_path, written



def _n() -> Column:
    return F.col("post_id")


_UTC, _LOCAL = "CAST(start_utc AS TIMESTAMP)", "CAST(start_utc AS TIMESTAMP) - INTERVAL 6 HOUR"
_FORM = "'%Y-%m-%d %H:%M:%S'"
_TITLED = "trim(post_title) <> ''"


def _s(x: Column) -> Column:
    return x.cast("string")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with iso and local start; blank titles left out, as feeds drop them."""
    start = F.to_timestamp("start_utc")
    there = F.from_utc_timestamp(start, "America/Chicago")
    rows = B.listings(spark, sf_dir).withColumns({"iso": F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "local_date": F.date_format(there, "yyyy-MM-dd"), "local_time": F.date_format(there, "HH:mm:ss"), "name": F.trim("post_title")})
    return rows.where("name <> ''")


def _body(rows: DataFrame, **fields: Column) -> DataFrame:
    return rows.select("city_slug", "source_name", _n(), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("body"))


# --- feeds ---------------------------------------------------------------------------------------


@register(f"""WITH {B.LISTINGS} SELECT 'tm_' || post_id AS external_id, trim(post_title) AS title, start_utc, strftime({_LOCAL}, {_FORM}) AS start_local, CASE WHEN post_id % 3 = 0 THEN start_utc ELSE strftime({_UTC} + INTERVAL 3 HOUR, {_FORM}) END AS end_utc,
  CASE WHEN post_id % 2 = 0 THEN 'America/Denver' ELSE 'America/Chicago' END AS timezone, 'https://i.example.com/c.jpg' AS image_url, 'https://t.example.com/' || post_id || CASE WHEN post_id % 2 = 0 THEN '?a=1&' ELSE '?' END || 'aaid=77' AS ticket_url,
  CASE post_id % 4 WHEN 0 THEN '$2–$20' WHEN 1 THEN '$12' ELSE '' END AS cost, 'Music,Jazz' AS categories, post_id % 5 <> 0 AS needs_enrichment FROM listings WHERE {_TITLED}""")
def s4_ticketing_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, text = F.lit(None).cast("string"), F.lit
    time = lambda iso, day, at: F.struct(iso.alias("dateTime"), day.alias("localDate"), at.alias("localTime"))
    even = _n() % 2 == 0
    start = F.when(even, time(F.col("iso"), none, none)).otherwise(time(none, F.col("local_date"), F.col("local_time")))
    late = F.date_format(F.to_timestamp("start_utc") + F.expr("interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    image = lambda ratio, width, name: F.struct(text(ratio).alias("ratio"), text(width).alias("width"), text(f"https://i.example.com/{name}.jpg").alias("url"))
    price = lambda low, high: F.struct(text(low).alias("min"), text(high).alias("max"))
    named = lambda n: F.struct(text(n).alias("name"))
    raw = _body(
        _listings(spark, sf_dir), id=_s(_n()), name=F.col("name"), url=F.concat(text("https://t.example.com/"), _s(_n()), F.when(even, "?a=1").otherwise("")), info=F.when(_n() % 5 == 0, "some text"),
        dates=F.struct(F.when(even, "America/Denver").alias("timezone"), start.alias("start"), F.when(_n() % 3 != 0, time(late, none, none)).alias("end")),
        images=F.array(image("4_3", 900, "a"), image("16_9", 600, "b"), image("16_9", 700, "c")),
        priceRanges=F.when(_n() % 4 == 0, F.array(price(2.5, 20.0))).when(_n() % 4 == 1, F.array(price(None, None).cast("struct<min: double, max: double>"), price(12.0, 12.0))),
        classifications=F.array(F.struct(named("Music").alias("segment"), named("Undefined").alias("genre"), named("Jazz").alias("subGenre")), F.struct(named("Jazz").alias("segment"), named("Music").alias("genre"), named("").alias("subGenre"))),
    )
    out = ticketing.normalize_ticketing(raw, "77").withColumn("categories", F.array_join("categories", ","))
    return out.select("external_id", "title", "start_utc", "start_local", "end_utc", "timezone", "image_url", "ticket_url", "cost", "categories", "needs_enrichment")


@register(f"""WITH {B.LISTINGS} SELECT 'eventim_' || post_id AS external_id, trim(post_title) AS title, start_utc, start_utc AS end_utc, strftime({_UTC} - to_hours(CASE WHEN post_id % 2 = 0 THEN 7 ELSE 6 END), {_FORM}) AS start_local,
  CASE WHEN post_id % 2 = 0 THEN 'America/Denver' ELSE 'America/Chicago' END AS timezone, city_slug || '-city' AS city_slug, CASE post_id % 3 WHEN 0 THEN '$5-$9' WHEN 1 THEN '$5' ELSE '' END AS cost,
  CASE WHEN post_id % 4 = 0 THEN 'w' ELSE 'r' END AS ticket_url, post_id % 7 <> 0 AS needs_enrichment FROM listings WHERE {_TITLED} AND city_slug IN ('en', 'de')""")
def s5_affiliate_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, text = _listings(spark, sf_dir), F.lit
    offset = F.date_format(F.to_timestamp("start_utc"), "yyyy-MM-dd'T'HH:mm:ss'+0000'")
    raw = _body(
        rows, id=_s(_n()), title=F.concat(text(" "), "name"), description=F.when(_n() % 7 == 0, "a text"), timeZone=F.when(_n() % 2 == 0, "America/Denver").otherwise("No/Where"), eventDate=F.when(_n() % 3 == 0, F.replace("iso", text("Z"), text(".000Z"))),
        startDate=offset, minTicketPrice=F.when(_n() % 3 < 2, "5"), maxTicketPrice=F.when(_n() % 3 == 0, "9").otherwise("5"), whiteLabelUrl=F.when(_n() % 4 == 0, "w"), regularEventUrl=text("r"),
        venue=F.struct(F.concat(text(" "), F.upper("city_slug")).alias("city"), text("tn").alias("state")),
    )
    filters = rows.where("city_slug IN ('en', 'de')").select(F.col("city_slug").alias("city"), text("TN").alias("state"), F.concat("city_slug", text("-city")).alias("city_slug")).distinct()
    return ticketing.normalize_affiliate(raw.select("body"), filters).select("external_id", "title", "start_utc", "end_utc", "start_local", "timezone", "city_slug", "cost", "ticket_url", "needs_enrichment")


@register(f"""WITH {B.LISTINGS} SELECT CAST(post_id AS VARCHAR) AS external_id, trim(post_title) AS title, CASE WHEN post_id % 2 = 0 THEN strftime({_UTC}, '%Y-%m-%dT%H:%M:%S') ELSE start_utc END AS start, post_id % 4 = 0 AS all_day,
  CASE WHEN post_id % 5 = 0 THEN 'https://v.example.com/more' ELSE 'https://v.example.com' END AS event_url FROM listings WHERE {_TITLED}""")
def s6_calendar_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(_n() % 2 == 0, _s(F.unix_timestamp(F.to_timestamp("start_utc")))).otherwise(F.col("start_utc"))
    fields = {"event-id": _n(), "name": F.concat(F.lit(" "), "name", F.lit(" ")), "start": start, "all_day_event": F.when(_n() % 4 == 0, True).when(_n() % 4 == 1, False), "learnmore_link": F.when(_n() % 5 == 0, "https://v.example.com/more").otherwise("")}
    one = _body(_listings(spark, sf_dir), **fields)
    shape = lambda front, back: F.concat(F.lit(front), "body", F.lit(back))
    files = one.select(F.lit("https://v.example.com").alias("base_url"), F.when(_n() % 3 == 0, shape("[", "]")).when(_n() % 3 == 1, shape('{"events": [', "]}")).otherwise(shape('{"note": 1, "2026-07-12": [', "]}")).alias("body"))
    return ticketing.flatten_calendar_json(files).select("external_id", "title", "start", "all_day", "event_url")


@register(f"""WITH {B.LISTINGS} SELECT 'tec_' || post_id AS external_id, 'A & ' || post_id AS title, start_utc AS start_date, start_utc AS end_date, CASE WHEN post_id % 2 = 0 THEN 'Hall' ELSE '' END AS venue_name, CASE WHEN post_id % 3 = 0 THEN 'i.png' ELSE '' END AS image_url
  FROM listings WHERE {_TITLED} AND substr(start_utc, 1, 10) <= '2026-01-20'""")
def s7_calendar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("<b>A &amp; "), _s(_n()), F.lit("</b> | Tickets"))
    plain = _body(_listings(spark, sf_dir), id=_n(), title=title, start_date=F.col("iso"), venue=F.when(_n() % 2 == 0, F.struct(F.lit("Hall").alias("venue"))), image=F.when(_n() % 3 == 0, F.struct(F.lit("i.png").alias("url"))))
    nested = _body(_listings(spark, sf_dir), id=_n(), title=F.struct(title.alias("rendered")), start_date=F.col("start_utc"), venue=F.when(_n() % 2 == 0, F.struct(F.lit("Hall").alias("venue"))), image=F.when(_n() % 3 == 0, F.struct(F.lit("i.png").alias("url"))))
    raw = plain.where(_n() % 2 == 0).union(nested.where(_n() % 2 == 1)).withColumn("body", F.concat(F.lit('{"total_pages": 1, "events": ['), "body", F.lit("]}")))
    return ticketing.normalize_calendar_pages(raw, "2026-01-15 00:00:00", 5).select("external_id", "title", "start_date", "end_date", "venue_name", "image_url")


@register(f"""WITH {B.LISTINGS} SELECT CAST(post_id AS VARCHAR) AS external_id, trim(post_title) AS title, start_utc AS start_date, CASE WHEN post_id % 2 = 0 THEN 'Hall' ELSE '' END AS venue_name, CASE WHEN post_id % 3 = 0 THEN '5' ELSE '' END AS cost FROM listings WHERE {_TITLED}""")
def s8_json_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listings(spark, sf_dir)
    one = _body(rows, id=_n(), title=F.col("name"), startDate=F.col("iso"), venue=F.when(_n() % 2 == 0, F.struct(F.lit("Hall").alias("name"))), price=F.when(_n() % 3 == 0, "5"))
    two = _body(rows, id=_n(), event_name=F.col("name"), start=F.col("start_utc"), location=F.when(_n() % 2 == 0, "Hall"), cost=F.when(_n() % 3 == 0, 5))
    shape = lambda df, front, back: df.withColumn("body", F.concat(F.lit(front), "body", F.lit(back)))
    raw = shape(one.where(_n() % 3 < 2), '{"results": [', "]}").union(shape(two.where(_n() % 3 == 2), "[", "]"))
    return feeds.normalize_json_api(raw).select("external_id", "title", "start_date", "venue_name", "cost")


@register(f"""WITH {B.LISTINGS} SELECT CAST(post_id AS VARCHAR) AS external_id, trim(post_title) AS title, start_utc AS start_date, CASE WHEN post_id % 2 = 0 THEN 'large' ELSE '' END AS image_url, CASE WHEN post_id % 3 = 0 THEN 'u' ELSE 'e' END AS ticket_url,
  CASE WHEN post_id % 5 = 1 THEN 'https://widgets.example.com/json/events/' || post_id || '/events.json' END AS feed FROM listings WHERE {_TITLED} AND post_id % 4 <> 0""")
def s9_widget_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit
    size = lambda name, w, h: F.struct(text(name).alias("file_name"), text(w).alias("width"), text(h).alias("height"))
    media = F.when(_n() % 2 == 0, F.create_map(text("a"), size("small", 10, 10), text("b"), size("large", 20, 30), text("c"), size("wide", 60, 5)))
    ticket = F.struct(F.when(_n() % 3 == 0, "u").otherwise("").alias("url"), text("e").alias("eventUrl"))
    raw = _body(_listings(spark, sf_dir), active=F.when(_n() % 4 == 0, False).when(_n() % 4 == 1, True), eventId=_s(_n()), eventDateTime=F.regexp_replace("iso", "Z$", ""), title=F.struct(F.col("name").alias("eventTitleText")), media=media, ticketing=ticket)
    out = ticketing.normalize_widget(raw.withColumn("body", F.concat(text('{"events": ['), "body", text("]}"))))
    page = F.when(F.col("external_id").cast("long") % 5 == 1, F.concat(text("<script src='//widgets.example.com/json/events/"), "external_id", text("/events.json'>"))).otherwise("<p>")
    return out.select("external_id", "title", "start_date", "image_url", "ticket_url", ticketing.widget_feed_url(page).alias("feed"))


@register(f"""WITH {B.LISTINGS} SELECT 'Event ' || post_id AS title, CASE post_id % 3 WHEN 0 THEN strftime({_LOCAL}, '%Y-%m-%d 00:00:00') ELSE strftime({_LOCAL}, {_FORM}) END AS start_date, CASE WHEN post_id % 2 = 0 THEN 'Hall, one' ELSE '' END AS venue_name FROM listings WHERE {_TITLED}""")
def s10_calendar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_timestamp("start_utc")
    there = F.from_utc_timestamp(start, "America/Chicago")
    form = "yyyyMMdd'T'HHmmss"
    when = F.when(_n() % 3 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(there, "yyyyMMdd"))).when(_n() % 3 == 1, F.concat(F.lit("DTSTART:"), F.date_format(start, form), F.lit("Z"))).otherwise(F.concat(F.lit("DTSTART;TZID=America/Denver:"), F.date_format(F.from_utc_timestamp(start, "America/Denver"), form)))
    body = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:Eve\r\n nt "), _s(_n())), when, F.when(_n() % 2 == 0, "LOCATION:Hall\\, one"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    return feeds.parse_ical(_listings(spark, sf_dir).select("source_name", body.alias("body"))).select("title", "start_date", "venue_name")


@register(f"""WITH {B.LISTINGS} SELECT post_id AS page_id, trim(post_title) AS title, start_utc AS start_date, CASE WHEN post_id % 2 = 0 THEN 'Hall' ELSE '' END AS venue_name FROM listings WHERE {_TITLED}""")
def s11_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(_n() % 2 == 0, "MusicEvent").otherwise("Event")
    one = F.to_json(F.struct(kind.alias("@type"), F.col("name").alias("name"), F.col("iso").alias("startDate"), F.when(_n() % 2 == 0, F.struct(F.lit("Hall").alias("name"))).alias("location")))
    one = F.replace(one, F.lit("</"), F.lit("<\\/"))
    shape = lambda front, back: F.concat(F.lit(front), one, F.lit(back))
    block = F.when(_n() % 3 == 0, one).when(_n() % 3 == 1, shape('[{"@type": "Place", "name": "x"},', "]")).otherwise(shape('{"@graph": [', "]}"))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), block, F.lit("</script><p>text</p></html>"))
    return feeds.extract_jsonld(_listings(spark, sf_dir).select(_n().alias("page_id"), page.alias("html"))).select("page_id", "title", "start_date", "venue_name")


@register("SELECT s_name AS name, lower(s_name) AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'd' ELSE '' END AS dma_id, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS lat, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 50 ELSE 35 END AS INTEGER) AS radius_miles FROM supplier WHERE s_suppkey % 5 <> 0")
def s2_load_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    rows = B.read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.lower("s_name").alias("slug"), F.when(n % 2 == 0, "d").alias("tm_dma_id"), F.when(n % 3 == 0, 1.5).alias("lat"), F.lit(None).cast("double").alias("lng"),
        F.when(n % 4 == 0, 50).when(n % 4 == 1, 0).alias("radius_miles"), F.when(n % 5 == 0, "closed").otherwise("active").alias("status"),
    )
    return store.load_cities(rows, rows).select("name", "slug", "dma_id", "lat", "radius_miles")


@register("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'own name' WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'https://s.example.com/' || s_suppkey END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'ical' ELSE 'html_auto' END AS source_type,
  s_nationkey AS city_slug, CAST((s_suppkey % 7 = 0)::INT AS INTEGER) AS n_notes FROM supplier WHERE s_suppkey % 11 <> 0""")
def s3_load_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    rows = B.read(spark, sf_dir, "supplier").select(
        n.alias("id"), F.concat(F.lit("https://s.example.com/"), _s(n)).alias("url"), F.when(n % 2 == 0, F.col("s_name")).otherwise("").alias("name"), F.when(n % 3 == 0, " ical").when(n % 3 == 1, "squarespace").alias("source_type"),
        F.col("s_nationkey").alias("city_slug"), F.when(n % 7 == 0, '{"name": "own name"}').when(n % 7 == 1, "{broken").alias("notes"), F.when(n % 11 == 0, "rejected").otherwise("active").alias("status"),
    )
    return store.load_sources(rows).select("id", "name", "source_type", "city_slug", F.size("notes").alias("n_notes"))


# --- filters and matches -------------------------------------------------------------------------


@register(f"WITH {B.LISTINGS} SELECT post_id, 'https://box.example.net/e/' || post_id AS link FROM listings WHERE post_id % 5 = 3 AND thumb_id IS NOT NULL")
def p9_ticket_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.ticket_host_candidates(B.listings(spark, sf_dir), "w.example.org", "box.example.net").select("post_id", "link")


@register()
def j8_match_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir).withColumn("day", F.substring("start_utc", 1, 10)).withColumnRenamed("post_title", "title")
    # A venue is a room for titles of one beginning.
    venue = F.concat(F.lit("room "), F.substring("title", 1, 3))
    weak = rows.where(_n() % 2 == 0).select("post_id", "title", "day", venue.alias("venue_name"), "city_slug")
    return match.match_listings(weak, rows.where(_n() % 2 == 1).select(_n().alias("listing_id"), "title", "day", venue.alias("venue_name"), "city_slug"))


# --- text, dates, pages --------------------------------------------------------------------------


_TYPED = "[‘’“”–—…\u00a0]"


@register(f"WITH {B.POSTS} SELECT post_id, post_title || ' it''s - \"so\"...' AS title FROM posts WHERE NOT regexp_matches(post_title, '{_TYPED}')")
def f3_clean_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.posts(spark, sf_dir).where(~F.col("post_title").rlike(_TYPED))
    return rows.select("post_id", T.clean_unicode(F.concat("post_title", F.lit(" it’s – “so”…"))).alias("title"))


@register(f"WITH {B.POSTS} SELECT post_id, 'Show ' || post_id AS title FROM posts")
def f5_strip_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(_n() % 3 == 0, " Thu, Jun 18").when(_n() % 3 == 1, " Jul 4").otherwise("")
    return B.posts(spark, sf_dir).select("post_id", dates.strip_trailing_date(F.concat(F.lit("Show "), _s(_n()), tail)).alias("title"))


@register(f"""WITH {B.LISTINGS}, {_TITLES} SELECT post_id, length(norm) >= 8 AND post_id % 3 <> 2 AS prefix, CASE WHEN length(norm) = 0 THEN CASE post_id % 3 WHEN 2 THEN 0.0 ELSE 0.0 END ELSE 2.0 * length(norm) / (2 * length(norm) + CASE post_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 5 ELSE 4 END) END AS bound,
  length(norm) > 0 AND len(list_distinct([w FOR w IN regexp_extract_all(norm, '[a-z0-9]+') IF length(w) > 1 AND w NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)})])) >= 3 AND post_id % 3 <> 2 AS contained FROM titles""")
def f7_f9_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = T.normalize_title(F.col("post_title"))
    longer = F.concat(norm, F.when(_n() % 3 == 0, F.lit(" w/ xy")).when(_n() % 3 == 1, F.lit(": xyz")).otherwise(F.lit("zzzz")))
    rows = B.listings(spark, sf_dir).select("post_id", norm.alias("a"), longer.alias("b"))
    # Letters glued to a title change its last token.
    contained = T.contains_tokens(T.tokens(F.col("a")), T.tokens(F.col("b"))) & (_n() % 3 != 2)
    return rows.select("post_id", T.is_headliner_prefix(F.col("a"), F.col("b")).alias("prefix"), T.ratio_bound(F.col("a"), F.col("b")).alias("bound"), contained.alias("contained"))


@register(f"""WITH {B.LISTINGS} SELECT post_id, CASE post_id % 5 WHEN 0 THEN strftime(t, '%Y-%m-%d 19:30:00') WHEN 1 THEN strftime(t, '%Y-%m-%d 00:00:00') WHEN 2 THEN strftime(t, '2027-%m-%d 20:00:00') WHEN 3 THEN strftime(t, '%Y-%m-%d 00:00:00') ELSE '' END AS found FROM (SELECT *, {_UTC} AS t FROM listings)""")
def f13_loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.to_timestamp("start_utc")
    said = F.when(_n() % 5 == 0, F.concat(F.lit("on "), F.date_format(t, "MMMM d yyyy"), F.lit(" 7:30 PM"))).when(_n() % 5 == 1, F.date_format(t, "M/d/yyyy")).when(_n() % 5 == 2, F.concat(F.date_format(t, "MMM d"), F.lit(" 8 pm")))
    said = said.when(_n() % 5 == 3, F.date_format(t, "d MMM yyyy")).otherwise(F.lit("doors at seven"))
    anchor = dates.year_anchor(F.when(_n() % 5 == 2, said), "2026-05-01")
    rows = B.listings(spark, sf_dir).select("post_id", said.alias("said"), anchor.alias("anchor"))
    return dates.loose_dates(rows, "said", "anchor").select("post_id", "found")


@register(f"""WITH {B.LISTINGS}, d AS (SELECT post_id, {_UTC} AS t FROM listings) SELECT post_id, CASE post_id % 4 WHEN 0 THEN strftime(t, '%B %-d, %Y') WHEN 1 THEN strftime(t, '%B %-d, %Y') WHEN 2 THEN strftime(t, 'Thu, %b %-d') || ' 7 pm' ELSE '' END AS said,
  CASE WHEN post_id % 4 = 2 THEN '7 pm' ELSE '' END AS time, CASE post_id % 4 WHEN 1 THEN '$5 to $10' WHEN 2 THEN '$12.50' ELSE '' END AS price, CASE WHEN post_id % 4 = 3 THEN strftime(t, '%B %Y') ELSE '' END AS month FROM d""")
def f16_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.to_timestamp("start_utc")
    text = (
        F.when(_n() % 4 == 0, F.concat(F.lit("Runs "), F.date_format(t, "MMMM d"), F.lit(" - March 9, "), F.date_format(t, "yyyy"), F.lit(" daily")))
        .when(_n() % 4 == 1, F.concat(F.lit("On "), F.date_format(t, "MMMM d, yyyy"), F.lit(" for $5 to $10"))).when(_n() % 4 == 2, F.concat(F.lit("Thu, "), F.date_format(t, "MMM d"), F.lit(" Doors: 6 pm Show: 7 pm $12.50")))
        .otherwise(F.concat(F.date_format(t, "MMMM yyyy"), F.lit(" at the hall")))
    )
    rows = B.listings(spark, sf_dir).select("post_id", text.alias("x"))
    x = F.col("x")
    return rows.select("post_id", dates.date_text(x).alias("said"), dates.start_time(x).alias("time"), dates.price_text(x).alias("price"), F.when(_n() % 4 == 3, dates.month_year(x)).otherwise("").alias("month"))


@register(f"WITH {B.POSTS} SELECT post_id, CASE post_id % 4 WHEN 0 THEN '$2' WHEN 1 THEN '$4–$10' WHEN 2 THEN '' ELSE '$7' END AS price, 'Music,Jazz' AS names, 'b' AS best FROM posts")
def f23_f24_t4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(_n() % 4 == 0, 2.5).when(_n() % 4 == 1, 3.5).when(_n() % 4 == 3, 7.0)
    high = F.when(_n() % 4 == 1, 10.0).when(_n() % 4 == 3, 7.0)
    named = lambda n: F.struct(F.lit(n).alias("name"))
    classes = F.array(F.struct(named("Music").alias("segment"), named("Undefined").alias("genre"), named("Jazz").alias("subGenre")))
    image = lambda ratio, width, url: F.struct(F.lit(ratio).alias("ratio"), width.cast("int").alias("width"), F.lit(url).alias("url"))
    images = F.array(image("4_3", _n() + 900, "a"), image("16_9", _n() + 1, "b"), image("16_9", _n(), "c"))
    return B.posts(spark, sf_dir).select("post_id", html.format_price(low, high).alias("price"), F.array_join(html.classification_names(classes), ",").alias("names"), html.best_image(images).alias("best"))


@register(f"""WITH {B.LISTINGS} SELECT post_id, CASE WHEN post_id % 3 = 2 THEN '' ELSE 'https://i.example.com/' || post_id || '.png' END AS image, CASE WHEN post_id % 2 = 0 THEN 'https://i.example.com/' || post_id || '.png' ELSE 'https://i.example.com/x.JPG' END AS tag,
  CASE WHEN post_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS extension, CASE WHEN post_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM listings""")
def f26_f30_f35_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.concat(F.lit("https://i.example.com/"), _s(_n()), F.lit(".png"))
    head = F.when(_n() % 3 == 0, F.concat(F.lit('<meta property="og:image" content="'), link, F.lit('">'))).when(_n() % 3 == 1, F.concat(F.lit("<meta content='"), link, F.lit("' name='og:image'/>"))).otherwise("<meta name='x' content='y'>")
    tag = F.when(_n() % 2 == 0, F.concat(F.lit('<img class="a" data-src="'), link, F.lit('?w=9">'))).otherwise("<div style=\"background-image: url('https://i.example.com/x.JPG?v=1')\">")
    found = html.image_from_tag(tag)
    return B.listings(spark, sf_dir).select("post_id", html.meta_content(head, "og:image").alias("image"), found.alias("tag"), urls.image_extension(found).alias("extension"), urls.image_mime(found).alias("mime"))


@register(r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, lower(coalesce(html, '')) AS low FROM pages)
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'mec' WHEN 1 THEN 'eventon' WHEN 2 THEN 'tec_block' END AS engine, CASE page_id % 4 WHEN 0 THEN 'meta' WHEN 3 THEN 'none' ELSE 'fingerprint' END AS confidence,
    CASE page_id % 4 WHEN 2 THEN 'tec_html' WHEN 3 THEN 'jsonld' END AS feed,
    NOT (page_id % 4 = 3 OR contains(low, '.ics') OR regexp_matches(low, '\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}') OR regexp_matches(low, '\b\d{1,2}/\d{1,2}/\d{2,4}\b')) AS bare FROM p
  WHERE NOT regexp_matches(low, 'eventon|evo_calendar|evcal_|webnus|mec-event|mec_skin|mec-calendar|tribe-events|generator|rhp')""")
def f27_f28_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    known = F.lower(F.coalesce("html", F.lit(""))).rlike("eventon|evo_calendar|evcal_|webnus|mec-event|mec_skin|mec-calendar|tribe-events|generator|rhp")
    mark = F.when(n % 4 == 0, '<meta name="generator" content="Webnus 5">').when(n % 4 == 1, "<div class='evo_calendar'>").when(n % 4 == 2, "<div class='tribe-events-view'>").otherwise('<script>{"@type" : "Event"}</script>')
    page = F.concat(mark, F.coalesce("html", F.lit("")))
    rows = B.read(spark, sf_dir, "pages").where(~known).select("page_id", page.alias("h"))
    kind = pages.detect_render_engine(F.col("h"))
    return rows.select("page_id", kind["engine"].alias("engine"), kind["confidence"].alias("confidence"), pages.detect_feed(F.col("h")).alias("feed"), pages.has_no_static_content(F.col("h")).alias("bare"))


@register(f"""WITH {B.LISTINGS} SELECT post_id, post_id % 4 = 0 OR post_id % 4 = 3 AS own FROM listings""")
def f29_venue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(_n() % 4 == 1, "https://www.eventbrite.com/growlers").when(_n() % 4 == 2, F.lit("https://elsewhere.example.org/")).when(_n() % 4 == 3, "https://any.example.org/").otherwise("https://www.growlers.example.org/shows")
    venue = F.when(_n() % 4 == 3, "The Hall").otherwise("Growlers, Music Hall")
    page = F.concat(F.lit("<title>Home</title> Tickets on sale for every concert "), _s(_n()))
    return B.listings(spark, sf_dir).select("post_id", pages.is_venue_page(url, page, venue).alias("own"))


@register(f"""WITH {B.LISTINGS} SELECT post_id, CASE post_id % 3 WHEN 0 THEN 'sports' WHEN 1 THEN 'concert' ELSE 'other' END AS kind, 'Event: ' || CASE post_id % 3 WHEN 0 THEN 'A vs. B ' WHEN 1 THEN 'On Tour ' ELSE 'Walk ' END || post_id || chr(10) || CASE WHEN post_id % 2 = 0 THEN 'Venue: Hall' || chr(10) ELSE '' END
  || 'City: New Place' || chr(10) || 'Date: ' || substr(start_utc, 1, 10) || chr(10) || 'Category: a, b' || chr(10) || CASE post_id % 3 WHEN 0 THEN 'Type: Professional or semi-professional sports match' || chr(10) || 'Note: Use your knowledge of these teams to write an exciting match preview.'
  WHEN 1 THEN 'Type: Live music or entertainment event' || chr(10) || 'Note: Use your knowledge of this artist to write an engaging description.' ELSE 'Note: Write an engaging local events description based on the event details.' END AS context FROM listings""")
def f32_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.when(_n() % 3 == 0, "A vs. B ").when(_n() % 3 == 1, "On Tour ").otherwise("Walk "), _s(_n()))
    categories = F.array(F.lit("a"), F.lit("b"))
    context = display.enrichment_context(title, F.when(_n() % 2 == 0, "Hall"), F.lit("new-place"), F.col("start_utc"), F.lit(""), categories, F.col("source_name"))
    return B.listings(spark, sf_dir).select("post_id", display.event_class(title, F.col("source_name")).alias("kind"), context.alias("context"))


@register(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']+)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']+)["'']', 1), 1) AS pos FROM pages),
  l AS (SELECT page_id, min(pos) AS pos, href FROM a WHERE page_id % 3 <> 0 AND starts_with(href, '/') AND NOT starts_with(href, '//') AND NOT regexp_matches(href, '[?#]') AND href <> '/' AND NOT regexp_matches(href, '/$') GROUP BY page_id, href),
  n AS (SELECT page_id, count(*) AS n FROM a WHERE starts_with(href, '/') AND NOT starts_with(href, '//') AND NOT regexp_matches(href, '[?#]') AND href <> '/' AND NOT regexp_matches(href, '/$') AND len([x FOR x IN string_split(href, '/') IF x <> '']) = 1 GROUP BY 1)
  SELECT page_id, count(*) AS n_links FROM l JOIN n USING (page_id) WHERE n >= 3 AND len([x FOR x IN string_split(href, '/') IF x <> '']) = 1 GROUP BY 1""")
def a13_calendar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "pages")
    # Links of one step become files of a collection in two of three pages.
    own = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)(<a\b[^>]*?\shref\s*=\s*[\"'])(/[^/\"'?#]+)([\"'])", "$1/events$2?format=ical$3")
    made = rows.select("page_id", F.lit("https://v.example.com/list").alias("url"), F.when(F.col("page_id") % 3 != 0, own).otherwise(F.col("html")).alias("html"))
    return pages.calendar_file_links(made).groupBy("page_id").agg(F.count("*").alias("n_links"))


@register(f"""WITH {B.LISTINGS} SELECT post_id AS page_id, CAST(4 AS BIGINT) AS n_links, 'event' AS segment FROM listings WHERE post_id % 3 <> 1""")
def a14_heading_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda href, title: F.concat(F.lit('<h2 class="x"><a href="'), href, F.lit('">'), title, F.lit("</a></h2>"))
    event = [head(F.concat(F.lit(front), _s(_n()), F.lit(f"-{i}")), F.lit(f"Show <i>{i}</i>")) for i, front in enumerate(("/event/", "https://v.example.com/event/", "/event/", "/event/"))]
    others = F.concat(*[head(F.lit(f"/about/{i}"), F.lit("More")) for i in range(2)], head(F.lit("/calendar/6"), F.lit("June 2026")))
    flat = F.concat(*[head(F.concat(F.lit(f"/p{i}-"), _s(_n())), F.lit("Show")) for i in range(4)])
    page = F.concat(F.lit("<nav>"), others, others, F.lit("</nav>"), F.when(_n() % 3 == 1, flat).otherwise(F.concat(*event, others)))
    rows = B.listings(spark, sf_dir).select(_n().alias("page_id"), page.alias("html"))
    return pages.heading_link_vote(rows).groupBy("page_id", "segment").agg(F.count("*").alias("n_links"))


# --- reports and folds ---------------------------------------------------------------------------


@register("""WITH c AS (SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'no_url_configured' WHEN 1 THEN 'dead_domain_or_connection_error' WHEN 2 THEN 'likely_js_rendered_empty_shell' WHEN 3 THEN 'markup_not_matched' WHEN 4 THEN 'needs_browser_ua' WHEN 5 THEN 'needs_html_relay'
  WHEN 6 THEN 'needs_html_relay' WHEN 7 THEN 'other_http_status' ELSE 'dead_domain_or_connection_error' END AS cause FROM supplier) SELECT cause, count(*) AS n FROM c GROUP BY 1""")
def a10_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    rows = B.read(spark, sf_dir, "supplier")
    sources = rows.select(n.alias("source_id"), F.when(n % 9 == 0, " ").otherwise("https://s.example.com").alias("url"))
    status = F.when(n % 9 <= 3, 200).when(n % 9 == 4, 403).when(n % 9 == 5, 202).when(n % 9 == 6, 429).otherwise(500)
    log = rows.where(n % 9 != 8).select(n.alias("source_id"), status.alias("http_status"), F.when(n % 9 == 4, 200).when(n % 9 == 5, 403).alias("browser_ua_status"), F.lit(10).cast("long").alias("n_bytes"), F.when(n % 9 == 3, "<a href='/events'>").otherwise("<p>").alias("html"), F.when(n % 9 == 1, "timeout").alias("error"))
    return reports.triage_summary(reports.triage(log, sources)).select("cause", "n")


@register(f"""WITH {B.POSTS} SELECT count(*) FILTER (WHERE post_id % 3 <> 0) AS n_changed, count(*) AS n FROM posts WHERE post_id % 2 = 0""")
def a17_recategorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir).where(_n() % 2 == 0)
    raw = posts.select("post_id", F.lit('["Comedy"]').alias("raw_categories"))
    current = posts.select("post_id", F.when(_n() % 3 == 0, F.array(F.lit("comedy"))).when(_n() % 3 == 1, F.array(F.lit("festivals"))).otherwise(F.array(F.lit("comedy"), F.lit("festivals"))).alias("slugs"))
    return reports.recategorize(posts, raw, current).agg(F.count_if("changed").alias("n_changed"), F.count("*").alias("n"))


@register(f"""WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, {_FP} AS fp FROM titles WHERE city_slug IS NOT NULL), g AS (SELECT fp, count(*) AS n FROM f GROUP BY 1)
  SELECT (SELECT count(*) FROM f WHERE post_id % 3 <> 0) AS n_changed, count(*) FILTER (WHERE n > 1) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_deletes FROM g""")
def a18_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.fingerprint(F.col("post_title"), F.col("start_utc"), F.col("city_slug"))
    rows = B.listings(spark, sf_dir).select("post_id", "post_title", "start_utc", F.lit(None).cast("string").alias("start_local"), "city_slug", F.when(_n() % 3 == 0, own).when(_n() % 3 == 1, "old").alias("old_fp"))
    return reports.fingerprint_summary(reports.recompute_fingerprints(rows))


@register("""WITH o AS (SELECT user_id AS post_id, event_id AS seq, CASE WHEN event_type = 'error' THEN '' ELSE lpad(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), 9, '0') END AS start_utc, CASE WHEN event_id % 3 = 0 THEN 'text ' || event_id ELSE '' END AS d FROM events WHERE user_id IS NOT NULL),
  l AS (SELECT post_id AS p, max(seq) AS m FROM o WHERE start_utc = '' GROUP BY 1),
  t AS (SELECT post_id, start_utc FROM o LEFT JOIN l ON p = post_id WHERE m IS NULL OR seq >= m QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY start_utc = '', start_utc, seq DESC) = 1)
  SELECT post_id, t.start_utc, (SELECT arg_min(d, seq) FROM o o2 WHERE o2.post_id = t.post_id AND d <> '') AS description, (SELECT max(seq) FROM o o3 WHERE o3.post_id = t.post_id) AS category FROM t""")
def m1_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("post_id", "start_utc", "description", F.col("category").cast("long").alias("category"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_observations(_observations(B.read(spark, sf_dir, "events").where("user_id IS NOT NULL")))


def _observations(e: DataFrame, every: int = 3) -> DataFrame:
    """Events as observations; one in so many has a text."""
    n = F.col("event_id")
    start = F.when(F.col("event_type") == "error", "").otherwise(F.lpad(F.floor(F.col("value") * 100).cast("string"), 9, "0"))
    link = F.when(n % 4 == 0, F.concat(F.lit("https://t.example.com/?aaid="), _s(n))).when(n % 4 == 1, F.concat(F.lit("https://eventim.us/"), _s(n))).when(n % 4 == 2, F.concat(F.lit("https://v.example.com/"), _s(n)))
    source = F.when(n % 4 == 0, "Ticketmaster").when(n % 4 == 1, "Eventim").otherwise("venue")
    return e.select(F.col("user_id").alias("post_id"), n.alias("seq"), F.col("event_type").alias("title"), start.alias("start_utc"), *(start.alias(c) for c in ("start_local", "end_local", "end_utc")), F.lit("UTC").alias("timezone"), link.alias("ticket_url"), source.alias("source_name"), F.when(n % every == 0, F.concat(F.lit("text "), _s(n))).otherwise("").alias("description"), F.lit("").alias("image_url"), _s(n).alias("category"))


@register()
def m1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("post_id", "ticket_url")


@register(f"""WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, post_title, {_FP} AS fp FROM titles WHERE {_TITLED}), n AS (SELECT * FROM f WHERE post_id % 2 = 1 AND post_id % 6 = 1 AND NOT regexp_matches(post_title, '[()|*&@]')),
  e AS (SELECT fp, min(post_id) AS post_id FROM f WHERE post_id % 2 = 0 GROUP BY 1) SELECT DISTINCT e.post_id FROM n JOIN e USING (fp)""")
def m6_cancelled_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _listings(spark, sf_dir).withColumn("day", F.substring("start_utc", 1, 10)).select("post_id", "post_title", "start_utc", "day", "city_slug")
    rows = written(listed, "cancelled-listings")  # texts are read once
    plain = ~F.col("post_title").rlike("[()|*&@]")
    title = F.when((_n() % 6 == 1) & plain, F.concat("post_title", F.lit(" **Cancelled**"))).otherwise(F.col("post_title"))
    new = rows.where(_n() % 2 == 1).select(_n().alias("seq"), title.alias("title"), "start_utc", "day", "city_slug")
    old = rows.where(_n() % 2 == 0).select("post_id", F.col("post_title").alias("title"), "start_utc", "day", "city_slug")
    fp = T.fingerprint(F.col("title"), F.col("start_utc"), F.col("city_slug"))
    gone = fold.drop_cancelled(new, old)[1]
    # Those found by fingerprint; matches by similar titles have no SQL.
    exact = new.where(T.is_cancelled(F.col("title"))).select(fp.alias("fp")).distinct()
    first = old.groupBy(fp.alias("fp")).agg(F.min("post_id").alias("post_id")).join(exact, "fp", "left_semi")
    return gone.join(first.select("post_id"), "post_id", "left_semi")


# --- the streaming store, and reports by rows -----------------------------------------------------


@register(f"""WITH {B.LISTINGS}, {_TITLES}, o AS (SELECT post_id, 2 * post_id AS seq, post_title, start_utc, {_FP} AS fp FROM titles WHERE {_TITLED}),
  k AS (SELECT fp, max(seq) + 1 AS last FROM o WHERE post_id % 7 = 3 AND NOT regexp_matches(post_title, '[()|*&@]') GROUP BY 1)
  SELECT fp, arg_min(post_title, seq) AS title, min(start_utc) AS start_utc, 'text ' || min(post_id) FILTER (WHERE post_id % 3 = 0) AS description, 'c' || max(post_id) AS category, count(*) AS n_observed
  FROM o LEFT JOIN k USING (fp) WHERE last IS NULL OR seq > last GROUP BY fp""")
def r1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings land in three parts, some cancelled right after they were listed; each part is taken in by the stream, and a snapshot
    follows the first two. What the store then shows are one post a fingerprint (R1 to R3)."""
    rows = B.listings(spark, sf_dir).select(
        _n(), (_n() * 2).alias("seq"), F.col("post_title").alias("title"), F.when(_n() % 3 == 0, F.concat(F.lit("text "), _s(_n()))).otherwise("").alias("description"), "start_utc", "city_slug",
        F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("ticket_url"), "source_name", F.concat(F.lit("c"), _s(_n())).alias("category"),
    )
    off = rows.where((_n() % 7 == 3) & (F.trim("title") != "") & ~F.col("title").rlike("[()|*&@]")).withColumns({"seq": F.col("seq") + 1, "title": F.concat("title", F.lit(" **Cancelled**"))})
    landed, folder = rows.unionByName(off), new_path(spark, "ingest")
    low, high = rows.agg(F.min("post_id"), F.max("post_id")).first()
    if low is None:
        return ingest.read_posts(spark, f"{folder}/store").select("fp", "title", "start_utc", "description", "category", "n_observed")
    for k in range(3):
        part = F.floor((_n() - low) * 3 / (high - low + 1)) == k
        landed.where(part).drop("post_id").write.mode("append").json(f"{folder}/in")
        ingest.ingest_stream(spark, f"{folder}/in", f"{folder}/store", f"{folder}/check").awaitTermination()
        if k < 2:
            ingest.compact(spark, f"{folder}/store")
    return ingest.read_posts(spark, f"{folder}/store").select("fp", "title", "start_utc", "description", "category", "n_observed")


@register("""WITH o AS (SELECT user_id AS post_id, event_id AS seq, CASE WHEN event_id % 150 = 0 THEN 'text ' || event_id ELSE '' END AS d FROM events WHERE user_id IS NOT NULL),
  p AS (SELECT post_id, arg_min(d, seq) FILTER (WHERE d <> '') AS d FROM o GROUP BY 1)
  SELECT post_id, d IS NULL AS queued, coalesce(d, CASE WHEN post_id % 2 = 0 THEN 'written ' || post_id END) AS description FROM p""")
def r4_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts folded from observations that seldom have a text; what is written for half of those that wait for one is applied."""
    seen = B.read(spark, sf_dir, "events").where("user_id IS NOT NULL")
    posts = written(_observations(seen, 150).transform(fold.fold_observations).withColumn("fp", _s(_n())), "posts")
    waiting = ingest.enrichment_queue(posts)
    results = waiting.where(_n() % 2 == 0).select("fp", F.concat(F.lit("written "), _s(_n())).alias("text"))
    queued = waiting.select("fp", F.lit(True).alias("queued"))
    return ingest.apply_enrichment(posts, results).join(queued, "fp", "left").select("post_id", F.coalesce("queued", F.lit(False)).alias("queued"), "description")


@register(f"""WITH {B.POSTS} SELECT post_id, CASE post_id % 3 WHEN 0 THEN 'comedy' WHEN 1 THEN 'festivals' ELSE 'comedy,festivals' END AS current, 'comedy' AS new, post_id % 3 <> 0 AS changed FROM posts""")
def a17_recategorized_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir)
    raw = posts.select("post_id", F.lit('["Comedy"]').alias("raw_categories"))
    current = posts.select("post_id", F.when(_n() % 3 == 0, F.array(F.lit("comedy"))).when(_n() % 3 == 1, F.array(F.lit("festivals"))).otherwise(F.array(F.lit("comedy"), F.lit("festivals"))).alias("slugs"))
    return reports.recategorize(posts, raw, current).select("post_id", F.array_join("current", ",").alias("current"), F.array_join("new", ",").alias("new"), "changed")


@register(f"""WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, {_FP} AS new_fp FROM titles WHERE city_slug IS NOT NULL)
  SELECT post_id, new_fp, post_id % 3 <> 0 AS changed, min(post_id) OVER (PARTITION BY new_fp) AS keeper, post_id <> min(post_id) OVER (PARTITION BY new_fp) AS is_delete FROM f""")
def a18_fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.fingerprint(F.col("post_title"), F.col("start_utc"), F.col("city_slug"))
    rows = B.listings(spark, sf_dir).select("post_id", "post_title", "start_utc", F.lit(None).cast("string").alias("start_local"), "city_slug", F.when(_n() % 3 == 0, own).when(_n() % 3 == 1, "old").alias("old_fp"))
    return reports.recompute_fingerprints(rows).drop("old_fp")


@register(f"WITH {B.POSTS} SELECT post_id, replace(translate(coalesce(post_title, ''), '‘’“”–— ', '''''\"\"-- '), '…', '...') AS title FROM posts")
def f3_clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles as they are, those that hold typed signs too."""
    return B.posts(spark, sf_dir).select("post_id", T.clean_unicode(F.col("post_title")).alias("title"))


@register(f"""WITH {B.LISTINGS} SELECT post_id AS page_id, i AS pos, 'Act ' || i AS title, CASE WHEN post_id % 3 = 0 THEN '/event/' || post_id || '-' || i ELSE '/p' || i || '-' || post_id END AS href, post_id % 3 <> 0 AS orphan
  FROM listings, unnest(range(0, 3)) AS t(i) WHERE post_id % 3 <> 2""")
def a14_orphan_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a listing: headings with links of one segment, posters beside plain headings, or headings that have no link near them."""
    def card(i: int) -> Column:
        title, link = F.lit(f"<h3>Act <i>{i}</i></h3>"), F.concat(F.lit(f'<a href="/p{i}-'), _s(_n()), F.lit('"><img src="p.png"></a>'))
        own = F.concat(F.lit('<h3><a href="/event/'), _s(_n()), F.lit(f'-{i}">Act <i>{i}</i></a></h3>'))
        far = F.concat(link, F.lit("<p></p><br><p></p>"), title)
        return F.concat(F.lit("<div>"), F.when(_n() % 3 == 0, own).when(_n() % 3 == 1, F.concat(link, F.lit("<br>"), title)).otherwise(far), F.lit("</div>"))

    page = F.concat(F.lit("<nav><h2><a href='/about'>About</a></h2></nav><h2>June 2026</h2>"), *[card(i) for i in range(3)], F.lit("<footer><h4><a href='/jobs'>Jobs</a></h4></footer>"))
    rows = B.listings(spark, sf_dir).select(_n().alias("page_id"), page.alias("html"))
    found = headings.event_headings(rows)
    number = F.regexp_extract("title", r"(\d+)$", 1).cast("long")
    return found.select("page_id", number.alias("pos"), "title", "href", "orphan")
