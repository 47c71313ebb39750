"""Feeds in JSON as listings: ticketing, affiliate, calendar plugin, calendar pages and ticket widgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import html
from marquee.functions.times import guess_timezone, known_zone, normalize_datetime, parse_offset_datetime
from marquee.functions.urls import add_param
from marquee.operators.upkeep import filter_by_city

# The shapes of the feeds.
_TIME = "struct<dateTime: string, localDate: string, localTime: string>"
_NAME = "struct<name: string>"
TICKETING = (
    f"id string, name string, url string, info string, pleaseNote string, dates struct<timezone: string, start: {_TIME}, end: {_TIME}>, "
    "images array<struct<ratio: string, width: int, url: string>>, priceRanges array<struct<min: double, max: double>>, "
    f"classifications array<struct<segment: {_NAME}, genre: {_NAME}, subGenre: {_NAME}>>, "
    f"_embedded struct<venues: array<struct<name: string, address: struct<line1: string>, city: {_NAME}, state: struct<stateCode: string>, postalCode: string>>>"
)
AFFILIATE = (
    "id string, title string, description string, timeZone string, eventDate string, startDate string, endDate string, minTicketPrice string, maxTicketPrice string, "
    "genre string, tags array<string>, whiteLabelUrl string, regularEventUrl string, venue struct<name: string, street: string, city: string, state: string, zipcode: string>"
)
WIDGET = (
    "events array<struct<active: boolean, eventId: string, eventDateTime: string, bio: string, title: struct<eventTitleText: string>, "
    "media: map<string, struct<file_name: string, width: int, height: int>>, ticketing: struct<url: string, eventUrl: string>>>"
)
#: Where a ticket widget keeps its feeds; a deployment gives its own host and folder.
WIDGET_HOST, WIDGET_FOLDER = "widgets.example.com", "json/events"


def _text(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def normalize_ticketing(raw: DataFrame, affiliate: str | None = None) -> DataFrame:
    """A listing a row of raw (body, city_slug) of the ticketing feed.

    Local times are the city's, while the record carries the venue's zone; an end that is missing is the start.
    Rows without a title or a start, and damaged ones, go."""
    e = raw.select(F.from_json("body", TICKETING).alias("e"), "city_slug").where("e IS NOT NULL")
    zone = guess_timezone(F.col("city_slug"))
    when = lambda s: parse_offset_datetime(F.col(f"e.dates.{s}.dateTime"), F.col(f"e.dates.{s}.localDate"), F.col(f"e.dates.{s}.localTime"), zone)
    venue = lambda path: F.coalesce(F.col("venue")[path], F.lit(""))
    price = F.get(F.filter("e.priceRanges", lambda p: p["min"].isNotNull()), F.lit(0))
    url = F.coalesce("e.url", F.lit(""))
    described = F.trim(_filled(F.coalesce("e.info", F.lit("")), F.coalesce("e.pleaseNote", F.lit(""))))
    out = e.withColumns({"start": when("start"), "end": when("end"), "venue": F.get("e._embedded.venues", F.lit(0)), "price": price})
    ends = F.col("end.utc") != ""
    return out.select(
        _text("e.name").alias("title"), described.alias("description"), F.col("start.utc").alias("start_utc"), F.col("start.local").alias("start_local"),
        F.when(ends, F.col("end.utc")).otherwise(F.col("start.utc")).alias("end_utc"), F.when(ends, F.col("end.local")).otherwise(F.col("start.local")).alias("end_local"),
        _filled(F.coalesce("e.dates.timezone", F.lit("")), zone).alias("timezone"), F.trim(venue("name")).alias("venue_name"),
        F.coalesce("venue.address.line1", F.lit("")).alias("venue_address"), F.coalesce("venue.city.name", F.lit("")).alias("venue_city"),
        F.coalesce("venue.state.stateCode", F.lit("")).alias("venue_state"), venue("postalCode").alias("venue_zip"),
        html.best_image(F.col("e.images")).alias("image_url"), (F.when(url == "", url).otherwise(add_param(url, "aaid", affiliate)) if affiliate else url).alias("ticket_url"),
        F.coalesce(html.format_price(F.col("price.min"), F.col("price.max")), F.lit("")).alias("cost"), F.lit("Ticketmaster").alias("source_name"), "city_slug",
        html.classification_names(F.col("e.classifications")).alias("categories"), F.concat(F.lit("tm_"), F.coalesce("e.id", F.lit(""))).alias("external_id"),
        (described == "").alias("needs_enrichment"),
    ).where("title <> '' AND (start_utc <> '' OR start_local <> '')")


def normalize_affiliate(raw: DataFrame, filters: DataFrame) -> DataFrame:
    """A listing a row of raw (body) of the national affiliate feed whose venue lies in a city of filters (city, state,
    city_slug). Each carries its own zone; the event's date counts before the start of a run."""
    e = raw.select(F.from_json("body", AFFILIATE).alias("e")).where("e IS NOT NULL").select("e.*")
    e = filter_by_city(e.withColumns({"city": F.coalesce("venue.city", F.lit("")), "state": F.coalesce("venue.state", F.lit(""))}), filters)
    zone, none = known_zone(F.col("timeZone")), F.lit(None).cast("string")
    when = lambda c: parse_offset_datetime(F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2"), none, none, zone)
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    out = e.withColumns({"start": when(F.coalesce(one("eventDate"), F.col("startDate"))), "end": when(F.col("endDate"))})
    ends, high = F.col("end.utc") != "", F.coalesce("maxTicketPrice", F.lit(""))
    dear = ~high.isin("", "0", "0.0") & (high != F.col("minTicketPrice"))
    place = lambda c: F.coalesce(f"venue.{c}", F.lit(""))
    return out.select(
        _text("title").alias("title"), _text("description").alias("description"), F.col("start.utc").alias("start_utc"), F.col("start.local").alias("start_local"),
        F.when(ends, F.col("end.utc")).otherwise(F.col("start.utc")).alias("end_utc"), F.when(ends, F.col("end.local")).otherwise(F.col("start.local")).alias("end_local"),
        zone.alias("timezone"), place("name").alias("venue_name"), place("street").alias("venue_address"), place("city").alias("venue_city"), place("state").alias("venue_state"),
        place("zipcode").alias("venue_zip"), F.lit("").alias("image_url"), _filled(F.coalesce("whiteLabelUrl", F.lit("")), F.coalesce("regularEventUrl", F.lit(""))).alias("ticket_url"),
        F.when(F.col("minTicketPrice").isNull(), "").otherwise(F.concat(F.lit("$"), "minTicketPrice", F.when(dear, F.concat(F.lit("-$"), high)).otherwise(""))).alias("cost"),
        F.lit("Eventim").alias("source_name"), "city_slug", F.when(F.coalesce("genre", F.lit("")) != "", F.array("genre")).otherwise(F.array().cast("array<string>")).alias("categories"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.concat(F.lit("eventim_"), F.coalesce("id", F.lit(""))).alias("external_id"), (F.coalesce("description", F.lit("")) == "").alias("needs_enrichment"),
    ).where("start_utc <> '' OR start_local <> ''")


def flatten_calendar_json(files: DataFrame) -> DataFrame:
    """An event an object of files (base_url, body): a list, a list under events, or lists under dates; other shapes give none."""
    v = F.col("v")
    parsed = files.select("base_url", F.try_parse_json("body").alias("v")).where("v IS NOT NULL")
    as_list = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.events", "array<variant>"))
    lists = parsed.select("base_url", "v", as_list.alias("items"))
    dated = lists.where("items IS NULL").select("base_url", F.explode(F.map_values(F.try_variant_get(v, "$", "map<string, variant>"))).alias("v"))
    items = lists.where("items IS NOT NULL").select("base_url", F.explode("items").alias("v"))
    items = items.unionByName(dated.select("base_url", F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("v")))
    get = lambda path: F.try_variant_get(v, path, "string")
    one = lambda path: F.when(F.coalesce(get(path), F.lit("")) != "", get(path))

    def time(path: str) -> Column:
        raw = get(path)
        return F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.date_format(F.timestamp_seconds(F.trim(raw).try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(raw)

    return items.select(
        _text(get("$.name")).alias("title"), _text(get("$.details")).alias("description"), time("$.start").alias("start"), time("$.end").alias("end"),
        (~F.lower(_text(get("$.all_day_event"))).isin("", "false", "0", "null")).alias("all_day"), one("$.image_url").alias("image_url"),
        one("$.location_name").alias("venue_name"), one("$.location_address").alias("venue_address"), one("$.location_lat").alias("lat"), one("$.location_lon").alias("lon"),
        one("$.organizer_name").alias("organizer_name"), F.coalesce(one("$.learnmore_link"), "base_url").alias("event_url"), F.coalesce(one("$['event-id']"), one("$.id")).alias("external_id"),
    )


def normalize_calendar_pages(raw: DataFrame, as_of: str, horizon_days: int = 35) -> DataFrame:
    """A listing an event of raw (source_name, city_slug, body) of the calendar's REST pages that starts at most so many days after as_of.

    Titles and texts are plain or under ``rendered``; both may hold markup. Events without a title go, those without a start stay."""
    events = raw.select("source_name", "city_slug", F.explode(F.try_variant_get(F.try_parse_json("body"), "$.events", "array<variant>")).alias("v"))
    v = F.col("v")
    get = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths], F.lit(""))
    written = lambda c: html.strip_html(get(f"$.{c}.rendered", f"$.{c}"))
    start = normalize_datetime(get("$.start_date"))
    until = F.date_format(F.date_add(F.lit(as_of[:10]).cast("date"), horizon_days), "yyyy-MM-dd")
    return events.select(
        "source_name", "city_slug", html.strip_ticket_boilerplate(written("title")).alias("title"), written("description").alias("description"), start.alias("start_date"),
        normalize_datetime(_filled(get("$.end_date"), get("$.start_date"))).alias("end_date"), get("$.venue.venue").alias("venue_name"), get("$.url").alias("ticket_url"),
        get("$.image.url").alias("image_url"), get("$.cost").alias("cost"), F.concat(F.lit("tec_"), get("$.id")).alias("external_id"),
    ).where((F.col("title") != "") & ~(F.substring("start_date", 1, 10) > until))


def widget_feed_url(page: Column, feed_host: str = WIDGET_HOST, folder: str = WIDGET_FOLDER) -> Column:
    """The feed of the ticket widget in a page: the file that it loads from folder at feed_host; null for none."""
    found = F.regexp_extract(F.coalesce(page, F.lit("")), rf"{re.escape(feed_host)}/{re.escape(folder)}/(\d+)/events\.json", 1)
    return F.when(found != "", F.concat(F.lit(f"https://{feed_host}/{folder}/"), found, F.lit("/events.json")))


def normalize_widget(raw: DataFrame) -> DataFrame:
    """A listing an active event of raw (source_name, city_slug, body) of the widget's feed, with its largest image."""
    e = raw.select("source_name", "city_slug", F.explode(F.from_json("body", WIDGET)["events"]).alias("e")).where("coalesce(e.active, true)")
    image = F.array_max(F.transform(F.map_values("e.media"), lambda m, k: F.struct((F.coalesce(m["width"], F.lit(0)) * F.coalesce(m["height"], F.lit(0))).alias("a"), (-k).alias("k"), m["file_name"].alias("f"))))
    start = normalize_datetime(F.col("e.eventDateTime"))
    return e.select(
        "source_name", "city_slug", html.strip_ticket_boilerplate(_text("e.title.eventTitleText")).alias("title"), _text("e.bio").alias("description"), start.alias("start_date"), start.alias("end_date"),
        F.col("source_name").alias("venue_name"), _filled(F.coalesce("e.ticketing.url", F.lit("")), F.coalesce("e.ticketing.eventUrl", F.lit(""))).alias("ticket_url"),
        F.coalesce(image["f"], F.lit("")).alias("image_url"), F.coalesce("e.eventId", F.lit("")).alias("external_id"), F.coalesce("e.eventDateTime", F.lit("")).alias("_raw"),
    ).where("title <> '' AND _raw <> ''").drop("_raw")


