"""What kind of page it is, and the links that matter in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.dates import MONTH_YEAR
from marquee.functions.html import SKIPPED_TAGS
from marquee.functions.urls import absolute_url, host, parent_path, path_depth

# Engines with what their generator tag and their markup say, in order.
ENGINES = (
    ("eventon", ("eventon",), ("evo_calendar", "eventon_events_list", "eventon_script", "evcal_")),
    ("mec", ("modern events calendar", "webnus"), ("mec-event", "mec_skin", "mec-calendar")),
    ("tec_block", ("the events calendar",), ("tribe-events-view", "tribe-events-pro")),
)
# Hosts that are never a venue's own, signs of a page of events, and words that tell no venue from another.
OTHER_HOSTS = (
    "ticketmaster.com", "stubhub.com", "seatgeek.com", "axs.com", "livenation.com", "tmpresale.com", "vividseats.com", "viagogo.com", "rateyourseats.com",
    "cashortrade.org", "ticketsqueeze.com", "eventticketscenter.com", "eventbrite.com", "songkick.com", "bandsintown.com", "setlist.fm", "concertarchives.org",
    "outhere.guide", "allevents.in", "dotstri.com", "nashvilleconcerts.org", "birmingham.events", "facebook.com", "instagram.com", "twitter.com", "x.com",
    "youtube.com", "google.com", "bing.com", "yahoo.com", "startpage.com", "mojeek.com", "yandex.com", "brave.com", "yelp.com", "tripadvisor.com", "trip.com",
    "foursquare.com", "visitdenver.com", "wikipedia.org", "scoop.it", "nashville.com", "bhamterminal.com", "do615.com", "thrillist.com", "timeout.com",
    "citysearch.com", "nasa.gov", "science.nasa.gov",
)
SIGNALS = ("tickets", "show", "concert", "event", "calendar", "schedule", "performance", "doors open", "on sale", "buy now", "get tickets")
PLAIN_WORDS = (
    "hall", "room", "house", "theater", "theatre", "arena", "field", "park", "music", "center", "amphitheater", "summit", "moon", "east", "west", "north",
    "south", "grand", "royal", "national", "first", "bank", "plus", "lounge", "stage", "live", "the", "and", "auditorium",
)
# Dates in a page's text, and the marks of feeds in the order in which they count.
DATES = (r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b")
JSONLD_EVENT = r'"@type"\s*:\s*"Event"'
FEEDS = (("tec_html", ("tribe-events", "the-events-calendar")), ("mec_html", ("mec-event", "modern-events-calendar")), ("rhp", ("rhp_events", "rhpEvents")))


def _has(text: Column, mark: str) -> Column:
    return F.contains(text, F.lit(mark))


def detect_render_engine(html: Column) -> Column:
    """A struct (engine, confidence, matched_on): by the generator tag (meta), else by markup (fingerprint), else none."""
    low = F.lower(F.coalesce(html, F.lit("")))
    generator = F.regexp_extract(low, r"<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)
    told = lambda e, how, mark: F.struct(F.lit(e).alias("engine"), F.lit(how).alias("confidence"), F.lit(mark).alias("matched_on"))
    tries = [(_has(generator, m), told(e, "meta", m)) for e, marks, _ in ENGINES for m in marks] + [(_has(low, m), told(e, "fingerprint", m)) for e, _, marks in ENGINES for m in marks]
    out = F.when(*tries[0])
    for condition, value in tries[1:]:
        out = out.when(condition, value)
    none = F.lit(None).cast("string")
    return out.otherwise(F.struct(none.alias("engine"), F.lit("none").alias("confidence"), none.alias("matched_on")))


def has_no_static_content(html: Column) -> Column:
    """Whether a page has neither a JSON-LD event, nor a calendar file, nor a date in its text."""
    low = F.lower(F.coalesce(html, F.lit("")))
    dated = low.rlike("|".join(DATES))
    return ~(_has(F.replace(low, F.lit(" ")), '"@type":"event"') | _has(low, ".ics") | dated)


def detect_feed(html: Column) -> Column:
    """jsonld, tec_html, mec_html or rhp, by the first sign that a page shows; null for none."""
    t = F.coalesce(html, F.lit(""))
    out = F.when(t.rlike(JSONLD_EVENT), "jsonld")
    for feed, marks in FEEDS:
        out = out.when(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(t, m)), feed)
    return out


def is_calendar_file(body: Column) -> Column:
    return _has(F.substring(F.coalesce(body, F.lit("")), 1, 2000), "BEGIN:VCALENDAR")


def hrefs(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))


def calendar_file_url(html: Column, base: Column) -> Column:
    """The calendar file of a whole page: of a link tag of that type, else of the first link at most one step deep; null for none."""
    t = F.coalesce(html, F.lit(""))
    tag = F.regexp_extract(t, r"(?is)(<link\b[^>]*text/calendar[^>]*>)", 1)
    named = F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']([^\"']+)", 1)
    files = F.filter(hrefs(html), lambda h: F.contains(h, F.lit(".ics")) | F.contains(h, F.lit("format=ical")))
    shallow = F.filter(F.transform(files, lambda h: absolute_url(h, base)), lambda u: path_depth(u) <= 1)
    return F.when(named != "", absolute_url(named, base)).otherwise(F.get(shallow, F.lit(0)))


def calendar_file_links(pages: DataFrame, least: int = 3, most: int = 75) -> DataFrame:
    """(page_id, pos, link): calendar files of single events in pages (page_id, url, html), all of the one parent path that
    most links share, three at least; each once, the first ``most`` of them (a bound on what is fetched from one page)."""
    links = pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    links = links.where(F.contains("href", F.lit("format=ical")) | F.endswith("href", F.lit(".ics"))).select("page_id", "pos", absolute_url(F.col("href"), F.col("url")).alias("link"))
    links = links.where(path_depth(F.col("link")) >= 2).withColumn("parent", parent_path(F.col("link")))
    each = links.groupBy("page_id", "parent").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where(F.col("n") >= least)
    top = each.groupBy("page_id").agg(F.max_by("parent", F.struct("n", -F.col("first"))).alias("parent"))
    won = links.join(top, ["page_id", "parent"], "left_semi").groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return won.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", F.col("rank").cast("long").alias("pos"), "link")


def heading_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, href) of the linked headings of pages (page_id, html), but for months and those of navigation, headers and footers."""
    t = F.coalesce("html", F.lit(""))
    for tag in SKIPPED_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    heads = F.regexp_extract_all(t, F.lit(r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]\s*>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(heads).alias("pos", "inner"))
    title = F.trim(F.regexp_replace(F.regexp_replace("inner", r"(?s)<[^>]*>", " "), r"\s+", " "))
    href = F.regexp_extract("inner", r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']+)[\"']", 1)
    return rows.select("page_id", "pos", title.alias("title"), href.alias("href")).where((F.col("href") != "") & ~F.col("title").rlike(f"(?i)^{MONTH_YEAR}$"))


def heading_link_vote(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """The linked headings whose first path segment is their page's most frequent one, if three and half of them have it."""
    path = F.regexp_replace("href", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    links = heading_links(pages).withColumn("segment", F.regexp_extract(path, r"^/*([^/?#]+)", 1))
    n = links.groupBy("page_id").agg(F.count("*").alias("all"))
    each = links.where("segment <> ''").groupBy("page_id", "segment").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = each.groupBy("page_id").agg(F.max_by(F.struct("segment", "n"), F.struct("n", -F.col("first"))).alias("t"))
    won = top.join(n, "page_id").where(F.col("t.n") >= F.greatest(F.lit(least), F.col("all") * share)).select("page_id", "t.segment")
    return links.join(won, ["page_id", "segment"], "left_semi").select("page_id", "pos", "title", "href", "segment")


def is_venue_page(url: Column, html: Column, venue: Column) -> Column:
    """Whether a landed page is the venue's own page of events: no known other host, two signals, and a telling word of
    the venue's name in the host or the title."""
    u, low = F.coalesce(url, F.lit("")), F.lower(F.coalesce(html, F.lit("")))
    other = F.exists(F.array(*[F.lit(h) for h in OTHER_HOSTS]), lambda h: F.contains(u, h))
    signals = F.size(F.filter(F.array(*[F.lit(s) for s in SIGNALS]), lambda s: F.contains(low, s)))
    title = F.regexp_extract(low, r"(?s)<title[^>]*>([^<]+)</title>", 1)
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(venue, F.lit(""))), r"(?U)[^\w\s]", ""), r"(?U)\s+"), lambda w: (F.length(w) > 4) & ~w.isin(*PLAIN_WORDS))
    named = F.exists(words, lambda w: F.contains(host(u), w) | F.contains(title, w))
    return F.startswith(u, F.lit("http")) & ~other & (signals >= 2) & ((F.size(words) == 0) | named)


