from pyspark.sql import functions as F

from marquee.functions import html
from marquee.sources import feeds

ICAL = """BEGIN:VCALENDAR\r
BEGIN:VEVENT\r
SUMMARY:A long\r
  show\\, really\r
DTSTART;VALUE=DATE:20260105\r
LOCATION:Hall\r
END:VEVENT\r
BEGIN:VEVENT\r
SUMMARY:Zoned\r
DTSTART;TZID=America/Denver:20260105T190000\r
DTEND:20260106T040000Z\r
END:VEVENT\r
BEGIN:VEVENT\r
SUMMARY:No start\r
END:VEVENT\r
"""


def test_ical(spark):
    files = spark.createDataFrame([("s", ICAL), ("t", None), ("u", "")], "source_name string, body string")
    got = {r["title"]: (r["start_date"], r["end_date"], r["venue_name"]) for r in feeds.parse_ical(files).collect()}
    assert got == {"A long show, really": ("2026-01-05 00:00:00", "2026-01-05 00:00:00", "Hall"), "Zoned": ("2026-01-05 20:00:00", "2026-01-05 22:00:00", "")}


def test_jsonld(spark):
    block = lambda s: f'<html><script type="application/ld+json">{s}</script></html>'
    pages = [
        (1, block('{"@type": "MusicEvent", "name": "One", "startDate": "2026-01-05T19:00", "image": "i.png", "location": {"name": "Hall"}}')),
        (2, block('[{"@type": "Event", "name": "Two", "startDate": "2026-01-06", "image": {"url": "j.png"}}, {"@type": "Place", "name": "x"}]')),
        (3, block('{"@graph": [{"@type": "Event", "name": "Three", "startDate": "2026-01-07", "image": ["k.png"], "subEvent": [{"@type": "Event", "name": "Four", "startDate": "2026-01-08"}]}]}')),
        (4, block("{broken")),
        (5, block('{"@type": "Event", "name": "No start"}')),
        (6, None),
    ]
    got = sorted((r["page_id"], r["title"], r["start_date"], r["image_url"], r["venue_name"]) for r in feeds.extract_jsonld(spark.createDataFrame(pages, "page_id long, html string")).collect())
    assert got == [(1, "One", "2026-01-05 19:00:00", "i.png", "Hall"), (2, "Two", "2026-01-06 00:00:00", "j.png", ""), (3, "Four", "2026-01-08 00:00:00", "", ""), (3, "Three", "2026-01-07 00:00:00", "k.png", "")]


def test_json_listings(spark):
    rows = [("a", '[{"title": "T", "date": "2026-01-05", "venue": {"name": "Hall"}, "image": {"url": "i"}, "id": 7}]'), ("b", '{"items": [{"name": "N", "start": 1767225600, "venue": "V", "image_url": "j"}, {"x": 1}]}'), ("c", "nothing"), ("d", None)]
    got = sorted((r["source_name"], r["title"], r["start_date"], r["venue_name"], r["image_url"], r["external_id"]) for r in feeds.normalize_json_api(spark.createDataFrame(rows, "source_name string, body string")).collect())
    assert got == [("a", "T", "2026-01-05 00:00:00", "Hall", "i", "7"), ("b", "N", "2026-01-01 00:00:00", "V", "j", "")]


def test_page_functions(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column).collect()[0][0]

    t = F.col("t")
    assert one(html.strip_ticket_boilerplate(t), "Fred Eaglesmith - Tickets") == "Fred Eaglesmith"
    assert one(html.strip_html(t), "<nav>menu</nav><p>A &amp; B</p>\n<script>x</script>c") == "A & B c"
    assert one(html.meta_content(t, "og:image"), '<meta content="i.png" property="og:image">') == "i.png"
    assert one(html.meta_content(t, "og:image"), '<meta property="og:image" content="i.png">') == "i.png"
    assert one(html.image_from_tag(t), '<img data-src="a.png?w=1">') == "a.png"
    assert one(html.image_from_tag(t), '<div style="background: url(b.png)">') == "b.png"
    prices = spark.createDataFrame([(2.5, None), (2.5, 3.5), (5.0, 5.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in prices.select(html.format_price(F.col("a"), F.col("b"))).collect()] == ["$2", "$2–$4", "$5", ""]
    images = spark.createDataFrame([([("4_3", 900, "x"), ("16_9", 100, "y"), ("16_9", 100, "z")],), ([],), (None,)], "i array<struct<ratio: string, width: int, url: string>>")
    assert [r[0] for r in images.select(html.best_image(F.col("i"))).collect()] == ["y", "", ""]


def test_classification_names(spark):
    part = "struct<name: string>"
    kind = f"c array<struct<segment: {part}, genre: {part}, subGenre: {part}>>"
    rows = [([(("Music",), ("Rock",), ("Undefined",)), (("Music",), None, ("",))],), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, kind).select(html.classification_names(F.col("c"))).collect()] == [["Music", "Rock"], []]
