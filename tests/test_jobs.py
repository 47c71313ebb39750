import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates, display, pages, urls
from marquee.functions import text as T
from marquee.operators import fold, reports, store, upkeep
from marquee.sources import store as tables
from marquee.tables import clear_tables, shared_dir

OBSERVED = "post_id long, seq long, title string, start_local string, end_local string, start_utc string, end_utc string, timezone string, ticket_url string, source_name string, description string, image_url string, category string"
LINKS = [None, "", "https://t.example.com/?aaid=1", "https://eventim.us/9", "https://v.example.com/x", "https://plain.example.com"]


def _rank(url):
    return 0 if "aaid=" in url else 1 if any(m in url for m in ("seeticketsusa.us", "eventim.us", "nts_trk=")) else None


def _fold(rows):
    """One post's observations, applied one by one."""
    post = None
    for r in sorted(rows, key=lambda r: r["seq"]):
        url, start = (r["ticket_url"] or "").strip(), r["start_utc"] or ""
        if post is None:
            post = {"title": r["title"], "start_utc": r["start_utc"], "url": url, "description": "", "image": "", "category": None}
        else:
            keep = bool((post["start_utc"] or "") and start and start > post["start_utc"])
            if not keep:
                post["start_utc"] = r["start_utc"]
                own = {"ticketmaster": 0, "eventim": 1}.get((r["source_name"] or "").strip().lower())
                held = _rank(post["url"])
                if url and (held is None or own is not None and own <= held):
                    post["url"] = url
        post["description"] = post["description"] or (r["description"] or "").strip()
        post["image"] = post["image"] or (r["image_url"] or "").strip()
        post["category"] = r["category"]
    return post


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_a_plain_fold(spark, seed):
    draw = random.Random(seed)
    rows = []
    for seq in range(240):
        start = draw.choice(["", None, "2026-03-01 18:00:00", "2026-03-01 19:00:00", "2026-03-01 20:00:00", "2026-03-02 10:00:00"])
        rows.append((draw.randrange(9), seq, f"t{seq}", start, start, start, start, "UTC", draw.choice(LINKS), draw.choice(["Ticketmaster", "eventim", "venue", None]), draw.choice(["", None, f"d{seq}"]), draw.choice([None, f"i{seq}"]), f"c{seq}"))
    df = spark.createDataFrame(rows, OBSERVED)
    by_post = {}
    for r in df.collect():
        by_post.setdefault(r["post_id"], []).append(r)
    # Whole, and scanned in parts of three rows or so.
    got, split = ({r["post_id"]: r for r in fold.fold_observations(df, *size).collect()} for size in ((), (3,)))
    assert got == split and set(got) == set(by_post)
    for i, seen in by_post.items():
        want, r = _fold(seen), got[i]
        assert (r["start_utc"] or "", r["ticket_url"] or "", r["description"] or "", r["image_url"] or "", r["category"], r["title"]) == (want["start_utc"] or "", want["url"], want["description"], want["image"], want["category"], want["title"])
    assert fold.fold_observations(df.where("false")).count() == 0


def test_cancelled_listings_take_their_posts_along(spark):
    new = spark.createDataFrame([(1, "Blues Night **Cancelled**", "2026-03-01 20:00:00", "2026-03-01", "tampa"), (2, "Cancelled: Other", "2026-03-01 20:00:00", "2026-03-01", "tampa"), (3, "Jazz Evening Show (sold out)", "2026-03-01 20:00:00", "2026-03-01", "tampa"), (4, "The Jazz Evening Shows *cancelled*", "2026-03-01 21:00:00", "2026-03-01", "tampa")], "seq long, title string, start_utc string, day string, city_slug string")
    old = spark.createDataFrame([(10, "blues night", "2026-03-01 20:00:00", "2026-03-01", "tampa"), (11, "The Jazz Evening Show", "2026-03-01 20:00:00", "2026-03-01", "tampa"), (12, "Other", "2026-03-01 20:00:00", "2026-03-01", "tampa")], "post_id long, title string, start_utc string, day string, city_slug string")
    kept, gone = fold.drop_cancelled(new, old)
    assert sorted(r["seq"] for r in kept.collect()) == [2, 3]
    assert sorted(r["post_id"] for r in gone.collect()) == [10, 11]


def test_dates_as_people_write_them(spark):
    rows = [
        ("June 26 - July 19, 2026", "June 26, 2026", "2026-06-26 00:00:00"), ("On June 19, 2026 7:00 PM at", "June 19, 2026 7:00 PM", "2026-06-19 19:00:00"), ("Thu, Jun 18 Doors: 6 pm Show: 7 pm", "Thu, Jun 18 7 pm", "2027-06-18 19:00:00"),
        ("no date here", "", ""), ("", "", ""), (None, "", ""), ("Friday, July 17", "Friday, July 17", "2026-07-17 00:00:00"),
    ]
    df = spark.createDataFrame([(t,) for t, *_ in rows], "t string").select("t", dates.date_text(F.col("t")).alias("said"))
    got = df.select("t", "said", dates.parse_loose_date(F.col("said"), dates.year_anchor(F.col("said"), "2026-07-01")).alias("found")).collect()
    assert [(r["t"], r["said"], r["found"]) for r in got] == rows
    texts = spark.createDataFrame([("Show Thu, Jun 18", "Tickets $5 to $10", "2026-06-21 19:00:00"), ("June Show", "free", "2026-06-21 00:00:00"), (None, None, None)], "a string, b string, c string")
    out = texts.select(dates.strip_trailing_date(F.col("a")), dates.price_text(F.col("b")), display.long_date(F.col("c"))).collect()
    assert [tuple(r) for r in out] == [("Show", "$5 to $10", "Sunday, June 21 at 7:00 PM"), ("June Show", "", "Sunday, June 21"), ("", "", None)]


def test_urls_and_pages(spark):
    base = "https://v.example.com/shows/list?x=1#top"
    cases = [("/a", "https://v.example.com/a"), ("b.ics", "https://v.example.com/shows/b.ics"), ("//o.example.org/c", "https://o.example.org/c"), ("https://z.example.net/", "https://z.example.net/"), ("?p=2", "https://v.example.com/shows/list?p=2"), ("#e", "https://v.example.com/shows/list?x=1#e")]
    df = spark.createDataFrame(cases, "href string, want string")
    assert all(r[0] == r[1] for r in df.select(urls.absolute_url(F.col("href"), F.lit(base)), "want").collect())
    bad = spark.createDataFrame([("https://w.example.org/r?u=100%zz",), ("https://w.example.org/r?u=a%20b",), (None,)], "u string")
    assert [r[0] for r in bad.select(urls.unwrap_redirect(F.col("u"), "w.example.org")).collect()] == ["https://w.example.org/r?u=100%zz", "a b", None]
    link = lambda h: f'<a class="x" href="{h}">x</a>'
    rows = [
        (1, base, "".join(link(f"/events/{i}.ics") for i in (1, 2, 2, 3)) + link("/other/9.ics")), (2, base, link("/events/1.ics") * 2 + link("/cal.ics")), (3, base, None),
        (4, base, '<link type="text/calendar" href="/all.ics">'), (5, base, "".join(link(f"/e/{i}?format=ical") for i in range(90))),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in pages.calendar_file_links(df).orderBy("page_id", "pos").collect()]
    assert got[:3] == [(1, i, f"https://v.example.com/events/{i}.ics") for i in (1, 2, 3)] and len(got) == 3 + 75
    files = {r[0]: r[1] for r in df.select("page_id", pages.calendar_file_url(F.col("html"), F.col("url"))).collect()}
    assert files == {1: None, 2: "https://v.example.com/cal.ics", 3: None, 4: "https://v.example.com/all.ics", 5: None}


def test_triage_and_reports(spark):
    sources = spark.createDataFrame([(i, "" if i == 0 else "u") for i in range(7)], "source_id long, url string")
    log = spark.createDataFrame([(0, 200, None, 1, "", None), (1, None, None, None, None, "timeout"), (2, 200, None, 9, "<p>", None), (3, 200, None, 9, "/EVENTS", None), (4, 403, 200, 0, "", None), (5, 202, None, 0, "", None)], "source_id long, http_status int, browser_ua_status int, n_bytes long, html string, error string")
    found = reports.triage(log, sources)
    assert [r["cause"] for r in found.orderBy("source_id").collect()] == ["no_url_configured", "dead_domain_or_connection_error", "likely_js_rendered_empty_shell", "markup_not_matched", "needs_browser_ua", "needs_html_relay", "dead_domain_or_connection_error"]
    assert [r["cause"] for r in reports.triage_summary(found).collect()] == [c for c in reports.CAUSES if c != "other_http_status"]
    posts = spark.createDataFrame([(1, "Jazz", ""), (2, "Jazz", None)], "post_id long, post_title string, post_content string")
    raw = spark.createDataFrame([(1, "{broken"), (2, '["Miscellaneous"]')], "post_id long, raw_categories string")
    current = spark.createDataFrame([(1, ["live-music-concerts"])], "post_id long, slugs array<string>")
    assert {r["post_id"]: (r["new"], r["changed"]) for r in reports.recategorize(posts, raw, current).collect()} == {1: (["live-music-concerts"], False), 2: (["more-to-do"], True)}
    # Fixed values of the scoring rules.
    assert "private rental" in T.OFF_TOPIC and upkeep.score_sources.__defaults__[:4] == (3, 1, 0.3, 0.5)


def test_members_and_cities(spark):
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(300)] + [(None,)], "name string")
    known = spark.createDataFrame([(7, "n005"), (9, "n100")], "id long, name string")
    got = store.ensure_members(names, known, "name", "id", parts=5).orderBy("name").collect()
    assert len(got) == 300 and [r["id"] for r in got if r["name"] not in ("n005", "n100")] == list(range(10, 308))
    cities = spark.createDataFrame([("A", "a", None, None, 1.0, 0, "closed")], "name string, slug string, tm_dma_id string, lat double, lng double, radius_miles int, status string")
    assert [r["slug"] for r in tables.load_cities(cities, cities).collect()] == ["a"]
    assert tables.load_cities(cities.withColumn("status", F.lit("active")), cities.withColumn("slug", F.lit("b"))).first()["slug"] == "a"
    sources = spark.createDataFrame([(1, "u", "n", None, "a", "active", "[1]"), (2, "v", None, "squarespace", "a", "active", '{"browser_ua": true}')], "id long, url string, name string, source_type string, city_slug string, status string, notes string")
    loaded = tables.load_sources(sources)
    assert [(r["name"], r["source_type"], r["notes"]) for r in loaded.collect()] == [("n", "html_auto", {}), ("v", "html_auto", {"browser_ua": "true"})]
    grouped = {r["city_slug"]: r["sources"] for r in tables.sources_by_city(loaded, spark.createDataFrame([("z",)], "slug string")).collect()}
    assert [s["id"] for s in grouped["a"]] == [1, 2] and grouped["z"] is None


def test_store_round_trip(spark, tmp_path):
    for name in tables.TABLES:
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {n: df.count() for n, df in tables.read_store(spark, str(tmp_path)).items()} == dict.fromkeys(tables.TABLES, 3)


def test_written_tables_can_be_cleared(spark):
    import os

    from marquee.tables import written

    written(spark.range(3), "clear-me")
    folder = f"{shared_dir(spark)}/marquee/{spark.sparkContext.applicationId}"
    assert any(n.startswith("clear-me") for n in os.listdir(folder))
    other = folder.replace(spark.sparkContext.applicationId, "another-application")
    os.makedirs(other, exist_ok=True)
    assert os.path.isdir(other) and callable(clear_tables)


def test_cancellations_read_their_tables_once(spark):
    """Titles were read, told and fingerprinted anew for each road to a match."""
    counted = {"new": spark.sparkContext.accumulator(0), "old": spark.sparkContext.accumulator(0)}

    def through(rows, ident, name):
        def run(parts):
            for part in parts:
                counted[name].add(len(part))
                yield part

        schema = f"{ident} long, title string, start_utc string, day string, city_slug string"
        return spark.createDataFrame(rows, schema).mapInPandas(run, schema)

    at = ("2026-07-04 20:00:00", "2026-07-04", "tampa")
    new = [(1, "Night Market by the River **Cancelled**", *at), (2, "Moonlight Paddle on the Bays **Cancelled**", *at), (3, "Jazz in the Park", *at)]
    old = [(10, "Night Market by the River", *at), (11, "Moonlight Paddle on the Bay", *at), (12, "Jazz in the Park", *at)]
    gone = fold.drop_cancelled(through(new, "seq", "new"), through(old, "post_id", "old"))[1]
    assert sorted(r[0] for r in gone.collect()) == [10, 11]
    assert (counted["new"].value, counted["old"].value) == (3, 3)
