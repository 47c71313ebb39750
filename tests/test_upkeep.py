import difflib
import json

from marquee.functions import text as T
from marquee.functions import times
from marquee.operators import match, upkeep
from marquee.streaming import ingest


def _one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).collect()[0][0]


def test_times_fill_each_other(spark):
    columns = ["start_utc", "start_local", "end_utc", "end_local", "start_date", "end_date", "timezone"]
    rows = [
        ("2026-07-01 01:00:00", None, None, None, None, None, "America/Denver"),
        (None, "2026-07-01 20:00:00", None, "2026-07-01 21:00:00", None, None, None),
        (None, None, None, None, "2026-03-08 02:30:00", "", "bad"),
        (None, None, None, None, "soon", None, "UTC"),
    ]
    got = [tuple(r) for r in times.resolve_times(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))).select(columns[:4]).collect()]
    assert got[0] == ("2026-07-01 01:00:00", "2026-06-30 19:00:00", "2026-07-01 03:00:00", "2026-06-30 21:00:00")
    assert got[1] == ("2026-07-02 01:00:00", "2026-07-01 20:00:00", "2026-07-02 02:00:00", "2026-07-01 21:00:00")
    assert got[2][0] == "2026-03-08 08:30:00"
    assert got[3] == ("soon", "soon", "soon", "soon")


def test_dates(spark):
    from pyspark.sql import functions as F

    for raw, want in (("1767225600", "2026-01-01 00:00:00"), ("2026-01-02T03:04:05-06:00", "2026-01-02 03:04:05"), ("2026-01-02T03:04", "2026-01-02 03:04:00"), ("on 2026-01-02", "2026-01-02 00:00:00"), ("soon", ""), (None, "")):
        assert _one(spark, times.normalize_datetime(F.col("a")), a=raw) == want
    for raw, want in (("January 5, 2026", "2026-01-05"), ("1/5/2026", "2026-01-05"), ("5 January 2026", "2026-01-05"), ("x 2026-01-05 y", "2026-01-05"), ("never", "None")):
        assert str(_one(spark, times.venue_date(F.col("a")), a=raw)) == want


def test_observed_times_follow_the_fold(spark):
    rows = [(p, q, s) for p, starts in enumerate([["9", "7", "8", "7"], ["7", "", "9", "8"], ["7", None], ["", "5"], ["3"]]) for q, s in enumerate(starts)]
    got = {r["post_id"]: (r["seq"], r["start_utc"]) for r in upkeep.resolve_observed_times(spark.createDataFrame(rows, "post_id long, seq long, start_utc string"), ["seq", "start_utc"]).collect()}
    want = {}
    for p, q, s in rows:  # one after another
        if p not in want or not (want[p][1] and s and s > want[p][1]):
            want[p] = (q, s)
    assert got == want


def test_filters_take_nulls_and_empty_tables(spark):
    events = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", ""), (4, None, None)], "post_id long, source_name string, image_url string")
    sources = spark.createDataFrame([("a", True), ("b", None)], "source_name string, require_image boolean")
    assert sorted(r[0] for r in upkeep.require_image(events, sources).collect()) == [2, 3, 4]
    assert upkeep.require_image(events.where("false"), sources).count() == 0
    links = spark.createDataFrame([(1, "p", "e"), (2, "p", "e"), (3, "p", "e"), (4, "p", "x"), (5, "q", "e")], "id long, page string, segment string")
    assert sorted(r[0] for r in upkeep.dominant(links, ["page"], "segment", 3, 0.5).collect()) == [1, 2, 3]


def test_merge_is_applied(spark):
    posts = spark.createDataFrame([(1, None, None), (2, "u", 5), (3, "v", 6)], "post_id long, ticket_url string, thumb_id long")
    planned = spark.createDataFrame([(1, 2, "u", 5)], "primary_id long, secondary_id long, new_url string, new_thumb long")
    meta = spark.createDataFrame([(1,), (2,), (2,), (3,)], "post_id long")
    kept, children = upkeep.apply_merge(posts, planned, {"meta": (meta, "post_id")})
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "u", 5), (3, "v", 6)]
    assert sorted(r[0] for r in children["meta"].collect()) == [1, 3]


def test_match_existing_agrees_with_brute_force(spark):
    titles = ["Blues Traveler", "Blues Traveler w/ Better Than Ezra", "Tedeschi Trucks Band", "Tedeschi Trucks Band (Night 2)", "blues travel", "Other Thing", None]
    existing = spark.createDataFrame([(i, t, "2026-01-01", "m") for i, t in enumerate(titles)], "post_id long, title string, day string, city_slug string")
    new = spark.createDataFrame([(10, "Blues Traveler", "2026-01-01", "m"), (11, "Tedeschi Truck Band", "2026-01-01", "m"), (12, "Other Thing", "2026-01-02", "m"), (13, None, "2026-01-01", "m")], "seq long, title string, day string, city_slug string")
    got = {r["seq"]: r["post_id"] for r in match.match_existing(new, existing).collect()}
    assert got == {10: 0, 11: 2}


def test_match_listings_takes_close_days(spark):
    weak = spark.createDataFrame([(1, "The Big Show!", "2026-01-05", "v", "m"), (2, "Nothing like it", None, "v", "m")], "post_id long, title string, day string, venue_name string, city_slug string")
    rows = [(7, "Big Show", "2026-01-09", "v", "m"), (8, "the big show", "2026-01-07", "v", "m"), (9, "big shows", None, "v", "m"), (10, "the big show", "2026-01-05", "w", "m")]
    listings = spark.createDataFrame(rows, "listing_id long, title string, day string, venue_name string, city_slug string")
    got = [tuple(r) for r in match.match_listings(weak, listings).collect()]
    assert got == [(1, 8, difflib.SequenceMatcher(None, "the big show", "the big show").ratio())]
    names = spark.createDataFrame([(1, "m", "Minglewood Hall")], "source_id long, city_slug string, name string")
    new = spark.createDataFrame([(5, "m", "Minglewood  Hall"), (6, "x", "Minglewood Hall"), (7, "m", None)], "candidate_id long, city_slug string, name string")
    assert [r["candidate_id"] for r in match.duplicate_sources(new, names).collect()] == [5]


def _land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_gives_one_post_a_fingerprint(spark, tmp_path):
    show = {"seq": 1, "title": "A Show", "start_utc": "2026-01-02 20:00:00", "city_slug": "m"}
    _land(tmp_path / "in", "1.json", [show, {**show, "seq": 2, "title": "*** CANCELLED *** B"}, {**show, "seq": 3, "title": " "}])
    paths = [str(tmp_path / d) for d in ("in", "store", "check")]
    ingest.ingest_stream(spark, *paths).awaitTermination()
    assert ingest.enrichment_queue(ingest.read_posts(spark, paths[1])).count() == 1
    _land(tmp_path / "in", "2.json", [{**show, "seq": 1, "start_utc": "2026-01-02 18:00:00", "description": "text"}, {**show, "seq": 2, "start_utc": "2026-01-02 22:00:00", "description": "late"}])
    ingest.ingest_stream(spark, *paths).awaitTermination()
    ingest.ingest_stream(spark, *paths).awaitTermination()  # nothing new
    posts = ingest.read_posts(spark, paths[1])
    assert [(r["title"], r["start_utc"], r["description"], r["n_observed"]) for r in posts.collect()] == [("A Show", "2026-01-02 18:00:00", "text", 3)]
    results = spark.createDataFrame([(posts.collect()[0]["fp"], "other")], "fp string, text string")
    assert ingest.apply_enrichment(posts, results).collect()[0]["description"] == "text"
    assert T.THRESHOLD == 0.8
