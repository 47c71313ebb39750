"""Malformed times, workers that start elsewhere, and matches by day against all pairs."""

import difflib
import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from marquee.functions import times
from marquee.operators import match, store, upkeep
from marquee.plans import digest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_malformed_times_are_no_times(spark):
    posts = spark.createDataFrame([(i, f"t{i}", "x", "publish") for i in range(4)], "post_id long, post_title string, post_content string, post_status string")
    starts = ["2026-01-09 20:00:00", "TBA", "2026-13-45 99:00:00", None]
    meta = spark.createDataFrame([(i, "start_utc", s) for i, s in enumerate(starts)] + [(i, "city_slug", "memphis") for i in range(4)], "post_id long, meta_key string, meta_value string")
    assert [r["post_id"] for r in digest.weekly_digest(posts, meta, "2026-01-08 00:00:00").collect()] == [0]
    events = spark.createDataFrame([(i, s, s) for i, s in enumerate(starts)], "post_id long, start_utc string, end_utc string")
    assert [r["post_id"] for r in digest.upcoming(events, "2026-01-08 00:00:00", 7, F.lit("America/Chicago")).collect()] == [0]
    shown = {r["post_id"]: (r["start_local"], r["duration"]) for r in store.calendar_index(events).collect()}
    assert shown == {0: ("2026-01-09 14:00:00", 7200), 1: (None, 7200), 2: (None, 7200), 3: (None, 7200)}
    close = spark.createDataFrame([("2026-01-01", "2026-01-03"), ("TBA", "2026-01-03"), (None, "x")], "a string, b string").select(times.dates_close(F.col("a"), F.col("b")))
    assert [r[0] for r in close.collect()] == [True, False, False]


def test_venues_with_a_malformed_check_are_checked(spark):
    import inspect

    assert "try_cast" in inspect.getsource(upkeep.venues_to_check)


def _plain(t):
    import re

    return re.sub(r"[^\w\s]", "", (t or "").strip(" ").lower())


def test_listings_match_like_all_pairs_within_days(spark):
    draw = random.Random(3)
    days = ["2026-02-27", "2026-02-28", "2026-03-01", "2026-03-02", "2026-03-05", None, "TBA", ""]
    make = lambda i: (i, draw.choice(["Blues Night", "Blues Nite", "Jazz Trio!", "The Jazz Trio", "Open Mic", ""]) + draw.choice(["", " live", " II"]), draw.choice(days), draw.choice(["hall", "room"]), draw.choice(["m", "n"]))
    weak, listings = [make(i) for i in range(60)], [make(i) for i in range(60)]
    columns = "title string, day string, venue_name string, city_slug string"
    w, l = spark.createDataFrame(weak, f"post_id long, {columns}"), spark.createDataFrame(listings, f"listing_id long, {columns}")
    date = lambda d: None if d in (None, "TBA", "") else __import__("datetime").date.fromisoformat(d)
    want, close = {}, set()
    for i, t, d, v, c in weak:
        for j, u, e, x, y in listings:
            if (v, c) == (x, y) and (date(d) is None or date(e) is None or abs((date(d) - date(e)).days) <= 2):
                close.add((i, j))
                ratio = difflib.SequenceMatcher(None, _plain(u), _plain(t)).ratio()
                if ratio >= 0.6 and (i not in want or (ratio, -j) > (want[i][1], -want[i][0])):
                    want[i] = (j, ratio)
    got = {r["post_id"]: (r["listing_id"], r["ratio"]) for r in match.match_listings(w, l).collect()}
    assert got == want and want
    a, b = match.in_day_slots(w, l, 2, "post_id", "listing_id")
    met = [tuple(r) for r in a.drop("text").join(b.drop("text"), ["venue_name", "city_slug", "slot"]).select("post_id", "listing_id").collect()]
    assert len(met) == len(set(met)) and set(met) == close


def test_workers_find_the_library_from_another_folder(tmp_path):
    """The library is found by sys.path alone, as where an entry script names it; workers start without PYTHONPATH."""
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
from marquee.functions import dates, text
from marquee.operators import match
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
one = spark.createDataFrame([("March 5th, 2026 at 8pm", "Blues Night", "Blues Nite")], "d string, a string, b string")
print(one.select(dates.parse_loose_date(F.col("d")).alias("d"), text.title_ratio(F.col("a"), F.col("b")).alias("r")).collect())
rows = [(1, "Blues Night", "2026-03-01", "hall", "m")]
columns = "title string, day string, venue_name string, city_slug string"
print("MATCHED", match.match_listings(spark.createDataFrame(rows, "post_id long, " + columns), spark.createDataFrame(rows, "listing_id long, " + columns)).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "MATCHED 1" in out.stdout, out.stderr[-2000:]
