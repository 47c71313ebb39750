import difflib

import pytest
from pyspark.sql import functions as F

from marquee.functions import category, urls
from marquee.functions import text as T

PAIRS = [
    ("WWE Monday Night RAW", "WWE Monday Night RAW | Official BJCC Ticket + Hotel Packages", 1.0),
    ("Amber Wallin at Growlers – Memphis, TN", "Amber Wallin @ Growlers", 1.0),
    ("Edge of Paradise and Starkill", "Edge Of Paradise & Starkill", 1.0),
    ("Blues Traveler", "Blues Traveler w/ Better Than Ezra", 0.5833),
    ("Birmingham Legion FC vs. Brooklyn FC", "Birmingham Legion FC vs Brooklyn FC", 0.9859),
    ("Tedeschi Trucks Band", "Tedeschi Trucks Band (Night 2)", 0.8),
    ("blues travel", "blues traveler", 0.9231),
]


def test_ratio_of_normalised_titles(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i int, a string, b string")
    n = df.select("i", T.normalize_title(F.col("a")).alias("a"), T.normalize_title(F.col("b")).alias("b"))
    rows = n.select("*", T.title_ratio("a", "b").alias("r"), T.ratio_bound(F.col("a"), F.col("b")).alias("bound")).orderBy("i").collect()
    for (_, _, want), r in zip(PAIRS, rows, strict=True):
        assert r["r"] == pytest.approx(want, abs=1e-4)
        assert r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() <= r["bound"] + 1e-12


def test_normalised_titles(spark):
    rows = {"A - B - Memphis, TN": "a", "X (Live) (16+)": "x", "X (Night 2)": "x (night 2)", "X (Night 2) (Live)": "x (night 2)", None: "", "  Y *** CANCELLED *** ": "y"}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.normalize_title(F.col("t"))).collect()} == rows


def test_flags_prefix_and_tokens(spark):
    df = spark.createDataFrame([("blues traveler", "blues traveler w/ better than ezra"), ("blues travel", "blues traveler"), ("colorado symphony: hans zimmer", "the colorado symphony performs the music of hans zimmer")], "a string, b string")
    got = df.select(T.is_headliner_prefix(F.col("a"), F.col("b")), T.contains_tokens(T.tokens(F.col("a")), T.tokens(F.col("b")))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]


def test_categories(spark):
    df = spark.createDataFrame([(["Arts & Theatre", "Comedy"], "x"), (["Miscellaneous"], "jazz night"), (None, "Trotsky at the Trapeze, Console of Babylon"), (None, "Jazz night")], "g array<string>, t string")
    got = [r[0] for r in df.select(category.categorize(F.col("g"), F.col("t"), F.lit(None).cast("string"))).collect()]
    assert got == ["comedy", "more-to-do", "more-to-do", "live-music-concerts"]


def test_urls(spark):
    df = spark.createDataFrame([("https://w.example.org/r?u=https%3A%2F%2Fa.example.com%2Fx%3Fy&z=1",), ("https://www.A.example.com/one/two?q",), (None,)], "u string")
    u = F.col("u")
    got = [tuple(r) for r in df.select(urls.unwrap_redirect(u, "w.example.org"), urls.host(u), urls.first_path_segment(u), urls.path_depth(u), urls.affiliate_rank(u)).collect()]
    assert got[0][0] == "https://a.example.com/x?y"
    assert got[1][1:4] == ("a.example.com", "one", 2)
    assert got[2] == (None, "", "", 0, None)
