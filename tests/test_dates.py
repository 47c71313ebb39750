"""Loose dates: forms in Spark against the parser that reads the rest."""

import random

from pyspark.sql import functions as F

from marquee.functions import dates

MONTHS = ["January", "Feb", "march", "Apr.", "MAY", "Jun", "July", "August", "Sept", "October", "Nov", "December"]


def _said(draw):
    month, day, year = draw.choice(MONTHS), draw.randint(1, 31), draw.choice([1999, 2020, 2021, 2026, 2030])
    time = draw.choice(["", "", " 7pm", " 7:30 PM", ", 11 am", " at 12:05 am", " 19:45", " 12 pm", " 25:00", " 13 pm", " 0:15"])
    suffix = draw.choice(["", "", "th", "st"])
    front = draw.choice(["", "", "on ", "Thu, ", "Friday ", "On Sat. "])
    forms = [f"{front}{month} {day}{suffix}, {year}{time}", f"{front}{day}{suffix} {month} {year}{time}", f"{front}{draw.randint(1, 14)}/{day}/{year}{time}", f"{year}-{draw.randint(1, 13):02d}-{day:02d}" + draw.choice(["", " 20:15", "T09:00:30"]), f"{front}{month} {day}{suffix}{time}"]
    others = ["", "doors at seven", "TBA", "soon", "2026", f"the show is on {month} {day} of {year}", f"{month} {year}", "Fri", "12/25/21 8pm", None, "8 pm"]
    return draw.choice([*forms, *forms, draw.choice(others)])


def test_forms_read_what_the_parser_reads(spark):
    draw = random.Random(7)
    rows = [(i, _said(draw), draw.choice([None, "2026-01-01", "2027-01-01"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, said string, anchor string")
    want = {r["id"]: r["found"] for r in df.select("id", dates.parse_loose_date(F.col("said"), F.col("anchor")).alias("found")).collect()}
    out = dates.loose_dates(df, "said", "anchor")
    assert out.columns == ["id", "said", "anchor", "found"]
    got = {r["id"]: r["found"] for r in out.collect()}
    assert [(rows[i], got[i], want[i]) for i in want if got[i] != want[i]][:20] == [] and len(got) == len(rows)
    by_form = df.select(dates._by_form(F.col("said"), F.col("anchor")).alias("f")).where("f IS NOT NULL").count()
    assert by_form > 0.6 * len(rows)
    alone = {r["id"]: r["found"] for r in dates.loose_dates(df, "said").collect()}
    plain = {r["id"]: r["found"] for r in df.select("id", dates.parse_loose_date(F.col("said")).alias("found")).collect()}
    assert alone == plain
    assert dates.loose_dates(df.where("false"), "said").count() == 0


def test_the_parser_sees_distinct_residue_alone(spark):
    """Of 10,000 rows, a fifth of them in no form, the parser gets the distinct texts."""
    df = spark.range(10_000).select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("some day "), (F.col("id") % 3).cast("string"))).otherwise("March 5 2026 7:30 PM").alias("said"))
    rest = df.where(dates._by_form(F.col("said"), F.lit(None).cast("string")).isNull()).select("said").distinct()
    assert rest.count() == 3
    plan = dates.loose_dates(df, "said")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("ArrowEvalPython") :]
