"""Running values in parts against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import upkeep
from marquee.operators.scans import running


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_running_values_equal_a_plain_scan(spark, size):
    draw = random.Random(size)
    rows = [(draw.choice(["a", "a", "a", "b", None]), seq * seq, draw.choice([None, 1, 2, 5]), draw.choice([None, "x", "y"])) for seq in range(90)]
    df = spark.createDataFrame(rows, "k string, seq long, n int, t string").repartition(3)
    values = {"low": (F.col("n"), "min", False), "high": (F.col("n"), "max", True), "total": (F.col("n"), "sum", False), "named": (F.col("t"), "last", True), "prior": (F.col("t"), "last", False)}
    got = {r["seq"]: (r["k"], r["low"], r["high"], r["total"], r["named"], r["prior"]) for r in running(df, ["k"], "seq", values, size).collect()}
    want, held = {}, {}
    for k, seq, n, t in rows:
        ns, ts = held.setdefault(k, ([], []))
        low, total, prior = min(ns, default=None), sum(ns) if ns else None, ts[-1] if ts else None
        ns += [n] if n is not None else []
        ts += [t] if t is not None else []
        want[seq] = (k, low, max(ns, default=None), total, ts[-1] if ts else None, prior)
    assert got == want
    assert running(df.where("false"), ["k"], "seq", values, size).count() == 0


def test_a_page_of_very_many_rows_is_scanned_in_parts(spark):
    n = 400_000
    page = F.when(F.col("id") < n, 1).otherwise(2)
    rows = spark.range(n + 50).select(page.alias("page_id"), F.col("id").alias("pos"), F.when(F.col("id") % 70_000 == 5, F.concat(F.lit("h"), "id")).alias("heading"))
    out = upkeep.section_anchor(rows, rows_a_part=20_000)
    expected = F.when(F.col("pos") >= n, None).when(F.col("pos") >= 5, F.concat(F.lit("h"), (F.floor((F.col("pos") - 5) / 70_000) * 70_000 + 5).cast("string")))
    assert out.where(~F.col("anchor").eqNullSafe(expected)).count() == 0 and out.count() == n + 50
    # The largest task of the last scan holds a range, not the page.
    assert max(r["count"] for r in out.groupBy("page_id", F.floor(F.col("pos") / 20_000)).count().collect()) <= 20_000
