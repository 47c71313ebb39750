"""The weekly digest: the next events of each city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.display import call_to_action, long_date
from marquee.functions.times import guess_timezone
from marquee.operators.store import pivot_meta, to_postmeta

KEYS = ["start_utc", "city_slug", "ticket_url", "thumb_id", "cost"]


def as_store(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings as posts and long attributes."""
    n = F.col("post_id")
    meta = to_postmeta(listings.where("post_status <> 'trash'"), {"start_utc": F.col("start_utc"), "city_slug": F.col("city_slug"), "ticket_url": F.col("ticket_url"), "thumb_id": F.col("thumb_id"), "cost": F.when(n % 4 == 0, F.concat(F.lit("$"), (n % 50).cast("string")))})
    return listings.select("post_id", "post_title", "post_content", "post_status"), meta


def upcoming(events: DataFrame, as_of: str, days: int, zone: Column | None = None) -> DataFrame:
    """Events that start within so many days of as_of, a UTC time; in the given zone's time, where clocks may change in
    between. Texts of this form order as times do; what is no time is not upcoming."""
    now = F.lit(as_of).cast("timestamp")
    there = (lambda t: F.from_utc_timestamp(t, zone)) if zone is not None else (lambda t: t)
    start, until = there(now), there(now) + F.expr(f"interval {days} days")
    shown = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    own = F.col("start_utc") if zone is None else shown(there(F.try_to_timestamp("start_utc")))
    return events.where((own >= shown(start)) & (own < shown(until)))


def weekly_digest(posts: DataFrame, meta: DataFrame, as_of: str, k: int = 8, days: int = 7) -> DataFrame:
    """The first k published events of each city in the coming days of its own time, with display fields.

    The week is filtered before the join and the ranking, so these see one week's rows."""
    zone = guess_timezone(F.col("city_slug"))
    week = upcoming(pivot_meta(meta, KEYS), as_of, days, zone)
    events = week.join(posts.where("post_status = 'publish'"), "post_id")
    rank = F.row_number().over(Window.partitionBy("city_slug").orderBy("start_utc", "post_id"))
    top = events.withColumn("rank", rank).where(F.col("rank") <= k)
    text = F.coalesce("post_content", F.lit(""))
    short = F.when(F.char_length(text) > 120, F.concat(F.substring(text, 1, 120), F.lit("…"))).otherwise(text)
    url = F.coalesce("ticket_url", F.concat(F.lit("https://example.com/events/"), F.col("post_id").cast("string"), F.lit("/")))
    local = F.date_format(F.from_utc_timestamp(F.try_to_timestamp("start_utc"), zone), "yyyy-MM-dd HH:mm:ss")
    return top.select(
        "city_slug", F.col("rank").cast("long").alias("rank"), "post_id", "post_title", "start_utc", local.alias("start_local"), long_date(local).alias("shown"), url.alias("url"),
        call_to_action(F.col("ticket_url")).alias("action"), "thumb_id", F.coalesce("cost", F.lit("")).alias("cost"), short.alias("description"),
    )
