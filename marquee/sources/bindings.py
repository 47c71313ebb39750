"""The content store's tables as views of the driver's tables: each as a DataFrame, and as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postmeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meta_id, post_id, meta_key, meta_value; pairs repeat."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("meta_id"), F.col("user_id").alias("post_id"), F.col("event_type").alias("meta_key"), F.floor(F.col("value") * 100).cast("string").alias("meta_value"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 10 == 0, "draft").when(F.col("doc_id") % 10 == 1, "trash").otherwise("publish")
    title = F.substring(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)), 1, 80)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), title.alias("post_title"), F.col("text").alias("post_content"), status.alias("post_status"), F.col("source").alias("source_name"), F.col("lang").alias("city_slug"))


def live_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that aren't in the trash, with their local start (the table's cities are all of the default zone)."""
    local = F.date_format(F.from_utc_timestamp(F.try_to_timestamp("start_utc"), "America/Chicago"), "yyyy-MM-dd HH:mm:ss")
    return listings(spark, sf_dir).where("post_status <> 'trash'").withColumn("start_local", local)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with city, start, image and ticket link; the date follows from the title, so that copies meet."""
    n = F.col("post_id")
    day, hour = (F.lpad(x.cast("string"), 2, "0") for x in (1 + F.ascii("post_title") % 28, n % 24))
    link = lambda front, back="": F.concat(F.lit(front), n.cast("string"), F.lit(back))
    url = F.when(n % 5 == 1, link("https://tickets.example.com/e/", "?aaid=1")).when(n % 5 == 2, link("https://eventim.us/")).when(n % 5 == 3, link("https://w.example.org/r?u=https%3A%2F%2Fbox.example.net%2Fe%2F")).when(n % 5 == 4, link("https://www.venue.example.com/shows/"))
    return posts(spark, sf_dir).withColumns({"start_utc": F.concat(F.lit("2026-01-"), day, F.lit(" "), hour, F.lit(":00:00")), "thumb_id": F.when(n % 3 != 0, n + 1000000), "ticket_url": url})


POSTMETA = "postmeta AS (SELECT event_id AS meta_id, user_id AS post_id, event_type AS meta_key, CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS meta_value FROM events)"
POSTS = """posts AS (SELECT doc_id AS post_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS post_title, text AS post_content,
    CASE WHEN doc_id % 10 = 0 THEN 'draft' WHEN doc_id % 10 = 1 THEN 'trash' ELSE 'publish' END AS post_status, source AS source_name, lang AS city_slug FROM documents)"""
LISTINGS = POSTS + """, listings AS (SELECT *, '2026-01-' || lpad(CAST(1 + ascii(post_title) % 28 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(post_id % 24 AS VARCHAR), 2, '0') || ':00:00' AS start_utc,
    CASE WHEN post_id % 3 <> 0 THEN post_id + 1000000 END AS thumb_id,
    CASE post_id % 5 WHEN 1 THEN 'https://tickets.example.com/e/' || post_id || '?aaid=1' WHEN 2 THEN 'https://eventim.us/' || post_id
      WHEN 3 THEN 'https://w.example.org/r?u=https%3A%2F%2Fbox.example.net%2Fe%2F' || post_id WHEN 4 THEN 'https://www.venue.example.com/shows/' || post_id END AS ticket_url FROM posts)"""
