"""Reports of jobs: fetches that gave nothing, categories and fingerprints that would change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import category
from marquee.functions import text as T

# Causes in the order of the report.
CAUSES = ("no_url_configured", "needs_browser_ua", "needs_html_relay", "likely_js_rendered_empty_shell", "markup_not_matched", "dead_domain_or_connection_error", "other_http_status")


def triage(fetches: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, cause, detail) of each source (source_id, url) without events, from the log of its last fetch
    (source_id, http_status, browser_ua_status, n_bytes, html, error). A source without a log counts as unreachable."""
    status, browser, low = F.col("http_status"), F.col("browser_ua_status"), F.lower(F.coalesce("html", F.lit("")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    shell = (F.char_length(low) < 3000) & ~F.contains(low, F.lit("/event"))
    refused = status.isin(403, 406, 429, 202)
    cause = (
        F.when(F.trim(F.coalesce("url", F.lit(""))) == "", "no_url_configured").when(F.col("error").isNotNull() | status.isNull(), "dead_domain_or_connection_error")
        .when((status == 200) & shell, "likely_js_rendered_empty_shell").when(status == 200, "markup_not_matched")
        .when(refused & F.coalesce(browser == 200, F.lit(False)), "needs_browser_ua").when(refused, "needs_html_relay").otherwise("other_http_status")
    )
    out = sources.select("source_id", "url").join(fetches.drop("url"), "source_id", "left").withColumn("cause", cause)
    size = text(F.coalesce("n_bytes", F.lit(0)))
    detail = (
        F.when(F.col("cause") == "no_url_configured", "no fix possible without adding a URL").when(F.col("cause") == "dead_domain_or_connection_error", F.coalesce("error", F.lit("no fetch logged")))
        .when(F.col("cause") == "likely_js_rendered_empty_shell", F.concat(size, F.lit(" bytes, no event links in raw HTML"))).when(F.col("cause") == "markup_not_matched", F.concat(size, F.lit(" bytes fetched, no tier matched")))
        .when(F.col("cause") == "needs_browser_ua", F.concat(F.lit("plain "), text(status), F.lit(", browser 200")))
        .when(F.col("cause") == "needs_html_relay", F.concat(F.lit("blocked on plain "), text(status), F.lit(" and browser "), F.coalesce(browser.cast("string"), F.lit("failed"))))
        .otherwise(F.concat(F.lit("HTTP "), text(status)))
    )
    return out.select("source_id", "cause", detail.alias("detail"))


def triage_summary(triaged: DataFrame) -> DataFrame:
    """Causes with their number of sources, in the order of the report."""
    place = F.array_position(F.array(*[F.lit(c) for c in CAUSES]), F.col("cause")).cast("int")
    return triaged.groupBy("cause").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place")


def recategorize(posts: DataFrame, raw: DataFrame, current: DataFrame) -> DataFrame:
    """(post_id, current, new, changed) of posts (post_id, post_title, post_content). raw: post_id and its saved genres, a
    JSON list that counts as empty when damaged; current: post_id and the slugs it has, sorted."""
    rows = posts.join(raw.select("post_id", F.from_json("raw_categories", "array<string>").alias("genres")), "post_id", "left").join(current.select("post_id", F.col("slugs").alias("current")), "post_id", "left")
    new = F.array(category.categorize(F.col("genres"), F.col("post_title"), F.col("post_content")))
    now = F.coalesce("current", F.array().cast("array<string>"))
    return rows.select("post_id", now.alias("current"), new.alias("new"), (now != new).alias("changed"))


def recompute_fingerprints(events: DataFrame) -> DataFrame:
    """(post_id, old_fp, new_fp, changed, keeper, is_delete) of events (post_id, post_title, start_utc, start_local,
    city_slug, old_fp) with a city and a start; the earliest post of a new fingerprint stays."""
    start = F.when(F.coalesce("start_utc", F.lit("")) != "", F.col("start_utc")).otherwise(F.coalesce("start_local", F.lit("")))
    known = events.where((F.coalesce("city_slug", F.lit("")) != "") & (start != ""))
    keyed = known.select("post_id", "old_fp", T.fingerprint(F.col("post_title"), start, F.col("city_slug")).alias("new_fp"))
    keepers = keyed.groupBy("new_fp").agg(F.min("post_id").alias("keeper"))
    out = keyed.join(keepers, "new_fp")
    return out.select("post_id", "old_fp", "new_fp", (F.col("new_fp") != F.coalesce("old_fp", F.lit(""))).alias("changed"), "keeper", (F.col("post_id") != F.col("keeper")).alias("is_delete"))


def fingerprint_summary(report: DataFrame) -> DataFrame:
    """n_changed, n_groups (fingerprints of several posts) and n_deletes."""
    groups = report.where("is_delete").agg(F.count_distinct("new_fp").alias("n_groups"), F.count("*").alias("n_deletes"))
    return report.agg(F.count_if("changed").alias("n_changed")).withColumn("one", F.lit(1)).join(groups.withColumn("one", F.lit(1)), "one").drop("one")
