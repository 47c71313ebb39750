"""Registered queries of filters, lookups, audits and times, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.functions import html, times, urls
from marquee.operators import match, resolve, upkeep
from marquee.operators.store import to_postmeta
from marquee.plans.registry import _FP, _TITLES, AS_OF, register
from marquee.sources import bindings as B

_HOST = r"regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '')"


def _linked(c: str = "post_id") -> F.Column:
    return F.col(c).cast("string")


@register(f"WITH {B.LISTINGS} SELECT post_id FROM listings WHERE thumb_id IS NOT NULL OR source_name IS NULL OR source_name NOT IN ('src1', 'src3')")
def p1_require_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir).select("post_id", "source_name", F.col("thumb_id").cast("string").alias("image_url"))
    sources = rows.select("source_name").distinct().withColumn("require_image", F.col("source_name").isin("src1", "src3"))
    return upkeep.require_image(rows, sources).select("post_id")


@register(f"WITH {B.POSTS} SELECT post_id FROM posts WHERE post_id % 9 < 2 OR regexp_matches(post_title, '(?i){T.CANCELLED}')")
def p2_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, title = F.col("post_id"), F.col("post_title")
    said = F.when(n % 9 == 0, F.concat(title, F.lit(" **Cancelled**"))).when(n % 9 == 1, F.concat(F.lit(" cancelled: "), title)).when(n % 9 == 2, F.concat(F.lit("Canceled plans "), title)).otherwise(title)
    return upkeep.cancelled_events(B.posts(spark, sf_dir).select("post_id", said.alias("post_title"))).select("post_id")


@register(f"WITH {B.POSTS} SELECT post_id, post_status FROM posts WHERE post_status <> 'trash'")
def p3_live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.live_events(B.posts(spark, sf_dir)).select("post_id", "post_status")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listings(spark, sf_dir).select("post_id", F.concat(F.when(F.col("post_id") % 3 == 0, "tm_").otherwise("tec_"), _linked()).alias("external_id"))


@register(f"WITH {B.LISTINGS} SELECT post_id, 'ticket_url' AS meta_key, 'https://t.example.com/e/' || post_id || '?r=1' AS meta_value FROM listings WHERE post_status = 'publish' AND post_id % 3 = 0 AND ticket_url IS NULL")
def p6_backfill_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir)
    return upkeep.backfill_ticket_urls(rows, _ids(spark, sf_dir), to_postmeta(rows, {"ticket_url": F.col("ticket_url")}), "https://t.example.com/e/", "?r=1")


@register(f"WITH {B.LISTINGS}, {B.POSTMETA} SELECT post_id, 'tm_' || post_id AS external_id FROM listings WHERE post_id % 3 = 0 AND post_id NOT IN (SELECT post_id FROM postmeta WHERE meta_key = 'click' AND post_id IS NOT NULL)")
def p7_missing_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.missing_raw_categories(_ids(spark, sf_dir), B.postmeta(spark, sf_dir), key="click").select("post_id", "external_id")


@register("SELECT c_custkey, lower(c_mktsegment) AS city_slug FROM customer WHERE c_nationkey % 3 = 1")
def p8_filter_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = B.read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("city"), F.when(F.col("c_nationkey") % 3 == 1, "tn").otherwise("al").alias("state"))
    filters = raw.select(F.trim("city").alias("city"), F.lit("TN").alias("state"), F.lower(F.trim("city")).alias("city_slug")).distinct()
    return upkeep.filter_by_city(raw, filters).select("c_custkey", "city_slug")


@register("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0")
def p10_select_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    status = F.when(n % 3 == 0, "rejected").when(n % 3 == 1, "active").otherwise("probation")
    rows = B.read(spark, sf_dir, "supplier").select(n.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("city_slug"), status.alias("status"))
    return upkeep.select_sources(rows, ["active", "probation"]).select("id", "name")


@register(f"WITH {B.POSTS} SELECT post_id FROM posts WHERE trim(coalesce(post_content, '')) = '' OR post_id % 7 = 0")
def p11_needs_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.needs_enrichment(B.posts(spark, sf_dir).select("post_id", F.col("post_content").alias("description"), (F.col("post_id") % 7 == 0).alias("needs_enrichment"))).select("post_id")


@register(f"WITH {B.POSTS} SELECT e.post_id, v.post_title AS venue_name, 'https://img.example.com/' || i.post_id AS image_url FROM posts e LEFT JOIN posts v ON v.post_id = e.post_id % 50 LEFT JOIN posts i ON i.post_id = e.post_id + 7")
def j11_venue_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir).select("post_id", "post_title", F.concat(F.lit("https://img.example.com/"), _linked()).alias("guid"))
    events = posts.select("post_id", (F.col("post_id") % 50).alias("venue_id"), (F.col("post_id") + 7).alias("thumb_id"))
    return upkeep.attach_venue_image(events, posts).select("post_id", "venue_name", "image_url")


def _taxonomies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("term_taxonomy_id"), F.col("s_nationkey").alias("term_id"), F.when(F.col("s_suppkey") % 2 == 0, "city").otherwise("category").alias("taxonomy"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("term_taxonomy_id"))


@register("SELECT l_orderkey AS post_id, string_agg(DISTINCT lower(n_name), ',' ORDER BY lower(n_name)) AS slugs FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0 GROUP BY 1")
def j12_post_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("term_id"), F.lower("n_name").alias("slug"))
    return upkeep.post_terms(_relations(spark, sf_dir), _taxonomies(spark, sf_dir), terms, "city").withColumn("slugs", F.array_join("slugs", ","))


@register(f"""WITH {B.LISTINGS}, v AS (SELECT DISTINCT source_name AS venue_name, city_slug FROM listings WHERE trim(coalesce(source_name, '')) <> '')
  SELECT venue_name, city_slug FROM v WHERE venue_name NOT IN ('src1', 'src2') OR city_slug IS NULL OR venue_name = 'src2' ORDER BY 1, 2 NULLS FIRST LIMIT 50""")
def j14_venues_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.listings(spark, sf_dir).select(F.col("source_name").alias("venue_name"), "city_slug")
    old = F.col("venue_name") == "src2"
    cache = events.where(F.col("venue_name").isin("src1", "src2")).distinct().select("venue_name", "city_slug", F.lit("https://venue.example.com/events").alias("events_url"), F.lit("active").alias("status"), F.when(old, "2025-11-01 00:00:00").otherwise("2025-12-30 00:00:00").alias("last_checked"))
    return upkeep.venues_to_check(events, cache, AS_OF)


@register(f"""WITH {B.LISTINGS}, w AS (SELECT post_id, substr(post_content, 1, 60 + 60 * (post_id % 2)) AS old, CAST(thumb_id AS VARCHAR) AS pic, CASE WHEN post_id % 5 <> 0 THEN trim(coalesce(substr(post_content, 1, 200), '')) END AS new FROM listings)
  SELECT post_id, CASE WHEN length(new) > 80 AND length(coalesce(old, '')) < 100 THEN new ELSE old END AS description, CASE WHEN pic IS NULL AND post_id % 5 <> 0 THEN 'https://img.example.com/' || post_id ELSE pic END AS image_url,
    coalesce(length(new) > 80 AND length(coalesce(old, '')) < 100, false) OR (pic IS NULL AND post_id % 5 <> 0) AS upgraded FROM w""")
def j15_upgrade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = B.listings(spark, sf_dir), F.col("post_id")
    weak = rows.select("post_id", F.substring("post_content", F.lit(1), (60 + 60 * (n % 2)).cast("int")).alias("description"), F.col("thumb_id").cast("string").alias("image_url"))
    matches = rows.where(n % 5 != 0).select("post_id", F.substring("post_content", 1, 200).alias("description"), F.concat(F.lit("https://img.example.com/"), _linked()).alias("image_url"))
    return upkeep.upgrade_events(weak, matches)


@register(rf"SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY CASE WHEN regexp_matches(lower(url), '/events|/shows|/calendar|/schedule') THEN 0 ELSE 1 END, page_id) AS rank FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)")
def t2_rank_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.read(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    return upkeep.rank_urls(pages, ["host"], "page_id").select("page_id", "host", F.col("rank").cast("long").alias("rank"))


@register(f"WITH {B.LISTINGS} SELECT city_slug, post_id, ticket_url FROM listings WHERE ticket_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city_slug ORDER BY CASE post_id % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 9 END, post_id) = 1")
def t3_pick_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir).where("ticket_url IS NOT NULL")
    return upkeep.pick_first(rows, ["city_slug"], F.coalesce(urls.affiliate_rank(F.col("ticket_url")), F.lit(9)), ["post_id", "ticket_url"], "post_id")


@register("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, NULL AS part FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_type FROM part")
def u1_union_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    b = B.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("part"))
    return upkeep.union_feeds(a, b)


@register("SELECT o_custkey AS page_id, o_orderkey AS pos, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS anchor FROM orders")
def w7_section_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("heading"))
    return upkeep.section_anchor(rows).select("page_id", "pos", "anchor")


@register("""WITH o AS (SELECT user_id AS post_id, event_id AS seq, CASE WHEN event_type = 'error' THEN '' ELSE lpad(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), 9, '0') END AS start_utc FROM events),
  l AS (SELECT post_id AS p, max(seq) AS m FROM o WHERE coalesce(start_utc, '') = '' GROUP BY 1)
  SELECT post_id, seq, start_utc FROM o LEFT JOIN l ON p = post_id WHERE m IS NULL OR seq >= m QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY coalesce(start_utc, '') = '', start_utc, seq DESC) = 1""")
def w8_observed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("event_type") == "error", "").otherwise(F.lpad(F.floor(F.col("value") * 100).cast("string"), 9, "0"))
    seen = B.read(spark, sf_dir, "events").select(F.col("user_id").alias("post_id"), F.col("event_id").alias("seq"), start.alias("start_utc"))
    return upkeep.resolve_observed_times(seen, ["seq", "start_utc"])


@register(f"""WITH {B.POSTS}, {B.POSTMETA} SELECT 'posts' AS tab, count(*) AS n, CAST(0 AS BIGINT) AS n_orphans FROM posts
  UNION ALL SELECT 'postmeta', count(*), count(*) FILTER (WHERE post_id IS NULL OR post_id NOT IN (SELECT post_id FROM posts)) FROM postmeta
  UNION ALL SELECT 'relations', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT post_id FROM posts)) FROM lineitem""")
def a5_store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.store_health(B.posts(spark, sf_dir), {"postmeta": B.postmeta(spark, sf_dir), "relations": _relations(spark, sf_dir)})


@register("SELECT s_suppkey AS term_taxonomy_id, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def a6_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.term_counts(_relations(spark, sf_dir), _taxonomies(spark, sf_dir))


@register(f"WITH {B.LISTINGS} SELECT source_name, count(*) AS last_count, '{AS_OF}' AS last_run FROM listings GROUP BY 1")
def a7_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.source_stats(B.listings(spark, sf_dir), AS_OF)


@register(f"""WITH {B.LISTINGS}, e AS (SELECT city_slug || '-' || (post_id % 40) AS source_name, count(*) AS n_events, count(*) FILTER (WHERE substr(start_utc, 1, 10) >= '2026-01-27') AS n_upcoming,
    count(thumb_id) FILTER (WHERE post_id % 2 = 0) AS n_images, count(*) FILTER (WHERE post_id % 40 = 7) AS n_off_topic FROM listings WHERE city_slug IS NOT NULL GROUP BY 1)
  SELECT source_name, n_events, n_upcoming, n_images, n_off_topic, round(n_images / n_events, 2) AS image_rate,
    CASE WHEN source_name = 'en-1' OR n_events < 3 OR n_upcoming < 1 OR n_off_topic >= 0.5 * n_events THEN 'SKIP' WHEN n_images / n_events < 0.3 THEN 'REVIEW' ELSE 'WORTH_IT' END AS verdict,
    CASE WHEN source_name = 'en-1' THEN 'Likely duplicate of existing source ''en-0'' (name similarity)' WHEN n_events < 3 THEN 'Trial scrape returned only ' || n_events || ' events (min 3)'
      WHEN n_upcoming < 1 THEN 'No upcoming events -- calendar looks stale/dead' WHEN n_off_topic >= 0.5 * n_events THEN '100% of trial titles look off-topic (private/internal events)'
      WHEN n_images / n_events < 0.3 THEN 'Low image coverage (' || CAST(round_even(n_images / n_events * 100, 0) AS BIGINT) || '% of trial events)' ELSE 'Clean pass on all checks' END AS reason FROM e""")
def a8_score_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("post_id")
    rows = B.listings(spark, sf_dir).where("city_slug IS NOT NULL").withColumn("source_name", F.concat_ws("-", "city_slug", (n % 40).cast("string")))
    title = F.when(n % 40 == 7, F.concat(F.lit("Board Meeting: "), F.coalesce("post_title", F.lit("")))).otherwise(F.lit("A private show"))
    trial = rows.select("source_name", title.alias("title"), F.col("start_utc").alias("start_date"), F.when(n % 2 == 0, F.col("thumb_id").cast("string")).alias("image_url"))
    candidates = rows.select("source_name").distinct().withColumn("duplicate_of", F.when(F.col("source_name") == "en-1", "en-0"))
    return upkeep.score_sources(trial, candidates, "2026-01-27").select("source_name", "n_events", "n_upcoming", "n_images", "n_off_topic", "image_rate", "verdict", "reason")


@register("""WITH e AS (SELECT l_suppkey + l_suppkey % 2 AS s, count(*) AS n FROM lineitem GROUP BY 1), v AS (SELECT s_suppkey AS source_id, coalesce(n, 0) AS n_events FROM supplier LEFT JOIN e ON s = s_suppkey),
  w AS (SELECT *, CASE WHEN n_events >= 1190 THEN 'PROMOTE' WHEN n_events = 0 AND source_id % 3 <> 0 THEN 'REJECT' ELSE 'REVIEW' END AS verdict FROM v)
  SELECT *, CASE verdict WHEN 'PROMOTE' THEN 'active' WHEN 'REJECT' THEN 'rejected' ELSE 'probation' END AS status FROM w""")
def a9_vet_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    # Odd suppliers' rows count for the next even one, so that some have none.
    events = _relations(spark, sf_dir).select((F.col("term_taxonomy_id") + F.col("term_taxonomy_id") % 2).alias("source_id"))
    fetches = s.withColumn("http_status", F.when(F.col("source_id") % 3 == 0, 403).otherwise(200))
    return upkeep.vet_sources(events, fetches, s.withColumn("status", F.lit("probation")), least=1190)


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity > 25) / count(*) >= 0.5)")
def a12_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return upkeep.quality_gate(rows, "l_orderkey", F.col("l_quantity") > 25).select("l_orderkey", "l_linenumber")


@register(rf"""WITH p AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1), '') AS segment FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)), g AS (SELECT host, segment, count(*) AS n FROM p WHERE segment <> '' GROUP BY ALL),
  t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, segment DESC) = 1), a AS (SELECT host, count(*) AS n_all FROM p GROUP BY 1)
  SELECT page_id, host, segment FROM p JOIN t USING (host, segment) JOIN a USING (host) WHERE n >= 3 AND n >= 0.5 * n_all""")
def a14_segment_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = B.read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.first_path_segment(F.col("url")).alias("segment"))
    return upkeep.dominant(links, ["host"], "segment", 3, 0.5)


@register(f"WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, thumb_id, {_FP} AS fp FROM titles), g AS (SELECT fp, min(post_id) AS keeper, count(thumb_id) AS n_images FROM f GROUP BY 1 HAVING count(*) > 1) SELECT g.* FROM g JOIN f ON f.post_id = keeper WHERE thumb_id IS NULL AND n_images > 0")
def a15_image_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir).select("post_id", "thumb_id", T.fingerprint(F.col("post_title"), F.col("start_utc"), F.col("city_slug")).alias("fp"))
    return upkeep.image_loss(rows)


@register(f"""WITH {B.LISTINGS} SELECT p.post_id, CASE WHEN (coalesce(p.source_name, '') <> 'src1' AND coalesce(s.source_name, '') <> 'src1') OR (coalesce(p.source_name, '') <> 'src1' AND p.ticket_url IS NOT NULL) THEN NULL
  WHEN coalesce(s.source_name, '') <> 'src1' AND s.ticket_url IS NOT NULL THEN s.ticket_url WHEN p.source_name = 'src1' AND p.ticket_url IS NOT NULL THEN '' END AS new_url FROM listings p JOIN listings s ON s.post_id = p.post_id + 1""")
def m3_resolve_ticket_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir).select("post_id", "source_name", "ticket_url")
    both = rows.join(rows.select((F.col("post_id") - 1).alias("post_id"), F.col("source_name").alias("s"), F.col("ticket_url").alias("u")), "post_id")
    return both.select("post_id", upkeep.resolve_ticket_url(F.col("source_name"), F.col("ticket_url"), F.col("s"), F.col("u"), ["src1"]).alias("new_url"))


@register(f"WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, {_FP} AS fp FROM titles), k AS (SELECT min(post_id) AS post_id FROM f GROUP BY fp), {B.POSTMETA} SELECT meta_id, post_id FROM postmeta WHERE post_id IS NULL OR post_id IN (SELECT post_id FROM k) OR post_id NOT IN (SELECT post_id FROM listings)")
def m7_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = {"meta": (B.postmeta(spark, sf_dir).select("meta_id", "post_id"), "post_id")}
    return upkeep.run_dedup(B.listings(spark, sf_dir), meta)[1]["meta"].select("meta_id", "post_id")


@register(rf"""WITH {B.LISTINGS}, k AS (SELECT post_id, lower(trim(regexp_replace(trim(post_title), '(?i){T.PROMO_SUFFIX}', '', 'g'))) AS t, start_utc, regexp_matches(trim(post_title), '(?i){T.PROMO_SUFFIX}') AS promo FROM listings),
  d AS (SELECT post_id FROM k QUALIFY row_number() OVER (PARTITION BY t, start_utc ORDER BY promo, post_id) > 1), {B.POSTMETA} SELECT meta_id, post_id FROM postmeta WHERE post_id IS NULL OR post_id NOT IN (SELECT post_id FROM d)""")
def m7_run_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = {"meta": (B.postmeta(spark, sf_dir).select("meta_id", "post_id"), "post_id")}
    return upkeep.run_dedup(B.listings(spark, sf_dir), meta, "normalized")[1]["meta"].select("meta_id", "post_id")


@register()
def m7_run_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = {"posts": (B.posts(spark, sf_dir).select("post_id", "post_title"), "post_id")}
    return upkeep.run_dedup(B.live_listings(spark, sf_dir), posts, "fuzzy")[1]["posts"].select("post_id", "post_title")


@register(f"""WITH {B.LISTINGS}, e AS (SELECT post_id, CAST(start_utc AS TIMESTAMP) AS t, CASE WHEN post_id % 4 = 1 THEN 7 ELSE 6 END AS h FROM listings)
  SELECT post_id, CASE WHEN h = 7 THEN 'America/Denver' ELSE 'America/Chicago' END AS timezone, strftime(t, '%Y-%m-%d %H:%M:%S') AS start_utc, strftime(t - to_hours(h), '%Y-%m-%d %H:%M:%S') AS start_local,
    strftime(t + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS end_utc, strftime(t + INTERVAL 2 HOUR - to_hours(h), '%Y-%m-%d %H:%M:%S') AS end_local FROM e""")
def f10_resolve_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("post_id"), F.lit(None).cast("string")
    zone = F.when(n % 4 == 0, "America/Chicago").when(n % 4 == 1, "America/Denver").when(n % 4 == 2, "Nowhere/Here")
    rows = B.listings(spark, sf_dir).select("post_id", "start_utc", zone.alias("timezone"), *(none.alias(c) for c in ("start_local", "end_utc", "end_local", "start_date", "end_date")))
    return times.resolve_times(rows).select("post_id", "timezone", "start_utc", "start_local", "end_utc", "end_local")


@register(f"WITH {B.LISTINGS} SELECT post_id, start_utc AS utc, strftime(CAST(start_utc AS TIMESTAMP) - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM listings")
def f11_offset_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, zone = F.to_timestamp("start_utc"), F.lit("America/Chicago")
    east = F.date_format(start - F.expr("interval 5 hours"), "yyyy-MM-dd'T'HH:mm:ss'-05:00'")
    there = F.from_utc_timestamp(start, "America/Chicago")
    known = F.col("post_id") % 2 == 0
    found = times.parse_offset_datetime(F.when(known, east), F.date_format(there, "yyyy-MM-dd"), F.date_format(there, "HH:mm:ss"), zone)
    return B.listings(spark, sf_dir).select("post_id", found.alias("t")).select("post_id", "t.utc", "t.local")


@register(f"WITH {B.LISTINGS} SELECT post_id, CASE post_id % 5 WHEN 4 THEN '' WHEN 3 THEN substr(start_utc, 1, 10) || ' 00:00:00' ELSE start_utc END AS normal FROM listings")
def f12_normalize_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("start_utc"), F.col("post_id") % 5
    raw = F.when(n == 0, F.unix_timestamp(F.to_timestamp(s)).cast("string")).when(n == 1, F.concat(F.replace(s, F.lit(" "), F.lit("T")), F.lit("Z"))).when(n == 2, s).when(n == 3, F.concat(F.lit("on "), F.substring(s, 1, 10))).otherwise(F.lit("soon"))
    return B.listings(spark, sf_dir).select("post_id", times.normalize_datetime(raw).alias("normal"))


@register(f"WITH {B.LISTINGS} SELECT post_id, CASE WHEN 1 + post_id % 12 < 7 THEN 2027 ELSE 2026 END AS year, CASE post_id % 3 WHEN 0 THEN 'America/Denver' WHEN 1 THEN 'America/New_York' ELSE 'America/Chicago' END AS zone, CAST(substr(start_utc, 1, 10) AS DATE) AS day, post_id % 4 <= 2 AS near FROM listings")
def f15_f33_f34_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("post_id"), F.to_date(F.substring("start_utc", 1, 10))
    said = F.when(n % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(n % 3 == 1, F.date_format(day, "MMMM d, yyyy")).otherwise(F.concat(F.lit("doors on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" at seven")))
    found = times.venue_date(said)
    city = F.when(n % 3 == 0, "denver").when(n % 3 == 1, "tampa").otherwise("elsewhere")
    return B.listings(spark, sf_dir).select("post_id", times.infer_year((1 + n % 12).cast("int"), "2026-07-01").alias("year"), times.guess_timezone(city).alias("zone"), found.alias("day"), times.dates_close(found, F.date_add(day, (n % 4).cast("int"))).alias("near"))


@register(f"WITH {B.POSTS} SELECT post_id, trim(regexp_replace(post_title || ' | Tickets', '(?i){html.TICKET_SUFFIX}', '')) AS title FROM posts")
def f4_ticket_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.posts(spark, sf_dir).select("post_id", html.strip_ticket_boilerplate(F.concat("post_title", F.lit(" | Tickets"))).alias("title"))


_PLAIN = "coalesce(html, '')"
for _tag in html.SKIPPED_TAGS:
    _PLAIN = rf"regexp_replace({_PLAIN}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"
_PLAIN = f"regexp_replace({_PLAIN}, '(?s)<[^>]*>', ' ', 'g')"
for _name, _sign in html.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@register(rf"SELECT page_id, trim(regexp_replace({_PLAIN}, '[ \t\r\n\f\x0B]+', ' ', 'g')) AS text FROM pages")
def f25_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "pages").select("page_id", html.strip_html(F.col("html")).alias("text"))


def _listed(spark: SparkSession, sf_dir: str, odd: int, ident: str) -> DataFrame:
    return B.live_listings(spark, sf_dir).where(F.col("post_id") % 2 == odd).select(F.col("post_id").alias(ident), F.col("post_title").alias("title"), F.substring("start_local", 1, 10).alias("day"), F.col("source_name").alias("venue_name"), "city_slug")


@register()
def j6_match_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_existing(_listed(spark, sf_dir, 1, "seq"), _listed(spark, sf_dir, 0, "post_id"))


@register()
def j9_duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "supplier")
    side = lambda odd, ident: rows.where(F.col("s_suppkey") % 2 == odd).select(F.col("s_suppkey").alias(ident), F.col("s_nationkey").alias("city_slug"), F.col("s_name").alias("name"))
    return match.duplicate_sources(side(1, "candidate_id"), side(0, "source_id"))
