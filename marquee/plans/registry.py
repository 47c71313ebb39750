"""Registered queries of the event-listing operators over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import category, urls
from marquee.functions import text as T
from marquee.functions.times import guess_timezone
from marquee.operators import resolve, store, upkeep
from marquee.plans import digest
from marquee.sources import bindings as B
from marquee.tables import ready, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2026-01-08 00:00:00"
EVENT_TYPES = ["signup", "error", "click", "view", "purchase"]


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_PIVOT = ", ".join(f"max(CASE WHEN meta_key = '{k}' THEN meta_value END) AS \"{k}\"" for k in EVENT_TYPES)
_IN = ", ".join(f"'{k}'" for k in EVENT_TYPES)


_LOCAL = "CAST(start_utc AS TIMESTAMP) - INTERVAL 6 HOUR"


@register(f"""WITH {B.LISTINGS}, w AS (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY start_utc, post_id) AS rank
    FROM listings WHERE post_status = 'publish' AND start_utc >= '2026-01-08 00:00:00' AND start_utc < '2026-01-15 00:00:00')
  SELECT city_slug, rank, post_id, post_title, start_utc, strftime({_LOCAL}, '%Y-%m-%d %H:%M:%S') AS start_local,
    strftime({_LOCAL}, '%A, %B %-d') || CASE WHEN post_id % 24 = 6 THEN '' ELSE ' at ' || strftime({_LOCAL}, '%-I:%M %p') END AS shown,
    coalesce(ticket_url, 'https://example.com/events/' || post_id || '/') AS url, CASE WHEN ticket_url IS NULL THEN 'More Info' ELSE 'Get Tickets' END AS action, CAST(thumb_id AS VARCHAR) AS thumb_id,
    CASE WHEN post_id % 4 = 0 THEN '$' || (post_id % 50) ELSE '' END AS cost,
    CASE WHEN length(coalesce(post_content, '')) > 120 THEN substr(post_content, 1, 120) || '…' ELSE coalesce(post_content, '') END AS description FROM w WHERE rank <= 8""")
def t1_weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.weekly_digest(*digest.as_store(B.listings(spark, sf_dir)), AS_OF)


@register(f"WITH {B.POSTMETA} SELECT post_id, {_PIVOT} FROM postmeta WHERE meta_key IN ({_IN}) GROUP BY post_id")
def a1_pivot_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pivot_meta(B.postmeta(spark, sf_dir), EVENT_TYPES)


@register(f"WITH {B.POSTMETA}, {B.POSTS}, v AS (SELECT post_id, {_PIVOT} FROM postmeta GROUP BY post_id) SELECT p.post_id, p.post_title, p.post_status, v.* EXCLUDE (post_id) FROM posts p LEFT JOIN v USING (post_id)")
def j1_event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.event_view(B.posts(spark, sf_dir).select("post_id", "post_title", "post_status"), B.postmeta(spark, sf_dir), EVENT_TYPES)


@register(f"WITH {B.POSTMETA} SELECT post_id, meta_key, meta_id, meta_value FROM postmeta QUALIFY row_number() OVER (PARTITION BY post_id, meta_key ORDER BY meta_id DESC) = 1")
def w1_dedup_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dedup_meta(B.postmeta(spark, sf_dir))


@register(f"WITH {B.POSTMETA} SELECT meta_key, count(*) AS n FROM postmeta GROUP BY 1 ORDER BY n DESC, meta_key LIMIT 20")
def a2_meta_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(B.postmeta(spark, sf_dir), "meta_key", 20)


@register(f"WITH {B.POSTS} SELECT post_status, count(*) AS n FROM posts GROUP BY 1")
def a2_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(B.posts(spark, sf_dir), "post_status")


@register(f"WITH {B.POSTS} SELECT post_title, count(*) AS n FROM posts GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, post_title LIMIT 20")
def a3_repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.repeated(B.posts(spark, sf_dir), "post_title")


@register(f"WITH {B.POSTMETA}, g AS (SELECT post_id, meta_key, count(*) AS n FROM postmeta WHERE meta_key IN ({_IN}) GROUP BY ALL HAVING count(*) > 1) SELECT meta_key, CAST(sum(n - 1) AS BIGINT) AS excess, count(*) AS posts FROM g GROUP BY 1")
def a4_excess_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.excess_rows(B.postmeta(spark, sf_dir), EVENT_TYPES)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select("c_custkey")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def j2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(B.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _customers(spark, sf_dir), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def j2_drop_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.drop_orphans(B.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _customers(spark, sf_dir), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@register(f"WITH {B.POSTMETA}, {B.POSTS} SELECT post_id, post_title FROM posts WHERE post_id NOT IN (SELECT CAST(meta_value AS BIGINT) FROM postmeta WHERE meta_key = 'click' AND meta_value IS NOT NULL)")
def j3_orphan_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphan_attachments(B.posts(spark, sf_dir).select("post_id", "post_title"), B.postmeta(spark, sf_dir), "click")


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def j4_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = B.read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("post_id"))
    tables = {"lineitem": (B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")}
    return store.cascade_delete(tables, ids)["lineitem"]


@register(f"""WITH {B.POSTMETA}, {B.POSTS}, m AS (SELECT post_id, count(*) AS n_meta FROM postmeta GROUP BY 1), r AS (SELECT o_custkey AS post_id, count(*) AS n_terms FROM orders GROUP BY 1)
  SELECT p.post_id, coalesce(n_meta, 0) AS n_meta, coalesce(n_terms, 0) AS n_terms, greatest(coalesce(n_meta, 0), 1) * greatest(coalesce(n_terms, 0), 1) AS n_joined FROM posts p LEFT JOIN m USING (post_id) LEFT JOIN r USING (post_id)""")
def j16_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fanout(B.posts(spark, sf_dir), B.postmeta(spark, sf_dir), B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("post_id")))


@register(f"""WITH {B.LISTINGS} SELECT post_id, 'start_utc' AS meta_key, start_utc AS meta_value FROM listings UNION ALL SELECT post_id, 'thumb_id', CAST(thumb_id AS VARCHAR) FROM listings WHERE thumb_id IS NOT NULL
  UNION ALL SELECT post_id, 'ticket_url', ticket_url FROM listings WHERE ticket_url IS NOT NULL""")
def s12_to_postmeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_postmeta(B.listings(spark, sf_dir), {c: F.col(c) for c in ("start_utc", "thumb_id", "ticket_url")})


_END = "strftime(CAST(start_utc AS TIMESTAMP) + to_hours(CAST(post_id % 4 AS INTEGER)), '%Y-%m-%d %H:%M:%S')"


@register(f"""WITH {B.LISTINGS}, e AS (SELECT post_id, start_utc, {_END} AS end_utc FROM listings)
  SELECT post_id, start_utc, end_utc, strftime(CAST(start_utc AS TIMESTAMP) - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS start_local, strftime(CAST(end_utc AS TIMESTAMP) - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS end_local,
    CASE WHEN post_id % 4 > 0 THEN 3600 * (post_id % 4) ELSE 7200 END AS duration, sha1(post_id || start_utc || end_utc) AS hash FROM e""")
def s13_calendar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.date_format(F.expr("to_timestamp(start_utc) + make_interval(0, 0, 0, 0, cast(post_id % 4 as int), 0, 0)"), "yyyy-MM-dd HH:mm:ss")
    return store.calendar_index(B.listings(spark, sf_dir).select("post_id", "start_utc", end.alias("end_utc")))


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def s14_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "customer").select("c_custkey")
    return store.upsert(c.withColumn("state", F.lit("old")), c.where("c_custkey % 3 = 0").withColumn("state", F.lit("new")), ["c_custkey"])


_PROMO = T.PROMO_SUFFIX
_NORM = rf"""lower(trim(regexp_replace(regexp_replace((CASE WHEN regexp_matches(t2, '(?i){T.NUMBERED}\s*$') THEN t2 ELSE regexp_replace(t2, '(?:\s*\([^()]*\))+\s*$', '') END), '\s@\s', ' at ', 'g'), '\s*&\s*', ' and ', 'g')))"""
_TITLES = rf"t1 AS (SELECT *, regexp_replace(trim(post_title), '(?i){_PROMO}', '', 'g') AS t1 FROM listings), t2 AS (SELECT *, regexp_replace(t1, '{T.CITY_STATE.replace(chr(39), chr(39) * 2)}', '') AS t2 FROM t1), titles AS (SELECT *, {_NORM} AS norm FROM t2)"
_FP = "sha256(norm || '|' || substr(start_utc, 1, 10) || '|' || coalesce(lower(trim(city_slug)), ''))"


@register(f"WITH {B.LISTINGS}, {_TITLES} SELECT post_id, norm FROM titles")
def f1_normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listings(spark, sf_dir).select("post_id", T.normalize_title(F.col("post_title")).alias("norm"))


@register(f"""WITH {B.POSTS} SELECT post_id, {", ".join(f"regexp_matches(coalesce(post_content, ''), '(?i){p}') AS {n}" for n, p in (("numbered", T.NUMBERED), ("fixture", T.FIXTURE), ("lineup", T.LINEUP), ("status", T.STATUS), ("cancelled", T.CANCELLED)))} FROM posts""")
def f2_title_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("post_content")
    return B.posts(spark, sf_dir).select("post_id", T.is_numbered(c).alias("numbered"), T.is_fixture(c).alias("fixture"), T.is_lineup(c).alias("lineup"), T.has_status(c).alias("status"), T.is_cancelled(c).alias("cancelled"))


@register(f"WITH {B.LISTINGS}, {_TITLES} SELECT post_id, array_to_string(list_sort(list_distinct([w FOR w IN regexp_extract_all(norm, '[a-z0-9]+') IF length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)})])), ' ') AS tokens FROM titles")
def f6_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listings(spark, sf_dir).select("post_id", F.array_join(F.sort_array(T.tokens(T.normalize_title(F.col("post_title")))), " ").alias("tokens"))


@register(f"WITH {B.LISTINGS}, {_TITLES} SELECT post_id, {_FP} AS fp FROM titles")
def f14_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listings(spark, sf_dir).select("post_id", T.fingerprint(F.col("post_title"), F.col("start_utc"), F.col("city_slug")).alias("fp"))


@register(f"""WITH {B.LISTINGS} SELECT post_id, CASE WHEN post_id % 5 = 3 THEN 'https://box.example.net/e/' || post_id ELSE ticket_url END AS unwrapped,
  coalesce(regexp_replace(lower(regexp_extract(ticket_url, '://([^/?#:]*)', 1)), '^www\\.', ''), '') AS host, coalesce(regexp_extract(ticket_url, '://[^/?#]*/([^/?#]*)', 1), '') AS segment,
  CASE post_id % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS rank, ticket_url || CASE WHEN contains(ticket_url, '?') THEN '&' ELSE '?' END || 'ref=9' AS tagged FROM listings""")
def f17_f20_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("ticket_url")
    return B.listings(spark, sf_dir).select("post_id", urls.unwrap_redirect(u, "w.example.org").alias("unwrapped"), urls.host(u).alias("host"), urls.first_path_segment(u).alias("segment"), urls.affiliate_rank(u).alias("rank"), urls.add_param(u, "ref", "9").alias("tagged"))


def _genres(n: Column) -> Column:
    return F.when(n % 4 == 0, F.array(F.lit("Arts & Theatre"), F.lit(" Comedy"))).when(n % 4 == 1, F.array(F.lit("Miscellaneous"))).when(n % 4 == 2, F.array(F.lit("Unheard of")))


_SCAN = " ".join(f"WHEN regexp_matches(t, '{category.keyword_pattern(w).replace(chr(39), chr(39) * 2)}') THEN '{slug}'" for slug, w in category.CATEGORIES if w)


@register(f"WITH {B.POSTS}, x AS (SELECT post_id, lower(post_title || ' ' || coalesce(post_content, '')) AS t FROM posts) SELECT post_id, CASE WHEN post_id % 4 = 0 THEN 'comedy' WHEN post_id % 4 = 1 THEN 'more-to-do' {_SCAN} ELSE 'more-to-do' END AS category FROM x")
def f21_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.posts(spark, sf_dir).select("post_id", category.categorize(_genres(F.col("post_id")), F.col("post_title"), F.col("post_content")).alias("category"))


@register(rf"WITH {B.POSTS} SELECT post_id, substr(regexp_replace(regexp_replace(lower(trim(post_title)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), 1, 200) AS slug FROM posts")
def f22_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.posts(spark, sf_dir).select("post_id", T.slugify(F.col("post_title")).alias("slug"))


@register(f"WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, {_FP} AS fp FROM titles) SELECT post_id, fp, min(post_id) OVER (PARTITION BY fp) AS keeper, post_id <> min(post_id) OVER (PARTITION BY fp) AS is_delete FROM f")
def w2_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.exact_duplicates(B.listings(spark, sf_dir))


@register(rf"""WITH {B.LISTINGS}, k AS (SELECT post_id, lower(trim(regexp_replace(trim(post_title), '(?i){_PROMO}', '', 'g'))) AS title_key, start_utc, regexp_matches(trim(post_title), '(?i){_PROMO}') AS promo FROM listings),
  r AS (SELECT *, first_value(post_id) OVER (PARTITION BY title_key, start_utc ORDER BY promo, post_id) AS keeper, count(*) OVER (PARTITION BY title_key, start_utc) AS n FROM k)
  SELECT post_id, title_key, start_utc, keeper, post_id <> keeper AS is_delete FROM r WHERE n > 1""")
def w3_normalized_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.normalized_duplicates(B.listings(spark, sf_dir))


@register(f"WITH {B.LISTINGS} SELECT post_id, ticket_url FROM (SELECT post_id, ticket_url, row_number() OVER (PARTITION BY thumb_id % 100 ORDER BY post_id) AS rn, thumb_id FROM listings) WHERE rn = 1 OR thumb_id IS NULL")
def w4_dedup_external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir).withColumn("external_id", F.col("thumb_id") % 100)
    return resolve.first_of(rows, ["external_id"], "post_id", ["post_id", "ticket_url"])


@register(f"WITH {B.LISTINGS} SELECT post_id, post_title FROM listings QUALIFY row_number() OVER (PARTITION BY source_name, lower(post_title), substr(start_utc, 1, 10) ORDER BY post_id) = 1")
def w5_dedup_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir).withColumns({"t": F.lower("post_title"), "day": F.substring("start_utc", 1, 10)})
    return resolve.first_of(rows, ["source_name", "t", "day"], "post_id", ["post_id", "post_title"])


_SLUG = r"substr(regexp_replace(regexp_replace(lower(trim(post_title)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), 1, 200)"


@register(rf"""WITH {B.POSTS}, s AS (SELECT post_id, {_SLUG} AS base FROM posts WHERE post_id % 3 <> 0), t AS (SELECT DISTINCT {_SLUG} AS base FROM posts WHERE post_id % 3 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY post_id) - 1 + (base IN (SELECT base FROM t))::INT AS n FROM s)
  SELECT post_id, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS slug FROM r""")
def w6_assign_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir)
    return resolve.assign_slugs(posts.where("post_id % 3 <> 0"), posts.where("post_id % 3 = 0").select(T.slugify(F.col("post_title")).alias("slug")).distinct())


@register()
def j7_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.duplicate_pairs(B.live_listings(spark, sf_dir))


@register(f"""WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, {_FP} AS fp, lower(trim(city_slug)) AS city, strftime(CAST(start_utc AS TIMESTAMP) - INTERVAL 6 HOUR, '%Y-%m-%d') AS day FROM titles WHERE post_status <> 'trash' AND trim(coalesce(city_slug, '')) <> ''),
  g AS (SELECT *, min(post_id) OVER (PARTITION BY city, day, fp) AS a FROM f) SELECT a, post_id AS b, CAST(1 AS DOUBLE) AS ratio FROM g WHERE post_id > a""")
def j7_exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.duplicate_pairs(B.live_listings(spark, sf_dir)).where("exact").select("a", "b", "ratio")


@register()
def m2_plan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.live_listings(spark, sf_dir)
    one = F.struct("post_id", "post_title", "post_content", "ticket_url", "thumb_id", "source_name")
    pairs = resolve.duplicate_pairs(events).select("a", "b")
    both = pairs.join(events.select(F.col("post_id").alias("a"), one.alias("one")), "a").join(events.select(F.col("post_id").alias("b"), one.alias("other")), "b")
    return resolve.plan_merge(both.select(F.col("one").alias("a"), F.col("other").alias("b")), banned=["src1"])


@register()
def m4_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_all(B.live_listings(spark, sf_dir))


@register()
def m5_apply_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live posts with what each takes over, without those merged into others."""
    events = B.live_listings(spark, sf_dir)
    one = F.struct("post_id", "post_title", "post_content", "ticket_url", "thumb_id", "source_name")
    # What is planned is read twice, for what is taken over and for what goes: groups are walked once.
    merged = written(resolve.merge_all(events), "merged").select(F.least("primary_id", "secondary_id").alias("a"), F.greatest("primary_id", "secondary_id").alias("b"))
    both = merged.join(events.select(F.col("post_id").alias("a"), one.alias("one")), "a").join(events.select(F.col("post_id").alias("b"), one.alias("other")), "b")
    planned = resolve.plan_merge(both.select(F.col("one").alias("a"), F.col("other").alias("b")), banned=["src1"])
    posts, _ = upkeep.apply_merge(events, planned, {})
    return posts.select("post_id", "post_title", "post_content", "ticket_url", "thumb_id")


@register(f"WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id AS seq, {_FP} AS fp FROM titles), k AS (SELECT fp, min(seq) AS post_id FROM f WHERE seq % 2 = 0 GROUP BY 1), l AS (SELECT fp, min(seq) AS post_id FROM f WHERE seq % 3 = 0 GROUP BY 1) SELECT seq, f.fp, coalesce(k.post_id, l.post_id) AS post_id, k.post_id IS NULL AND l.post_id IS NOT NULL AS backfill FROM f LEFT JOIN k USING (fp) LEFT JOIN l USING (fp)")
def j5_resolve_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.listings(spark, sf_dir).select(F.col("post_id").alias("seq"), T.fingerprint(F.col("post_title"), F.col("start_utc"), F.col("city_slug")).alias("fp"))
    known, legacy = (f.where(f"seq % {n} = 0").groupBy("fp").agg(F.min("seq").alias("post_id")) for n in (2, 3))
    return resolve.resolve_fingerprints(f, known, legacy)


@register(f"WITH {B.LISTINGS} SELECT post_id, post_title, start_utc FROM listings WHERE start_utc >= '2026-01-08 00:00:00' AND start_utc < '2026-02-12 00:00:00'")
def p4_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.listings(spark, sf_dir)
    return digest.upcoming(rows, AS_OF, 35, guess_timezone(F.col("city_slug"))).select("post_id", "post_title", "start_utc")


@register(f"WITH {B.LISTINGS} SELECT post_id, start_utc FROM listings WHERE source_name = 'src3' AND (thumb_id IS NULL OR length(coalesce(post_content, '')) < 100) ORDER BY start_utc, post_id LIMIT 200")
def p5_weak_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    weak = B.listings(spark, sf_dir).where((F.col("source_name") == "src3") & (F.col("thumb_id").isNull() | (F.char_length(F.coalesce("post_content", F.lit(""))) < 100)))
    return weak.select("post_id", "start_utc").orderBy("start_utc", "post_id").limit(200)


@register(f"WITH {B.LISTINGS} SELECT substr(start_utc, 1, 10) AS day, count(*) AS n FROM listings GROUP BY 1")
def a11_date_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listings(spark, sf_dir).groupBy(F.substring("start_utc", 1, 10).alias("day")).agg(F.count("*").alias("n"))


@register(f"WITH {B.LISTINGS} SELECT city_slug, count(*) AS n, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources FROM listings GROUP BY 1")
def a16_city_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listings(spark, sf_dir).groupBy("city_slug").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source_name")), ",").alias("sources"))


@register("SELECT domain, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages) WHERE domain <> '' AND domain NOT IN (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') FROM pages WHERE page_id % 10 = 0) GROUP BY 1")
def j10_new_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("domain"))
    known = pages.where("page_id % 10 = 0").select("domain").distinct()
    return pages.where("domain <> ''").join(known, "domain", "left_anti").groupBy("domain").agg(F.min("page_id").alias("page_id"))


@register("WITH n AS (SELECT c_name AS name, c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT DISTINCT c_name AS name FROM customer WHERE c_name NOT IN (SELECT name FROM n)) SELECT CAST(id AS BIGINT) AS id, name FROM n UNION ALL SELECT (SELECT max(id) FROM n) + row_number() OVER (ORDER BY name), name FROM u")
def j13_ensure_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    return store.ensure_members(names, names.where("id % 3 = 0"), "name", "id")


@register(f"WITH {B.LISTINGS}, {_TITLES}, f AS (SELECT post_id, {_FP} AS fp FROM titles) SELECT min(post_id) AS post_id FROM f GROUP BY fp")
def u2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.exact_duplicates(B.listings(spark, sf_dir)).where("not is_delete").select("post_id")


@register(f"WITH {B.LISTINGS} SELECT post_id FROM listings WHERE post_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def u3_fingerprint_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(B.listings(spark, sf_dir).select("post_id"), B.postmeta(spark, sf_dir), "post_id")
