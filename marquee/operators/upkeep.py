"""Filters, lookups and audits of listings, sources and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.functions.urls import unwrap_redirect
from marquee.operators.scans import ROWS_A_PART, running
from marquee.operators.store import cascade_delete, upsert


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


# --- filters -------------------------------------------------------------------------------------


def require_image(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events without an image go where their source asks for one. sources: source_name, require_image."""
    asks = sources.where("require_image").select("source_name").distinct()
    return events.where(_blank(F.col("image_url"))).join(asks, "source_name", "left_anti").unionByName(events.where(~_blank(F.col("image_url")))).select(events.columns)


def cancelled_events(posts: DataFrame) -> DataFrame:
    return posts.where(T.is_cancelled(F.col("post_title")))


def live_events(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("post_status").isin("publish", "draft"))


def backfill_ticket_urls(posts: DataFrame, ids: DataFrame, meta: DataFrame, front: str, back: str = "", prefix: str = "tm_", key: str = "ticket_url") -> DataFrame:
    """Meta rows with a link made of the external id (ids: post_id, external_id) for published posts that have none."""
    has = meta.where((F.col("meta_key") == key) & (F.col("meta_value") != "")).select("post_id")
    own = ids.where(F.startswith("external_id", F.lit(prefix)))
    lacks = own.join(posts.where("post_status = 'publish'").select("post_id"), "post_id", "left_semi").join(has, "post_id", "left_anti")
    return lacks.select("post_id", F.lit(key).alias("meta_key"), F.concat(F.lit(front), F.substring("external_id", len(prefix) + 1, 1 << 20), F.lit(back)).alias("meta_value"))


def missing_raw_categories(ids: DataFrame, meta: DataFrame, prefix: str = "tm_", key: str = "raw_categories") -> DataFrame:
    """Posts of an external id with the prefix that have no saved categories."""
    return ids.where(F.startswith("external_id", F.lit(prefix))).join(meta.where(F.col("meta_key") == key).select("post_id"), "post_id", "left_anti")


def filter_by_city(raw: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows (city, state) of a national feed that a filter (city, state, city_slug) names; the slug is added."""
    wanted = filters.select(F.lower(F.trim("city")).alias("_city"), F.upper(F.trim("state")).alias("_state"), "city_slug").dropDuplicates(["_city", "_state"])
    keyed = raw.withColumns({"_city": F.lower(F.trim("city")), "_state": F.upper(F.trim("state"))})
    return keyed.join(wanted, ["_city", "_state"]).drop("_city", "_state")


def select_sources(sources: DataFrame, statuses: list[str], city: str | None = None, limit: int | None = None) -> DataFrame:
    out = sources.where(F.col("status").isin(statuses))
    if city is not None:
        out = out.where(F.col("city_slug") == city)
    out = out.orderBy("city_slug", "id")
    return out.limit(limit) if limit else out


def needs_enrichment(events: DataFrame) -> DataFrame:
    """Events without a description, or marked."""
    return events.where(_blank(F.col("description")) | F.coalesce("needs_enrichment", F.lit(False)))


# --- lookups -------------------------------------------------------------------------------------


def post_terms(relations: DataFrame, taxonomies: DataFrame, terms: DataFrame, taxonomy: str) -> DataFrame:
    """post_id and the sorted slugs of its terms of a taxonomy. The two small tables meet first."""
    slugs = taxonomies.where(F.col("taxonomy") == taxonomy).join(terms, "term_id").select("term_taxonomy_id", "slug")
    return relations.join(slugs, "term_taxonomy_id").groupBy("post_id").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))


def attach_venue_image(events: DataFrame, posts: DataFrame) -> DataFrame:
    """events with the title of the post venue_id names and the link of the one thumb_id names."""
    venues = posts.select(F.col("post_id").alias("venue_id"), F.col("post_title").alias("venue_name"))
    images = posts.select(F.col("post_id").alias("thumb_id"), F.col("guid").alias("image_url"))
    return events.join(venues, "venue_id", "left").join(images, "thumb_id", "left")


def venues_to_check(events: DataFrame, cache: DataFrame, as_of: str, limit: int = 50, days: int = 30) -> DataFrame:
    """The first venues (venue_name, city_slug) of a run to look up: unknown, without a link, or not seen for long."""
    known = cache.select("venue_name", "city_slug", "events_url", "status", "last_checked", F.lit(True).alias("known"))
    each = events.where(~_blank(F.col("venue_name"))).select("venue_name", "city_slug").distinct().join(known, ["venue_name", "city_slug"], "left")
    old = F.coalesce(F.datediff(F.lit(as_of).cast("timestamp"), F.col("last_checked").try_cast("timestamp")) > days, F.lit(False))
    due = F.col("known").isNull() | _blank(F.col("events_url")) | old
    return each.where((F.coalesce("status", F.lit("")) != "skip") & due).select("venue_name", "city_slug").orderBy("venue_name", "city_slug").limit(limit)


def upgrade_events(weak: DataFrame, matches: DataFrame) -> DataFrame:
    """weak (post_id, description, image_url) with what its match offers: a text of over 80 characters for one of
    fewer than 100, an image where there is none."""
    offered = matches.select("post_id", F.trim(F.coalesce("description", F.lit(""))).alias("new_text"), F.col("image_url").alias("new_image"))
    fuller = (F.char_length("new_text") > 80) & (F.char_length(F.coalesce("description", F.lit(""))) < 100)
    adds = _blank(F.col("image_url")) & ~_blank(F.col("new_image"))
    changed = F.coalesce(fuller, F.lit(False)) | F.coalesce(adds, F.lit(False))
    return weak.join(offered, "post_id", "left").select("post_id", F.when(fuller, F.col("new_text")).otherwise(F.col("description")).alias("description"), F.when(adds, F.col("new_image")).otherwise(F.col("image_url")).alias("image_url"), changed.alias("upgraded"))


def pick_first(df: DataFrame, keys: list[str], rank: Column, columns: list[str], position: str = "pos") -> DataFrame:
    """Of each key the row of the least rank, then position: a ticket link, say. An aggregate, without a sort."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(rank.alias("r"), F.col(position).alias("p"))).alias("row")).select(*keys, "row.*")


def rank_urls(candidates: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Candidates with their rank: links to a calendar first, in order."""
    plain = (~F.lower(F.coalesce("url", F.lit(""))).rlike("/events|/shows|/calendar|/schedule")).cast("int")
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(plain, position)))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def section_anchor(rows: DataFrame, page: str = "page_id", position: str = "pos", heading: str = "heading", rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """rows with anchor: the last heading of the page at or before each row. A page of very many rows is scanned in parts."""
    return running(rows, [page], position, {"anchor": (F.col(heading), "last", True)}, rows_a_part)


def resolve_observed_times(seen: DataFrame, columns: list[str]) -> DataFrame:
    """Of each post's observations (post_id, seq, start_utc) the one whose times stand after all are applied in order.

    An earlier or equal start replaces what stands, an empty one always does, and anything replaces an
    empty one: the least start after the last empty one, the later of equals. Aggregates alone; no group is sorted."""
    empty = _blank(F.col("start_utc"))
    last = seen.where(empty).groupBy("post_id").agg(F.max("seq").alias("last_empty"))
    live = seen.join(last, "post_id", "left").where(F.col("last_empty").isNull() | (F.col("seq") >= F.col("last_empty")))
    # The last empty observation stands only if none follows.
    order = F.struct(empty.cast("int").alias("e"), F.col("start_utc").alias("s"), (-F.col("seq")).alias("q"))
    return live.groupBy("post_id").agg(F.min_by(F.struct(*columns), order).alias("row")).select("post_id", "row.*")


# --- audits --------------------------------------------------------------------------------------


def store_health(posts: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(tab, n, n_orphans) of the posts and of each child table (post_id)."""
    ids = posts.select("post_id").distinct()
    out = [posts.agg(F.lit("posts").alias("tab"), F.count("*").alias("n"), F.lit(0).cast("long").alias("n_orphans"))]
    for name, df in children.items():
        known = df.select("post_id").join(ids.withColumn("known", F.lit(1)), "post_id", "left")
        out.append(known.agg(F.lit(name).alias("tab"), F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("n_orphans")))
    return reduce(DataFrame.unionByName, out)


def term_counts(relations: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """term_taxonomy_id and how many relations use it, unused ones too."""
    used = relations.groupBy("term_taxonomy_id").agg(F.count("*").alias("n"))
    return taxonomies.select("term_taxonomy_id").join(used, "term_taxonomy_id", "left").na.fill(0, ["n"])


def source_stats(events: DataFrame, as_of: str) -> DataFrame:
    return events.groupBy("source_name").agg(F.count("*").alias("last_count")).withColumn("last_run", F.lit(as_of))


def score_sources(events: DataFrame, candidates: DataFrame, as_of: str, least: int = 3, least_upcoming: int = 1, images: float = 0.3, off_topic: float = 0.5, pattern: str = T.OFF_TOPIC) -> DataFrame:
    """A verdict a candidate (source_name, duplicate_of) from its trial events, the counts and shares behind it, and the reason.

    The first check that fails decides; poor image coverage alone asks for a review."""
    title = F.coalesce("title", F.lit(""))
    each = events.groupBy("source_name").agg(
        F.count("*").alias("n_events"), F.count_if(F.substring(F.coalesce("start_date", F.lit("")), 1, 10) >= as_of[:10]).alias("n_upcoming"),
        F.count_if(~_blank(F.col("image_url"))).alias("n_images"), F.count_if(T.has(title, pattern)).alias("n_off_topic"),
    )
    out = candidates.join(each, "source_name", "left").na.fill(0, ["n_events", "n_upcoming", "n_images", "n_off_topic"])
    n = F.greatest("n_events", F.lit(1))
    image_share, off_share = F.col("n_images") / n, F.col("n_off_topic") / n
    percent = lambda share: F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))
    checks = [
        ("SKIP", F.col("duplicate_of").isNotNull(), F.concat(F.lit("Likely duplicate of existing source '"), "duplicate_of", F.lit("' (name similarity)"))),
        ("SKIP", F.col("n_events") < least, F.concat(F.lit("Trial scrape returned only "), F.col("n_events").cast("string"), F.lit(f" events (min {least})"))),
        ("SKIP", F.col("n_upcoming") < least_upcoming, F.lit("No upcoming events -- calendar looks stale/dead")),
        ("SKIP", off_share >= off_topic, F.concat(percent(off_share), F.lit(" of trial titles look off-topic (private/internal events)"))),
        ("REVIEW", image_share < images, F.concat(F.lit("Low image coverage ("), percent(image_share), F.lit(" of trial events)"))),
        ("WORTH_IT", F.lit(True), F.lit("Clean pass on all checks")),
    ]
    verdict, reason = F.when(checks[0][1], checks[0][0]), F.when(checks[0][1], checks[0][2])
    for name, failed, why in checks[1:]:
        verdict, reason = verdict.when(failed, name), reason.when(failed, why)
    return out.withColumns({"image_rate": F.round(image_share, 2), "off_topic_fraction": F.round(off_share, 2), "verdict": verdict, "reason": reason})


def vet_sources(events: DataFrame, fetches: DataFrame, sources: DataFrame, least: int = 3) -> DataFrame:
    """A verdict and the new status a source (source_id, status): enough events promote, none reject unless a fetch was refused."""
    found = events.groupBy("source_id").agg(F.count("*").alias("n_events"))
    refused = fetches.groupBy("source_id").agg(F.max((F.col("http_status") == 403).cast("int")).alias("refused"))
    out = sources.join(found, "source_id", "left").join(refused, "source_id", "left").na.fill(0, ["n_events", "refused"])
    verdict = F.when(F.col("n_events") >= least, "PROMOTE").when((F.col("n_events") == 0) & (F.col("refused") == 0), "REJECT").otherwise("REVIEW")
    status = F.when(F.col("verdict") == "PROMOTE", "active").when(F.col("verdict") == "REJECT", "rejected").otherwise(F.col("status"))
    return out.withColumn("verdict", verdict).select("source_id", "n_events", "verdict", status.alias("status"))


def quality_gate(rows: DataFrame, page: str, failed: Column, share: float = 0.5) -> DataFrame:
    """Rows of the pages of which fewer than a share of rows failed. Shares are aggregated and joined back."""
    bad = rows.groupBy(page).agg((F.count_if(failed) / F.count("*")).alias("share")).where(F.col("share") >= share).select(page)
    return rows.join(bad, page, "left_anti")


def dominant(links: DataFrame, keys: list[str], vote: str, least: int = 3, share: float | None = None) -> DataFrame:
    """Links of each page's most frequent value of vote, if it has enough links (and a share of the page's)."""
    each = links.where(F.col(vote) != "").groupBy(*keys, vote).agg(F.count("*").alias("n"))
    top = each.groupBy(*keys).agg(F.max_by(F.struct(F.col(vote), "n"), F.struct("n", vote)).alias("t"))
    all_of = links.groupBy(*keys).agg(F.count("*").alias("n_all"))
    won = top.join(all_of, keys).where((F.col("t.n") >= least) & (F.col("t.n") >= F.col("n_all") * F.lit(share or 0.0)))
    return links.join(won.select(*keys, f"t.{vote}"), [*keys, vote], "left_semi").select(links.columns)


def image_loss(events: DataFrame) -> DataFrame:
    """Fingerprints (fp) whose keeper has no image while a copy to be deleted has one."""
    keeper = F.min(F.struct("post_id", F.col("thumb_id").isNotNull().alias("has")))
    each = events.groupBy("fp").agg(keeper.alias("k"), F.count_if(F.col("thumb_id").isNotNull()).alias("n_images"), F.count("*").alias("n"))
    return each.where((F.col("n") > 1) & ~F.col("k.has") & (F.col("n_images") > 0)).select("fp", F.col("k.post_id").alias("keeper"), "n_images")


# --- jobs ----------------------------------------------------------------------------------------


def source_key(source: Column) -> Column:
    """A source's name in small letters without blanks."""
    return F.replace(F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lit(" "), F.lit(""))


def resolve_ticket_url(p_source: Column, p_url: Column, s_source: Column, s_url: Column, banned: Sequence[str]) -> Column:
    """The link a merge gives its primary where a source of untrusted links takes part: null leaves it as it is."""
    pb, sb = source_key(p_source).isin(*banned), source_key(s_source).isin(*banned)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(~(pb | sb) | (~pb & has(p_url)), F.lit(None).cast("string")).when(~sb & has(s_url), s_url).when(pb & has(p_url), F.lit(""))


def run_dedup(events: DataFrame, children: dict[str, tuple[DataFrame, str]], mode: str = "exact") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The posts that a dedup job deletes (post_id), and children without their rows. mode: exact (fingerprints),
    normalized (title without promotion, and start) or fuzzy (what the greedy merge takes in)."""
    from marquee.operators import resolve

    if mode == "fuzzy":
        gone = resolve.merge_all(events).select(F.col("secondary_id").alias("post_id"))
    else:
        gone = (resolve.exact_duplicates if mode == "exact" else resolve.normalized_duplicates)(events).where("is_delete").select("post_id")
    return gone, cascade_delete(children, gone)


def ticket_host_candidates(events: DataFrame, wrapper: str, host_name: str) -> DataFrame:
    """(post_id, link, thumb_id) of events whose link, unwrapped, is of a ticket host, and that have an image."""
    link = unwrap_redirect(F.col("ticket_url"), wrapper)
    return events.where(F.contains(link, F.lit(host_name)) & F.col("thumb_id").isNotNull()).select("post_id", link.alias("link"), "thumb_id")


def apply_merge(posts: DataFrame, planned: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """posts with what each merged primary takes over and without secondaries; children without the latter's rows.

    A primary's merges apply in their order, which is that of its secondaries: of each field the last value given stands,
    and none leaves the field as it is. An empty link is a value. planned: the columns of plan_merge."""
    gone = planned.select(F.col("secondary_id").alias("post_id")).distinct()
    given = {"ticket_url": "new_url", "thumb_id": "new_thumb", "post_content": "new_content"}
    given = {c: new for c, new in given.items() if c in posts.columns and new in planned.columns}
    last = [F.max_by(new, F.when(F.col(new).isNotNull(), F.col("secondary_id"))).alias(new) for new in given.values()]
    takes = planned.groupBy(F.col("primary_id").alias("post_id")).agg(*last)
    changed = posts.join(takes, "post_id").withColumns({c: F.coalesce(new, F.col(c)) for c, new in given.items()}).select(posts.columns)
    kept = cascade_delete({"posts": (upsert(posts, changed, ["post_id"]), "post_id"), **children}, gone)
    return kept.pop("posts").select(posts.columns), kept
