"""Observations of events folded into posts, and cancellations taken out before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.functions.urls import affiliate_rank
from marquee.operators.match import like_existing, match_existing
from marquee.operators.scans import ROWS_A_PART, running
from marquee.tables import written

TIMES = ("start_local", "end_local", "start_utc", "end_utc", "timezone")
#: Sources whose links are of the two affiliate programmes, in their order.
AFFILIATES = ("ticketmaster", "eventim")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _taken(seen: DataFrame, rows_a_part: int) -> DataFrame:
    """seen with taken: whether an observation's times replace those before it. They don't only if both have a start and
    its own is later than the one that stands.

    What stands before a row is the least start since the last row that had none."""
    empty = _blank(F.col("start_utc"))
    runs = running(seen, ["post_id"], "seq", {"run": (empty.cast("int"), "sum", True)}, rows_a_part)
    stands = running(runs, ["post_id", "run"], "seq", {"before": (F.when(~empty, F.col("start_utc")), "min", False)}, rows_a_part)
    return stands.withColumn("taken", empty | F.col("before").isNull() | (F.col("start_utc") <= F.col("before"))).drop("run", "before")


def _link(seen: DataFrame, rows_a_part: int) -> DataFrame:
    """(post_id, ticket_url): links of observations whose times were taken, by the rule of programmes: a post's first link
    stands as it is; a programme's link replaces one of its rank or lower, any other link only one of no programme.

    An observation of the first programme replaces any link, so only what follows the last of these counts (or the first
    row). From there: a link of the first programme, once it stands, stays; one of the second programme's source replaces all
    others; any other source's only links of no programme, until one of theirs is of a programme. So a few rows decide, and
    aggregates find them: no post's observations are gathered."""
    url, source = F.trim(F.coalesce("ticket_url", F.lit(""))), F.lower(F.trim(F.coalesce("source_name", F.lit(""))))
    rank = F.array_position(F.array(*[F.lit(a) for a in AFFILIATES]), source)
    rows = seen.select("post_id", "seq", "taken", url.alias("url"), F.when(rank > 0, (rank - 1).cast("int")).alias("own"), F.coalesce(affiliate_rank(url), F.lit(9)).alias("mark"))
    counts = F.col("taken") & (F.col("url") != "")
    of = lambda own: F.max(F.when(counts & (F.col("own") == own), F.col("seq")))
    facts = rows.groupBy("post_id").agg(F.min("seq").alias("first"), of(0).alias("any"), of(1).alias("second")).withColumn("start", F.coalesce("any", "first"))
    facts = facts.select("post_id", "start", F.greatest("start", "second").alias("z"))  # greatest: nulls don't count
    live = rows.join(facts, "post_id").where((F.col("seq") >= F.col("start")) & (counts | (F.col("seq") == F.col("start"))))
    sets = (F.col("seq") == F.col("start")) | F.coalesce(F.col("own") == 1, F.lit(False))
    live = live.withColumn("sets", sets)
    # Where another source's link of the first programme came to stand: on one of no programme, just set.
    marked = running(live.where(F.col("sets") | (F.col("mark") < 9)), ["post_id"], "seq", {"prior": (F.struct("sets", "mark"), "last", False)}, rows_a_part)
    stays = (F.col("mark") == 0) & (F.col("sets") | (F.col("prior.sets") & (F.col("prior.mark") == 9)))
    for_good = marked.where(stays).groupBy("post_id").agg(F.min_by("url", "seq").alias("good"), F.lit(True).alias("is_good"))
    after = ~F.col("sets") & (F.col("seq") > F.col("z"))
    last = live.groupBy("post_id").agg(
        F.max_by(F.struct("url", "mark"), F.when(F.col("sets"), F.col("seq"))).alias("set"),
        F.min_by("url", F.when(after & (F.col("mark") < 9), F.col("seq"))).alias("next"), F.max_by("url", F.when(after, F.col("seq"))).alias("last"),
    )
    plain = F.when(F.col("set.mark") == 9, F.coalesce("next", "last", "set.url")).otherwise(F.col("set.url"))
    return last.join(for_good, "post_id", "left").select("post_id", F.when(F.col("is_good"), F.col("good")).otherwise(plain).alias("ticket_url"))


def fold_observations(seen: DataFrame, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """A post an id, as its observations in the order of seq leave it. seen: post_id, seq, title, the times, ticket_url,
    source_name, description, image_url, category; a stored post counts as the observation of the least seq.

    The earliest start stands, with its times, and the link only moves with them; text and image are filled once, the
    first observation's title stays, the category is the last one's. A post of more than rows_a_part observations is
    scanned in parts."""
    marked = written(_taken(seen, rows_a_part), "observations")
    order = F.col("seq")
    once = lambda c: F.min_by(F.trim(c), F.when(~_blank(F.col(c)), order)).alias(c)
    plain = marked.groupBy("post_id").agg(
        F.min_by("title", order).alias("title"), F.max_by(F.struct(*TIMES), F.when(F.col("taken"), order)).alias("times"), once("description"), once("image_url"), F.max_by("category", order).alias("category"), F.count("*").alias("n_observed")
    )
    return plain.join(_link(marked, rows_a_part), "post_id", "left").select("post_id", "title", "times.*", "ticket_url", "description", "image_url", "category", "n_observed")


def cancels(title: Column) -> Column:
    """Whether a listing's title cancels its event: it says so in a form that the promotional rule takes off."""
    return T.is_cancelled(title) & T.has_promo_suffix(title) & ~_blank(title)


def _there(needs: DataFrame, seen: DataFrame, made: DataFrame) -> DataFrame:
    """Those of needs (post_id, seq) whose post is there at that time: what last happened to it before is no deletion."""
    asked = needs.select("post_id").distinct()
    at = lambda df, kind, late: df.select("post_id", (F.col("seq") * 2 + late).alias("at"), "seq", F.lit(kind).alias("kind"))
    events = at(seen.join(asked, "post_id", "left_semi"), "shown", 0).union(at(made.join(asked, "post_id", "left_semi"), "gone", 1)).union(at(needs, "asked", 0))
    told = running(events, ["post_id"], "at", {"prior": (F.when(F.col("kind") != "asked", F.col("kind")), "last", False)})
    return told.where("kind = 'asked' AND prior = 'shown'").select("seq", "post_id")


def deletions(seen: DataFrame, off: DataFrame) -> DataFrame:
    """(post_id, seq): which posts the cancellations delete, and when. seen: post_id, seq, title, day, city_slug of
    observations, off: the same of cancellations, whose post_id is that of the event they name.

    A cancellation deletes its own post; if that isn't there at its time, the one that it most resembles of those that are
    (of equals the least post_id).
    What is there depends on earlier cancellations alone, so they are decided in rounds: each once no earlier undecided one may
    touch what it looks at. One title has one post_id, so what resembles what is found once, before."""
    seen, off = written(seen.select("post_id", "seq", "title", "day", "city_slug"), "seen"), written(off.select("post_id", "seq", "title", "day", "city_slug"), "cancelled")
    made = off.select("post_id", "seq")
    # If each finds its own post, titles need not be compared.
    if not made.join(_there(made, seen, made), ["seq", "post_id"], "left_anti").take(1):
        return made
    titles = seen.join(off.select("city_slug", "day").distinct(), ["city_slug", "day"], "left_semi").groupBy("post_id", "city_slug", "day").agg(F.min_by("title", "seq").alias("title"))
    names = off.groupBy("post_id", "city_slug", "day").agg(F.min_by("title", "seq").alias("title")).withColumn("seq", F.monotonically_increasing_id())
    names, ids = written(names, "cancelled-names"), written(titles.withColumn("number", F.monotonically_increasing_id()), "seen-titles")
    like = like_existing(names.select("seq", "title", "day", "city_slug"), ids.select(F.col("number").alias("post_id"), "title", "day", "city_slug"))
    like = like.join(names.select("seq", F.col("post_id").alias("own")), "seq").join(ids.select(F.col("number"), F.col("post_id").alias("other")), like["post_id"] == F.col("number")).where("own <> other").select("own", "other", "ratio")
    # looks: what each undecided cancellation may delete.
    looks = written(off.select("seq", F.col("post_id").alias("own")).join(like, "own"), "looks")
    while looks.take(1):
        touched = looks.groupBy(F.col("other").alias("post_id")).agg(F.min("seq").alias("first"))
        needs = looks.select("seq", F.col("other").alias("post_id")).union(looks.select("seq", "own")).distinct()
        ready = needs.join(touched, "post_id", "left").groupBy("seq").agg(F.coalesce(F.min("first"), F.col("seq")).alias("first")).where("first >= seq").select("seq")
        now = written(needs.join(ready, "seq", "left_semi"), "ready")
        there = written(_there(now.select("post_id", "seq"), seen, made), "there")
        open_ = looks.join(ready, "seq", "left_semi").join(there.select("seq", F.col("post_id").alias("own")), ["seq", "own"], "left_anti")
        hit = open_.join(there.select("seq", F.col("post_id").alias("other")), ["seq", "other"]).groupBy("seq").agg(F.min_by("other", F.struct(-F.col("ratio"), F.col("other"))).alias("post_id"))
        made = written(made.unionByName(hit.select("post_id", "seq")), "deletions")
        looks = written(looks.join(ready, "seq", "left_anti"), "looks")
    return made


def drop_cancelled(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new (seq, title, start_utc, day, city_slug) without cancelled listings, and the posts (post_id) of existing
    (post_id, title, start_utc, day, city_slug) that these cancel: by fingerprint, else by the best similar title of the day.

    Only titles from which the promotional rule takes the cancellation off count."""
    gone = cancels(F.col("title"))
    fp = T.fingerprint(F.col("title"), F.col("start_utc"), F.col("city_slug"))
    # Both are read several times: their titles are told and fingerprinted once.
    off = written(new.where(gone).withColumn("fp", fp), "cancelled")
    known = written(existing.select("post_id", "title", "day", "city_slug", fp.alias("fp")), "cancelled-known")
    exact = written(off.select("seq", "fp").join(known.select("fp", "post_id"), "fp").groupBy("seq").agg(F.min("post_id").alias("post_id")), "cancelled-exact")
    rest = off.join(exact, "seq", "left_anti")
    like = match_existing(rest.select("seq", "title", "day", "city_slug"), known.select("post_id", "title", "day", "city_slug"))
    return new.where(~gone), exact.select("post_id").union(like.select("post_id")).distinct()
