"""The attribute store: pivot, deduplication, orphans, deletes, index rows, upsert, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.tables import written


def pivot_meta(meta: DataFrame, keys: list[str]) -> DataFrame:
    """A row a post, a column a key with its largest value. The keys are filtered before the one shuffle, maxima combine before it."""
    return meta.where(F.col("meta_key").isin(keys)).groupBy("post_id").pivot("meta_key", keys).agg(F.max("meta_value"))


def event_view(posts: DataFrame, meta: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return posts.join(pivot_meta(meta, keys), "post_id", how)


def dedup_meta(meta: DataFrame) -> DataFrame:
    """The latest row of each post and key. max_by aggregates partially, unlike a ranking window."""
    return meta.groupBy("post_id", "meta_key").agg(F.max("meta_id").alias("meta_id"), F.max_by("meta_value", "meta_id").alias("meta_value"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def drop_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_semi")


def orphan_attachments(attachments: DataFrame, meta: DataFrame, key: str = "_thumbnail_id") -> DataFrame:
    """Attachments that no post's image value names; values that are no number name none."""
    used = meta.where(F.col("meta_key") == key).select(F.expr("try_cast(meta_value AS bigint)").alias("post_id"))
    return attachments.join(used, "post_id", "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the posts in ids (post_id)."""
    return {name: df.join(ids.select(F.col("post_id").alias(key)), key, "left_anti") for name, (df, key) in tables.items()}


def counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows by value, most first; a top-n report if n is given."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column).limit(n) if n else out


def repeated(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values that occur more than once."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), column).limit(n)


def excess_rows(meta: DataFrame, keys: list[str]) -> DataFrame:
    """By key: rows beyond the first of each post, and posts that have any."""
    each = meta.where(F.col("meta_key").isin(keys)).groupBy("post_id", "meta_key").agg(F.count("*").alias("n")).where("n > 1")
    return each.groupBy("meta_key").agg(F.sum(F.col("n") - 1).alias("excess"), F.count("*").alias("posts"))


def fanout(posts: DataFrame, meta: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows that a join of posts with both tables would give; both are counted first, so it isn't made."""
    m, r = (df.groupBy("post_id").agg(F.count("*").alias(n)) for df, n in ((meta, "n_meta"), (relations, "n_terms")))
    out = posts.select("post_id").join(m, "post_id", "left").join(r, "post_id", "left").na.fill(0, ["n_meta", "n_terms"])
    return out.withColumn("n_joined", F.greatest("n_meta", F.lit(1)) * F.greatest("n_terms", F.lit(1)))


def to_postmeta(events: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Long rows (post_id, meta_key, meta_value) of the given columns, absent values left out."""
    wide = events.select("post_id", *(c.cast("string").alias(k) for k, c in columns.items()))
    return wide.unpivot("post_id", list(columns), "meta_key", "meta_value").where(F.col("meta_value").isNotNull())


def calendar_index(events: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    """Start and end, local and UTC, duration in seconds (two hours if there is none), and a hash. A text that is no time
    stays as it is and has no local time."""
    start, end = F.try_to_timestamp("start_utc"), F.try_to_timestamp("end_utc")
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    shown = lambda t: F.date_format(F.from_utc_timestamp(t, zone), "yyyy-MM-dd HH:mm:ss")
    return events.select(
        "post_id", "start_utc", "end_utc", shown(start).alias("start_local"), shown(end).alias("end_local"),
        F.when(seconds > 0, seconds).otherwise(F.lit(7200)).alias("duration"),
        F.sha1(F.concat(F.col("post_id").cast("string"), F.col("start_utc"), F.col("end_utc"))).alias("hash"),
    )


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of each key in updates replaced by these."""
    return target.join(updates.select(keys).distinct(), keys, "left_anti").unionByName(updates)


def ensure_members(names: DataFrame, members: DataFrame, name: str, ident: str, parts: int = 64) -> DataFrame:
    """members and a new one for each unknown name; new ids follow the largest, by name.

    Unknown names are dealt in ranges, and each range is numbered from where the ones before it end, so no task sees
    them all."""
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(members.select(name), name, "left_anti")
    dealt = written(new.repartitionByRange(parts, name).withColumn("part", F.spark_partition_id()), "new-members")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # at most `parts` rows
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    most = members.agg(F.coalesce(F.max(ident), F.lit(0)).cast("long").alias("most")).first()["most"]
    numbered = dealt.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(name))).join(F.broadcast(before), "part")
    return members.select(ident, name).unionByName(numbered.select((F.col("i") + F.col("before") + F.lit(most)).cast("long").alias(ident), name))
