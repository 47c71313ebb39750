"""Listings from landed files: each micro-batch adds rows of its own, and posts are their fold, one a fingerprint.

Batches never read or rewrite what is stored, so their cost follows the batch alone. A batch's folder bears its
number and is overwritten, so one that is run again after a failure leaves no row twice. Cancellations are rows like the
others: markers that delete the post of their fingerprint (or the most similar one that is there) as of their place.

``compact`` folds what has landed into a snapshot of posts, kept in buckets of fingerprints. Only buckets that new
batches touch are read and written again; a manifest says which version of each bucket counts, and is what makes a
snapshot visible at once. Reading folds the batches that came after the last manifest onto it.

    store/batches/batch=N           observations and cancellations of a micro-batch
    store/posts/upto=N/bucket=B     posts of bucket B, as the batches up to N leave them
    store/manifests/upto=N          (bucket, version): the snapshot N is these buckets"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.functions import text as T
from marquee.operators.fold import TIMES, cancels, deletions, fold_observations
from marquee.tables import ready, written

SCHEMA = "seq long, title string, description string, start_utc string, city_slug string, image_url string, ticket_url string, source_name string, category string"
#: The order of observations is that of batches, then of rows; a snapshot comes before all of them.
_SPAN = 1 << 40
#: Buckets of fingerprints; fixed for a store once it has a snapshot.
BUCKETS = 256
_OBSERVED = f"{SCHEMA}, fp string, cancels boolean, batch long, n_before long"


def normalized(rows: DataFrame) -> DataFrame:
    """rows without blank titles, with their fingerprint, and whether they cancel their event.

    Titles that say cancelled in a form that the promotional rule leaves in place neither cancel nor list anything."""
    live = rows.where(F.trim(F.coalesce("title", F.lit(""))) != "").withColumn("cancels", F.coalesce(cancels(F.col("title")), F.lit(False)))
    return live.where(F.col("cancels") | ~T.is_cancelled(F.col("title"))).withColumn("fp", T.fingerprint(F.col("title"), F.col("start_utc"), F.col("city_slug")))


def ingest_stream(spark: SparkSession, in_dir: str, store_dir: str, checkpoint: str, most_files: int | None = None) -> StreamingQuery:
    """Takes in all JSON-lines files that have landed in in_dir, at most so many a batch, and stops; a later run takes in later ones."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store_dir}/batches/batch={number}")

    reader = spark.readStream.schema(SCHEMA)
    source = (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).json(in_dir)
    return normalized(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def post_id(fp: Column) -> Column:
    """A number that a fingerprint always has: its first 60 bits."""
    return F.conv(F.substring(fp, 1, 15), 16, 10).cast("long")


def bucket_of(fp: Column) -> Column:
    return (F.conv(F.substring(fp, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def _placed(observed: DataFrame) -> DataFrame:
    return observed.withColumn("at", F.col("batch") * _SPAN + F.col("seq"))


def _block() -> list[Column]:
    """Day and city, within which titles are compared; the same for all rows of a fingerprint."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return [F.substring(text("start_utc"), 1, 10).alias("day"), F.lower(text("city_slug")).alias("city_slug")]


def _deleted(observed: DataFrame) -> DataFrame:
    """(fp, last): when the last cancellation of each fingerprint deleted its post. observed: with at."""
    if not observed.where("cancels").take(1):
        return observed.select("fp", F.col("at").alias("last")).where("false")
    rows = observed.select(F.col("fp").alias("post_id"), F.col("at").alias("seq"), "title", *_block(), "cancels")
    return deletions(rows.where("NOT cancels"), rows.where("cancels")).groupBy(F.col("post_id").alias("fp")).agg(F.max("seq").alias("last"))


def posts_of(observed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One post a fingerprint, by the rules of fold_observations, of what was observed after its last deletion.

    observed: the columns of SCHEMA with fp, cancels, batch and n_before; deleted (fp, last), if it is known already."""
    placed = _placed(observed)
    gone = _deleted(placed) if deleted is None else deleted
    # Written once: the fold reads it several times, and what is stored lies in a file a bucket at least.
    live = placed.where("NOT cancels").join(gone, "fp", "left").where("last IS NULL OR at > last")
    live = written(live.select("fp", "at", "title", "start_utc", "ticket_url", "source_name", "description", "image_url", "category", "city_slug", "n_before"), "live")
    start = F.col("start_utc")
    seen = live.select(F.col("fp").alias("post_id"), F.col("at").alias("seq"), "title", start, *(start.alias(c) for c in TIMES if c not in ("start_utc", "timezone")), F.lit("UTC").alias("timezone"), "ticket_url", "source_name", "description", "image_url", "category")
    city = live.groupBy(F.col("fp").alias("post_id")).agg(F.min_by("city_slug", "at").alias("city_slug"), F.sum(F.coalesce("n_before", F.lit(1))).cast("long").alias("n_observed"))
    folded = fold_observations(seen).drop("n_observed").join(city, "post_id")
    return folded.select(post_id(F.col("post_id")).alias("post_id"), F.col("post_id").alias("fp"), "title", "description", "image_url", "ticket_url", "category", "city_slug", "start_utc", "n_observed")


def _children(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the folders name=N."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    written = [n for n in found if n.startswith(f"{name}=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in written)


def _manifest(spark: SparkSession, store_dir: str) -> tuple[int, dict[int, int]]:
    """The last snapshot's number (-1: none), and the version of each bucket: at most BUCKETS rows."""
    upto = _children(spark, f"{store_dir}/manifests", "upto")
    if not upto:
        return -1, {}
    return upto[-1], {r["bucket"]: r["version"] for r in spark.read.parquet(f"{store_dir}/manifests/upto={upto[-1]}").collect()}


def _stored(spark: SparkSession, store_dir: str, versions: dict[int, int]) -> DataFrame:
    """Posts of some buckets as observations of a time before all others."""
    if not versions:
        return spark.createDataFrame([], _OBSERVED)
    held = spark.read.parquet(*[f"{store_dir}/posts/upto={v}/bucket={b}" for b, v in sorted(versions.items())])
    # A link is of the source whose mark it bears.
    source = F.when(F.contains("ticket_url", F.lit("aaid=")), "ticketmaster")
    rows = held.withColumnsRenamed({"n_observed": "n_before"}).withColumns({"seq": F.lit(0).cast("long"), "batch": F.lit(-1).cast("long"), "source_name": source, "cancels": F.lit(False)})
    return rows.select(spark.createDataFrame([], _OBSERVED).columns)


def _landed(spark: SparkSession, store_dir: str, after: int) -> tuple[DataFrame, int]:
    """What landed after a batch, and the last batch's number."""
    new = [b for b in _children(spark, f"{store_dir}/batches", "batch") if b > after]
    rows = spark.createDataFrame([], _OBSERVED)
    if new:
        landed = spark.read.option("basePath", f"{store_dir}/batches").parquet(*[f"{store_dir}/batches/batch={b}" for b in new])
        rows = landed.withColumns({"batch": F.col("batch").cast("long"), "n_before": F.lit(1).cast("long")}).select(rows.columns)
    return rows, max([after, *new])


def read_posts(spark: SparkSession, store_dir: str) -> DataFrame:
    """All posts: the last snapshot, and what landed after it folded onto it."""
    last, versions = _manifest(spark, store_dir)
    return posts_of(_stored(spark, store_dir, versions).unionByName(_landed(spark, store_dir, last)[0]))


def compact(spark: SparkSession, store_dir: str) -> int:
    """Writes a snapshot of the posts as of the last landed batch and returns that batch's number.

    Buckets without a new row keep their version. Of the other stored posts only those of a day and city of a cancellation
    are looked at, by title, for one that it may mean. A snapshot counts once its manifest is there; running it again, or
    after a failure, gives the same one. Older versions stay for those who read them (see ``vacuum``)."""
    ready(spark)
    last, versions = _manifest(spark, store_dir)
    landed, upto = _landed(spark, store_dir, last)
    if upto == last:
        return last
    new = written(landed, "landed")
    named = [c.alias(f"_{i}") for i, c in enumerate(_block())]
    days, stored = new.where("cancels").select(*named).distinct(), _stored(spark, store_dir, versions)
    near = stored.select("*", *named).join(days, ["_0", "_1"], "left_semi").select(stored.columns)
    deleted = written(_deleted(_placed(new.unionByName(near))), "deleted")
    touched = {r[0] for r in new.select("fp").union(deleted.select("fp")).select(bucket_of(F.col("fp"))).distinct().collect()}  # at most BUCKETS numbers
    before = _stored(spark, store_dir, {b: v for b, v in versions.items() if b in touched})
    posts = posts_of(before.unionByName(new), deleted).withColumn("bucket", bucket_of(F.col("fp")))
    path = f"{store_dir}/posts/upto={upto}"
    posts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    held = {r[0] for r in spark.read.parquet(path).select("bucket").distinct().collect()} if _has_files(spark, path) else set()
    now = {b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(held, upto)
    rows = spark.createDataFrame(sorted(now.items()), "bucket int, version long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{store_dir}/manifests/upto={upto}")
    return upto


def _has_files(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(s.isDirectory() for s in fs.listStatus(path))


def vacuum(spark: SparkSession, store_dir: str, keep: int = 2) -> int:
    """Removes manifests but for the last ``keep``, and buckets that none of these names. Returns how many buckets went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    delete = lambda folder: (p := jvm.org.apache.hadoop.fs.Path(folder)).getFileSystem(conf).delete(p, True)
    upto = _children(spark, f"{store_dir}/manifests", "upto")
    named = {(r["bucket"], r["version"]) for n in upto[-keep:] for r in spark.read.parquet(f"{store_dir}/manifests/upto={n}").collect()}
    for n in upto[:-keep]:
        delete(f"{store_dir}/manifests/upto={n}")
    gone = 0
    for version in _children(spark, f"{store_dir}/posts", "upto"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{store_dir}/posts/upto={version}")
        for s in folder.getFileSystem(conf).listStatus(folder):
            name = s.getPath().getName()
            if version <= max(upto, default=-1) and name.startswith("bucket=") and (int(name[7:]), version) not in named:
                delete(f"{store_dir}/posts/upto={version}/{name}")
                gone += 1
    return gone


def enrichment_queue(posts: DataFrame) -> DataFrame:
    """Posts that still need a text."""
    return posts.where(F.trim(F.coalesce("description", F.lit(""))) == "")


def apply_enrichment(posts: DataFrame, results: DataFrame) -> DataFrame:
    """posts with the texts of results (fp, text) where they have none yet."""
    one = results.groupBy("fp").agg(F.min("text").alias("new_text"))
    empty = F.trim(F.coalesce("description", F.lit(""))) == ""
    return posts.join(one, "fp", "left").withColumn("description", F.when(empty, F.coalesce("new_text", "description")).otherwise(F.col("description"))).drop("new_text")
