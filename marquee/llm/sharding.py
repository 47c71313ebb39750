"""Shards that all hold the corpus's mixture of sources, by proportional stratified interleaving.

The rows of each source are shuffled by a seeded digest of their id and text, and ranked. Rank r of n becomes the
fractional rank (r + u) / n, where u, between 0 and 1, is a digest of the source: so a source's rows lie evenly between 0
and 1, and sources of a single row don't meet in one place. All rows in the order of fractional ranks are one sequence in
which any stretch has the mixture; it is cut into equal stretches. Counts of shards differ by one at most, and a source's
share in a shard differs from its due by less than two rows.

No rank is taken in one task: rows are dealt to buckets of a shuffle key (or of the fractional rank), buckets are counted,
and a row's rank is what lies before its bucket and its number within. Texts are read once and only numbers are shuffled.

Defined results: a null text has no bytes (size 1, checksum 0); null sources are a source of their own; null ids are rows
like any other; rows that are repeated are dealt singly, so copies spread over the shards (of a row that very many others
repeat the places follow its place in the table, else the result depends on the seed alone); a text may be of any length,
for only its digests are kept; an empty table gives an empty one; other columns are left out unless kept by name, and then
those named like a result give way to it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import quoted, without, written

#: A row repeated so often, and by a thousandth of all rows, is told apart by its place in the table: at most 1000 are.
REPEATED = 1000


def _digest(*parts: Column, digits: int = 15) -> Column:
    """A number of so many hexadecimal digits out of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, digits), 16, 10).cast("long")


def _numbered(rows: DataFrame, part: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """rows with name, their number from 0 by order within part. bucket rises with the order; each is numbered by a task."""
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(*part, "_bucket").agg(F.count("*").alias("_held"))
    before = sizes.select(*part, "_bucket", (F.sum("_held").over(Window.partitionBy(*part).orderBy("_bucket")) - F.col("_held")).alias("_before"))
    within = dealt.withColumn("_within", F.row_number().over(Window.partitionBy(*part, "_bucket").orderBy(*order)) - 1)
    return within.join(before, [*part, "_bucket"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def interleave(df: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", stratum: str = "source", keep: Iterable[str] = (), rows_per_bucket: int = 20_000) -> DataFrame:
    """(id_col, the columns of keep, size, text_crc32, law, shard, slot, grown_shard) of every row.

    law: ``rows``, for counts are what is equal. grown_shard is for laws of a key, and null here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = without(df.select([quoted(c) for c in keep]), [id_col, *out])
    rows = df.select(
        F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("")).alias("_stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"), *[quoted(c) for c in kept],
    )
    rows = written(rows, "sharding-rows")
    n = rows.count()
    # What very many rows repeat: at most 1000 ids and digests.
    often = rows.groupBy("_id", "text_crc32", "size").agg(F.count("*").alias("_held")).where(F.col("_held") >= max(REPEATED, n // 1000))
    often = often.select(F.col("_id").alias("_often"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.lit(True).alias("_hot"))
    same = F.col("_id").eqNullSafe(F.col("_often")) & (F.col("text_crc32") == F.col("_crc")) & (F.col("size") == F.col("_size"))
    rows = rows.join(F.broadcast(often), same, "left").drop("_often", "_crc", "_size")
    known = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    rows = rows.withColumn("_draw", _digest(F.lit(str(seed)), known, F.col("text_crc32").cast("string"), F.when(F.col("_hot"), F.col("_row").cast("string"))))
    buckets = max(1, n // rows_per_bucket, min(n // 500, 1000))
    in_source = _numbered(rows, ["_stratum"], F.floor(F.col("_draw") / (16.0**15 / buckets)), ["_draw", "_id", "text_crc32", "size"], "_rank")
    of_source = rows.groupBy("_stratum").agg(F.count("*").alias("_n")).withColumn("_shift", _digest(F.lit(str(seed)), F.col("_stratum"), digits=13) / F.lit(16.0**13))
    part = (F.col("_rank") + F.col("_shift")) / F.col("_n")
    spread = written(in_source.join(of_source, "_stratum").withColumn("_part", part), "sharding-parts")
    placed = _numbered(spread.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_part") * buckets), ["_part", "_stratum", "_draw", "_id", "text_crc32", "size"], "_place")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", F.expr(f"cast(_place * {shards} div {max(1, n)}L as int)")).select(
        F.col("_id").alias(id_col), *[quoted(c) for c in kept], "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
