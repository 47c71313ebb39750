"""Connected components of a link table, by alternating stars.

Each round points every vertex at the smallest neighbour, first from the larger side of each link and then
from the smaller. Rounds are logarithmic in the size of a component; a hub with very many links is
pre-aggregated before its shuffle and joined apart, by a broadcast of at most 1000 rows. Each round is a
written table.

Defined results: links of a vertex with itself or with null are ignored; repeated links count once; an empty
table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of at least this many rows, and of a thousandth of all, is joined apart; fewer rows than FEW are one small join.
HOT, FEW = 1000, 20_000

from marquee.tables import tidy, written


def joined(rows: DataFrame, facts: DataFrame, key: str, n: int) -> DataFrame:
    """rows joined with facts on key. facts: a row a key, with held, how many of the n rows have it.

    Keys of max(HOT, n / 1000) rows or more are at most 1000 whatever n is: these are broadcast, so that the rows
    of a hub stay where they are, and only the others meet by a shuffle on the key."""
    bound = max(HOT, n // 1000)
    if n < FEW:
        return rows.join(facts.drop("held"), key)
    hot = F.broadcast(facts.where(F.col("held") >= bound).drop("held"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("held") < bound).drop("held"), key))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")).select("u", F.least("u", "m").alias("m"), "held")
    return joined(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held"))
    across = joined(links, least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) of a links table with u > v -> (id, component) for every vertex but the smallest of each component."""
    links = written(links.where("u > v").select("u", "v").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        # As a decimal, for sums of hashes overflow.
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = state(links)
    tidy(links.sparkSession)
    while now[0]:
        # The large star never adds rows.
        links = written(_small_star(_large_star(links, now[0]), now[0]), "links")
        then, now = now, state(links)
        if now == then:
            break
    return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
