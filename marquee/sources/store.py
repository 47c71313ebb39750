"""The store's own tables: content, cities and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content tables and the column that splits each when it is read from a database.
TABLES = {"posts": "ID", "postmeta": "meta_id", "terms": "term_id", "term_taxonomy": "term_taxonomy_id", "term_relationships": "object_id", "tec_events": "event_id", "tec_occurrences": "event_id", "fingerprints": None}


def read_store(spark: SparkSession, path: str | None = None, jdbc: dict | None = None, prefix: str = "", parts: int = 64) -> dict[str, DataFrame]:
    """The content tables by name, from Parquet folders under path, or from a database (jdbc: url and connection properties).

    From a database, each table is read in ranges of its key, whose bounds are asked for first; filters and the columns that
    are needed go along with each range's query."""
    if path:
        return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in TABLES}
    options = {k: str(v) for k, v in (jdbc or {}).items()}
    mark = "`" if options.get("url", "").startswith(("jdbc:mysql:", "jdbc:mariadb:")) else '"'
    named = lambda name: f"{mark}{name}{mark}"
    out = {}
    for name, key in TABLES.items():
        table, reader = named(prefix + name), spark.read.format("jdbc").options(**options)
        low, high = reader.option("query", f"SELECT min({named(key)}) AS low, max({named(key)}) AS high FROM {table}").load().first() if key else (None, None)
        reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
        if low is not None:
            reader = reader.options(partitionColumn=named(key), lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
        out[name] = reader.load()
    return out


def load_cities(cities: DataFrame, fallback: DataFrame) -> DataFrame:
    """Active cities by name with their gaps filled; fallback (the same columns) where none is active."""
    filled = lambda df: df.select("name", "slug", F.coalesce("tm_dma_id", F.lit("")).alias("dma_id"), F.coalesce("lat", F.lit(0.0)).cast("double").alias("lat"), F.coalesce("lng", F.lit(0.0)).cast("double").alias("lng"), F.when(F.coalesce("radius_miles", F.lit(0)) == 0, 35).otherwise(F.col("radius_miles")).cast("int").alias("radius_miles"))
    active = filled(cities.where("status = 'active'"))
    any_active = active.select(F.lit(1).alias("one")).limit(1)
    spare = filled(fallback).withColumn("one", F.lit(1)).join(any_active, "one", "left_anti").drop("one")
    return active.unionByName(spare).orderBy("name")


def load_sources(sources: DataFrame) -> DataFrame:
    """Active sources in order of city and id: a blank name is the URL's, a kind of its own where the notes give one,
    and notes, a JSON object, as a map; notes that are no object count as none."""
    kind = F.trim(F.coalesce("source_type", F.lit("html_auto")))
    kind = F.when(kind.isin("", "auto", "squarespace"), "html_auto").otherwise(kind)
    parsed = F.coalesce(F.from_json("notes", "map<string, string>"), F.create_map().cast("map<string, string>"))
    rows = sources.where("status = 'active'").withColumn("notes", parsed)
    own = lambda c, value: F.coalesce(F.try_element_at("notes", F.lit(c)), value).alias(c)
    name = F.when(F.coalesce("name", F.lit("")) == "", F.col("url")).otherwise(F.col("name"))
    return rows.select("id", own("name", name), own("url", F.col("url")), own("source_type", kind), "city_slug", "notes").orderBy("city_slug", "id")


def sources_by_city(sources: DataFrame, cities: DataFrame) -> DataFrame:
    """city_slug and its sources in order of id, cities without one too. A city's sources are a short, curated list."""
    each = sources.groupBy("city_slug").agg(F.array_sort(F.collect_list(F.struct("id", "name", "url", "source_type"))).alias("sources"))
    known = cities.select(F.col("slug").alias("city_slug")).union(sources.select("city_slug")).distinct()
    return known.join(each, "city_slug", "left")
