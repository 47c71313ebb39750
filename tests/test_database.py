"""The store read from a database: the Derby that Spark brings along."""

from pyspark.sql import functions as F

from marquee.sources.store import TABLES, read_store


def test_a_database_gives_what_parquet_gives(spark, tmp_path):
    jdbc = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    made = {}
    for name, key in TABLES.items():
        n = 0 if name == "tec_occurrences" else 500
        made[name] = spark.range(n).select((F.col("id") * 3 + 7).alias(key or "fp_id"), F.concat(F.lit(f"{name} "), F.col("id").cast("string")).alias("meta_value"), (F.col("id") % 4).cast("int").alias("kind"))
        made[name].write.parquet(f"{tmp_path}/parquet/{name}.parquet")
        made[name].coalesce(1).write.format("jdbc").options(**jdbc).option("dbtable", f'"wp_{name}"').save()
    held, read = read_store(spark, path=f"{tmp_path}/parquet"), read_store(spark, jdbc=jdbc, prefix="wp_", parts=5)
    for name, key in TABLES.items():
        assert sorted(tuple(r) for r in read[name].collect()) == sorted(tuple(r) for r in held[name].collect())
        # Ranges of the key, each a query of its own; a table without a key or rows is one.
        assert read[name].rdd.getNumPartitions() == (5 if key and name != "tec_occurrences" else 1)
    sizes = [len(p) for p in read["postmeta"].rdd.glom().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 120
    plan = read["postmeta"].where("kind = 2").select("meta_value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(kind), *EqualTo(kind,2)]" in plan and "meta_id" not in plan.split("ReadSchema")[1]
