from pyspark.sql import functions as F

from strandloom.operators.graph import components
from strandloom.operators.skew import spread_join


def test_a_key_with_a_third_of_the_rows_is_spread(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    groups = spark.createDataFrame(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = spread_join(rows, groups, "k", "n", least=1000)
        per = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per) == 30_000 and max(per) < 0.4 * 30_000
        assert sorted(map(tuple, out.select("k", "v", "top").collect())) == sorted(map(tuple, rows.join(groups, "k").select("k", "v", "top").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_keys_and_empty_sides(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v int")
    groups = spark.createDataFrame([("a", 2, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, n int, w string")
    for least in (1, 100):
        assert sorted((r.k, r.v, r.w) for r in spread_join(rows, groups, "k", "n", least=least).collect()) == [("a", 2, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 3, "y")]
        assert spread_join(rows, groups.limit(0), "k", "n", least=least).count() == 0


def test_components_with_a_hub_a_chain_and_loops(spark):
    edges = [(1000, i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7), (3000, 3001), (3001, 3000)]
    out = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in (1000, *range(1, 200))} == {1} and {out[i] for i in range(2000, 2041)} == {2000} and out[3001] == 3000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
