"""Tiles of many points are counted whole."""

from pyspark.sql import functions as F

from silva.plans import catalog


def test_a_tile_beyond_the_sample_is_counted_whole(spark, tmp_path):
    same = spark.range(20_500).select(F.col("id").alias("o_orderkey"), F.lit(100).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(10_000.0).alias("o_totalprice"), F.lit("1995-01-02").cast("timestamp").alias("o_orderdate"))
    same.write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.queries()["tile_min_points"](spark, str(tmp_path)).collect()
    assert got and {r.n for r in got} == {20_500}
