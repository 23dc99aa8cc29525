"""Point views over the driver's tables: a cloud has pid, x, y, z and a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views in DuckDB SQL.
SQL = {
    "embed": "SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label % 4 AS INTEGER) AS label FROM embeddings",
    "orders_": "SELECT o_orderkey AS pid, o_totalprice / CAST(10000 AS DOUBLE) AS x, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / CAST(100 AS DOUBLE) AS y, CAST(o_custkey AS DOUBLE) / CAST(100 AS DOUBLE) AS z, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END AS label FROM orders",
    "line_": "SELECT l_quantity AS x, l_extendedprice / CAST(1000 AS DOUBLE) AS y, l_discount * CAST(100 AS DOUBLE) AS z, l_returnflag AS flag FROM lineitem",
    "event_": "SELECT event_id AS pid, CAST(hour(ts) AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, value AS z, event_type FROM events",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *axes, (F.col("label") % 4).cast("int").alias("label"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(3)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), (F.col("o_totalprice") / 10000.0).alias("x"), (day / 100.0).alias("y"), (F.col("o_custkey").cast("double") / 100.0).alias("z"), kind.alias("label"))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") * 100.0).alias("z"), F.col("l_returnflag").alias("flag"))


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), F.hour("ts").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("z"), "event_type")
