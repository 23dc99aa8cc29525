"""What the driver holds doesn't grow with the cloud."""

from pyspark.sql import functions as F

from silva.operators import neighbors, shape


def cloud(spark):
    return spark.range(300).select(F.col("id").alias("pid"), *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1009)) / 1009.0).alias(a) for k, a in enumerate("xyz")])


def test_copies_for_the_cells_around_are_not_broadcast(spark):
    p = neighbors._cells(neighbors._named(cloud(spark), "p_", []), 0.1, "p_")
    q = neighbors._cells(neighbors._named(cloud(spark), "q_", []), 0.1, "q_")
    for pairs in (q.join(neighbors._around(p), ["cx", "cy", "cz"]), neighbors._around(q).join(p, ["cx", "cy", "cz"])):
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_normals_are_short_enough_to_compile(spark):
    near = spark.createDataFrame([(i, j, 0.0, j + 1) for i in range(4) for j in range(4)], "src long, dst long, d2 double, rank int")
    for found in (shape.normals(cloud(spark), 4, near), shape.linearity(cloud(spark).withColumn("seg_id", F.col("pid") % 3), ["seg_id"])):
        assert max(map(len, found._jdf.queryExecution().optimizedPlan().toString().splitlines())) < 8000
