"""Numbered, resumed and boxed tables."""

import pytest
from pyspark.sql import functions as F

from silva.operators import tables, voxel
from silva.plans import pipelines


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(8)
    got = tables.numbered(rows, ["k"]).collect()
    assert sorted(r.row for r in got) == list(range(1000)) and all(r.row == r.k for r in got)
    assert tables.numbered(rows.limit(0), ["k"]).count() == 0


def test_stages_are_resumed_with_equal_parameters(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    for parameters in ({"a": 1}, {"a": 1}, {"a": 2}, {"a": 2}):
        assert tables.resumed(spark, str(tmp_path), "five", make, parameters).count() == 5
    assert len(made) == 2


def test_finished_stages_leave_no_files(spark, tmp_path):
    import os

    one = tables.stage(spark.range(10), "gone")
    folder = one.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    tables.drop_stages(one)
    assert not os.path.isdir(folder)


def test_boxes_hold_their_points_around_their_middle(spark, tmp_path):
    points = spark.range(400).select(F.col("id").alias("pid"), (F.col("id") % 20 / 4).alias("x"), (F.floor(F.col("id") / 20) / 4).alias("y"), F.lit(0.5).alias("z"))
    tiled = voxel.sample_tiles(voxel.tiles(points), 10)
    pipelines.write_boxes(tiled, str(tmp_path / "boxes"))
    back = spark.read.parquet(str(tmp_path / "boxes"))
    assert back.count() == tiled.count()
    means = back.groupBy("box_x", "box_y", "box_z").agg(F.avg("x").alias("m")).collect()
    assert all(r.m == pytest.approx(0, abs=0.51) for r in means)
