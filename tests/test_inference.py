"""Models over tiles, parameters, and the run from scan to trees with leaves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silva.operators import inference, voxel
from silva.plans import pipelines


def tiles(spark):
    xyz = np.random.default_rng(6).uniform([0, 0, 0], [14, 8, 3], size=(900, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    return voxel.sample_tiles(voxel.tiles(points), 20).cache()


def test_models_get_whole_tiles_in_batches(spark):
    tiled = tiles(spark)

    def load():
        loaded = np.random.default_rng().uniform()  # tells one load from another

        def predict(rows):
            size = rows.groupby("tile").x.transform("size")
            return pd.DataFrame({"size": size, "tiles": rows.tile.nunique(), "last": rows.tile.max(), "x0": rows.x, "loaded": loaded})

        return predict

    got = inference.infer(tiled.coalesce(2), load, ["size", "tiles", "last", "x0", "loaded"], 4).toPandas()
    want = tiled.toPandas()
    assert len(got) == len(want)
    both = got.merge(want, on=[*inference.TILE, "pid"])
    assert len(both) == len(want) and (both["size"] == both.box_size).all() and np.allclose(both.x0, both.x_y - both.local_x)
    assert got.tiles.max() == 4 and (got["last"] == got.tiles - 1).all()
    tasks = inference.infer(tiled, load, ["size", "tiles", "last", "x0", "loaded"], 4).withColumn("task", F.spark_partition_id()).toPandas()
    assert (tasks.groupby("task").loaded.nunique() == 1).all()


def test_a_cloud_without_full_tiles_has_no_rows(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], "pid long, x double, y double, z double")
    for some in (points, points.limit(0)):
        assert pipelines.classify(some, lambda rows: rows, at_least=10).count() == 0


def test_parameters_come_from_names():
    assert pipelines.parameters(pipelines.Stems, {"eps": 0.3}) == pipelines.Stems(eps=0.3)
    with pytest.raises(ValueError, match="epz"):
        pipelines.parameters(pipelines.Leaves, {"epz": 0.3, "k": 3})


def test_a_scan_becomes_trees_with_leaves_and_goes_on_where_it_stopped(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(a, b, c / 50) for a, b, c in rng.uniform([-1, -1, 0], [4, 1, 1], size=(900, 3))]
    for x, r in ((0.0, 0.15), (3.0, 0.1)):
        turn, h = rng.uniform(0, 2 * np.pi, 900), rng.uniform(0.1, 2.6, 900)
        rows += [(x + r * np.cos(t), r * np.sin(t), z) for t, z in zip(turn, h)]
        rows += [(x + a, b, 2.75 + c) for a, b, c in rng.uniform(-0.4, 0.4, size=(80, 3)) * [1, 1, 0.3]]
    rows = [(i, *map(float, p)) for i, p in enumerate(rows)]
    middle, reads = np.mean([r[3] for r in rows]), []

    def load():
        def predict(local):
            z = local.z + middle
            return pd.DataFrame({"pTerrain": np.where(z < 0.05, 0.9, 0.0), "pLeaf": np.where(z > 2.615, 0.8, 0.1), "pCWD": 0.0, "pWood": np.where((z >= 0.05) & (z <= 2.615), 0.9, 0.0)})

        return predict

    def read():
        reads.append(1)
        return spark.createDataFrame(rows, "pid long, x double, y double, z double")

    scan = pipelines.Scan(step=20.0, side=40.0, at_least=50, k=1)  # one tile holds all, so its middle is the cloud's
    stems = pipelines.Stems(slice_height=0.3, eps=0.15, at_least=5, more_than=20, k=50, longest=0.5, stem_eps=0.15, stem_at_least=10, stem_points=50)
    run = lambda **leaves: pipelines.trees_of_scan(spark, str(tmp_path), read, load, scan, stems, pipelines.Leaves(**leaves))
    first = run()
    counts = {(r.tree, r.wood): r.n for r in first.groupBy("tree", "wood").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {(1, 1), (1, 0), (2, 1), (2, 0)} and min(counts[1, 1], counts[2, 1]) > 700 and min(counts[1, 0], counts[2, 0]) > 60
    assert first.groupBy("tree").agg(F.round(F.avg("x")).alias("x")).orderBy("tree").collect() == [(1, 0.0), (2, 3.0)]
    assert run().count() == first.count() and run(longest=0.0001).where("wood = 0").count() == 0 and len(reads) == 1
