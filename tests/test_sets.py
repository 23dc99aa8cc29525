"""Lists of groups, first occurrences and cubes with empty layers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silva.operators import sets, voxel


def test_first_occurrences_keep_their_order(spark):
    given = [5, 3, 5, None, 9, 3, 1, None, 1]
    table = spark.createDataFrame(list(enumerate(given)), "at long, k long").repartition(5)
    got = {r.place: r.k for r in sets.distinct_in_order(table, ["k"], ["at"]).collect()}
    assert [got[i] for i in range(len(got))] == list(dict.fromkeys(given))
    assert sets.distinct_in_order(table.limit(0), ["k"], ["at"]).count() == 0


def test_lists_hold_each_value_once_and_end_in_time(spark):
    rows = [(k, i * 7 % 50) for i in range(900) for k in ([0] if i % 3 else [1, None])] + [(2, None), (3, 4), (3, None)]
    got = sets.lists(spark.createDataFrame(rows, "k long, v long").repartition(7), ["k"], "v", 64).collect()
    assert max(len(r.v) for r in got) == 64 and sum(len(r.v) for r in got) == sum(v is not None for _, v in rows)
    for k in (0, 1, None, 3):
        parts = [r.v for r in sorted((r for r in got if r.k == k), key=lambda r: r.part)]
        assert [v for p in parts for v in p] == sorted(v for o, v in rows if o == k and v is not None)
    assert not any(r.k == 2 for r in got)


def test_rows_that_are_equal_meet_in_several_tasks(spark):
    same = spark.range(0, 20_000, 1, 8).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    got = sets.lists(same, ["k"], "v", 500)
    assert {len(r.v) for r in got.collect()} == {500} and got.count() == 40


@pytest.mark.parametrize("most, edge, layers", [(4e9, 0.5, 2), (3e4, None, 2), (10, 0.5 * 1.1**10, 3)])
def test_cubes_grow_until_the_grid_is_small_enough(spark, most, edge, layers):
    xyz = np.random.default_rng(4).uniform([-3, 0, 2], [9, 7, 6], size=(300, 3))
    table = spark.createDataFrame([(i, *map(float, p), 7) for i, p in enumerate(xyz)], "pid long, x double, y double, z double, edge_of long")
    got = voxel.bordered_cubes(table, 0.5, 2, most)
    assert got.columns == [*table.columns, "edge", "cx", "cy", "cz", "cell"]
    rows = got.collect()
    (used,) = {r.edge for r in rows}
    span = np.ptp(xyz, axis=0)
    if edge is None:
        assert 0.5 < used < 0.5 * 1.1**10
        for e, fits in ((used, True), (used / 1.1, False)):
            assert (8 * np.prod(np.ceil(span / e) + 2 * layers + 1) <= most) == fits
    else:
        assert used == pytest.approx(edge)
    n = np.ceil(span / used) + 2 * layers + 1
    for r in rows:
        at = np.floor((xyz[r.pid] - xyz.min(axis=0)) / used) + layers + 1
        assert [r.cx, r.cy, r.cz] == at.tolist() and r.cell == at[0] + (at[1] - 1) * n[0] + (at[2] - 1) * n[0] * n[1]
        assert np.all(at > layers) and np.all(at <= n - layers)


def test_voxels_replace_those_of_an_earlier_call(spark):
    table = spark.createDataFrame([(1, 0.6, 0.2, 3.0), (2, 1.4, 0.2, 3.0)], "pid long, x double, y double, z double")
    once = voxel.voxelise(table, 0.5)
    flat = voxel.voxelise(once, 1.0, flat=True)
    assert flat.columns == [*table.columns, "ix", "iy", "xx", "yy"] and [r.ix for r in flat.orderBy("pid").collect()] == [0, 1]
    again = voxel.downsample_first(voxel.downsample_first(table, 1.0, keep_all=True), 2.0, keep_all=True)
    assert again.columns.count("downsample") == 1 and [r.downsample for r in again.orderBy("pid").collect()] == [True, False]
