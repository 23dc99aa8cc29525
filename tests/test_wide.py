"""Clouds wider than the constants of the SQL: no point is lost."""

from silva.operators import voxel


def test_boxes_beyond_the_two_hundredth_are_given(spark):
    p = spark.createDataFrame([(i, 0.5, 0.5, 10.0 * i) for i in range(100)], "pid long, x double, y double, z double")
    got = voxel.tiles(p).select("pid", "box_z").collect()
    assert {r.pid for r in got} == set(range(100))
    assert {(r.pid, r.box_z) for r in got} == {(i, b) for i in range(100) for b in range(332) if 3 * b - 3 <= 10 * i <= 3 * b + 3}


def test_cubes_too_many_for_the_bound_keep_all_points(spark):
    p = spark.createDataFrame([(i, 0.0, 0.0, 10.0 * i) for i in range(1000)], "pid long, x double, y double, z double")
    got = voxel.bordered_cubes(p, 1.0, 2, 1e5).collect()
    assert len({r.pid for r in got}) == 1000 and {round(r.edge, 6) for r in got} == {round(1.1**10, 6)}
    assert min(r.cz for r in got) == 4
