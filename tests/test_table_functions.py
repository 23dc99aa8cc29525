"""Table functions in SQL against the operators."""

import numpy as np
import pytest

from silva.functions import table_functions
from silva.operators import shape


def test_groups_by_sql(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, radius in ((1, 0.1), (2, 0.25)):
        angle, up = rng.random(300) * 2 * np.pi, rng.random(300)
        rows += [(g, g * 1000 + k, float(5 * g + radius * np.cos(a)), float(radius * np.sin(a)), float(z)) for k, (a, z) in enumerate(zip(angle, up))]
    rows += [(3, 9000 + k, 1e6 + k / 10.0, 1e6, 0.0) for k in range(30)] + [(4, 9900, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "clstr long, pid long, x double, y double, z double")
    points.createOrReplaceTempView("some_points")
    table_functions.register(spark)
    lines = {r.key: r for r in spark.sql("SELECT * FROM silva_linearity(TABLE(SELECT clstr, x, y, z FROM some_points) PARTITION BY clstr)").collect()}
    want = {r.clstr: r for r in shape.linearity(points, ["clstr"]).collect()}
    assert set(lines) == {1, 2, 3, 4} and all(lines[k].n == want[k].n and lines[k].linearity == pytest.approx(want[k].linearity, abs=1e-6) for k in want)
    stems = {r.key: r for r in spark.sql("SELECT * FROM silva_cylinder(TABLE(SELECT clstr, pid, x, y, z FROM some_points) PARTITION BY clstr)").collect()}
    fitted = {r.clstr: r for r in shape.fit_cylinders(points).collect()}
    for g, radius in ((1, 0.1), (2, 0.25)):
        assert stems[g].radius == pytest.approx(radius, abs=1e-3) and stems[g].radius == pytest.approx(fitted[g].radius) and stems[g].n == 300
    assert stems[3].radius is None and stems[4].radius is None
    keys = spark.sql("SELECT v.* FROM some_points, LATERAL silva_voxel(x, y, z, 0.5D) AS v WHERE pid = 9900").collect()
    assert [tuple(r) for r in keys] == [(0, 0, 0)]
