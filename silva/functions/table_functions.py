"""Table functions for ``spark.sql``: voxel keys of a point, and per partition of a table its linearity and its cylinder.

    SELECT * FROM silva_cylinder(TABLE(SELECT clstr, pid, x, y, z FROM stems) PARTITION BY clstr)

A table function sees the rows of one key in one task, so it suits many groups of bounded size; :mod:`silva.operators.shape` has the forms for groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators import shape


class _Voxel:
    """ix, iy, iz of the cube that holds a point, by the floor of its coordinates."""

    def eval(self, x: float, y: float, z: float, size: float) -> Iterator[tuple]:
        if None not in (x, y, z, size) and size > 0:
            yield tuple(int(np.floor(v / size)) for v in (x, y, z))


class _Linearity:
    """First column of the table as the group's name, its points, and the share by which the largest eigenvalue of columns x, y, z exceeds the second: sums alone are kept."""

    def __init__(self) -> None:
        self.key, self.n, self.origin = None, 0, None
        self.sums, self.squares = np.zeros(3), np.zeros((3, 3))

    def eval(self, row: Row) -> None:
        self.key = row[0]
        p = np.array([row["x"], row["y"], row["z"]], dtype=float)
        self.origin = p if self.origin is None else self.origin  # sums about a point of the group don't cancel
        self.n, self.sums, self.squares = self.n + 1, self.sums + (p - self.origin), self.squares + np.outer(p - self.origin, p - self.origin)

    def terminate(self) -> Iterator[tuple]:
        if not self.n:
            return
        found = 0.0
        if self.n >= 5:
            middle = self.sums / self.n
            values = np.linalg.eigvalsh((self.squares - self.n * np.outer(middle, middle)) / (self.n - 1))[::-1]
            first, second = (v if v > 0 else 1e-8 for v in values[:2])
            found = float((first - second) / first)
        yield self.key, self.n, found


class _Cylinder:
    """First column of the table as the group's name, its points, and radius, centre and coefficient of variation of the cylinder through them, as :func:`shape.cylinder` finds it."""

    def __init__(self) -> None:
        self.key, self.rows = None, []

    def eval(self, row: Row) -> None:
        self.key = row[0]
        self.rows.append((row["pid"], row["x"], row["y"], row["z"]))

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            xyz = np.array([r[1:] for r in sorted(self.rows)], dtype=float)
            radius, middle, cv = shape.cylinder(xyz, int(self.key or 0) & 0x7FFFFFFF)
            yield self.key, len(xyz), None if np.isnan(radius) else radius, *map(float, middle), cv


TABLE_FUNCTIONS = {
    "silva_voxel": udtf(_Voxel, returnType="ix long, iy long, iz long"),
    "silva_linearity": udtf(_Linearity, returnType="key long, n long, linearity double"),
    "silva_cylinder": udtf(_Cylinder, returnType="key long, n long, radius double, x double, y double, z double, cv double"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to ``spark.sql``."""
    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, made)
