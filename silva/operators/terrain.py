"""Terrain: ground heights on a grid of cells, gaps filled, heights above ground."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import floor_index
from .tables import stage

#: Cells to a block's side at least.
BLOCK = 64


def ground_cells(points: DataFrame, ground: Column, size: float = 0.5, median_value: bool = False) -> DataFrame:
    """ix, iy, ground: the height of the ground point that equals its cell's median. A cell without such a point is absent, unless ``median_value``."""
    own = points.where(ground).withColumns({"ix": floor_index("x", size), "iy": floor_index("y", size)})
    middle = own.groupBy("ix", "iy").agg(F.median("z").alias("ground"))
    if median_value:
        return middle
    hit = own.join(middle, ["ix", "iy"]).where("z = ground")
    return hit.select("ix", "iy", "ground").distinct()


def _reach(cells: DataFrame, grid: DataFrame, total: int) -> int:
    """The least h, 1 or more, such that every cell of ``grid`` has one of ``cells`` within h on both axes: doubled until it does, then halved in on.

    Within h on both axes is within h along the row of something within h along the column, so a pass is two windows over the grid.
    """
    marked = stage(grid.join(cells.select("ix", "iy", F.lit(1).alias("there")), ["ix", "iy"], "left"), "marked")

    def reached(h: int) -> bool:
        row = F.max("there").over(Window.partitionBy("iy").orderBy("ix").rangeBetween(-h, h))
        column = F.max("row").over(Window.partitionBy("ix").orderBy("iy").rangeBetween(-h, h))
        return marked.withColumn("row", row).select("ix", column.alias("both")).where("both = 1").count() == total

    high = 1
    while not reached(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) else (middle, high)
    return high


def _images(i: Column, many: Column, h: int) -> Column:
    """Where the index (from 0) lies on the axis that its ``many`` cells and their mirror images, edge cells repeated, continue for h cells beyond both ends."""
    k = F.floor(F.lit(h) / (2 * many)).cast("long") + 1
    all_ = F.flatten(F.transform(F.sequence(-k, k), lambda n: F.array(2 * many * n + i, 2 * many * n - 1 - i)))
    return F.filter(all_, lambda v: (v >= -h) & (v < many + h))


def _block_medians(h: int, side: int, nx: int, ny: int):
    """For a block of ``side`` cells: the median over the window of each of its cells, from the cells of the block and its halo."""

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[0]) * side, int(key[1]) * side
        grid = np.full((min(side, nx - x0) + 2 * h, min(side, ny - y0) + 2 * h), np.nan)
        grid[cells.vx.to_numpy() - x0 + h, cells.vy.to_numpy() - y0 + h] = cells.ground.to_numpy()
        out = []
        for row in range(len(grid) - 2 * h):  # windows of one row at a time
            windows = sliding_window_view(grid[row : row + 2 * h + 1], 2 * h + 1, axis=1)
            flat = windows.transpose(1, 0, 2).reshape(windows.shape[1], -1)
            held = np.flatnonzero(~np.isnan(flat).all(axis=1))
            out.append(pd.DataFrame({"ix": x0 + row, "iy": y0 + held, "ground": np.nanmedian(flat[held], axis=1)}))
        return pd.concat(out)

    return run


def fill(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """ix, iy, ground of all cells of ``grid`` (one row: ix_min, ix_max, iy_min, iy_max).

    Every cell becomes the median of its window, which is as wide as it takes to leave no cell empty, and mirrored at the borders. Ground cells go to the blocks whose
    windows hold them: four at most, as a block is at least as wide as a window, so what is shuffled doesn't depend on the window. Without any ground the grid has no rows.
    """
    cells = stage(cells.select("ix", "iy", "ground"), "cells")
    box = grid.first()
    if cells.isEmpty() or box is None:
        return cells
    nx, ny = box.ix_max - box.ix_min + 1, box.iy_max - box.iy_min + 1
    whole = grid.sparkSession.range(nx * ny).select((F.col("id") % nx + box.ix_min).alias("ix"), (F.floor(F.col("id") / nx) + box.iy_min).alias("iy"))
    h = _reach(cells, whole, nx * ny)
    images = cells.select(F.explode(_images(F.col("ix") - box.ix_min, F.lit(nx), h)).alias("vx"), "iy", "ground").select("vx", F.explode(_images(F.col("iy") - box.iy_min, F.lit(ny), h)).alias("vy"), "ground")
    side = max(BLOCK, 2 * h + 1)

    def blocks(v: str, many: int) -> Column:
        first, last = F.floor((F.col(v) - h) / side), F.floor((F.col(v) + h) / side)
        return F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit((many - 1) // side))))

    spread = images.select("*", blocks("vx", nx).alias("bx")).select("*", blocks("vy", ny).alias("by"))
    out = spread.groupBy("bx", "by").applyInPandas(_block_medians(h, side, nx, ny), "ix long, iy long, ground double")
    return stage(out.select((F.col("ix") + box.ix_min).alias("ix"), (F.col("iy") + box.iy_min).alias("iy"), "ground"), "terrain")


def normalise(points: DataFrame, ground: Column, size: float = 0.5, median_value: bool = False) -> DataFrame:
    """``points`` with ix, iy and n_z, their height above the filled ground."""
    placed = points.withColumns({"ix": floor_index("x", size), "iy": floor_index("y", size)})
    grid = placed.agg(F.min("ix").alias("ix_min"), F.max("ix").alias("ix_max"), F.min("iy").alias("iy_min"), F.max("iy").alias("iy_max")).where("ix_min is not null")
    filled = fill(ground_cells(points, ground, size, median_value), grid)
    return placed.join(filled, ["ix", "iy"], "left").withColumn("n_z", F.col("z") - F.col("ground")).drop("ground")


def relabel_ground(points: DataFrame, terrain: int = 0, height: float = 0.1) -> DataFrame:
    """Points no higher than ``height`` above ground get the terrain label."""
    return points.withColumn("label", F.when(F.col("n_z") <= height, F.lit(terrain)).otherwise(F.col("label")))


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
