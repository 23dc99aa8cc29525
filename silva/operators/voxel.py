"""Voxels, cubes and overlapping tiles: bucketing a cloud by columns, one shuffle at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import floor_index, floor_origin, plain_floor

AXES = ("x", "y", "z")


def voxelise(points: DataFrame, size: float, flat: bool = False) -> DataFrame:
    """Cell indices ix, iy (and iz) and origins xx, yy (and zz) of each point, in place of those of an earlier call."""
    axes = AXES[:2] if flat else AXES
    return points.drop("ix", "iy", "iz", "xx", "yy", "zz").withColumns({f"i{a}": floor_index(a, size) for a in axes} | {f"{a}{a}": floor_origin(a, size) for a in axes})


def downsample_first(points: DataFrame, size: float, keep_all: bool = False) -> DataFrame:
    """The point with the smallest pid of each voxel; with ``keep_all`` every point, flagged ``downsample`` if chosen."""
    first = F.row_number().over(Window.partitionBy("ix", "iy", "iz").orderBy("pid")) == 1
    flagged = voxelise(points, size).withColumn("downsample", first)
    return flagged if keep_all else flagged.where("downsample").drop("downsample")


def downsample_median(points: DataFrame, size: float, keep_all: bool = False) -> DataFrame:
    """The point nearest to the component-wise median of its voxel, ties by pid."""
    cells = voxelise(points, size)
    keys = ["ix", "iy", "iz"]
    middle = cells.groupBy(*keys).agg(*[F.median(a).alias(f"m{a}") for a in AXES])
    d2 = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in AXES[1:]), (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(d2, 12), "pid")) == 1
    flagged = cells.join(middle, keys).withColumn("downsample", best).drop("mx", "my", "mz")
    return flagged if keep_all else flagged.where("downsample").drop("downsample")


def bbox(points: DataFrame) -> DataFrame:
    """One row: the smallest and largest value on each axis."""
    return points.agg(*[f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def cubes(points: DataFrame, size: float) -> DataFrame:
    """Cell indices cx, cy, cz from 1, counted from the cloud's minimum, and the lexicographic key ``cell``. Columns of the bounding box are dropped again."""
    box = bbox(points)
    with_box = points.crossJoin(F.broadcast(box))  # one row
    at = {f"c{a}": plain_floor(a, size, F.col(f"{a}_min")) + 1 for a in AXES}
    many = {f"n{a}": plain_floor(f"{a}_max", size, F.col(f"{a}_min")) + 1 for a in AXES[:2]}
    out = with_box.withColumns(at | many)
    out = out.withColumn("cell", F.col("cx") + (F.col("cy") - 1) * F.col("nx") + (F.col("cz") - 1) * F.col("nx") * F.col("ny"))
    return out.drop("nx", "ny", *box.columns)


def bordered_cubes(points: DataFrame, size: float, border: int = 3, most: float = 4e9) -> DataFrame:
    """Cell indices cx, cy, cz and the key ``cell`` as :func:`cubes`, with ``border`` empty layers around the cloud, and ``edge``, the cubes' size.

    While eight bytes for each cube of the whole grid are more than ``most``, the size grows by a tenth, ten times at most; a grid that is larger still has three layers.
    The size follows from the one row of the bounding box, so nothing but that row is shuffled.
    """
    edges = [size]
    for _ in range(10):
        edges.append(1.1 * edges[-1])

    def many(a: str, edge: Column, layers: Column | int) -> Column:
        return F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min")) / edge) + 2 * layers + 1

    def fits(edge: float) -> Column:
        n = [many(a, F.lit(edge), border).cast("double") for a in AXES]
        return 8 * n[0] * n[1] * n[2] <= most

    box = bbox(points).withColumn("edge", F.coalesce(*[F.when(fits(e), F.lit(e)) for e in edges]))
    box = box.withColumn("_layers", F.when(F.col("edge").isNull(), 3).otherwise(border)).withColumn("edge", F.coalesce("edge", F.lit(edges[-1])))
    box = box.withColumns({f"n{a}": many(a, F.col("edge"), F.col("_layers")) for a in AXES[:2]})
    out = points.crossJoin(F.broadcast(box))  # one row
    out = out.withColumns({f"c{a}": plain_floor(a, F.col("edge"), F.col(f"{a}_min")) + F.col("_layers") + 1 for a in AXES})
    out = out.withColumn("cell", F.col("cx") + (F.col("cy") - 1) * F.col("nx") + (F.col("cz") - 1) * F.col("nx") * F.col("ny"))
    return out.drop("nx", "ny", "_layers", *(f"{a}_{n}" for a in AXES for n in ("min", "max")))


def downsample_cubes(points: DataFrame, size: float) -> DataFrame:
    """The point with the smallest pid of each cube."""
    first = F.row_number().over(Window.partitionBy("cell").orderBy("pid"))
    return cubes(points, size).withColumn("_n", first).where("_n = 1").drop("_n")


def shift(points: DataFrame, back: bool = False) -> DataFrame:
    """The cloud around its mean (columns shift_x.. keep the mean), or such a cloud put back."""
    if back:
        return points.withColumns({a: F.col(a) + F.col(f"shift_{a}") for a in AXES}).drop(*[f"shift_{a}" for a in AXES])
    mean = points.agg(*[F.avg(a).alias(f"shift_{a}") for a in AXES])
    return points.crossJoin(F.broadcast(mean)).withColumns({a: F.col(a) - F.col(f"shift_{a}") for a in AXES})


def tiles(points: DataFrame, step: float = 3.0, side: float = 6.0) -> DataFrame:
    """One row per point and box that holds it: box_x, box_y, box_z, the box's place on each axis.

    Boxes of ``side`` begin every ``step`` from one step below the floored minimum, as long as they begin less than a step above the
    raised maximum; both ends count. The boxes are enumerated from the point, so nothing is joined.
    """
    box = bbox(points).select(*[F.floor(f"{a}_min").alias(f"lo_{a}") for a in AXES], *[F.ceil(f"{a}_max").alias(f"hi_{a}") for a in AXES])
    out = points.crossJoin(F.broadcast(box))  # one row
    for a in AXES:
        start = F.col(f"lo_{a}") - step
        last = F.ceil((F.col(f"hi_{a}") + step - start) / step) - 1
        low = F.greatest(F.ceil((F.col(a) - start - side) / step), F.lit(0))
        high = F.least(F.floor((F.col(a) - start) / step), last)
        out = out.withColumn(f"box_{a}", F.explode(F.sequence(low.cast("long"), F.greatest(high, low).cast("long"))))
    return out.drop(*box.columns)


def large_tiles(tiled: DataFrame, at_least: int = 1000) -> DataFrame:
    """box_x, box_y, box_z and box_size, the count of its points, of the tiles of more than ``at_least`` points."""
    return tiled.groupBy("box_x", "box_y", "box_z").agg(F.count("*").alias("box_size")).where(F.col("box_size") > at_least)


def sample_tiles(tiled: DataFrame, at_least: int = 1000, at_most: int = 20_000, seed: int = 0) -> DataFrame:
    """Tiles of more than ``at_least`` points, each with at most ``at_most`` of them by a seeded hash (a sampling operator), centred at their rounded mean."""
    keys = ["box_x", "box_y", "box_z"]
    sizes = large_tiles(tiled, at_least)
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "pid"), "pid"))
    kept = tiled.join(sizes, keys).withColumn("_n", order).where(F.col("_n") <= at_most).drop("_n")
    middle = kept.groupBy(*keys).agg(*[F.round(F.avg(a)).alias(f"local_{a}") for a in AXES])
    return kept.join(middle, keys)
