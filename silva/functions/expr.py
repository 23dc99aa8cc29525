"""Column expressions that the point-cloud operators share. All stay inside Spark's own functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_index(c: Column | str, size: float) -> Column:
    """Index of the cell of ``size`` by the remainder (the floor division of floats in Python): 2.0 lies in cell 9 of size 0.2."""
    x, length = col(c), F.lit(float(size))
    return (F.round((x - x % length) / length) - F.when(x % length < 0, 1).otherwise(0)).cast("long")


def floor_origin(c: Column | str, size: float) -> Column:
    """Lower edge of that cell."""
    return floor_index(c, size) * F.lit(float(size))


def plain_floor(c: Column | str, size: Column | float, low: Column | float = 0.0) -> Column:
    """Index of the cell of ``size`` counted from ``low`` by plain division."""
    start = low if isinstance(low, Column) else F.lit(float(low))
    edge = size if isinstance(size, Column) else F.lit(float(size))
    return F.floor((col(c) - start) / edge).cast("long")


def squared_distance(a: str, b: str) -> Column:
    """Squared distance of the points whose columns are prefixed ``a`` and ``b``."""
    dx, dy, dz = (F.col(f"{a}{d}") - F.col(f"{b}{d}") for d in "xyz")
    return dx * dx + dy * dy + dz * dz


def argmax(columns: list[str]) -> Column:
    """Position of the largest column, the first of equal ones."""
    values = F.array(*[F.col(c) for c in columns])
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(scores, lambda v: F.exp(v - top) / total)


def edge_weight(d: Column, mean: Column, mode: float) -> Column:
    """Weight of an edge of length d: 1 for mode 0, 1 / (d / mean + mode) above it, exp(d / (mean * mode)) below."""
    if mode == 0:
        return F.lit(1.0)
    share = F.coalesce(F.try_divide(d, mean), F.lit(0.0))  # all points in one place
    return 1 / (share + F.lit(float(mode))) if mode > 0 else F.exp(share / F.lit(float(mode)))


def _with(rows: Column, known: list[str], **more: Callable[[Column], Column]) -> Column:
    """``rows``, an array of structs with the fields ``known``, and more fields from these: each is worked out once, however often a later one names it."""
    return F.transform(rows, lambda m: F.struct(*[m[k].alias(k) for k in known], *[f(m).alias(k) for k, f in more.items()]))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """An array of one struct e1, e2, e3 (for ``inline``): the eigenvalues of a symmetric 3 x 3 matrix, largest first, in closed form.

    Written as one expression each, the steps would repeat those before them, thousands of terms in all, more than Spark can compile.
    """
    known = ["xx", "yy", "zz", "xy", "xz", "yz"]
    rows = F.array(F.struct(*[c.alias(k) for k, c in zip(known, (xx, yy, zz, xy, xz, yz))]))
    rows = _with(rows, known, mean=lambda m: (m.xx + m.yy + m.zz) / 3, off=lambda m: m.xy * m.xy + m.xz * m.xz + m.yz * m.yz)
    spread = lambda m: (m.xx - m.mean) * (m.xx - m.mean) + (m.yy - m.mean) * (m.yy - m.mean) + (m.zz - m.mean) * (m.zz - m.mean) + 2 * m.off
    rows = _with(rows, [*known, "mean", "off"], p=lambda m: F.sqrt(spread(m) / 6))
    scaled = {n: (lambda m, k=k: F.try_divide(m[k] - m.mean, m.p)) for n, k in zip("abc", known)} | {n: (lambda m, k=k: F.try_divide(m[k], m.p)) for n, k in zip("def", known[3:])}
    rows = _with(rows, ["mean", "p"], **scaled)
    half = lambda m: (m.a * (m.b * m.c - m.f * m.f) - m.d * (m.d * m.c - m.f * m.e) + m.e * (m.d * m.f - m.b * m.e)) / 2
    rows = _with(rows, ["mean", "p"], angle=lambda m: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half(m)))) / 3)
    rows = _with(rows, ["mean", "p"], high=lambda m: m.mean + 2 * m.p * F.cos(m.angle), low=lambda m: m.mean + 2 * m.p * F.cos(m.angle + 2 * math.pi / 3))
    ends = {"e1": lambda m: m.high, "e2": lambda m: 3 * m.mean - m.high - m.low, "e3": lambda m: m.low}
    return _with(rows, [], **{k: (lambda m, f=f: F.when(m.p == 0, m.mean).otherwise(f(m))) for k, f in ends.items()})


def wood_vote(linearity: Column, size: Column, thresholds: list[float], sizes: list[int]) -> Column:
    """Share of all (linearity, size) threshold pairs that a segment passes: the product of two counts."""
    passed = sum((F.when(linearity >= F.lit(t), 1).otherwise(0) for t in thresholds[1:]), F.when(linearity >= F.lit(thresholds[0]), 1).otherwise(0))
    large = sum((F.when(size >= F.lit(s), 1).otherwise(0) for s in sizes[1:]), F.when(size >= F.lit(sizes[0]), 1).otherwise(0))
    return passed * large / F.lit(float(len(thresholds) * len(sizes)))


def diameter_class(radius: Column | str) -> Column:
    """Stem diameter rounded down to 0.1 m."""
    return floor_index(2 * col(radius), 0.1) / F.lit(10.0)


def colour(tree: Column, brighter: float = 1.0) -> list[Column]:
    """red, green, blue of a tree by its id, 0 to 254 times ``brighter`` and 255 at most; 211 each without a tree."""
    shades = [F.pmod(F.xxhash64(F.lit(k), tree), F.lit(255)) for k in range(3)]
    return [F.when(tree.isNull(), 211).otherwise(F.least(F.lit(255), F.floor(s * brighter))).cast("int").alias(name) for name, s in zip(("red", "green", "blue"), shades)]


# The shares and sizes that tell branches from a segment's continuation.
MAIN_SHARE, SMALL_SHARE, TINY = 0.7, 0.05, 3


def branch_rules(base, size, goes_on, cut, study):
    """(whether a part ends with its segment, whether it continues it); what does neither begins a branch. Of columns, or of integers and a numpy boolean."""
    ends = ((base == size) | ((base == 1) & (size <= 2)) | ((base / cut < SMALL_SHARE) & (2 * base >= size)) | (size <= TINY)) & ~goes_on
    return ends, ~ends & ((base / cut >= MAIN_SHARE) | (size >= MAIN_SHARE * study))
