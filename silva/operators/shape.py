"""Shapes of point sets: linearity, normals, hulls, cylinders and the rules for branches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import branch_rules, eigenvalues, wood_vote
from . import neighbors
from .tables import stage

PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")
#: Points whose hull one task computes at most, unless they are all vertices of the hulls of smaller parts already.
HULL_POINTS = 50_000


def covariances(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and the six central second moments over n - 1, in two grouped passes."""
    middle = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in "xyz"])
    both = points.join(middle, keys)
    d = {a: F.col(a) - F.col(f"m{a}") for a in "xyz"}
    return both.groupBy(*keys, "n").agg(*[F.try_divide(F.sum(d[p[0]] * d[p[1]]), F.col("n") - 1).alias(p) for p in PAIRS])


def linearity(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, linearity: the share by which the largest eigenvalue exceeds the second; 0 under five points. Eigenvalues that aren't positive count as 1e-8."""
    c = covariances(points, keys)
    c = c.select(*keys, "n", F.inline(eigenvalues(*[F.col(p) for p in PAIRS])))  # computed once, however often named
    e1, e2 = F.when(F.col("e1") <= 0, 1e-8).otherwise(F.col("e1")), F.when(F.col("e2") <= 0, 1e-8).otherwise(F.col("e2"))
    return c.select(*keys, "n", F.when(F.col("n") < 5, 0.0).otherwise(F.try_divide(e1 - e2, e1)).alias("linearity"))


def normals(points: DataFrame, k: int = 10, neighbours: DataFrame | None = None) -> DataFrame:
    """pid and nz, the absolute vertical part of the normal of the plane through the k nearest (itself included); null where it is undefined."""
    near = neighbours if neighbours is not None else neighbors.knn(points, points, k, with_self=True)
    there = near.join(points.select(F.col("pid").alias("dst"), "x", "y", "z"), "dst")
    c = covariances(there.withColumnRenamed("src", "pid"), ["pid"])
    c = c.select("pid", "xx", "yy", "xy", F.inline(eigenvalues(*[F.col(p) for p in PAIRS])))
    minor = (F.col("xx") - F.col("e3")) * (F.col("yy") - F.col("e3")) - F.col("xy") * F.col("xy")
    square = F.try_divide(minor, (F.col("e3") - F.col("e1")) * (F.col("e3") - F.col("e2")))
    return c.select("pid", F.sqrt(F.when(square.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), square)))).alias("nz"))


def wood_probability(points: DataFrame, segment: str = "seg_id", thresholds: list[float] | None = None, sizes: list[int] | None = None) -> DataFrame:
    """``points`` with linearity, size and p_wood of their segment."""
    ts = thresholds or [round(0.70 + 0.02 * i, 2) for i in range(13)]
    ss = sizes or list(range(10, 211, 10))
    found = linearity(points, [segment])
    found = found.select(segment, F.col("n").alias("size"), "linearity", wood_vote(F.col("linearity"), F.col("n"), ts, ss).alias("p_wood"))
    return points.join(found, segment)


def hull_vertices(xyz: np.ndarray) -> np.ndarray:
    """Positions of the vertices of the convex hull of n x 3 points; all of them if they lie in a plane or are under six."""
    n = len(xyz)
    everything = np.arange(n)
    if n < 6:
        return everything
    span = max(np.ptp(xyz, axis=0).max(), 1e-300)
    a = int(np.argmin(xyz[:, 0]))
    b = int(np.argmax(((xyz - xyz[a]) ** 2).sum(axis=1)))
    c = int(np.argmax((np.cross(xyz - xyz[a], xyz[b] - xyz[a]) ** 2).sum(axis=1)))
    normal = np.cross(xyz[b] - xyz[a], xyz[c] - xyz[a])
    height = (xyz - xyz[a]) @ normal
    d = int(np.argmax(np.abs(height)))
    if np.abs(height[d]) <= 1e-9 * span**3:
        return everything
    inner = xyz[[a, b, c, d]].mean(axis=0)
    slack = 1e-12 * span**3

    def facets(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corners turned so that normals point outwards, normals, offsets."""
        p, q, r = (xyz[corners[:, k]] for k in range(3))
        out = np.cross(q - p, r - p)
        turned = ((inner - p) * out).sum(axis=1) > 0
        corners = np.where(turned[:, None], corners[:, [0, 2, 1]], corners)
        out = np.where(turned[:, None], -out, out)
        return corners, out, (out * p).sum(axis=1)

    corners, normals_, offsets = facets(np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]]))
    alive = np.ones(4, dtype=bool)
    over = np.full(n, -1)  # a facet that the point is above; -1 for points inside

    def settle(points: np.ndarray, first: int) -> None:
        """Put points over the facet from ``first`` on that they are highest above; those above none are inside for good."""
        above = xyz[points] @ normals_[first:].T - offsets[first:]
        best = np.argmax(above, axis=1)
        over[points] = np.where(above[np.arange(len(points)), best] > slack, best + first, -1)

    settle(everything, 0)
    facet = 0
    while facet < len(alive):
        mine = np.flatnonzero(over == facet) if alive[facet] else everything[:0]
        if not len(mine):
            facet += 1
            continue
        p = int(mine[np.argmax(xyz[mine] @ normals_[facet])])  # the farthest above a facet is a vertex
        seen = np.flatnonzero(alive & (normals_ @ xyz[p] - offsets > slack))
        edges = {(int(f[s]), int(f[(s + 1) % 3])) for f in corners[seen] for s in range(3)}
        new = facets(np.array([[i, j, p] for i, j in edges if (j, i) not in edges]))
        loose = np.flatnonzero(np.isin(over, seen))
        first = len(alive)
        alive[seen] = False
        corners, normals_, offsets = (np.concatenate((old, more)) for old, more in zip((corners, normals_, offsets), new))
        alive = np.append(alive, np.ones(len(new[2]), dtype=bool))
        settle(loose[loose != p], first)
        over[p] = -1
    return np.unique(corners[alive])


def convex_hulls(points: DataFrame, cluster: str = "clstr") -> DataFrame:
    """The rows of ``points`` that are vertices of the hull of their cluster.

    A part's own hull keeps every vertex of the whole. So clusters of more than HULL_POINTS are cut into parts and left with the vertices of these, and
    again, as long as that takes points away; then no task meets a large cluster whole, unless nearly all its points are vertices.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[hull_vertices(rows[["x", "y", "z"]].to_numpy(dtype=float))]

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        return run(rows).drop(columns="_part")

    while True:
        sizes = points.groupBy(F.col(cluster).alias("_c")).agg(F.count("*").alias("_n")).where(F.col("_n") > HULL_POINTS)
        large = sizes.agg(F.count("*"), F.sum("_n")).first()
        if not large[0]:
            break
        met = points.join(sizes, F.col(cluster).eqNullSafe(F.col("_c")), "left")
        split = met.where("_n is not null").withColumn("_part", F.pmod(F.xxhash64("x", "y", "z"), F.ceil(2 * F.col("_n") / HULL_POINTS))).drop("_c", "_n")
        kept = stage(split.groupBy(cluster, "_part").applyInPandas(part, points.schema), "hulls")
        points = met.where("_n is null").select(*points.columns).unionByName(kept)
        if kept.count() > 0.9 * large[1]:
            break
    return points.groupBy(cluster).applyInPandas(run, points.schema)


def _squares(xyz: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of points from the axis of a cylinder, and the derivatives of squared distance less squared radius by its five parameters.

    Parameters: where the axis meets z = 0, its slopes in x and y, the squared radius. The axis has the unit direction d = (slopes, 1) / length, and
    a point w away from its foot is |w|^2 - (w d)^2 from it, squared.
    """
    slope = np.array([p[2], p[3], 1.0])
    length = np.sqrt(slope @ slope)
    d = slope / length
    w = xyz - np.array([p[0], p[1], 0.0])
    along = w @ d
    by_foot = -2 * (w - along[:, None] * d)[:, :2]
    by_slope = -2 * along[:, None] * (w - along[:, None] * d)[:, :2] / length
    return (w * w).sum(axis=1) - along * along, np.column_stack([by_foot, by_slope, -np.ones(len(xyz))])


def _damped(normal: np.ndarray, gradient: np.ndarray, damp: float) -> np.ndarray:
    return np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), -gradient, rcond=None)[0]


def _fit(xyz: np.ndarray, start: np.ndarray, steps: int = 60) -> np.ndarray:
    """The parameters of a cylinder by damped least squares on squared distance less squared radius."""
    p, damp = start.astype(float), 1e-3
    square, jac = _squares(xyz, p)
    r = square - p[4]
    for _ in range(steps):
        step = _damped(jac.T @ jac, jac.T @ r, damp)
        square, slopes = _squares(xyz, p + step)
        after = square - (p + step)[4]
        if after @ after < r @ r:
            p, r, jac, damp = p + step, after, slopes, damp / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def cylinder(xyz: np.ndarray, seed: int, tries: int = 100) -> tuple[float, np.ndarray, float]:
    """Radius, centre and coefficient of variation of a stem: RANSAC from 50 points on, else no radius and the mean."""
    mean = xyz.mean(axis=0) if len(xyz) else np.full(3, np.nan)
    none = (float("nan"), mean, float("inf"))
    if len(xyz) < 50:
        return none
    centred, rng, best = xyz - mean, np.random.default_rng(seed), none
    for _ in range(tries):
        pick = rng.choice(len(centred), 20, replace=False)
        p = _fit(centred[pick], np.zeros(5), 20)
        radius = np.sqrt(max(p[4], 0.0))
        if not radius or np.abs(p[:2]).max() > 1.05 * radius:
            continue
        away = np.sqrt(np.maximum(_squares(centred, p)[0], 0)) / radius
        inside = (away >= 0.8) & (away <= 1.2)
        if inside.sum() < 0.2 * len(centred):
            continue
        p = _fit(centred[inside], p, 20)
        away = np.sqrt(np.maximum(_squares(centred[inside], p)[0], 0))
        cv = float(away.std() / away.mean()) if away.mean() else float("inf")
        if p[4] > 0 and cv < best[2]:
            best = (float(np.sqrt(p[4])), mean + np.array([p[0], p[1], 0.0]), cv)
    return best


def fit_cylinders(points: DataFrame, cluster: str = "clstr", tries: int = 100, at_most: int = 20_000) -> DataFrame:
    """clstr, radius (null if none is found), x, y, z, cv, cnt per cluster. A try samples 20 points; inliers, the fit to them and cv take all points.

    A cluster of ``at_most`` points is one task's; the tries of a larger one sample a part of that size, and its sums are made by parts.
    """
    own = points.select(F.col(cluster).cast("long").alias("clstr"), "pid", "x", "y", "z")
    sizes = stage(own.groupBy("clstr").agg(F.count("*").alias("cnt"), *[F.avg(a).alias(f"m{a}") for a in "xyz"]), "sizes")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("pid")
        radius, centre, cv = cylinder(own[["x", "y", "z"]].to_numpy(dtype=float), int(key[0]) & 0x7FFFFFFF, tries)
        return pd.DataFrame({"clstr": [key[0]], "radius": [radius], "x": [centre[0]], "y": [centre[1]], "z": [centre[2]], "cv": [cv], "cnt": [len(own)]})

    schema = "clstr long, radius double, x double, y double, z double, cv double, cnt long"
    # a null cluster is a group like others
    placed = own.join(sizes, own.clstr.eqNullSafe(sizes.clstr)).drop(sizes.clstr)
    small = placed.where(F.col("cnt") <= at_most).select(*own.columns).groupBy("clstr").applyInPandas(run, schema)
    large = sizes.where(F.col("cnt") > at_most).agg(F.sum("cnt")).first()[0]
    if not large:
        return small
    # small rows, much work: numbers of partitions that aren't lowered by their size
    many = max(4 * points.sparkSession.sparkContext.defaultParallelism, large // (8 * at_most))
    return small.unionByName(_large_cylinders(placed.where(F.col("cnt") > at_most), sizes, tries, at_most, many))


#: Of one try: the sampled fit, the best and the tried parameters, then at the best the inliers' count, squared residuals, distances, squared distances, gradient and normal matrix; the damping and whether it goes on.
_FIRST, _BEST, _TRIED, _SUMS, _DAMP, _LIVE, _STATE = slice(0, 5), slice(5, 10), slice(10, 15), slice(15, 49), 49, 50, 51


def _going(state: list[float]) -> int:
    """How many tries of a state go on."""
    return int(sum(state[_LIVE::_STATE]))


def _large_cylinders(points: DataFrame, sizes: DataFrame, tries: int, at_most: int, many: int, steps: int = 20) -> DataFrame:
    """:func:`cylinder` of clusters too large for a task: each step of the damped fits of all tries is one grouped sum over parts, which lie in ``many`` partitions."""
    part = F.pmod(F.xxhash64("pid"), F.ceil(F.col("cnt") / at_most))
    centred = points.select("clstr", part.alias("part"), "cnt", *[(F.col(a) - F.col(f"m{a}")).alias(a) for a in "xyz"]).repartition(many, "clstr", "part")

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        xyz = rows[["x", "y", "z"]].sort_values(["x", "y", "z"]).to_numpy(dtype=float)
        return pd.DataFrame({"clstr": [key[0]], "part": [key[1]], "cnt": [key[2]], "xyz": [np.ascontiguousarray(xyz).tobytes()]})

    parts = stage(centred.groupBy("clstr", "part", "cnt").applyInPandas(packed, "clstr long, part long, cnt long, xyz binary"), "parts")

    def begin(batches):
        for rows in batches:
            states = []
            for clstr, raw in zip(rows.clstr, rows.xyz):
                xyz, rng = np.frombuffer(raw).reshape(-1, 3), np.random.default_rng(int(clstr) & 0x7FFFFFFF if clstr == clstr else 0)
                state = np.zeros((tries, _STATE))
                for own in state:
                    p = _fit(xyz[rng.choice(len(xyz), min(20, len(xyz)), replace=False)], np.zeros(5), 20)
                    radius = np.sqrt(max(p[4], 0.0))
                    own[_FIRST] = own[_BEST] = own[_TRIED] = p
                    own[_DAMP], own[_LIVE] = 1e-3, bool(radius) and np.abs(p[:2]).max() <= 1.05 * radius
                states.append(state.ravel().tolist())
            yield pd.DataFrame({"clstr": rows.clstr, "cnt": rows.cnt, "state": states, "live": [_going(s) for s in states]})

    def summed(batches):
        for rows in batches:
            found = []
            for raw, flat in zip(rows.xyz, rows.state):
                xyz, out = np.frombuffer(raw).reshape(-1, 3), np.zeros((tries, 34))
                for own, sums in zip(np.asarray(flat, dtype=float).reshape(tries, _STATE), out):
                    if not own[_LIVE]:
                        continue
                    away = np.sqrt(np.maximum(_squares(xyz, own[_FIRST])[0], 0)) / np.sqrt(own[_FIRST][4])
                    inside, p = xyz[(away >= 0.8) & (away <= 1.2)], own[_TRIED]
                    square, jac = _squares(inside, p)
                    r, away = square - p[4], np.sqrt(np.maximum(square, 0))
                    sums[:4] = len(inside), r @ r, away.sum(), away @ away
                    sums[4:9], sums[9:] = jac.T @ r, (jac.T @ jac).ravel()
                found.append(out.ravel().tolist())
            yield pd.DataFrame({"clstr": rows.clstr, "sums": found})

    def stepped(first: bool):
        def run(batches):
            for rows in batches:
                states = []
                for cnt, flat, sums in zip(rows.cnt, rows.state, rows.sums):
                    state = np.array(flat, dtype=float).reshape(tries, _STATE)
                    for own, new in zip(state, np.asarray(sums, dtype=float).reshape(tries, 34)):
                        if not own[_LIVE]:
                            continue
                        if first:
                            own[_SUMS], own[_LIVE] = new, new[0] >= 0.2 * cnt
                        elif new[1] < own[_SUMS][1]:
                            own[_LIVE] = np.abs(own[_TRIED] - own[_BEST]).max() >= 1e-10
                            own[_BEST], own[_SUMS] = own[_TRIED], new
                            own[_DAMP] /= 3
                        else:
                            own[_DAMP] *= 4
                            own[_LIVE] = own[_DAMP] <= 1e12
                        if own[_LIVE]:
                            gradient, normal = own[_SUMS][4:9], own[_SUMS][9:].reshape(5, 5)
                            own[_TRIED] = own[_BEST] + _damped(normal, gradient, own[_DAMP])
                        elif first:
                            own[_SUMS] = 0  # too few inliers: no candidate
                    states.append(state.ravel().tolist())
                yield pd.DataFrame({"clstr": rows.clstr, "cnt": rows.cnt, "state": states, "live": [_going(s) for s in states]})

        return run

    schema = "clstr long, cnt long, state array<double>, live long"
    states = stage(parts.where("part = 0").select("clstr", "cnt", "xyz").mapInPandas(begin, schema), "tries")
    for step in range(steps + 1):
        if states.where("live > 0").isEmpty():  # all tries have settled
            break
        met = parts.join(states.select(F.col("clstr").alias("c"), "state"), F.col("clstr").eqNullSafe(F.col("c"))).select("clstr", "xyz", "state")
        each = met.mapInPandas(summed, "clstr long, sums array<double>").select("clstr", F.posexplode("sums").alias("k", "v")).groupBy("clstr", "k").agg(F.sum("v").alias("v"))
        sums = each.groupBy(F.col("clstr").alias("c")).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("s")).select("c", F.transform("s", lambda x: x["v"]).alias("sums"))
        states = stage(states.join(sums, F.col("clstr").eqNullSafe(F.col("c"))).select("clstr", "cnt", "state", "sums").mapInPandas(stepped(step == 0), schema), "tries")

    def chosen(batches):
        for rows in batches:
            out = []
            for flat in rows.state:
                best = (float("nan"), 0.0, 0.0, float("inf"))
                for own in np.asarray(flat, dtype=float).reshape(tries, _STATE):
                    n, _, away, square = own[_SUMS][:4]
                    p = own[_BEST]
                    if n and away and p[4] > 0:
                        cv = float(np.sqrt(max(square / n - (away / n) ** 2, 0.0)) / (away / n))
                        if cv < best[3]:
                            best = (float(np.sqrt(p[4])), p[0], p[1], cv)
                out.append(best)
            radius, x, y, cv = zip(*out)
            yield pd.DataFrame({"clstr": rows.clstr, "cnt": rows.cnt, "radius": radius, "x": x, "y": y, "cv": cv})

    best = states.mapInPandas(chosen, "clstr long, cnt long, radius double, x double, y double, cv double")
    middle = sizes.select(F.col("clstr").alias("c"), "mx", "my", "mz")
    return best.join(middle, F.col("clstr").eqNullSafe(F.col("c"))).select("clstr", "radius", (F.col("x") + F.col("mx")).alias("x"), (F.col("y") + F.col("my")).alias("y"), F.col("mz").alias("z"), "cv", "cnt")


def is_stem(radius: float = 0.025, count: int = 200, cv: float = 0.15) -> Column:
    """Whether a cylinder is thick, full and even enough for a stem."""
    return (F.col("radius") > radius) & (F.col("cnt") > count) & (F.col("cv") <= cv)


def branch_class(base: Column, comp: Column, cut: Column, study: Column, goes_on: Column) -> tuple[Column, Column]:
    """(class, continuation) of a component: 1 begins a branch. The first rule that holds decides."""
    ends, main = branch_rules(base, comp, goes_on, cut, study)
    return F.when(ends | main, 0).otherwise(1), main


def classify_components(components: DataFrame) -> DataFrame:
    """``components`` (cut_id, comp_id, base, comp, cut, study, goes_on) with class and continuation; where a cut has none, its largest branch goes on."""
    kind, goes = branch_class(F.col("base"), F.col("comp"), F.col("cut"), F.col("study"), F.col("goes_on"))
    out = components.withColumns({"_k": kind, "_g": goes})
    w = Window.partitionBy("cut_id")
    first = F.row_number().over(w.orderBy(F.desc("_k"), F.desc("comp"), "comp_id"))
    out = out.withColumns({"_any": F.max(F.col("_g").cast("int")).over(w), "_n": first})
    turned = (F.col("_any") == 0) & (F.col("_n") == 1) & (F.col("_k") == 1)
    return out.withColumns({"class": F.when(turned, 0).otherwise(F.col("_k")), "continuation": F.col("_g") | turned}).drop("_k", "_g", "_any", "_n")
