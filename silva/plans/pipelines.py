"""The three pipelines: classify a scan, separate trees, tell wood from leaf. Each is DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import argmax, colour, diameter_class, floor_index
from ..operators import branches, cluster, graph, inference, neighbors, regularize, shape, terrain, voxel
from ..operators.tables import numbered, resumed, stage

CLASSES = ["pTerrain", "pLeaf", "pCWD", "pWood"]
#: Patch, ball and points in a ball of the cover sets that part segments into branches.
PATCH, BALL, BALL_POINTS = 0.1, 0.12, 3


@dataclass(frozen=True)
class Scan:
    """Parameters of classification."""

    voxel: float = 0.01
    step: float = 3.0
    side: float = 6.0
    at_least: int = 1000
    at_most: int = 20_000
    batch: int = 10
    k: int = 16
    wood_threshold: float = 0.5
    cell: float = 0.5
    ground_height: float = 0.1
    model: str = ""


@dataclass(frozen=True)
class Stems:
    """Parameters of tree separation."""

    slice_height: float = 0.2
    eps: float = 0.1
    at_least: int = 20
    more_than: int = 200
    k: int = 200
    longest: float = 1.0
    stem_height: float = 1.5
    stem_thickness: float = 0.5
    stem_eps: float = 0.2
    stem_at_least: int = 50
    stem_radius: float = 0.025
    stem_points: int = 200
    stem_cv: float = 0.15
    longest_path: float = float("inf")
    points_per_tree: int = 0
    wood_label: int = 3


@dataclass(frozen=True)
class Leaves:
    """Parameters of leaf attachment."""

    voxel_size: float = 0.5
    k: int = 20
    longest: float = 1.0
    least_height: float = 1.5


def parameters(kind: type, given: Mapping) -> Scan | Stems | Leaves:
    """The ``kind`` of parameters with what ``given`` names, such as a file's or a command line's content; a name it hasn't got is an error."""
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    return kind(**given)


def face_points(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Six points per voxel: the extremes on each axis, at the medians of the others."""
    ends = voxels.groupBy(*keys).agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max), ("m", F.median))])
    faces = [F.struct(*[F.col(f"{end if a == axis else 'm'}{a}").alias(a) for a in "xyz"]) for axis in "xyz" for end in ("lo", "hi")]
    return ends.select(*keys, F.explode(F.array(*faces)).alias("f")).select(*keys, "f.x", "f.y", "f.z")


def number_trees(stems: DataFrame) -> DataFrame:
    """``stems`` (t_clstr, radius) with tree, from 1 by descending radius (null last), and the diameter class."""
    ranked = numbered(stems.withColumns({"_none": F.col("radius").isNull(), "_thin": -F.col("radius")}), ["_none", "_thin", "t_clstr"], "tree")
    return ranked.select(*stems.columns, (F.col("tree") + 1).cast("int").alias("tree"), diameter_class("radius").alias("diameter_class"))


def classify(points: DataFrame, predict: inference.Predictor | None = None, at_least: int = 1000, ground_height: float = 0.1, load: Callable[[], inference.Predictor] | None = None, p: Scan | None = None) -> DataFrame:
    """``points`` (pid, x, y, z) with class probabilities, label and n_z; those of an earlier run are dropped.

    ``predict`` is called as :func:`inference.infer` says; ``load`` gives such a function instead, once a Python worker. ``p`` stands for the two single parameters and
    the others. Tiles overlap, so a point may be classified several times; labels are voted from the nearest classified points. A cloud without a tile of more than
    at_least points has no rows.
    """
    p = p or Scan(at_least=at_least, ground_height=ground_height)
    cloud = voxel.shift(voxel.downsample_first(points.select("pid", "x", "y", "z"), p.voxel))
    tiled = voxel.sample_tiles(voxel.tiles(cloud.select("pid", "x", "y", "z"), p.step, p.side), p.at_least, p.at_most)
    scored = stage(inference.infer(tiled, load or (lambda: predict), CLASSES, p.batch).withColumnRenamed("pid", "_of"), "scored")
    # repeated points stay repeated, each with a number of its own in the order of tiles
    classified = numbered(scored, [*inference.TILE, "_of"], "pid").select("pid", "x", "y", "z", *CLASSES)
    voted = neighbors.vote(cloud.select("pid", "x", "y", "z"), classified, CLASSES, p.k, "pWood", p.wood_threshold)
    back = voxel.shift(cloud.join(voted, "pid"), back=True).select("pid", "x", "y", "z", "label", *CLASSES)
    return terrain.relabel_ground(terrain.normalise(back, F.col("label") == 0, p.cell), 0, p.ground_height)


def wood_clusters(points: DataFrame, p: Stems = Stems()) -> DataFrame:
    """The wood with its slice and its cluster within the slice: n_slice, clstr (-1 outside clusters)."""
    wood = points.where(F.col("label") == p.wood_label).withColumn("n_slice", floor_index("n_z", p.slice_height))
    return cluster.slice_clusters(wood, p.eps, p.at_least, p.more_than).select("pid", "x", "y", "z", "n_z", "n_slice", "clstr")


def medians(clustered: DataFrame) -> DataFrame:
    """One node per cluster: clstr, the medians x, y, z, n_z, and n_slice."""
    return clustered.where("clstr >= 0").groupBy("clstr").agg(*[F.median(c).alias(c) for c in ("x", "y", "z", "n_z")], F.min("n_slice").alias("n_slice"))


def find_stems(clustered: DataFrame, p: Stems = Stems()) -> DataFrame:
    """Cylinders of clusters at stem height: clstr, radius, x, y, z, cv, cnt, accepted.

    The points of all clusters in the slices from stem_height to stem_thickness above lose their noise by a quantile, and clusters of the rest on the plan join
    what belongs to one stem; each is named after its smallest slice cluster, and gets a cylinder. Those thick, even and full enough are accepted. Ten points or
    fewer give none.
    """
    low, high = floor_index(F.lit(p.stem_height), p.slice_height), floor_index(F.lit(p.stem_height + p.stem_thickness), p.slice_height) + 1
    level = clustered.where((F.col("clstr") >= 0) & F.col("n_slice").between(low, high))
    level = stage(neighbors.quantile_cut(level, 10, 0.9).drop("nn"), "level")
    flat = cluster.dbscan(level, p.stem_eps, p.stem_at_least, flat=True).withColumnRenamed("clstr", "stem")
    stems = level.join(flat, "pid")
    names = stems.groupBy("stem").agg(F.min("clstr").alias("name"))
    named = stage(stems.join(names, "stem").select(F.col("name").alias("clstr"), "pid", "x", "y", "z"), "stems")
    if named.limit(11).count() <= 10:
        named = named.limit(0)
    fitted = shape.fit_cylinders(named)
    accepted = shape.is_stem(p.stem_radius, p.stem_points, p.stem_cv)
    return stage(fitted.withColumn("accepted", F.coalesce(accepted, F.lit(False))), "cylinders")


def separate_trees(points: DataFrame, p: Stems = Stems()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trees, cylinders, hulls) of a labelled cloud (pid, x, y, z, n_z, label).

    trees: the clustered wood with t_clstr, the stem cluster that its shortest path leads to, distance, is_tip and a colour; points that no
    path reaches have null there, and trees of points_per_tree points or fewer are absent. cylinders: as :func:`find_stems`. hulls: hull points of the clusters. No wood gives no rows.
    """
    clustered = stage(wood_clusters(points, p), "clustered")
    cylinders = find_stems(clustered, p)
    hulls = stage(shape.convex_hulls(clustered.where("clstr >= 0")), "hulls")
    return stage(grown_trees(clustered, cylinders, hulls, p), "trees"), cylinders, hulls


def grown_trees(clustered: DataFrame, cylinders: DataFrame, hulls: DataFrame, p: Stems = Stems()) -> DataFrame:
    """The trees of :func:`separate_trees` from its clusters, cylinders and hulls."""
    edges = stage(graph.cluster_edges(hulls, p.k, p.longest), "edges")
    paths = graph.best_path(graph.shortest_paths(edges, cylinders.where("accepted").select("clstr"))).where(F.col("distance") <= p.longest_path)
    named = clustered.where("clstr >= 0").join(paths, "clstr", "left")
    kept = named.groupBy(F.col("t_clstr").alias("_t")).agg(F.count("*").alias("_n")).where(F.col("_n") > p.points_per_tree)
    trees = named.join(kept.select("_t"), F.col("t_clstr").eqNullSafe(F.col("_t")), "left_semi")
    red, green, blue = colour(F.col("t_clstr"))
    return trees.select("*", red, green, blue)


def numbered_trees(trees: DataFrame, cylinders: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The points of ``trees`` with tree, from 1 by descending stem radius, and diameter_class; only stems inside ``box`` (x and y from, to) if one is given."""
    stems = cylinders.where("accepted").select(F.col("clstr").alias("t_clstr"), "radius", "x", "y")
    if box:
        stems = stems.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))
    there = trees.select("t_clstr").distinct()
    return trees.join(number_trees(stems.drop("x", "y").join(there, "t_clstr", "left_semi")), "t_clstr")


def attach_leaves(leaves: DataFrame, hulls: DataFrame, paths: DataFrame, voxel_size: float = 0.5, k: int = 20, longest: float = 1.0, least_height: float = 1.5) -> DataFrame:
    """``leaves`` (pid, x, y, z, n_z) with t_clstr, the tree that the shortest path from a branch tip through leaf voxels leads to, and that distance; null where none does.

    ``paths``: clstr, t_clstr, is_tip of clusters. Of the hull points of tips above ``least_height`` only those stay that are one of the two nearest of a leaf voxel's face point.
    """
    cells = voxel.voxelise(leaves, voxel_size).withColumn("vx", F.xxhash64("ix", "iy", "iz"))
    faces = face_points(cells, ["vx"]).select(F.lit(True).alias("leaf"), F.col("vx").alias("clstr"), "x", "y", "z")
    tips = stage(paths.where("is_tip and t_clstr is not null").select("clstr", "t_clstr"), "tips")
    ends = hulls.join(tips, "clstr").where(F.col("n_z") > least_height).select(F.lit(False).alias("leaf"), "clstr", "x", "y", "z")
    both = numbered(stage(faces.unionByName(ends), "leaf-nodes"), ["leaf", "clstr", "x", "y", "z"], "pid")
    near = neighbors.knn(both.where("leaf"), both, 2).select(F.col("dst").alias("pid")).distinct()
    kept = stage(both.where("leaf").unionByName(both.where("not leaf").join(near, "pid", "left_semi")), "leaf-graph")
    entries = kept.where("not leaf").select("clstr").distinct()
    reached = graph.best_path(graph.shortest_paths(graph.cluster_edges(kept, k, longest), entries)).where("distance > 0")
    trees = reached.join(tips.select(F.col("clstr").alias("t"), F.col("t_clstr").alias("tree")), reached.t_clstr == F.col("t")).select(F.col("clstr").alias("vx"), F.col("tree").alias("t_clstr"), "distance")
    return cells.join(trees, "vx", "left").select(*leaves.columns, "t_clstr", "distance")


def with_leaves(trees: DataFrame, leaves: DataFrame) -> DataFrame:
    """Wood and attached leaves in one cloud without repeated rows: wood is 1 or 0, leaves have the brighter colour of their tree."""
    red, green, blue = colour(F.col("t_clstr"), 1.2)
    green_ones = leaves.where("t_clstr is not null").select(*[c for c in leaves.columns if c not in ("red", "green", "blue")], red, green, blue, F.lit(0).alias("wood"))
    return trees.withColumn("wood", F.lit(1)).unionByName(green_ones, allowMissingColumns=True).dropDuplicates()


def trees_of_scan(spark: SparkSession, folder: str, read: Callable[[], DataFrame], load: Callable[[], inference.Predictor], scan: Scan = Scan(), stems: Stems = Stems(), leaves: Leaves = Leaves()) -> DataFrame:
    """The trees of a scan with their leaves, numbered: classified, separated and completed.

    ``read`` gives the points. Each stage is a table of ``folder`` beside the parameters it depends on, and is read back instead of made while they are equal, so a run
    that was stopped goes on, and new parameters for the leaves leave the stages before them. A model's name is a parameter, its content isn't: name another one anew.
    """
    said = {"scan": asdict(scan)}
    classified = resumed(spark, folder, "classified", lambda: classify(read(), load=load, p=scan), said)
    said = said | {"stems": asdict(stems)}
    clustered = resumed(spark, folder, "clustered", lambda: wood_clusters(classified, stems), said)
    cylinders = resumed(spark, folder, "cylinders", lambda: find_stems(clustered, stems), said)
    hulls = resumed(spark, folder, "hulls", lambda: shape.convex_hulls(clustered.where("clstr >= 0")), said)
    trees = resumed(spark, folder, "trees", lambda: grown_trees(clustered, cylinders, hulls, stems), said)

    def whole() -> DataFrame:
        own = trees.select("clstr", "t_clstr", "is_tip").distinct()
        attached = attach_leaves(classified.where("label = 1").select("pid", "x", "y", "z", "n_z"), hulls, own, **asdict(leaves))
        return numbered_trees(with_leaves(trees, attached), cylinders)

    return resumed(spark, folder, "leaf_on", whole, said | {"leaves": asdict(leaves)})


def write_trees(points: DataFrame, path: str, by_diameter: bool = False) -> None:
    """One folder per tree, of :func:`numbered_trees`, within one per diameter class if asked for."""
    folders = (["diameter_class"] if by_diameter else []) + ["tree"]
    points.repartition(*[F.col(f) for f in folders]).write.mode("overwrite").partitionBy(*folders).parquet(path)


def write_boxes(tiled: DataFrame, path: str) -> None:
    """One folder per box of :func:`voxel.sample_tiles`, its points relative to the box's middle."""
    boxes = ["box_x", "box_y", "box_z"]
    local = tiled.select(*boxes, "pid", *[(F.col(a) - F.col(f"local_{a}")).alias(a) for a in "xyz"])
    local.repartition(*[F.col(b) for b in boxes]).write.mode("overwrite").partitionBy(*boxes).parquet(path)


def filtered(points: DataFrame, k: int = 10, k_sigmas: float = 1.5, radius: float = 0.1, sigmas: float = 1.5, patch: float = 0.1, ball: float = 0.11, sets: int = 10, size: float | None = None) -> DataFrame:
    """pid and kept of all points: what passes, in this order, the finite coordinates, the kth distance, the density, the size of the component, and the thinning to one point a cube.

    A component is one of cover sets that touch, and passes with ``sets`` of them. No ``size``, no thinning.
    """
    sound = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z"))
    dense = stage(neighbors.knn_outliers(sound, k, k_sigmas).select("pid", "x", "y", "z"), "filter")
    dense = stage(neighbors.density_outliers(dense, radius, sigmas).select("pid", "x", "y", "z"), "filter")
    dense = stage(large_components(dense, patch, ball, sets), "filter")
    if size is not None:
        dense = voxel.downsample_cubes(dense, size)
    return points.select("pid").join(dense.select("pid", F.lit(True).alias("kept")), "pid", "left").select("pid", F.coalesce("kept", F.lit(False)).alias("kept"))


def large_components(points: DataFrame, patch: float, ball: float, sets: int, at_least: int = 3) -> DataFrame:
    """The rows of ``points`` in cover sets whose component, by sets that touch, has ``sets`` of them."""
    cover = stage(cluster.cover_sets(points, patch, ball, at_least), "cover")
    touch = cluster.cover_neighbours(points, cover, ball).select(F.col("set_id").alias("src"), F.col("nbr_id").alias("dst"))
    parts = graph.connected_components(touch, cover.select(F.col("center_pid").alias("pid")).distinct())
    large = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= sets)
    inside = parts.join(large, "component", "left_semi").select(F.col("pid").alias("center_pid"))
    return points.join(cover.join(inside, "center_pid", "left_semi").select("pid"), "pid", "left_semi")


def into_branches(points: DataFrame, patch: float, ball: float, at_least: int, more_than: int = 100, height: float = 1.0) -> DataFrame:
    """pid and seg_id, the smallest pid of each branch that :func:`branches.split_branches` makes of the segments; what no branch of a segment reaches stays together."""
    split = stage(branches.split_branches(points, patch, ball, at_least, more_than, height).select("pid", "seg_id", F.coalesce("branch", F.lit(0)).alias("branch")), "branches")
    names = split.groupBy("seg_id", "branch").agg(F.min("pid").alias("name"))
    return split.join(names, ["seg_id", "branch"]).select("pid", F.col("name").alias("seg_id"))


def wood_leaf(points: DataFrame, k: int = 10, threshold: float = 0.125, strength: float = 0.5, rounds: int = 10, split_above: int = 10, patch: float = PATCH, ball: float = BALL, at_least: int = BALL_POINTS, more_than: int = 100, height: float = 1.0) -> DataFrame:
    """pid, seg_id, linearity, p_wood, label (1 wood): regions grown by normals, split again while that changes them, tall ones of many points parted into branches, judged by linearity, smoothed on the graph.

    A segment of more than ``more_than`` points over ``height`` is covered with sets and followed from its lowest one (``patch``, ``ball`` and ``at_least`` are those of the cover).
    """
    near = stage(neighbors.knn(points, points, k), "near")
    # normals are long expressions: written once, or each filter on them would repeat them
    flat = stage(shape.normals(points, k, neighbors.including_self(near, points, k)), "normals")
    regions = graph.region_growing(points.join(flat, "pid"), "nz", k, threshold, near)
    done = stage(regions.withColumnRenamed("region", "seg_id"), "segments")
    live = done
    for _ in range(rounds):
        # large regions get normals from their own points alone, and are grown again
        sizes = live.groupBy("seg_id").agg(F.count("*").alias("n")).where(F.col("n") > split_above)
        large = stage(points.join(live, "pid").join(sizes.select("seg_id"), "seg_id", "left_semi"), "large")
        if large.isEmpty():
            break
        inner = stage(neighbors.knn(large, large, k, keys=["seg_id"]), "inner")
        own = stage(shape.normals(large, k, inner), "normals")
        again = stage(graph.region_growing(large.join(own, "pid", "left").withColumn("nz", F.coalesce("nz", F.lit(0.0))), "nz", k, threshold, inner), "again")
        parts = large.select("pid", "seg_id").join(again, "pid").groupBy("seg_id").agg(F.countDistinct("region").alias("parts")).where("parts > 1")
        moved = stage(again.join(large.select("pid", "seg_id").join(parts, "seg_id", "left_semi").select("pid"), "pid", "left_semi"), "moved")
        if moved.isEmpty():
            break
        done = stage(done.join(moved, "pid", "left").select("pid", F.coalesce("region", "seg_id").alias("seg_id")), "segments")
        live = moved.withColumnRenamed("region", "seg_id")
    done = into_branches(points.join(done, "pid"), patch, ball, at_least, more_than, height)
    judged = stage(shape.wood_probability(points.join(done, "pid")).select("pid", "seg_id", "linearity", "p_wood"), "judged")
    smooth = regularize.smooth(regularize.unary(judged), graph.adjacency(points, k, 0.0, near), strength, places=regularize.along_curve(points, ball))
    return judged.join(smooth, "pid")


def predicted(points: DataFrame) -> DataFrame:
    """The label by the likeliest class."""
    return points.withColumn("label", argmax(CLASSES))
