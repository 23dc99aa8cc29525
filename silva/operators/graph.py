"""Graphs as edge tables: symmetrising, weights, components, growing regions and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import edge_weight
from . import neighbors
from .tables import drop_stages, stage


def symmetrise(edges: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of each edge once; of several with other ``columns`` the forward one's come first, then the smallest."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns, F.lit(1).alias("_back"))
    both = edges.select("src", "dst", *columns, F.lit(0).alias("_back")).unionByName(back)
    if not columns:
        return both.select("src", "dst").distinct()
    first = both.groupBy("src", "dst").agg(F.min(F.struct("_back", *columns)).alias("_x"))
    return first.select("src", "dst", *[F.col(f"_x.{c}").alias(c) for c in columns])


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """pid and component, the smallest pid that undirected ``edges`` (src, dst) reach; ``nodes`` (pid) without edges are alone.

    Each round takes the smallest label around, then jumps to that label's own label, so rounds grow with the logarithm of the longest path.
    """
    links = stage(symmetrise(edges.where("src <> dst")), "links")
    labels = links.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("pid"), F.least("src", "m").alias("component"))
    labels = stage(labels, "labels")
    before = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if now == before:
            break
        before = now
        around = links.join(labels, links.dst == labels.pid).groupBy("src").agg(F.min("component").alias("m"))
        low = labels.join(around, labels.pid == around.src, "left").select("pid", F.least("component", F.coalesce("m", "component")).alias("component"))
        # a label's node passes the smaller label on to all that point at it
        hooked = low.unionByName(low.join(labels.withColumnRenamed("component", "old"), "pid").where("old <> component").select(F.col("old").alias("pid"), "component"))
        low = stage(hooked.groupBy("pid").agg(F.min("component").alias("component")), "labels")
        jump = low.select(F.col("pid").alias("component"), F.col("component").alias("further"))
        after = stage(low.join(jump, "component", "left").select("pid", F.coalesce("further", "component").alias("component")), "labels")
        drop_stages(labels, low)
        labels = after
    drop_stages(links)
    if nodes is None:
        return labels
    return nodes.select("pid").join(labels, "pid", "left").select("pid", F.coalesce("component", "pid").alias("component"))


def adjacency(points: DataFrame, k: int, mode: float, neighbours: DataFrame | None = None) -> DataFrame:
    """Weighted graph of the k nearest: edges pruned by source, weighed by length over the mean of all, both directions once."""
    found = neighbours if neighbours is not None else neighbors.knn(points, points, k)
    edges = found.withColumn("d", F.sqrt("d2"))
    mean = edges.agg(F.avg("d").alias("_mean"))
    kept = neighbors.prune_rows(edges).crossJoin(F.broadcast(mean))
    return symmetrise(kept.where("src <> dst").withColumn("w", edge_weight(F.col("d"), F.col("_mean"), mode)), ("w",))


def region_growing(points: DataFrame, feature: str, k: int = 10, threshold: float = 0.1, neighbours: DataFrame | None = None) -> DataFrame:
    """pid and region: components of the pruned graph of the k nearest whose ends' absolute features differ by the threshold at most."""
    found = neighbours if neighbours is not None else neighbors.knn(points, points, k)
    edges = neighbors.prune_rows(neighbors.prune_all(found.withColumn("d", F.sqrt("d2")), k))
    a = points.select(F.col("pid").alias("src"), F.col(feature).alias("_a"))
    b = points.select(F.col("pid").alias("dst"), F.col(feature).alias("_b"))
    alike = edges.join(a, "src").join(b, "dst").where(F.abs(F.abs("_a") - F.abs("_b")) <= threshold)
    return connected_components(alike, points).withColumnRenamed("component", "region")


def cluster_edges(points: DataFrame, k: int, longest: float, neighbours: DataFrame | None = None) -> DataFrame:
    """Shortest edge per ordered pair of clusters among each point's k nearest, no longer than ``longest``. Neighbours in the own cluster use up k."""
    found = neighbours if neighbours is not None else neighbors.knn(points, points, k)
    a = points.select(F.col("pid").alias("src"), F.col("clstr").alias("source"))
    b = points.select(F.col("pid").alias("dst"), F.col("clstr").alias("target"))
    edges = found.join(a, "src").join(b, "dst").where("source <> target")
    return edges.groupBy("source", "target").agg(F.min(F.sqrt("d2")).alias("length")).where(F.col("length") <= longest)


def undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair; where both directions exist, that from the larger to the smaller id."""
    a, b = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    return edges.groupBy(a, b).agg(F.max_by("length", "source").alias("length"))


def shortest_paths(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """clstr, distance, t_clstr (the origin), is_tip (no shortest path goes on from there) of every cluster that origins reach.

    ``edges``: source, target, length; ``origins``: clstr. Origins without an edge of their own are left out. Equal distances go to the smaller
    origin, then predecessor. Rounds of relaxation from what the round before changed, each written to the shared folder.
    """
    one = undirected(edges)
    links = stage(one.select(F.col("a").alias("u"), F.col("b").alias("v"), "length").unionByName(one.select(F.col("b").alias("u"), F.col("a").alias("v"), "length")), "roads")
    starts = origins.select("clstr").distinct().join(edges.select(F.col("source").alias("clstr")).distinct(), "clstr", "left_semi")
    best = stage(starts.select("clstr", F.struct(F.lit(0.0).alias("distance"), F.col("clstr").alias("t_clstr"), F.lit(None).cast("long").alias("pred")).alias("s")), "paths")
    changed = best
    while True:
        # only what the last round changed goes on
        step = changed.join(links, changed.clstr == links.u).select(F.col("v").alias("clstr"), F.struct((F.col("s.distance") + F.col("length")).alias("distance"), F.col("s.t_clstr").alias("t_clstr"), F.col("u").alias("pred")).alias("new"))
        met = step.groupBy("clstr").agg(F.min("new").alias("new")).join(best, "clstr", "left")
        newer = stage(met.where(F.col("s").isNull() | (F.col("new") < F.col("s"))).select("clstr", F.col("new").alias("s")), "changed")
        if changed is not best:
            drop_stages(changed)
        changed = newer
        if changed.isEmpty():
            break
        after = stage(best.join(changed.select("clstr"), "clstr", "left_anti").unionByName(changed), "paths")
        drop_stages(best)
        best = after
    drop_stages(changed, links)
    inner = best.where("s.pred is not null").select(F.col("s.pred").alias("clstr")).distinct().withColumn("_inner", F.lit(True))
    out = best.join(inner, "clstr", "left")
    return out.select("clstr", "s.distance", "s.t_clstr", F.col("_inner").isNull().alias("is_tip"))


def best_path(paths: DataFrame) -> DataFrame:
    """The row with the smallest distance of each cluster."""
    return paths.withColumn("_n", F.row_number().over(Window.partitionBy("clstr").orderBy("distance", "t_clstr"))).where("_n = 1").drop("_n")
