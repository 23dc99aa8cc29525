"""Operators against brute force on small clouds, with ties, empty clouds and single points."""

import math

import numpy as np
import pytest

from silva.functions import expr
from silva.operators import cluster, graph, neighbors, regularize, shape, terrain, voxel
from pyspark.sql import functions as F


def cloud(spark, xyz, **more):
    names = list(more)
    rows = [(i, *[float(v) for v in p], *[more[n][i] for n in names]) for i, p in enumerate(xyz)]
    kinds = "".join(f", {n} {'string' if more[n] and isinstance(more[n][0], str) else 'long'}" for n in names)
    return spark.createDataFrame(rows, "pid long, x double, y double, z double" + kinds)


def test_floor_index_follows_the_remainder(spark):
    values = [2.0, 1.0, -0.3, -1e-20, 0.0, 0.6000000000000001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(expr.floor_index("v", 0.2)).collect()]
    assert got == [int(v // 0.2) for v in values]


def test_knn_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.normal(size=(60, 3)), np.zeros((4, 3)), [[40, 0, 0]]])
    p = cloud(spark, xyz)
    got = {}
    for r in neighbors.knn(p, p, 4).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for i in range(len(xyz)):
        d2 = [((xyz[i] - xyz[j]) ** 2).sum() for j in range(len(xyz))]
        near = sorted((j for j in range(len(xyz)) if j != i), key=lambda j: (d2[j], j))[:4]
        assert [d2[j] for _, j in sorted(got[i])] == pytest.approx([d2[j] for j in near])


def test_knn_of_few_and_no_points(spark):
    p = cloud(spark, [[0, 0, 0], [1, 1, 1]])
    assert {(r.src, r.dst) for r in neighbors.knn(p, p, 5).collect()} == {(0, 1), (1, 0)}
    assert neighbors.knn(p.limit(0), p.limit(0), 5).count() == 0


def test_components_of_a_long_chain_and_lone_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(3, 60)] + [(70, 71), (5, 5)], "src long, dst long")
    nodes = spark.range(75).withColumnRenamed("id", "pid")
    got = {r.pid: r.component for r in graph.connected_components(edges, nodes).collect()}
    assert got == {i: 3 if 3 <= i <= 60 else 70 if i in (70, 71) else i for i in range(75)}


def test_dbscan_noise_border_and_core(spark):
    rng = np.random.default_rng(2)
    xyz = np.concatenate([rng.normal(scale=0.02, size=(20, 3)), rng.normal(scale=0.02, size=(20, 3)) + 1, [[5, 5, 5], [9, 9, 9]]])
    got = {r.pid: r.clstr for r in cluster.dbscan(cloud(spark, xyz), 0.15, 5).collect()}
    assert got == {**{i: 0 for i in range(20)}, **{i: 20 for i in range(20, 40)}}


def test_cover_sets_equal_the_sequential_choice(spark):
    rng = np.random.default_rng(3)
    xyz = rng.random((150, 3))
    p = cloud(spark, xyz)
    got = {r.pid: r.center_pid for r in cluster.cover_sets(p, 0.2, 0.25, 3).collect()}
    rank = {r.pid: (r.h, r.pid) for r in p.select("pid", F.xxhash64(F.lit(0), "pid").alias("h")).collect()}
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    open_, seeds = set(range(150)), []
    for i in sorted(range(150), key=rank.get):
        if i in open_ and (d[i] < 0.25).sum() >= 3:
            seeds.append(i)
            open_ -= set(np.flatnonzero(d[i] < 0.2).tolist())
    want = {j: min((s for s in seeds if d[s, j] < 0.25), key=lambda s: (d[s, j], rank[s])) for j in range(150) if any(d[s, j] < 0.25 for s in seeds)}
    assert got == want


def test_linearity_of_line_and_ball_and_single_point(spark):
    rng = np.random.default_rng(4)
    line = np.stack([np.linspace(0, 1, 60)] * 3, axis=1)
    ball = rng.normal(size=(400, 3))
    xyz = np.concatenate([line, ball, [[0, 0, 0]]])
    p = cloud(spark, xyz, seg=[0] * 60 + [1] * 400 + [2])
    got = {r.seg: r.linearity for r in shape.linearity(p, ["seg"]).collect()}
    assert got[0] > 0.999 and got[1] < 0.3 and got[2] == 0


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.random((80, 2)), np.zeros((80, 1))], axis=1)
    assert all(r.nz == pytest.approx(1) for r in shape.normals(cloud(spark, xyz)).collect())


def test_hull_keeps_the_corners(spark):
    corners = [[a, b, c] for a in (0, 3) for b in (0, 3) for c in (0, 3)]
    inside = np.random.default_rng(6).uniform(0.5, 2.5, size=(50, 3)).tolist()
    p = cloud(spark, corners + inside, clstr=[7] * 58)
    assert {r.pid for r in shape.convex_hulls(p).collect()} == set(range(8))


def test_cylinder_radius(spark):
    rng = np.random.default_rng(7)
    t, h = rng.uniform(0, 2 * math.pi, 300), rng.uniform(0, 1, 300)
    xyz = np.stack([0.1 * np.cos(t) + 5, 0.1 * np.sin(t) - 2, h], axis=1) + rng.normal(scale=0.002, size=(300, 3))
    few = xyz[:30]
    p = cloud(spark, np.concatenate([xyz, few]), clstr=[1] * 300 + [2] * 30)
    got = {r.clstr: r for r in shape.fit_cylinders(p, tries=20).collect()}
    assert got[1].radius == pytest.approx(0.1, abs=0.005) and got[1].x == pytest.approx(5, abs=0.01) and got[1].cv < 0.1
    assert got[2].radius is None and got[2].cnt == 30


def test_cylinder_of_a_large_cluster_takes_all_points(spark):
    rng = np.random.default_rng(3)
    angle, r = rng.uniform(0, 2 * np.pi, 900), 0.1 + rng.normal(scale=0.003, size=900)
    p = cloud(spark, np.stack([5 + r * np.cos(angle), 2 + r * np.sin(angle), rng.uniform(0, 0.2, 900)], axis=1), clstr=[1] * 900)
    whole, parts = (shape.fit_cylinders(p, tries=4, at_most=n).first() for n in (1000, 150))
    assert parts.cnt == whole.cnt == 900
    for a in ("radius", "x", "y", "z", "cv"):
        assert parts[a] == pytest.approx(whole[a], abs=1e-5)


def test_parts_of_a_large_cluster_are_many_tasks_and_settled_tries_end_the_rounds(spark, monkeypatch):
    angle = np.linspace(0, 2 * np.pi, 900)
    p = cloud(spark, np.stack([5 + 0.1 * np.cos(angle), 2 + 0.1 * np.sin(angle), np.linspace(0, 0.2, 900)], axis=1), clstr=[1] * 900)
    written, write = [], shape.stage

    def kept(df, name):
        written.append((name, write(df, name)))
        return written[-1][1]

    monkeypatch.setattr(shape, "stage", kept)
    assert shape.fit_cylinders(p, tries=4, at_most=150).first().radius == pytest.approx(0.1, abs=1e-6)
    parts = [df for name, df in written if name == "parts"][0]
    assert len(parts.inputFiles()) > 2  # one before, so one task
    assert sum(name == "tries" for name, _ in written) < 20  # 22 before, whatever the tries did


def test_wood_leaf_query_runs_all_rounds(monkeypatch):
    import inspect

    from silva.plans import catalog, pipelines

    class Points:
        def select(self, *_):
            return self

    seen = []
    rule = inspect.signature(pipelines.wood_leaf)
    monkeypatch.setattr(catalog.views, "embed", lambda *_: Points())
    monkeypatch.setattr(catalog.pipelines, "wood_leaf", lambda *a, **k: seen.append(rule.bind(*a, **k)))
    catalog._wood_leaf(None, "")
    seen[0].apply_defaults()
    assert seen[0].arguments["rounds"] == 10


def test_branch_rules_pass_the_continuation_on(spark):
    rows = [(1, 1, 10, 20, 100, 200, True), (1, 2, 12, 30, 100, 200, True), (2, 1, 80, 90, 100, 200, True)]
    got = {(r.cut_id, r.comp_id): (r["class"], r.continuation) for r in shape.classify_components(spark.createDataFrame(rows, "cut_id int, comp_id int, base int, comp int, cut int, study int, goes_on boolean")).collect()}
    assert got == {(1, 1): (1, False), (1, 2): (0, True), (2, 1): (0, True)}


def test_terrain_of_a_ramp_with_holes(spark):
    xyz = [[x + 0.25, y + 0.25, 0.5 * x] for x in range(6) for y in range(6) if (x, y) not in {(2, 2), (3, 3)}] + [[2.25, 2.25, 3.0]]
    p = cloud(spark, xyz, label=[0] * 34 + [3])
    got = {r.pid: r.n_z for r in terrain.normalise(p, F.col("label") == 0, 1.0).collect()}
    assert len(got) == 35 and got[34] == pytest.approx(2.0, abs=0.6)


def test_smoothing_lowers_the_energy(spark):
    rng = np.random.default_rng(8)
    n = 40
    costs = spark.createDataFrame([(i, float(rng.random()), float(rng.random())) for i in range(n)], "pid long, u0 double, u1 double")
    edges = graph.symmetrise(spark.createDataFrame([(i, (i + 1) % n, 0.6) for i in range(n)], "src long, dst long, w double"), ("w",))
    start = costs.select("pid", (F.col("u1") < F.col("u0")).cast("int").alias("label"))
    smooth = regularize.smooth(costs, edges, 0.5)
    assert regularize.energy(smooth, costs, edges, 0.5) <= regularize.energy(start, costs, edges, 0.5)


def test_smoothing_settles_long_fronts(spark):
    n = 54  # the front moves one point a sweep
    costs = spark.createDataFrame([(i, 10.0 if i == 0 else 0.0, 0.0 if i == 0 else 0.001) for i in range(n)], "pid long, u0 double, u1 double")
    edges = graph.symmetrise(spark.createDataFrame([(i, i + 1, 2 - i * 0.01) for i in range(n - 1)], "src long, dst long, w double"), ("w",))
    assert {r.label for r in regularize.smooth(costs, edges, 0.5).collect()} == {1}


def test_shift_goes_back_and_tiles_cover(spark):
    p = cloud(spark, np.random.default_rng(9).uniform(-8, 8, size=(40, 3)))
    back = {r.pid: r.x for r in voxel.shift(voxel.shift(p), back=True).collect()}
    assert back == pytest.approx({r.pid: r.x for r in p.collect()})
    assert {r.n for r in voxel.tiles(p).groupBy("pid").agg(F.count("*").alias("n")).collect()} == {8}
