"""Whole pipelines on a small synthetic forest, and the operators that queries can't hold against SQL."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silva.functions.expr import colour
from silva.operators import cluster, graph, neighbors, regularize, shape
from silva.plans import pipelines

STEMS = [(0.0, 0.0, 0.08), (3.0, 0.5, 0.16), (1.0, 3.0, 0.12)]
PARAMETERS = pipelines.Stems(at_least=5, more_than=30, k=30, stem_at_least=20, stem_points=100, points_per_tree=50)


@pytest.fixture(scope="module")
def forest(spark):
    """Three upright stems of known radius, a bush too thin for a stem, and leaves over each stem: pid, x, y, z, n_z, label, tree."""
    rng = np.random.default_rng(7)
    rows = []
    for k, (x, y, r) in enumerate(STEMS):
        turn, h = rng.uniform(0, 2 * np.pi, 700), rng.uniform(0.0, 2.6, 700)
        rows += [(x + r * np.cos(t) + e, y + r * np.sin(t) + e, z, 3, k) for t, z, e in zip(turn, h, rng.normal(scale=0.002, size=700))]
        rows += [(x + a, y + b, 2.75 + c, 1, k) for a, b, c in rng.uniform(-0.4, 0.4, size=(60, 3)) * [1, 1, 0.3]]
    rows += [(5.0 + a, 5.0 + b, c, 3, -1) for a, b, c in rng.uniform(0, 0.05, size=(60, 3)) + [0, 0, 1.6]]
    return spark.createDataFrame([(i, float(x), float(y), float(z), float(z), lab, t) for i, (x, y, z, lab, t) in enumerate(rows)], "pid long, x double, y double, z double, n_z double, label int, tree int").cache()


@pytest.fixture(scope="module")
def separated(forest):
    return pipelines.separate_trees(forest.drop("tree"), PARAMETERS)


def test_every_stem_is_found_with_its_radius(separated):
    _, cylinders, _ = separated
    found = sorted((r.radius, round(r.x), round(r.y)) for r in cylinders.where("accepted").collect())
    assert [(round(x), round(y)) for x, y, _ in sorted(STEMS, key=lambda s: s[2])] == [f[1:] for f in found]
    assert [f[0] for f in found] == pytest.approx(sorted(r for _, _, r in STEMS), abs=0.01)


def test_wood_belongs_to_its_own_stem(forest, separated, tmp_path):
    trees, cylinders, _ = separated
    seen = trees.join(forest.select("pid", "tree"), "pid").where("t_clstr is not null").groupBy("t_clstr").agg(F.countDistinct("tree").alias("kinds"), F.count("*").alias("n"), F.min("tree").alias("tree")).collect()
    assert len(seen) == 3 and all(r.kinds == 1 and r.n > 600 for r in seen)
    own = pipelines.numbered_trees(trees, cylinders)
    assert own.join(forest.select("pid", F.col("tree").alias("planted")), "pid").select("tree", "planted", "diameter_class").distinct().orderBy("tree").collect() == [(1, 1, 0.3), (2, 2, 0.2), (3, 0, 0.1)]
    assert pipelines.numbered_trees(trees, cylinders, (2.0, 4.0, 0.0, 1.0)).select("tree").distinct().count() == 1
    pipelines.write_trees(own, str(tmp_path / "trees"), by_diameter=True)
    back = own.sparkSession.read.parquet(str(tmp_path / "trees"))
    assert back.count() == own.count() and {"diameter_class", "tree"} <= set(back.columns)


def test_leaves_go_to_the_tree_below(forest, separated):
    trees, _, hulls = separated
    paths = trees.select("clstr", "t_clstr", "is_tip").distinct()
    leaves = forest.where("label = 1")
    got = pipelines.attach_leaves(leaves, hulls, paths)
    named = {r.t_clstr: r.tree for r in trees.join(forest.select("pid", "tree"), "pid").where("t_clstr is not null").select("t_clstr", "tree").distinct().collect()}
    rows = got.collect()
    attached = [r for r in rows if r.t_clstr is not None]
    assert len(rows) == leaves.count() and len(attached) > 0.9 * len(rows) and all(named[r.t_clstr] == r.tree for r in attached)
    whole = pipelines.with_leaves(trees, got.drop("tree"))
    assert whole.where("wood = 0").count() == len(attached) and whole.where("wood = 1").count() == trees.count()


def test_colours(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "t long")
    plain, bright = (rows.select("t", *colour(F.col("t"), f)).collect() for f in (1.0, 1.2))
    assert plain[2][1:] == (211, 211, 211) == bright[2][1:] and plain[0][1:] != plain[1][1:]
    assert all(b == min(255, int(a * 1.2)) for p, q in zip(plain[:2], bright[:2]) for a, b in zip(p[1:], q[1:]))


def test_classify_votes_over_overlapping_tiles(spark):
    rng = np.random.default_rng(3)
    xyz = rng.uniform([0, 0, 0], [7, 4, 0.8], size=(250, 3))
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")

    def predict(rows):
        wood = np.where(rows.z > 0.3, 0.6, 0.1)
        return pd.DataFrame({"pTerrain": np.where(rows.z < -0.1, 0.7, 0.05), "pLeaf": 0.2 + rows.z.abs() / 10, "pCWD": 0.1, "pWood": wood})

    got = {r.pid: r for r in pipelines.classify(table, predict, at_least=10).collect()}
    centre = xyz.mean(axis=0)
    local = xyz - centre
    low, high = np.floor(local.min(axis=0)), np.ceil(local.max(axis=0))
    starts = [np.arange(a - 3, b + 3, 3) for a, b in zip(low, high)]
    times = np.zeros(len(xyz), dtype=int)
    for corner in itertools.product(*starts):
        inside = np.all((local >= corner) & (local <= np.array(corner) + 6), axis=1)
        if inside.sum() > 10:
            assert round(local[inside][:, 2].mean()) == 0
            times += inside
    values = predict(pd.DataFrame(local, columns=["x", "y", "z"])).to_numpy()
    for i in range(len(xyz)):
        order = np.argsort(((local - local[i]) ** 2).sum(axis=1), kind="stable")
        near = np.repeat(order, times[order])[:16]
        want = np.median(values[near], axis=0)
        label = 3 if (values[near][:, 3] > 0.5).any() else int(np.argmax(want))
        row = got[i]
        assert [row.pTerrain, row.pLeaf, row.pCWD, row.pWood] == pytest.approx(want.tolist())
        assert row.label == label or row.n_z <= 0.1 and row.label == 0


def test_minimal_cuts_equal_the_least_energy_of_all_labellings(spark):
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 7
        u0, u1 = rng.random(n), rng.random(n)
        pairs = [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.4]
        a, b = (np.array([p[k] for p in pairs], dtype=int) for k in (0, 1))
        w = rng.random(len(pairs)) * 0.5

        def energy(labels):
            return sum(u1[i] if labels[i] else u0[i] for i in range(n)) + sum(x for x, i, j in zip(w, a, b) if labels[i] != labels[j])

        assert energy(regularize.minimal_cut(u0, u1, a, b, w)) == pytest.approx(min(map(energy, itertools.product((0, 1), repeat=n))))
    costs = spark.createDataFrame([(i, float(rng.random()), float(rng.random())) for i in range(60)], "pid long, u0 double, u1 double")
    links = [(i, (i * 7 + 3) % 55, float(rng.random())) for i in range(55) if i != (i * 7 + 3) % 55]
    edges = spark.createDataFrame(links + [(j, i, w) for i, j, w in links], "src long, dst long, w double")
    cut, swept = regularize.smooth(costs, edges, 0.5), regularize.smooth(costs, edges, 0.5, exact=3)
    assert cut.count() == swept.count() == 60
    assert regularize.energy(cut, costs, edges, 0.5) <= regularize.energy(swept, costs, edges, 0.5) + 1e-9


def test_exact_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(6)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 3.0], 700), rng.exponential(size=1)):
        table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.37, 0.9, 1.0):
            assert neighbors.exact_quantile(table, "v", share, few=50) == pytest.approx(np.quantile(values, share))
    assert neighbors.exact_quantile(table.limit(0), "v", 0.5) is None


def test_filters_drop_what_lies_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, size=(800, 3)) * [1, 1, 0.9])]
    rows += [(900 + i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 0.05, size=(6, 3)) + 2.0)]  # a speck
    rows += [(1000, 9.0, 9.0, 0.5), (1001, float("nan"), 0.0, 0.0), (1002, None, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    kept = {r.pid: r.kept for r in pipelines.filtered(table, radius=0.3, patch=0.2, ball=0.25, sets=5).collect()}
    assert len(kept) == len(rows) and not any(kept[i] for i in (*range(900, 906), 1000, 1001, 1002)) and sum(kept[i] for i in range(800)) > 600
    thin = pipelines.filtered(table, radius=0.3, patch=0.2, ball=0.25, sets=5, size=0.5)
    assert 0 < thin.where("kept").count() <= 8 + 19


def test_hulls_of_large_clusters_are_those_of_all_points(spark, monkeypatch):
    monkeypatch.setattr(shape, "HULL_POINTS", 100)
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, p), i % 2) for i, p in enumerate(rng.normal(size=(900, 3)))] + [(1000 + i, float(i), 0.0, 0.0, 5) for i in range(8)]
    got = shape.convex_hulls(spark.createDataFrame(rows, "pid long, x double, y double, z double, clstr long"))
    for c in (0, 1):
        own = np.array([r[1:4] for r in rows if r[4] == c])
        hull = np.array([(r.x, r.y, r.z) for r in got.where(F.col("clstr") == c).collect()])
        turn = rng.normal(size=(500, 3))
        assert np.allclose((own @ turn.T).max(axis=0), (hull @ turn.T).max(axis=0)) and len(hull) < 120
    assert got.where("clstr = 5").count() == 8


def test_trees_with_leaves_are_written_once_a_row(spark, tmp_path):
    from silva.sources import format

    format.register(spark)
    trees = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5, 10, 20, 30), (2, 0.0, 0.0, 1.0, 5, 10, 20, 30)], "pid long, x double, y double, z double, t_clstr long, red int, green int, blue int")
    leaves = spark.createDataFrame([(3, 0.1, 0.0, 1.0, 5), (3, 0.1, 0.0, 1.0, 5), (4, 9.0, 9.0, 9.0, None)], "pid long, x double, y double, z double, t_clstr long")
    whole = pipelines.with_leaves(trees, leaves)
    whole.write.format("silva").option("kind", "las").mode("overwrite").save(str(tmp_path / "leaf_on"))
    back = spark.read.format("silva").load(str(tmp_path / "leaf_on"))
    assert {"red", "green", "blue", "t_clstr", "wood"} <= set(back.columns)
    got = sorted((round(r.x, 3), round(r.z, 3), int(r.t_clstr), int(r.wood)) for r in back.collect())
    assert got == [(0.0, 0.0, 5, 1), (0.0, 1.0, 5, 1), (0.1, 1.0, 5, 0)]
    assert back.where("wood = 0").select(F.max("green")).first()[0] >= 0


def test_normals_of_the_wood_leaf_run_take_the_neighbours_that_are_known(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xyz = [*map(tuple, rng.uniform(0, 1, (80, 3)).tolist()), *[(2.0, 2.0, 2.0)] * 9]
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(xyz)], "pid long, x double, y double, z double")
    columns = ["src", "dst", "d2", "rank"]
    got = neighbors.including_self(neighbors.knn(p, p, 4), p, 4).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, neighbors.knn(p, p, 4, with_self=True).select(columns).collect()))
    searched, written, knn, stage = [], [], neighbors.knn, pipelines.stage
    monkeypatch.setattr(neighbors, "knn", lambda *a, **k: searched.append(k) or knn(*a, **k))
    monkeypatch.setattr(pipelines, "stage", lambda df, name: written.append(name) or stage(df, name))

    class Grown(Exception):
        pass

    def grown(*given):
        raise Grown

    monkeypatch.setattr(graph, "region_growing", grown)
    with pytest.raises(Grown):
        pipelines.wood_leaf(p, 4)
    assert len(searched) == 1 and "normals" in written
