"""Branches on drawn graphs, and of a forked stem."""

import numpy as np

from silva.operators import branches


def graph(*chains):
    near = {}
    for chain in chains:
        for a, b in zip(chain, chain[1:]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def test_a_chain_is_one_branch():
    assert branches.follow(graph(range(10)), {0}) == {i: (1, 0) for i in range(10)}
    assert branches.follow({}, {4}) == {4: (1, 0)}


def test_the_longer_arm_of_a_fork_goes_on():
    # a stem of five sets; arms of 12 and 9, of which the look-ahead of two layers sees equally many: the first found goes on
    near = graph(range(5), [4, *range(10, 22)], [4, *range(30, 39)])
    got = branches.follow(near, {0})
    assert {got[i] for i in (*range(5), *range(10, 22))} == {(1, 0)} and {got[i] for i in range(30, 39)} == {(2, 1)}
    assert len(got) == len(near)


def test_short_stubs_end_with_their_parent():
    near = graph(range(20), [9, 40])  # a stub of one set beside the stem's next layer
    got = branches.follow(near, {0})
    assert got[40] == (1, 0) and {v for v in got.values()} == {(1, 0)}


def test_branches_of_branches_and_unreached_sets():
    near = graph(range(30), [8, *range(100, 130)], [110, *range(200, 225)], [500, 501])
    got = branches.follow(near, {0})
    assert set(got) == set(near) - {500, 501}
    kinds = {name: {got[i] for i in own} for name, own in {"stem": range(9, 30), "side": range(100, 111), "twig": range(200, 225)}.items()}
    assert all(len(k) == 1 for k in kinds.values()) and len(set().union(*kinds.values())) >= 2
    assert {b for b, _ in got.values()} == {1, 2, 3} and {p for _, p in got.values()} == {0, 1} | {p for _, p in got.values() if p}


def test_rules_match_the_column_expressions(spark):
    from pyspark.sql import functions as F

    from silva.operators import shape

    rows = [(b, c, cut, study, g) for b in (1, 2, 5, 14) for c in (1, 2, 3, 5, 28, 60) for cut in (15, 20, 400) for study in (60, 90) for g in (False, True)]
    kind, goes = shape.branch_class(F.col("b"), F.col("c"), F.col("cut"), F.col("study"), F.col("g"))
    got = spark.createDataFrame(rows, "b long, c long, cut long, study long, g boolean").select("*", kind.alias("kind"), goes.alias("goes")).collect()
    for r in got:
        branch, main = branches._is_branch(r.b, r.c, r.g, r.cut, r.study)
        assert (int(branch), main) == (r.kind, r.goes)


def test_a_forked_stem_is_split(spark):
    rng = np.random.default_rng(2)
    h = rng.uniform(0, 2, 500)
    up = rng.uniform(0, 1.2, 300)
    rows = [(0.0, 0.0, z) for z in h] + [(t * 0.9, 0.0, 1.0 + t * 0.5) for t in up[:300]]
    rows = [(i, *map(float, p + rng.normal(scale=0.01, size=3)), 1) for i, p in enumerate(np.array(rows))]
    rows += [(1000 + i, 9.0, 9.0, i / 100, 2) for i in range(50)]
    got = branches.split_branches(spark.createDataFrame(rows, "pid long, x double, y double, z double, seg_id long"), 0.1, 0.13).collect()
    assert len(got) == len(rows) and {(r.branch, r.parent) for r in got if r.seg_id == 2} == {(1, 0)}
    low = [r for r in got if r.seg_id == 1 and r.z < 0.8]
    far = [r for r in got if r.seg_id == 1 and r.x > 0.4 and r.branch]
    assert {r.branch for r in low if r.branch} == {1} and len({r.branch for r in far}) == 1 and len(far) > 100
    assert len({r.branch for r in got if r.seg_id == 1 and r.branch}) >= 2


def test_segments_become_branches(spark):
    from silva.plans import pipelines

    rng = np.random.default_rng(3)
    h, up = rng.uniform(0, 2, 500), rng.uniform(0, 1.2, 300)
    rows = [(0.0, 0.0, z) for z in h] + [(t * 0.9, 0.0, 1.0 + t * 0.5) for t in up]
    rows = [(i, *map(float, p + rng.normal(scale=0.01, size=3)), 7) for i, p in enumerate(np.array(rows))] + [(2000 + i, 9.0, 9.0, i / 100, 8) for i in range(50)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double, seg_id long")
    got = {r.pid: r.seg_id for r in pipelines.into_branches(points, 0.1, 0.13, 3).collect()}
    assert set(got) == {r[0] for r in rows} and {got[2000 + i] for i in range(50)} == {2000}
    arm = {got[r[0]] for r in rows if r[4] == 7 and r[1] > 0.4}
    stem = {got[r[0]] for r in rows if r[4] == 7 and r[3] < 0.8}
    most = lambda part: max(part, key=lambda s: sum(v == s for v in got.values()))
    assert most(arm) != most(stem) and all(got[s] == s for s in set(got.values()))
