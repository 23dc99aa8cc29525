"""Minimal cuts by blocks against one cut, expansion moves against all labellings."""

import itertools
import random

import numpy as np
import pytest

from silva.operators import regularize


def grid_graph(rng, side, pull):
    """A noisy square grid with two blobs: costs (pid, u0, u1) and edges both ways."""
    costs, edges = [], []
    for x in range(side):
        for y in range(side):
            lean = pull if (x // 20 + y // 20) % 2 else -pull
            costs.append((x * side + y, rng.random() + lean, rng.random()))
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < side and y + dy < side:
                    w = rng.random()
                    a, b = x * side + y, (x + dx) * side + y + dy
                    edges += [(a, b, w), (b, a, w)]
    return costs, edges


def tables(spark, costs, edges):
    return spark.createDataFrame(costs, "pid long, u0 double, u1 double"), spark.createDataFrame(edges, "src long, dst long, w double")


def one_cut(costs, edges, strength):
    a, b, w = (np.array(v) for v in zip(*[e for e in edges if e[0] < e[1]]))
    u0, u1 = (np.array([c[k] for c in costs]) for k in (1, 2))
    return regularize.minimal_cut(u0, u1, a, b, strength * w)


def test_blocks_give_the_labels_of_one_cut(spark):
    costs, edges = grid_graph(random.Random(1), 142, 0.2)  # 20,164 points, one component
    c, e = tables(spark, costs, edges)
    want = one_cut(costs, edges, 0.7)
    got = {r.pid: r.label for r in regularize.smooth(c, e, 0.7, exact=2500).collect()}
    assert len(got) == len(costs) and 0 < want.sum() < len(costs)
    assert all(got[k] == want[k] for k in range(len(costs)))


def test_strong_edges_and_weak_costs(spark):
    costs, edges = grid_graph(random.Random(2), 40, 0.01)
    c, e = tables(spark, costs, edges)
    want = one_cut(costs, edges, 20.0)
    assert {r.pid: r.label for r in regularize.smooth(c, e, 20.0, exact=100).collect()} == dict(enumerate(want))
    # blocks that may not grow: a local minimum, no lower than the bound
    arcs = e.selectExpr("src", "dst", "20.0 * w AS cap")
    rough = regularize.least_energy(c, arcs, block=100, most=100)
    low, found = regularize.lower_bound(c, e, 20.0, 100), regularize.energy(rough, c, e, 20.0)
    best = regularize.energy(spark.createDataFrame([(k, int(v)) for k, v in enumerate(want)], "pid long, label int"), c, e, 20.0)
    assert low <= best + 1e-9 <= found + 2e-9


def test_arcs_of_one_direction(spark):
    rng = random.Random(3)
    for _ in range(2):
        costs = [(k, rng.random(), rng.random()) for k in range(9)]
        arcs = [(a, b, rng.random()) for a, b in itertools.permutations(range(9), 2) if rng.random() < 0.3]
        c = spark.createDataFrame(costs, "pid long, u0 double, u1 double")
        got = {r.pid: r.label for r in regularize.least_energy(c, spark.createDataFrame(arcs, "src long, dst long, cap double"), block=4).collect()}

        def energy(x):
            return sum(costs[k][1 + v] for k, v in enumerate(x)) + sum(w for a, b, w in arcs if x[a] == 0 and x[b] == 1)

        assert energy([got[k] for k in range(9)]) == pytest.approx(min(map(energy, itertools.product((0, 1), repeat=9))))


def test_compact_stretches(spark):
    points = spark.createDataFrame([(x * 16 + y, float(x), float(y), 0.0) for x in range(16) for y in range(16)], "pid long, x double, y double, z double")
    at = {r.pid: r.curve for r in regularize.along_curve(points, 1.0).collect()}
    first = sorted(at, key=at.get)[:16]
    assert {(k // 16, k % 16) for k in first} == set(itertools.product(range(4), repeat=2))


@pytest.mark.parametrize("apart", [None, [[0, 1, 2], [1, 0, 1], [2, 1, 0]]])
def test_expansion_on_small_graphs(spark, apart):
    rng = random.Random(4)
    costs = [(k, [rng.random() for _ in range(3)]) for k in range(7)]
    some = [(a, b, rng.random()) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.5]
    c = spark.createDataFrame(costs, "pid long, u array<double>")
    e = spark.createDataFrame(some + [(b, a, w) for a, b, w in some], "src long, dst long, w double")
    labels = regularize.expansion(c, e, 0.6, apart)
    got = {r.pid: r.label for r in labels.collect()}

    def energy(x):
        return sum(costs[k][1][v] for k, v in enumerate(x)) + 0.6 * sum(w * (apart[x[a]][x[b]] if apart else x[a] != x[b]) for a, b, w in some)

    mine = [got[k] for k in range(7)]
    assert regularize.class_energy(labels, c, e, 0.6, apart) == pytest.approx(energy(mine))
    for label in range(3):  # no expansion is better
        for change in itertools.product((False, True), repeat=7):
            assert energy(mine) <= energy([label if ch else v for v, ch in zip(mine, change)]) + 1e-9
    assert energy(mine) == pytest.approx(min(map(energy, itertools.product(range(3), repeat=7))))


def test_costs_of_classes(spark):
    points = spark.createDataFrame([(1, 0.7, 0.2, 0.1), (2, 0.1, 0.1, 0.8)], "pid long, a double, b double, c double")
    for mode in range(4):
        rows = regularize.class_costs(points, ["a", "b", "c"], mode).collect()
        assert all(min(r.u) == 0 for r in rows) and sum(map(sum, (r.u for r in rows))) == pytest.approx(6)
        assert [r.u.index(0) for r in sorted(rows)] == [0, 2]


def test_no_points(spark):
    c, e = tables(spark, [(1, 0.0, 1.0)], [(1, 1, 1.0)])
    assert regularize.smooth(c.limit(0), e.limit(0), 1.0).count() == 0
    assert [tuple(r) for r in regularize.smooth(c, e.limit(0), 1.0).collect()] == [(1, 0)]
