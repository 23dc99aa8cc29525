"""Blocks that may not grow end at the least energy too."""

import itertools
import random

import numpy as np
import pytest

from silva.operators import regularize

from .test_regularize import grid_graph, one_cut, tables


def test_blocks_that_may_not_grow_give_the_labels_of_one_cut(spark):
    costs, edges = grid_graph(random.Random(2), 40, 0.02)
    c, e = tables(spark, costs, edges)
    got = {r.pid: r.label for r in regularize.least_energy(c, e.selectExpr("src", "dst", "5.0 * w AS cap"), block=200, most=200).collect()}
    assert got == dict(enumerate(one_cut(costs, edges, 5.0)))


def test_a_flow_between_blocks_takes_arcs_of_one_direction(spark):
    rng = random.Random(5)
    costs = [(k, 2 * rng.random(), 2 * rng.random()) for k in range(9)]
    arcs = [(a, b, rng.random()) for a, b in itertools.permutations(range(9), 2) if rng.random() < 0.4]
    c = spark.createDataFrame(costs, "pid long, u0 double, u1 double")
    links = spark.createDataFrame(arcs, "src long, dst long, cap double")
    got = {r.pid: r.label for r in regularize._by_regions(c, links, ["pid"], 2).collect()}
    a, b, w = (np.array(v) for v in zip(*arcs))
    want = regularize.minimal_cut(np.array([x[1] for x in costs]), np.array([x[2] for x in costs]), a, b, w, np.zeros(len(w)))
    assert got == dict(enumerate(want))

    def energy(x):
        return sum(costs[k][1 + v] for k, v in enumerate(x)) + sum(w for a, b, w in arcs if x[a] == 0 and x[b] == 1)

    assert energy([got[k] for k in range(9)]) == pytest.approx(min(map(energy, itertools.product((0, 1), repeat=9))))
