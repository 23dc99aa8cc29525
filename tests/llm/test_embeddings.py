"""The embedding join against all pairs: repeated ids, groups of near copies over many units of work, ties at the threshold, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from silva.llm import embeddings


def brute(rows, least=0.93):
    """(vec_id, n_links, component_id) of each row, in order."""
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i, (a, x, k) in enumerate(rows):
        for j in range(i):
            b, y, m = rows[j]
            if None in (a, b, k, m) or k != m or x is None or y is None or len(x) != len(y) or not len(x):
                continue
            x_, y_ = np.array(x, dtype=float), np.array(y, dtype=float)
            if not (np.isfinite(x_).all() and np.isfinite(y_).all() and x_.any() and y_.any()):
                continue
            if (x_ * y_).sum() / (np.sqrt((x_ * x_).sum()) * np.sqrt((y_ * y_).sum())) >= least:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), float("inf")), rows[i][0] if rows[i][0] is not None else float("inf"))
    return sorted((-1 if r[0] is None else r[0], links[i], -1 if r[0] is None else low[find(i)]) for i, r in enumerate(rows))


def test_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        rows.append((k, rng.normal(size=32).tolist(), k % 2))
    centre = rng.normal(size=32)
    for k in range(150, 260):  # a near group whose members aren't all linked
        rows.append((k, (centre + rng.normal(scale=0.2, size=32)).tolist(), 0))
    rows += [(i, [v * 3 for v in rows[i][1]], 0) for i in range(10)]  # repeated ids, other lengths
    rows += [(7, rows[155][1], 0), (8, rows[155][1], 0), (8, rows[155][1], 0), (None, rows[155][1], 0), (300, rows[155][1], None), (301, rows[155][1], 1)]
    rows += [(310, None, 0), (311, [], 0), (312, [0.0] * 32, 0), (313, [None] + [1.0] * 31, 0), (314, [float("inf")] * 32, 0), (315, [1.0, 2.0], 0), (316, [1.0, 2.001], 0), (317, [5.0], 0), (318, [7.0], 0)]
    side = (1 - 0.93**2) ** 0.5
    rows += [(400, [1.0, 0.0], 3), (401, [0.93, side], 3), (402, [0.93 - 1e-9, (1 - (0.93 - 1e-9) ** 2) ** 0.5], 3), (403, [1e200, 0.0], 3), (404, [1e-150, 0.0], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"part": F.lit("x"), "node": F.lit(1), "n": F.lit(0)})
    got = embeddings.near_duplicates(table).collect()
    rows = [(a, [v if v is None else v / max(abs(w) for w in x) for v in x] if x and a in (403, 404) else [float("nan") if v is None else v for v in x] if x else x, k) for a, x, k in rows]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_a_group_of_near_copies_leaves_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 64)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    rows = [(k, (centre + rng.normal(scale=0.05, size=64)).tolist(), 0) for k in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.near_duplicates(table).collect()
    assert all(r.n_links == 399 and r.component_id == 0 for r in got)
    nodes = table.selectExpr("vec_id AS node", "1L AS part", "1L AS copies", "embedding AS v")
    assert embeddings.range_join(nodes, 0.93).count() < 400 * 60  # 79,800 pairs
