"""Named queries over the driver's tables, with their SQL oracles: one for each operator of the survey's inventory.

A query is a function of (spark, sf_dir); its SQL, where SQL expresses it, stands beside it. The SQL writes every
neighbour search as all pairs, so it shares no method with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import branches, cluster, graph, neighbors, regularize, shape, tables, terrain, voxel
from . import pipelines, views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_VIEWS = ", ".join(f"{name} AS ({sql})" for name, sql in views.SQL.items())


def _cell(c: str, size: str) -> str:
    return f"CAST(round(({c} - {c} % {size}) / {size}) - (CASE WHEN {c} % {size} < 0 THEN 1 ELSE 0 END) AS BIGINT)"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([_VIEWS, *ctes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- projections, boxes and voxels

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
VOX = f"vox AS (SELECT *, {_cell('x', '2.0::DOUBLE')} AS ix, {_cell('y', '2.0::DOUBLE')} AS iy, {_cell('z', '2.0::DOUBLE')} AS iz FROM orders_)"
KNN5 = f"near AS (SELECT src, dst, d2, rank FROM (SELECT a.pid AS src, b.pid AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM embed a JOIN embed b ON a.pid <> b.pid) WHERE rank <= 5)"
KNN10 = KNN5.replace("<= 5", "<= 10")


@query("bbox", f"{_with()} SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM line_")
def _bbox(spark, d):
    return voxel.bbox(views.line(spark, d))


@query("plot_centre", f"{_with()} SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM line_")
def _plot_centre(spark, d):
    return voxel.bbox(views.line(spark, d)).select(((F.col("x_min") + F.col("x_max")) / 2).alias("cx"), ((F.col("y_min") + F.col("y_max")) / 2).alias("cy"))


@query("global_shift", f"{_with()} SELECT pid, round(x - avg(x) OVER (), 6) AS x, round(y - avg(y) OVER (), 6) AS y, round(z - avg(z) OVER (), 6) AS z FROM orders_")
def _global_shift(spark, d):
    return _rounded(voxel.shift(views.orders(spark, d).drop("label")), "x", "y", "z").drop("shift_x", "shift_y", "shift_z")


@query("col_prune_rename", "SELECT o_orderkey AS pid, CAST(o_totalprice AS FLOAT) AS n_z FROM orders")
def _col_prune_rename(spark, d):
    return views.table(spark, d, "orders").withColumnRenamed("o_totalprice", "nz").withColumnRenamed("nz", "n_z").select(F.col("o_orderkey").alias("pid"), F.col("n_z").cast("float").alias("n_z"))


@query("slice_index", f"{_with()} SELECT pid, {_cell('z', '0.2::DOUBLE')} AS n_slice, {_cell('z', '0.2::DOUBLE')} * 0.2::DOUBLE AS slice FROM event_")
def _slice_index(spark, d):
    return views.event(spark, d).select("pid", expr.floor_index("z", 0.2).alias("n_slice"), expr.floor_origin("z", 0.2).alias("slice"))


@query("voxel_key", f"{_with(VOX)} SELECT pid, ix, iy, iz, ix * 2.0::DOUBLE AS xx, iy * 2.0::DOUBLE AS yy, iz * 2.0::DOUBLE AS zz FROM vox")
def _voxel_key(spark, d):
    return voxel.voxelise(views.orders(spark, d), 2.0).select("pid", "ix", "iy", "iz", "xx", "yy", "zz")


@query("voxel_downsample_first", f"{_with(VOX)} SELECT min(pid) AS pid, ix, iy, iz FROM vox GROUP BY ix, iy, iz")
def _downsample_first(spark, d):
    return voxel.downsample_first(views.orders(spark, d), 2.0).select("pid", "ix", "iy", "iz")


@query(
    "voxel_downsample_median",
    f"{_with(VOX, 'm AS (SELECT ix, iy, iz, median(x) AS mx, median(y) AS my, median(z) AS mz FROM vox GROUP BY ix, iy, iz)')} SELECT pid, ix, iy, iz FROM vox JOIN m USING (ix, iy, iz) QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 12), pid) = 1",
)
def _downsample_median(spark, d):
    return voxel.downsample_median(views.orders(spark, d), 2.0).select("pid", "ix", "iy", "iz")


CUBES = "box AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy FROM orders_), cubes AS (SELECT pid, CAST(floor((x - lx) / 3::DOUBLE) AS BIGINT) + 1 AS cx, CAST(floor((y - ly) / 3::DOUBLE) AS BIGINT) + 1 AS cy, CAST(floor((z - lz) / 3::DOUBLE) AS BIGINT) + 1 AS cz, CAST(floor((hx - lx) / 3::DOUBLE) AS BIGINT) + 1 AS nx, CAST(floor((hy - ly) / 3::DOUBLE) AS BIGINT) + 1 AS ny FROM orders_, box), keyed AS (SELECT *, cx + (cy - 1) * nx + (cz - 1) * nx * ny AS cell FROM cubes)"


@query("cubical_downsample", f"{_with(CUBES)} SELECT min(pid) AS pid, cell FROM keyed GROUP BY cell")
def _cubical_downsample(spark, d):
    return voxel.downsample_cubes(views.orders(spark, d), 3.0).select("pid", "cell")


@query("cubical_partition_counts", f"{_with(CUBES)} SELECT cell, cx, cy, cz, count(*) AS n FROM keyed GROUP BY cell, cx, cy, cz")
def _cubical_counts(spark, d):
    return voxel.cubes(views.orders(spark, d), 3.0).groupBy("cell", "cx", "cy", "cz").agg(F.count("*").alias("n"))


def _corners(a: str) -> str:
    return f"{a}c AS (SELECT i AS box_{a}, lo - 3 + 3 * i AS c FROM (SELECT floor(min({a})) AS lo, ceil(max({a})) AS hi FROM orders_), generate_series(0, 200) AS g(i) WHERE lo - 3 + 3 * i < hi + 3)"


TILES = f"{_corners('x')}, {_corners('y')}, {_corners('z')}, tiled AS (SELECT pid, box_x, box_y, box_z FROM orders_ JOIN xc ON x BETWEEN xc.c AND xc.c + 6 JOIN yc ON y BETWEEN yc.c AND yc.c + 6 JOIN zc ON z BETWEEN zc.c AND zc.c + 6)"


@query("tile_assign", f"{_with(TILES)} SELECT pid, CAST(box_x AS BIGINT) AS box_x, CAST(box_y AS BIGINT) AS box_y, CAST(box_z AS BIGINT) AS box_z FROM tiled")
def _tile_assign(spark, d):
    return voxel.tiles(views.orders(spark, d)).select("pid", "box_x", "box_y", "box_z")


@query("tile_min_points", f"{_with(TILES)} SELECT CAST(box_x AS BIGINT) AS box_x, CAST(box_y AS BIGINT) AS box_y, CAST(box_z AS BIGINT) AS box_z, count(*) AS n FROM tiled GROUP BY ALL HAVING count(*) > 100")
def _tile_min_points(spark, d):
    return voxel.large_tiles(voxel.tiles(views.orders(spark, d)), 100).withColumnRenamed("box_size", "n")


@query("tile_corners", f"{_with(_corners('x'), _corners('y'))} SELECT CAST(box_x AS BIGINT) AS box_x, CAST(box_y AS BIGINT) AS box_y FROM xc, yc")
def _tile_corners(spark, d):
    box = voxel.bbox(views.orders(spark, d))
    axis = {a: box.select(F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil((F.ceil(f"{a}_max") - F.floor(f"{a}_min") + 6) / 3) - 1).cast("long"))).alias(f"box_{a}")) for a in "xy"}
    return axis["x"].crossJoin(F.broadcast(axis["y"]))  # corners of one axis box_y those of the other: the answer itself


# --- filters, maps and unions


@query("crop_between", f"{_with()} SELECT pid, x, y, z FROM orders_ WHERE x BETWEEN 5 AND 20 AND y BETWEEN 2 AND 15 AND z BETWEEN 0 AND 9")
def _crop(spark, d):
    return views.orders(spark, d).where(F.col("x").between(5, 20) & F.col("y").between(2, 15) & F.col("z").between(0, 9)).select("pid", "x", "y", "z")


@query("label_filter", f"{_with()} SELECT pid, label FROM orders_ WHERE label = 3")
def _label_filter(spark, d):
    return views.orders(spark, d).where("label = 3").select("pid", "label")


@query("isin_semi", "SELECT o_orderkey AS pid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def _isin(spark, d):
    rich = views.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return views.table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("pid"))


@query("anti_join", "SELECT c_custkey AS pid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _anti(spark, d):
    return views.table(spark, d, "customer").join(views.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("pid"))


@query("nan_drop", f"{_with()} SELECT pid, sqrt(z - 5) AS v FROM orders_ WHERE z >= 5")
def _nan_drop(spark, d):
    return views.orders(spark, d).withColumn("v", F.sqrt(F.col("z") - 5)).where(~F.isnan("v")).select("pid", "v")


@query("deterministic_sample_size", f"{_with()} SELECT label, least(count(*), 100) AS n FROM orders_ GROUP BY label")
def _sample(spark, d):
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(1), "pid")))
    return views.orders(spark, d).withColumn("_n", order).where("_n <= 100").groupBy("label").agg(F.count("*").alias("n"))


@query("cluster_median", f"{_with()} SELECT label, round(median(x), 6) AS x, round(median(y), 6) AS y, round(median(z), 6) AS z FROM orders_ GROUP BY label")
def _cluster_median(spark, d):
    return views.orders(spark, d).groupBy("label").agg(*[F.round(F.median(a), 6).alias(a) for a in "xyz"])


@query("group_count_filter", "SELECT o_orderkey AS pid, n FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 12")
def _group_count(spark, d):
    sized = views.table(spark, d, "orders").withColumn("n", F.count("*").over(Window.partitionBy("o_custkey")))
    return sized.where("n > 12").select(F.col("o_orderkey").alias("pid"), "n")


@query("voxel_minmaxmedian", f"{_with(VOX)} SELECT ix, iy, iz, count(*) AS n, min(z) AS z_min, max(z) AS z_max, round(median(z), 6) AS z_median FROM vox GROUP BY ix, iy, iz")
def _minmaxmedian(spark, d):
    return voxel.voxelise(views.orders(spark, d), 2.0).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.round(F.median("z"), 6).alias("z_median"))


@query(
    "voxel_face_points",
    f"{_with(VOX, 'b AS (SELECT ix, iy, iz, min(x) AS x0, max(x) AS x1, median(x) AS xm, min(y) AS y0, max(y) AS y1, median(y) AS ym, min(z) AS z0, max(z) AS z1, median(z) AS zm FROM vox GROUP BY ix, iy, iz)')} SELECT ix, iy, iz, round(f[1], 9) AS x, round(f[2], 9) AS y, round(f[3], 9) AS z FROM (SELECT ix, iy, iz, unnest([[x0, ym, zm], [x1, ym, zm], [xm, y0, zm], [xm, y1, zm], [xm, ym, z0], [xm, ym, z1]]) AS f FROM b)",
)
def _face_points(spark, d):
    return _rounded(pipelines.face_points(voxel.voxelise(views.orders(spark, d), 2.0), ["ix", "iy", "iz"]), "x", "y", "z", places=9)


@query("best_path_per_cluster", "SELECT o_custkey AS clstr, o_totalprice AS distance, o_orderkey AS t_clstr FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def _best_path(spark, d):
    return graph.best_path(views.table(spark, d, "orders").select(F.col("o_custkey").alias("clstr"), F.col("o_totalprice").alias("distance"), F.col("o_orderkey").alias("t_clstr")))


@query("rank_by_radius", "SELECT s_suppkey AS t_clstr, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS tree FROM supplier")
def _rank(spark, d):
    return pipelines.number_trees(views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("t_clstr"), F.col("s_acctbal").alias("radius"))).select("t_clstr", "tree")


@query("label_offset_dense", "SELECT p_size, p_brand, CAST(dense_rank() OVER (ORDER BY p_size, p_brand) - 1 AS BIGINT) AS clstr FROM (SELECT DISTINCT p_size, p_brand FROM part)")
def _label_offset(spark, d):
    ids = views.table(spark, d, "part").select("p_size", "p_brand").distinct()
    return tables.numbered(ids, ["p_size", "p_brand"], "clstr")


@query("map_dict_left", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def _map_dict(spark, d):
    names = views.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return views.table(spark, d, "customer").join(names, "c_nationkey", "left").select("c_custkey", "n_name")


NULLABLE = "a AS (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS k FROM customer), b AS (SELECT CASE WHEN n_nationkey < 24 THEN n_nationkey END AS k, n_name FROM nation WHERE n_nationkey > 3)"


@query("join_right_nullsafe", f"{_with(NULLABLE)} SELECT a.c_custkey, b.n_name FROM a RIGHT JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _nullsafe(spark, d):
    a = views.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("k"))
    b = views.table(spark, d, "nation").where("n_nationkey > 3").select(F.when(F.col("n_nationkey") < 24, F.col("n_nationkey")).alias("j"), "n_name")
    return a.join(b, a.k.eqNullSafe(b.j), "right").select("c_custkey", "n_name")


@query("join_full_outer_grid", f"{_with()} SELECT CAST(coalesce(g.ix, h.ix) AS BIGINT) AS ix, n, m FROM (SELECT {_cell('x', '1.0::DOUBLE')} AS ix, count(*) AS n FROM orders_ WHERE label = 0 GROUP BY 1) g FULL JOIN (SELECT {_cell('x', '1.0::DOUBLE')} AS ix, count(*) AS m FROM orders_ WHERE label = 3 GROUP BY 1) h ON g.ix = h.ix")
def _full_outer(spark, d):
    cells = views.orders(spark, d).withColumn("ix", expr.floor_index("x", 1.0))
    return cells.where("label = 0").groupBy("ix").agg(F.count("*").alias("n")).join(cells.where("label = 3").groupBy("ix").agg(F.count("*").alias("m")), "ix", "full")


@query("union_missing_cols", f"{_with()} SELECT pid, label, NULL::DOUBLE AS z FROM embed UNION ALL SELECT pid, NULL AS label, z FROM event_")
def _union_missing(spark, d):
    return views.embed(spark, d).select("pid", "label").unionByName(views.event(spark, d).select("pid", "z"), allowMissingColumns=True)


@query("edge_symmetrize", f"{_with(KNN5)} SELECT src, dst FROM near UNION SELECT dst, src FROM near")
def _symmetrize(spark, d):
    p = views.embed(spark, d)
    return graph.symmetrise(neighbors.knn(p, p, 5))


@query("set_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _difference(spark, d):
    return views.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(views.table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _duplicates(spark, d):
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("first_of_key", f"{_with()} SELECT label, pid FROM orders_ QUALIFY row_number() OVER (PARTITION BY label ORDER BY x, pid) = 1")
def _first_of_key(spark, d):
    return terrain.first_of_key(views.orders(spark, d), ["label"], ["x", "pid"]).select("label", "pid")


@query("argmin_all_ties", "SELECT p_brand, p_partkey FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) = 1")
def _ties(spark, d):
    return views.table(spark, d, "part").withColumn("_r", F.rank().over(Window.partitionBy("p_brand").orderBy("p_size"))).where("_r = 1").select("p_brand", "p_partkey")


@query("threshold_cross", "SELECT CAST(t AS INTEGER) AS t, CAST(s AS INTEGER) AS s, count(*) FILTER (p_size >= t AND p_retailprice >= s) AS n FROM part, generate_series(0, 48, 12) AS a(t), generate_series(900, 1900, 250) AS b(s) GROUP BY t, s")
def _threshold_cross(spark, d):
    pairs = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(12))).alias("t")).withColumn("s", F.explode(F.sequence(F.lit(900), F.lit(1900), F.lit(250))))
    passed = (F.col("p_size") >= F.col("t")) & (F.col("p_retailprice") >= F.col("s"))
    return views.table(spark, d, "part").crossJoin(F.broadcast(pairs)).groupBy("t", "s").agg(F.count_if(passed).alias("n"))  # a fixed list of 25 pairs


@query("wood_vote_closed_form", "SELECT p_partkey, round(count(*) FILTER (p_size / 50::DOUBLE >= t / 100::DOUBLE AND p_retailprice >= s) / 273::DOUBLE, 6) AS p_wood FROM part, generate_series(70, 94, 2) AS a(t), generate_series(900, 1900, 50) AS b(s) GROUP BY p_partkey")
def _wood_vote(spark, d):
    p = expr.wood_vote(F.col("p_size") / 50.0, F.col("p_retailprice"), [i / 100 for i in range(70, 95, 2)], list(range(900, 1901, 50)))
    return views.table(spark, d, "part").select("p_partkey", F.round(p, 6).alias("p_wood"))


@query("diameter_class", f"SELECT p_partkey, {_cell('(2 * r)', '0.1::DOUBLE')} / 10::DOUBLE AS diameter_class FROM (SELECT p_partkey, p_size / 100::DOUBLE AS r FROM part)")
def _diameter(spark, d):
    return views.table(spark, d, "part").select("p_partkey", expr.diameter_class(F.col("p_size") / 100.0).alias("diameter_class"))


@query("argmax_label", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 0 WHEN l_tax >= l_quantity / 500 THEN 1 ELSE 2 END AS label FROM lineitem")
def _argmax(spark, d):
    scored = views.table(spark, d, "lineitem").withColumn("q", F.col("l_quantity") / 500)
    return scored.select("l_orderkey", "l_linenumber", "l_quantity", expr.argmax(["l_discount", "l_tax", "q"]).alias("label"))


@query("softmax_scores", "SELECT p_partkey, round(exp(a) / (exp(a) + exp(b)), 6) AS p0, round(exp(b) / (exp(a) + exp(b)), 6) AS p1 FROM (SELECT p_partkey, p_size / 10::DOUBLE AS a, p_retailprice / 1000::DOUBLE AS b FROM part)")
def _softmax(spark, d):
    p = expr.softmax(F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0))
    return views.table(spark, d, "part").select("p_partkey", p.alias("p")).select("p_partkey", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.round(F.get("p", F.lit(1)), 6).alias("p1"))


# --- neighbours


@query("knn_self", f"{_with(KNN5)} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(d2, 9) AS d2 FROM near")
def _knn_self(spark, d):
    p = views.embed(spark, d)
    return _rounded(neighbors.knn(p, p, 5), "d2", places=9)


@query("knn_incl_self", f"{_with(KNN5.replace('ON a.pid <> b.pid', 'ON TRUE'))} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(d2, 9) AS d2 FROM near")
def _knn_incl(spark, d):
    p = views.embed(spark, d)
    return _rounded(neighbors.knn(p, p, 5, with_self=True), "d2", places=9)


CROSS = f"near AS (SELECT * FROM (SELECT a.pid AS src, b.pid AS dst, b.x AS x, b.y AS y, b.z AS z, b.label AS label, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM embed a JOIN embed b ON a.label = 3 AND b.label <> 3) WHERE rank <= 16)"


@query("knn_cross_vote", f"{_with(CROSS, 'v AS (SELECT src AS pid, median(x) AS p0, median(y) AS p1, median(z) AS p2, bool_or(z > 0.25) AS w FROM near GROUP BY src)')} SELECT pid, CASE WHEN w THEN 2 WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM v")
def _cross_vote(spark, d):
    p = views.embed(spark, d)
    classified = p.where("label <> 3").select("pid", "x", "y", "z", F.col("x").alias("p0"), F.col("y").alias("p1"), F.col("z").alias("p2"))
    return neighbors.vote(p.where("label = 3"), classified, ["p0", "p1", "p2"], 16, "p2", 0.25).select("pid", "label")


@query("nn_label_transfer", f"{_with(CROSS)} SELECT src AS pid, label FROM near WHERE rank = 1")
def _label_transfer(spark, d):
    p = views.embed(spark, d)
    known = p.where("label <> 3")
    near = neighbors.knn(p.where("label = 3"), known, 1, same=False)
    return near.join(known.select(F.col("pid").alias("dst"), "label"), "dst").select(F.col("src").alias("pid"), "label")


NEAR = f"close AS (SELECT a.pid AS src, b.pid AS dst, {D2} AS d2 FROM embed a JOIN embed b ON {D2} < 0.1::DOUBLE * 0.1::DOUBLE)"


@query("radius_count", f"{_with(NEAR)} SELECT src AS pid, count(*) AS n FROM close GROUP BY src")
def _radius_count(spark, d):
    p = views.embed(spark, d)
    return neighbors.radius_join(p, p, 0.1, with_self=True, dealt=True).groupBy(F.col("src").alias("pid")).agg(F.count("*").alias("n"))


@query("radius_self_join", f"{_with(NEAR)} SELECT src, dst, round(d2, 9) AS d2 FROM close WHERE src <> dst")
def _radius_join(spark, d):
    p = views.embed(spark, d)
    return _rounded(neighbors.radius_join(p, p, 0.1, dealt=True), "d2", places=9)


LAYERS = "tall AS (SELECT pid, 10 * x AS x, 10 * y AS y, 10 * z AS z FROM embed), layered AS (SELECT *, CAST(floor(z - lo) + 1 AS BIGINT) AS layer FROM (SELECT *, min(z) OVER () AS lo, max(z) OVER () AS hi FROM tall) WHERE floor(z - lo) + 1 <= ceil(hi - lo))"


def _tall(spark, d):
    return views.embed(spark, d).select("pid", *[(10 * F.col(a)).alias(a) for a in "xyz"])


@query("knn_outlier_filter", f"{_with(LAYERS, f'far AS (SELECT pid, sqrt(d2) AS far FROM (SELECT a.pid, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM tall a, tall b) WHERE rank = 10)')} SELECT pid, layer FROM layered JOIN far USING (pid) QUALIFY far < avg(far) OVER (PARTITION BY layer) + 1.5 * stddev_samp(far) OVER (PARTITION BY layer)")
def _knn_outliers(spark, d):
    return neighbors.knn_outliers(_tall(spark, d)).select("pid", "layer")


@query("density_outlier_filter", f"{_with(LAYERS, f'den AS (SELECT a.pid, count(*) AS near FROM tall a JOIN tall b ON {D2} < 1 GROUP BY a.pid)')} SELECT pid, layer, near FROM layered JOIN den USING (pid) QUALIFY near > avg(near) OVER (PARTITION BY layer) - 1.0 * stddev_samp(near) OVER (PARTITION BY layer)")
def _density_outliers(spark, d):
    return neighbors.density_outliers(_tall(spark, d), 1.0, 1.0).select("pid", "layer", "near")


@query("quantile_noise_cut", f"{_with(KNN10, 'nn AS (SELECT src AS pid, avg(sqrt(d2)) AS nn FROM near WHERE rank >= 2 GROUP BY src)')} SELECT pid, round(nn, 6) AS nn FROM nn WHERE nn < (SELECT quantile_cont(nn, 0.9) FROM nn)")
def _quantile_cut(spark, d):
    return _rounded(neighbors.quantile_cut(views.embed(spark, d)).select("pid", "nn"), "nn")


ROWS = "pruned AS (SELECT src, dst, sqrt(d2) AS d, rank FROM near QUALIFY sqrt(d2) <= avg(sqrt(d2)) OVER (PARTITION BY src) + stddev_samp(sqrt(d2)) OVER (PARTITION BY src))"


@query("row_prune_edges", f"{_with(KNN5, ROWS)} SELECT src, dst, round(d, 6) AS d FROM pruned")
def _row_prune(spark, d):
    p = views.embed(spark, d)
    return _rounded(neighbors.prune_rows(neighbors.knn(p, p, 5).withColumn("d", F.sqrt("d2"))).select("src", "dst", "d"), "d")


GLOBAL = "cut AS (SELECT avg(sqrt(d2)) + stddev_samp(sqrt(d2)) AS c FROM near WHERE rank = 5), global AS (SELECT src, dst, sqrt(d2) AS d, rank FROM near, cut WHERE sqrt(d2) <= c)"


@query("global_prune_edges", f"{_with(KNN5, GLOBAL)} SELECT src, dst, round(d, 6) AS d FROM global")
def _global_prune(spark, d):
    p = views.embed(spark, d)
    return _rounded(neighbors.prune_all(neighbors.knn(p, p, 5).withColumn("d", F.sqrt("d2")), 5).select("src", "dst", "d"), "d")


@query("edge_weight_modes", f"{_with(KNN5, 'm AS (SELECT avg(sqrt(d2)) AS m FROM near)')} SELECT src, dst, 1::DOUBLE AS w0, round(1 / (sqrt(d2) / m + 0.5::DOUBLE), 6) AS w1, round(exp(sqrt(d2) / (m * (-2)::DOUBLE)), 6) AS w2 FROM near, m")
def _weights(spark, d):
    p = views.embed(spark, d)
    edges = neighbors.knn(p, p, 5).withColumn("d", F.sqrt("d2"))
    both = edges.crossJoin(F.broadcast(edges.agg(F.avg("d").alias("m"))))
    return both.select("src", "dst", expr.edge_weight(F.col("d"), F.col("m"), 0).alias("w0"), F.round(expr.edge_weight(F.col("d"), F.col("m"), 0.5), 6).alias("w1"), F.round(expr.edge_weight(F.col("d"), F.col("m"), -2), 6).alias("w2"))


ADJ = f"{ROWS}, m AS (SELECT avg(sqrt(d2)) AS m FROM near), adj AS (SELECT src, dst, 1 / (d / m + 0.5::DOUBLE) AS w FROM pruned, m)"


@query("adjacency_graph", f"{_with(KNN5, ADJ)} SELECT src, dst, round(max(w), 6) AS w FROM (SELECT src, dst, w FROM adj UNION ALL SELECT dst, src, w FROM adj) GROUP BY src, dst")
def _adjacency(spark, d):
    return _rounded(graph.adjacency(views.embed(spark, d), 5, 0.5), "w")


# --- graphs and clusters


def _reach(pairs: str) -> str:
    return f"lnk AS ({pairs}), two AS (SELECT src AS a, dst AS b FROM lnk UNION SELECT dst, src FROM lnk), reach(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a), comp AS (SELECT pid, least(pid, coalesce(min(b), pid)) AS c FROM embed LEFT JOIN reach ON pid = a GROUP BY pid)"


GROW = _reach("SELECT p.src, p.dst FROM (SELECT src, dst, d FROM global QUALIFY d <= avg(d) OVER (PARTITION BY src) + coalesce(stddev_samp(d) OVER (PARTITION BY src), 0)) p JOIN embed a ON a.pid = src JOIN embed b ON b.pid = dst WHERE abs(abs(a.z) - abs(b.z)) <= 0.02")


@query("region_growing", f"{_with(KNN5, GLOBAL, GROW)} SELECT pid, c AS region FROM comp")
def _region_growing(spark, d):
    return graph.region_growing(views.embed(spark, d), "z", 5, 0.02)


@query("connected_components", f"{_with(KNN5, _reach('SELECT src, dst FROM near WHERE rank <= 3 AND d2 <= 0.0025'))} SELECT pid, c AS component FROM comp")
def _components(spark, d):
    p = views.embed(spark, d)
    return graph.connected_components(neighbors.knn(p, p, 3).where("d2 <= 0.0025"), p)


CL = "cl AS (SELECT pid, x, y, z, pid % 60 AS clstr FROM embed)"
CE = f"ce AS (SELECT a.clstr AS source, b.clstr AS target, min(sqrt(d2)) AS length FROM near JOIN cl a ON a.pid = src JOIN cl b ON b.pid = dst WHERE a.clstr <> b.clstr GROUP BY 1, 2 HAVING min(sqrt(d2)) <= 0.06)"
UND = "und AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max_by(length, source) AS length FROM ce GROUP BY 1, 2)"
PATHS = "roads AS (SELECT a AS u, b AS v, length FROM und UNION ALL SELECT b, a, length FROM und), walk(clstr, distance, t_clstr, hops) AS (SELECT DISTINCT source, 0::DOUBLE, source, 0 FROM ce WHERE source < 3 UNION SELECT v, nd, nt, nh FROM (SELECT v, w.distance + r.length AS nd, w.t_clstr AS nt, w.hops + 1 AS nh FROM walk w JOIN roads r ON w.clstr = r.u WHERE w.hops < 25) QUALIFY row_number() OVER (PARTITION BY v, nt ORDER BY nd) = 1), best AS (SELECT clstr, min(distance) AS distance, arg_min(t_clstr, distance) AS t_clstr FROM walk GROUP BY clstr)"


def _clusters(spark, d):
    p = views.embed(spark, d).withColumn("clstr", F.col("pid") % 60)
    return p, graph.cluster_edges(p, 5, 0.06)


@query("cluster_edges_min", f"{_with(KNN5, CL, CE)} SELECT source, target, round(length, 6) AS length FROM ce")
def _cluster_edges(spark, d):
    return _rounded(_clusters(spark, d)[1], "length")


@query("undirected_dedupe", f"{_with(KNN5, CL, CE, UND)} SELECT a, b, round(length, 6) AS length FROM und")
def _undirected(spark, d):
    return _rounded(graph.undirected(_clusters(spark, d)[1]), "length")


def _paths(spark, d):
    return graph.shortest_paths(_clusters(spark, d)[1], spark.range(3).withColumnRenamed("id", "clstr"))


@query("shortest_paths", f"{_with(KNN5, CL, CE, UND, PATHS)} SELECT clstr, round(distance, 6) AS distance, t_clstr FROM best")
def _shortest(spark, d):
    return _rounded(_paths(spark, d).select("clstr", "distance", "t_clstr"), "distance")


@query("path_tips", f"{_with(KNN5, CL, CE, UND, PATHS)} SELECT clstr FROM best WHERE clstr NOT IN (SELECT u FROM roads JOIN best p ON p.clstr = u JOIN best q ON q.clstr = v WHERE abs(p.distance + length - q.distance) < 1e-12)")
def _tips(spark, d):
    return _paths(spark, d).where("is_tip").select("clstr")


def _dbscan_sql(d2: str, eps: str, at_least: int, match: str = "TRUE") -> str:
    core = f"nb AS (SELECT a.pid AS src, b.pid AS dst FROM cloud a JOIN cloud b ON {match} AND {d2} <= {eps} * {eps}), core AS (SELECT src AS pid FROM nb GROUP BY src HAVING count(*) >= {at_least})"
    links = _reach("SELECT src, dst FROM nb WHERE src IN (SELECT pid FROM core) AND dst IN (SELECT pid FROM core)")
    return f"{core}, {links}, db AS (SELECT dst AS pid, min(c) AS clstr FROM nb JOIN comp ON nb.src = comp.pid WHERE src IN (SELECT pid FROM core) GROUP BY dst)"


@query("dbscan_2d", f"{_with('cloud AS (SELECT * FROM embed)', _dbscan_sql('(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)', '0.03::DOUBLE', 8))} SELECT pid, clstr FROM db")
def _dbscan(spark, d):
    return cluster.dbscan(views.embed(spark, d), 0.03, 8, flat=True)


@query("slice_cluster", f"{_with('cloud AS (SELECT *, label AS n_slice FROM embed WHERE label IN (SELECT label FROM embed GROUP BY label HAVING count(*) > 100))', _dbscan_sql(D2, '0.08::DOUBLE', 6, 'a.n_slice = b.n_slice'))} SELECT e.pid, CAST(coalesce(r.k, -1) AS BIGINT) AS clstr FROM embed e LEFT JOIN (SELECT pid, dense_rank() OVER (ORDER BY n_slice, clstr) - 1 AS k FROM db JOIN cloud USING (pid)) r ON e.pid = r.pid")
def _slice_cluster(spark, d):
    return cluster.slice_clusters(views.embed(spark, d).withColumn("n_slice", F.col("label")), 0.08, 6, 100).select("pid", "clstr")


# --- shapes, terrain, smoothing

LIN = "mid AS (SELECT label AS k, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM embed GROUP BY 1), cov AS (SELECT label AS k, n, sum((x - mx) * (x - mx)) / (n - 1) AS xx, sum((y - my) * (y - my)) / (n - 1) AS yy, sum((z - mz) * (z - mz)) / (n - 1) AS zz, sum((x - mx) * (y - my)) / (n - 1) AS xy, sum((x - mx) * (z - mz)) / (n - 1) AS xz, sum((y - my) * (z - mz)) / (n - 1) AS yz FROM embed JOIN mid ON label = k GROUP BY label, n), q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM cov), p AS (SELECT *, sqrt(((xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q), r AS (SELECT *, ((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * p * p * p) AS h FROM p), e AS (SELECT k, n, m + 2 * p * cos(acos(h) / 3) AS e1, m + 2 * p * cos(acos(h) / 3 + 2 * pi() / 3) AS e3, m FROM r)"


@query("linearity", f"{_with(LIN)} SELECT k AS label, n, round((e1 - (3 * m - e1 - e3)) / e1, 6) AS linearity FROM e")
def _linearity(spark, d):
    return _rounded(shape.linearity(views.embed(spark, d), ["label"]), "linearity")


@query("unary_potentials", "WITH r AS (SELECT p_partkey AS pid, 2 * (1 - (1 - p)) * (1 - (1 - p)) AS r0, 2 * (1 - p) * (1 - p) AS r1 FROM (SELECT p_partkey, p_size / 50::DOUBLE AS p FROM part)), s AS (SELECT pid, r0 - least(r0, r1) AS s0, r1 - least(r0, r1) AS s1 FROM r), m AS (SELECT sum(s0 + s1) / (2 * count(*)) AS m FROM s) SELECT pid, round(s0 / m, 6) AS u0, round(s1 / m, 6) AS u1 FROM s, m")
def _unary(spark, d):
    return _rounded(regularize.unary(views.table(spark, d, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") / 50.0).alias("p_wood"))), "u0", "u1")


@query("branch_rules", "SELECT p_partkey AS comp_id, CASE WHEN (b = c AND NOT g) OR (b = 1 AND c <= 2 AND NOT g) OR (b / 50::DOUBLE < 0.05 AND 2 * b >= c AND NOT g) OR (c <= 3 AND NOT g) OR b / 50::DOUBLE >= 0.7 OR c >= 0.7 * s THEN 0 ELSE 1 END AS class FROM (SELECT p_partkey, p_size AS b, p_partkey % 60 AS c, CAST(floor(p_retailprice / 20) AS BIGINT) AS s, p_partkey % 3 = 0 AS g FROM part)")
def _branch_rules(spark, d):
    part = views.table(spark, d, "part")
    kind, _ = shape.branch_class(F.col("p_size"), F.col("p_partkey") % 60, F.lit(50.0), F.floor(F.col("p_retailprice") / 20), F.col("p_partkey") % 3 == 0)
    return part.select(F.col("p_partkey").alias("comp_id"), kind.alias("class"))


GROUND = f"own AS (SELECT *, {_cell('x', '2.0::DOUBLE')} AS ix, {_cell('y', '2.0::DOUBLE')} AS iy FROM orders_), gm AS (SELECT ix, iy, median(z) AS g FROM own WHERE label = 3 GROUP BY ix, iy), filled AS (SELECT DISTINCT ix, iy, g FROM own JOIN gm USING (ix, iy) WHERE label = 3 AND z = g)"
FILL = "ext AS (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM own), grid AS (SELECT i AS ix, j AS iy FROM ext, generate_series(x0, x1) AS a(i), generate_series(y0, y1) AS b(j)), gap AS (SELECT greatest(1, max(c)) AS h FROM (SELECT grid.ix, grid.iy, min(greatest(abs(grid.ix - f.ix), abs(grid.iy - f.iy))) AS c FROM grid, filled f GROUP BY 1, 2)), refl AS (SELECT grid.ix, grid.iy, CASE WHEN grid.ix + dx < x0 THEN 2 * x0 - 1 - grid.ix - dx WHEN grid.ix + dx > x1 THEN 2 * x1 + 1 - grid.ix - dx ELSE grid.ix + dx END AS sx, CASE WHEN grid.iy + dy < y0 THEN 2 * y0 - 1 - grid.iy - dy WHEN grid.iy + dy > y1 THEN 2 * y1 + 1 - grid.iy - dy ELSE grid.iy + dy END AS sy FROM grid, ext, gap, generate_series(-h, h) AS a(dx), generate_series(-h, h) AS b(dy)), terr AS (SELECT refl.ix, refl.iy, median(g) AS g FROM refl JOIN filled f ON f.ix = sx AND f.iy = sy GROUP BY 1, 2)"


@query("terrain_cell_median", f"{_with(GROUND)} SELECT ix, iy, round(g, 6) AS ground FROM filled")
def _terrain_cells(spark, d):
    return _rounded(terrain.ground_cells(views.orders(spark, d), F.col("label") == 3, 2.0), "ground")


@query("terrain_normalized_height", f"{_with(GROUND, FILL)} SELECT pid, round(z - g, 6) AS n_z FROM own JOIN terr USING (ix, iy)")
def _terrain(spark, d):
    return _rounded(terrain.normalise(views.orders(spark, d), F.col("label") == 3, 2.0).select("pid", "n_z"), "n_z")


@query("ground_relabel", f"{_with()} SELECT pid, CASE WHEN z <= 0.5 THEN 0 ELSE label END AS label FROM orders_")
def _relabel(spark, d):
    return terrain.relabel_ground(views.orders(spark, d).withColumn("n_z", F.col("z")), 0, 0.5).select("pid", "label")


NORMALS = "own AS (SELECT src, x, y, z FROM (SELECT a.pid AS src, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.pid) AS k FROM embed a, embed b) WHERE k <= 10), mid AS (SELECT src, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM own GROUP BY src), cov AS (SELECT src, sum((x - mx) * (x - mx)) / 9 AS xx, sum((y - my) * (y - my)) / 9 AS yy, sum((z - mz) * (z - mz)) / 9 AS zz, sum((x - mx) * (y - my)) / 9 AS xy, sum((x - mx) * (z - mz)) / 9 AS xz, sum((y - my) * (z - mz)) / 9 AS yz FROM own JOIN mid USING (src) GROUP BY src), q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM cov), p AS (SELECT *, sqrt(((xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q), r AS (SELECT *, ((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * p * p * p) AS h FROM p), e AS (SELECT *, m + 2 * p * cos(acos(h) / 3 + 2 * pi() / 3) AS l FROM r), v AS (SELECT src, xy * yz - xz * (yy - l) AS a, xz * xy - (xx - l) * yz AS b, (xx - l) * (yy - l) - xy * xy AS c FROM e)"


@query("normals", f"{_with(NORMALS)} SELECT src AS pid, round(abs(c) / sqrt(a * a + b * b + c * c), 4) AS nz FROM v")
def _normals(spark, d):
    return _rounded(shape.normals(views.embed(spark, d)), "nz", places=4)


COVER = "ball AS (SELECT a.pid AS src, b.pid AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM embed a, embed b), able AS (SELECT src AS pid, row_number() OVER (ORDER BY src) AS n FROM ball WHERE d2 < 0.12::DOUBLE * 0.12::DOUBLE GROUP BY src HAVING count(*) >= 3), near AS (SELECT src, list(dst) AS own FROM ball WHERE src <> dst AND d2 < 0.1::DOUBLE * 0.1::DOUBLE GROUP BY src), g(n, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.n, CASE WHEN list_has_any(seeds, coalesce(own, []::BIGINT[])) THEN seeds ELSE list_append(seeds, s.pid) END FROM g JOIN able s ON s.n = g.n + 1 LEFT JOIN near ON near.src = s.pid), seed AS (SELECT unnest(seeds) AS pid FROM g WHERE n = (SELECT max(n) FROM g)), cover AS (SELECT dst AS pid, src AS center_pid, d2 FROM ball JOIN seed ON src = seed.pid WHERE d2 < 0.12::DOUBLE * 0.12::DOUBLE QUALIFY row_number() OVER (PARTITION BY dst ORDER BY d2, src) = 1)"


@query("cover_sets", f"{_with(COVER)} SELECT pid, center_pid, round(d2, 6) AS d2 FROM cover")
def _cover_sets(spark, d):
    return _rounded(cluster.cover_sets(views.embed(spark, d), 0.1, 0.12, 3, order="pid"), "d2")


@query("cover_neighbours", f"{_with(COVER, 'touch AS (SELECT DISTINCT src AS a, center_pid AS b FROM ball JOIN (SELECT DISTINCT center_pid AS s FROM cover) ON src = s JOIN cover ON cover.pid = dst WHERE ball.d2 < 0.12::DOUBLE * 0.12::DOUBLE AND src <> center_pid)')} SELECT a AS set_id, b AS nbr_id FROM touch UNION SELECT b, a FROM touch")
def _cover_neighbours(spark, d):
    p = views.embed(spark, d)
    return cluster.cover_neighbours(p, cluster.cover_sets(p, 0.1, 0.12, 3, order="pid"), 0.12)


@query("radius_by_row", f"{_with()} SELECT a.pid AS src, b.pid AS dst, round({D2}, 6) AS d2 FROM (SELECT *, 0.02::DOUBLE + (pid % 5) / 50::DOUBLE AS r FROM embed) a JOIN embed b ON {D2} < a.r * a.r")
def _radius_by_row(spark, d):
    p = views.embed(spark, d)
    return _rounded(neighbors.radius_join_by_row(p.withColumn("r", 0.02 + (F.col("pid") % 5) / 50.0), p, "r"), "d2")


@query("stem_acceptance", "SELECT p_partkey AS clstr, (p_size / 500::DOUBLE > 0.025 AND p_retailprice > 1200 AND p_partkey % 40 / 100::DOUBLE <= 0.15) AS accepted FROM part")
def _stem_acceptance(spark, d):
    part = views.table(spark, d, "part").select(F.col("p_partkey").alias("clstr"), (F.col("p_size") / 500.0).alias("radius"), F.col("p_retailprice").alias("cnt"), (F.col("p_partkey") % 40 / 100.0).alias("cv"))
    return part.select("clstr", shape.is_stem(0.025, 1200, 0.15).alias("accepted"))


@query("convex_hull")
def _hull(spark, d):
    return shape.convex_hulls(views.embed(spark, d), "label")


@query("cylinder_fit")
def _cylinders(spark, d):
    return shape.fit_cylinders(views.embed(spark, d), "label", 10)


@query("label_smoothing")
def _smoothing(spark, d):
    p = views.embed(spark, d)
    return regularize.smooth(regularize.unary(p.select("pid", F.abs("x").alias("p_wood"))), graph.adjacency(p, 5, 0.5), 0.5)


@query("wood_leaf_pipeline")
def _wood_leaf(spark, d):
    return pipelines.wood_leaf(views.embed(spark, d).select("pid", "x", "y", "z"))


STEMS = pipelines.Stems(slice_height=0.05, eps=0.12, at_least=4, more_than=20, k=20, longest=0.3, stem_height=0.0, stem_thickness=0.05, stem_eps=0.1, stem_at_least=5, stem_radius=0.001, stem_points=5, stem_cv=10.0)


def _forest(spark, d):
    return views.embed(spark, d).withColumns({"n_z": F.col("z"), "label": F.lit(3)})


@query("find_stems")
def _find_stems(spark, d):
    return pipelines.find_stems(pipelines.wood_clusters(_forest(spark, d), STEMS), STEMS)


@query("separate_trees_pipeline")
def _separate(spark, d):
    return pipelines.separate_trees(_forest(spark, d), STEMS)[0]


@query("split_branches")
def _split_branches(spark, d):
    p = views.embed(spark, d).withColumn("seg_id", F.col("label").cast("long"))
    return branches.split_branches(p.drop("label"), 0.1, 0.12, more_than=50, height=0.2)


@query("filter_pipeline")
def _filtered(spark, d):
    return pipelines.filtered(views.embed(spark, d), radius=0.05, sets=3, size=0.02)


from . import catalog_points  # noqa: E402, F401  more queries, registered by import
