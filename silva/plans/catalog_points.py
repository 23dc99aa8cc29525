"""More queries: covers of variable size, sampling and interpolation, labels of several classes, files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import table_functions
from ..operators import cluster, graph, regularize, sampling, sets, tables, voxel
from ..sources import format
from . import pipelines, views
from .catalog import D2, FILL, GROUND, KNN5, LIN, STEMS, TILES, _cell, _rounded, _tall, _with, query

SIZES = (
    "sized AS (SELECT *, (pid * 37 % 257) % 256 AS rel, (pid * 37 % 257) % 256 / 256::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE AS share FROM embed), "
    "reach AS (SELECT *, share * 0.1::DOUBLE AS patch, share * 0.1::DOUBLE + sqrt(share) * (0.12::DOUBLE - 0.1::DOUBLE) AS ball FROM sized WHERE rel > 0), "
    f"balls AS (SELECT a.pid AS src, b.pid AS dst, {D2} AS d2, a.patch FROM reach a JOIN embed b ON {D2} < a.ball * a.ball), "
    "able AS (SELECT pid, row_number() OVER (ORDER BY CASE WHEN rel <= 32 THEN 0 WHEN rel <= 128 THEN 1 ELSE 2 END, pid) AS n FROM reach WHERE pid IN (SELECT src FROM balls GROUP BY src HAVING count(*) >= 3)), "
    "near AS (SELECT dst, list(src) AS own FROM balls WHERE src <> dst AND d2 < patch * patch GROUP BY dst), "
    "g(n, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.n, CASE WHEN list_has_any(seeds, coalesce(own, []::BIGINT[])) THEN seeds ELSE list_append(seeds, s.pid) END FROM g JOIN able s ON s.n = g.n + 1 LEFT JOIN near ON near.dst = s.pid), "
    "seed AS (SELECT unnest(seeds) AS pid FROM g WHERE n = (SELECT max(n) FROM g))"
)


@query("variable_cover", f"{_with(SIZES)} SELECT dst AS pid, src AS center_pid, round(d2, 6) AS d2 FROM balls JOIN seed ON src = seed.pid JOIN able ON src = able.pid QUALIFY row_number() OVER (PARTITION BY dst ORDER BY balls.d2, able.n) = 1")
def _variable_cover(spark, d):
    p = views.embed(spark, d).withColumn("rel", F.col("pid") * 37 % 257 % 256)
    return _rounded(cluster.variable_cover(p, "rel", 0.05, 0.1, 0.12, 3, order="pid"), "d2")


@query("radius_capped", f"{_with()} SELECT src, dst, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM (SELECT a.pid AS src, b.pid AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM embed a JOIN embed b ON {D2} <= 0.15::DOUBLE * 0.15::DOUBLE) WHERE rank <= 8")
def _radius_capped(spark, d):
    p = views.embed(spark, d)
    return _rounded(sampling.radius_capped(p, p, 0.15, 8), "d2")


@query("interpolate_features", f"""{_with(KNN5)}, w AS (SELECT a.pid, b.pid AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM embed a JOIN embed b ON b.pid % 5 = 0)
    SELECT pid, round(sum(e.embedding[4]::DOUBLE / greatest(d2, 1e-16)) / sum(1 / greatest(d2, 1e-16)), 6) AS f0, round(sum(e.embedding[5]::DOUBLE / greatest(d2, 1e-16)) / sum(1 / greatest(d2, 1e-16)), 6) AS f1
    FROM w JOIN embeddings e ON e.vec_id = dst WHERE rank <= 3 GROUP BY pid""")
def _interpolate(spark, d):
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in (3, 4)]).alias("f"))
    p = views.embed(spark, d)
    found = sampling.interpolate(p, p.where("pid % 5 = 0").join(e, "pid"), "f", 3)
    return _rounded(found.select("pid", F.get("f", F.lit(0)).alias("f0"), F.get("f", F.lit(1)).alias("f1")), "f0", "f1")


@query("pool_largest", "SELECT label, place, round(max(v), 6) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS place FROM embeddings) GROUP BY label, place")
def _pool(spark, d):
    e = views.table(spark, d, "embeddings").select("label", "embedding")
    found = sampling.pool_largest(e, ["label"], "embedding").select("label", F.posexplode("embedding").alias("place", "v"))
    return found.select("label", F.col("place").cast("long").alias("place"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query("farthest_points")
def _farthest(spark, d):
    return sampling.farthest_points(views.embed(spark, d), 0.1, ["label"])


@query("label_expansion")
def _expansion(spark, d):
    p = views.embed(spark, d)
    costs = regularize.class_costs(p.select("pid", *[F.abs(a).alias(a) for a in "xyz"]), ["x", "y", "z"])
    return regularize.expansion(costs, graph.adjacency(p, 5, 0.5), 0.5, places=regularize.along_curve(p, 0.1))


@query("table_functions", f"{_with(LIN)} SELECT k AS key, n, round((e1 - (3 * m - e1 - e3)) / e1, 6) AS linearity FROM e")
def _table_functions(spark, d):
    table_functions.register(spark)
    views.embed(spark, d).createOrReplaceTempView("silva_embed")
    found = spark.sql("SELECT * FROM silva_linearity(TABLE(SELECT CAST(label AS BIGINT) AS label, x, y, z FROM silva_embed) PARTITION BY label)")
    return _rounded(found, "linearity")


@query("files_round_trip", f"{_with()} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CAST(label AS DOUBLE) AS label, CAST(pid AS DOUBLE) AS source FROM orders_ WHERE x > 10")
def _files(spark, d):
    """Points written and read back by the data source, in ranges of records, with a filter that reaches the reader."""
    format.register(spark)
    folder = tables.new_path(spark, "points")
    views.orders(spark, d).withColumnRenamed("pid", "source").write.format(format.NAME).option("kind", "ply").mode("append").save(folder)
    back = spark.read.format(format.NAME).option("rowsPerPartition", 4000).load(folder)
    return _rounded(back.where("x > 10").select("x", "y", "z", "label", "source"), "x", "y", "z")


@query("segment_branches")
def _into_branches(spark, d):
    p = views.embed(spark, d).withColumn("seg_id", F.col("label").cast("long"))
    return pipelines.into_branches(p.drop("label"), 0.1, 0.12, 3, 50, 0.2)


CLASSIFIED = (
    f"tall AS (SELECT pid, 10 * x AS x, 10 * y AS y, 10 * z AS z FROM embed), thin AS (SELECT * FROM tall QUALIFY row_number() OVER (PARTITION BY {_cell('x', '0.01::DOUBLE')}, {_cell('y', '0.01::DOUBLE')}, {_cell('z', '0.01::DOUBLE')} ORDER BY pid) = 1), "
    "mean AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM thin), cloud AS (SELECT pid, x - mx AS x, y - my AS y, z - mz AS z FROM thin, mean), "
    f"{TILES.replace('orders_', 'cloud')}, "
    "kept AS (SELECT *, round(avg(x) OVER w) AS lx, round(avg(y) OVER w) AS ly, round(avg(z) OVER w) AS lz FROM tiled JOIN cloud USING (pid) WINDOW w AS (PARTITION BY box_x, box_y, box_z) QUALIFY count(*) OVER w > 20), "
    "scored AS (SELECT row_number() OVER (ORDER BY box_x, box_y, box_z, pid) AS row, x, y, z, 0.5::DOUBLE + (x - lx) / 20::DOUBLE AS p0, 0.5::DOUBLE + (y - ly) / 20::DOUBLE AS p1, 0.5::DOUBLE + (z - lz) / 20::DOUBLE AS p2, 0.25::DOUBLE - ((x - lx) + (y - ly) + (z - lz)) / 40::DOUBLE AS p3 FROM kept), "
    f"near AS (SELECT a.pid, p0, p1, p2, p3, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.row) AS k FROM cloud a, scored b), "
    "voted AS (SELECT pid, median(p0) AS p0, median(p1) AS p1, median(p2) AS p2, median(p3) AS p3, bool_or(p3 > 0.5::DOUBLE) AS wood FROM near WHERE k <= 16 GROUP BY pid), "
    "back AS (SELECT pid, x + mx AS x, y + my AS y, z + mz AS z, CASE WHEN wood THEN 3 WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS label, p3 FROM cloud JOIN voted USING (pid), mean)"
)
BACK = GROUND.replace("orders_", "back").replace("2.0::DOUBLE", "0.5::DOUBLE").replace("label = 3", "label = 0")


def _linear():
    """A fixed linear model of the place within the tile."""
    return lambda rows: pd.DataFrame({"pTerrain": 0.5 + rows.x / 20, "pLeaf": 0.5 + rows.y / 20, "pCWD": 0.5 + rows.z / 20, "pWood": 0.25 - (rows.x + rows.y + rows.z) / 40})


@query("classify_scan", f"{_with(CLASSIFIED, BACK, FILL)} SELECT pid, CASE WHEN z - g <= 0.1::DOUBLE THEN 0 ELSE label END AS label, round(p3, 6) AS p_wood, round(z - g, 6) AS n_z FROM own LEFT JOIN terr USING (ix, iy)")
def _classify(spark, d):
    found = pipelines.classify(_tall(spark, d), load=_linear, p=pipelines.Scan(at_least=20))
    return _rounded(found.select("pid", "label", F.col("pWood").alias("p_wood"), "n_z"), "p_wood", "n_z")


@query("leaf_on_trees")
def _leaf_on(spark, d):
    p = views.embed(spark, d).withColumns({"n_z": F.col("z"), "label": F.when(F.col("pid") % 4 == 0, 1).otherwise(3)})
    trees, _, hulls = pipelines.separate_trees(p, STEMS)
    own = trees.select("clstr", "t_clstr", "is_tip").distinct()
    leaves = pipelines.attach_leaves(p.where("label = 1").select("pid", "x", "y", "z", "n_z"), hulls, own, 0.1, 10, 1.0, -1.0)
    return pipelines.with_leaves(trees, leaves)


EDGES = [1.0]
for _ in range(10):
    EDGES.append(1.1 * EDGES[-1])
BORDERED = (
    "box AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM orders_), "
    f"tried AS (SELECT *, ceil((hx - lx) / e) + 5 AS nx, ceil((hy - ly) / e) + 5 AS ny, ceil((hz - lz) / e) + 5 AS nz FROM box, (VALUES {', '.join(f'({e!r}::DOUBLE)' for e in EDGES)}) AS t(e)), "
    "grid AS (SELECT * FROM tried WHERE 8 * nx * ny * nz <= 100000 ORDER BY e LIMIT 1), "
    "cubes AS (SELECT pid, e, nx, ny, floor((x - lx) / e) + 3 AS cx, floor((y - ly) / e) + 3 AS cy, floor((z - lz) / e) + 3 AS cz FROM orders_, grid)"
)


@query("cubical_border", f"{_with(BORDERED)} SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CAST(cz AS BIGINT) AS cz, CAST(cx + (cy - 1) * nx + (cz - 1) * nx * ny AS BIGINT) AS cell, round(e, 9) AS edge, count(*) AS n FROM cubes GROUP BY ALL")
def _bordered(spark, d):
    cells = voxel.bordered_cubes(views.orders(spark, d), 1.0, 2, 1e5)
    return _rounded(cells.groupBy("cx", "cy", "cz", "cell", "edge").agg(F.count("*").alias("n")), "edge", places=9)


@query("group_lists", "SELECT l_returnflag, CAST(part AS BIGINT) AS part, len(k) AS n, array_to_string(k, ',') AS keys FROM (SELECT l_returnflag, part, list(l_orderkey ORDER BY l_orderkey) AS k FROM (SELECT l_returnflag, l_orderkey, floor((row_number() OVER (ORDER BY l_returnflag, l_orderkey) - 1) / 1000) AS part FROM lineitem) GROUP BY ALL)")
def _lists(spark, d):
    found = sets.lists(views.table(spark, d, "lineitem"), ["l_returnflag"], "l_orderkey", 1000)
    return found.select("l_returnflag", "part", F.size("l_orderkey").cast("long").alias("n"), F.array_join("l_orderkey", ",").alias("keys"))


@query("distinct_in_order", "SELECT l_partkey, row_number() OVER (ORDER BY first, l_partkey) - 1 AS place FROM (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY l_partkey)")
def _in_order(spark, d):
    return sets.distinct_in_order(views.table(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"])
