"""The data source: ranges of records, columns, boxes, commits and aborts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from silva.sources import clouds, format


@pytest.fixture(scope="module")
def points(spark):
    format.register(spark)
    return spark.range(5000).select((F.col("id") / 8).alias("x"), (-F.col("id") / 4).alias("y"), F.lit(2.5).alias("z"), (F.col("id") % 256).cast("int").alias("red"), F.lit(1).alias("green"), F.lit(2).alias("blue"), F.sqrt("id").alias("n_z"), F.lit("no").alias("text"))


@pytest.mark.parametrize("kind", ["ply", "las", "pcd"])
def test_round_trip_in_ranges(spark, tmp_path, points, kind):
    folder = str(tmp_path / "out")
    points.repartition(3).write.format("silva").option("kind", kind).option("rowsPerFile", 900).mode("append").save(folder)
    back = spark.read.format("silva").option("rowsPerPartition", 170).load(folder)
    assert back.rdd.getNumPartitions() > 25
    rows = back.orderBy("x").collect()
    assert len(rows) == 5000 and len({r.pid for r in rows}) == 5000
    assert np.allclose([r.x for r in rows], np.arange(5000) / 8, atol=0.00051 if kind == "las" else 0)
    if kind != "pcd":
        assert [r.red for r in rows] == [k % 256 for k in range(5000)] and np.allclose([r.n_z for r in rows], np.sqrt(np.arange(5000)))
    told = json.loads((tmp_path / "out" / format.INDEX).read_text())
    assert told["rows"] == 5000 and told["least"] == [0, -4999 / 4, 2.5] and told["largest"] == [4999 / 8, 0, 2.5]
    same = clouds.read_points(spark, f"{folder}/*.{kind}", kind=kind).orderBy("pid").collect()
    assert [r.pid for r in same] == sorted(r.pid for r in rows)
    assert not [f for f in (tmp_path / "out").iterdir() if f.is_dir()]


def test_columns_and_boxes(spark, tmp_path, points):
    folder = str(tmp_path / "out")
    points.repartitionByRange(5, "x").write.format("silva").option("kind", "las").mode("append").save(folder)
    back = spark.read.format("silva").option("columns", "x, red").load(folder)
    assert back.columns == ["pid", "x", "red"] and back.where("x > 100 AND x <= 120").count() == 160
    reader = format.PointReader(format._listed(folder), {}, ["pid", "x"])
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    assert len(list(reader.pushFilters([GreaterThan(("x",), 10.0), LessThanOrEqual(("x",), 20.0)]))) == 2
    assert len(reader.partitions()) == 1  # the other files' boxes lie elsewhere
    got = np.concatenate([b.column(1).to_numpy() for p in reader.partitions() for b in reader.read(p)])
    assert got.min() >= 10 and got.max() <= 20 and len(got) in (80, 81)
    assert spark.read.format("silva").load(folder).where("z > 99").count() == 0


def test_text_files_patterns_and_other_columns(spark, tmp_path, points):
    for k in range(2):
        (tmp_path / f"{k}.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nend_header\n1 2 3\n4 5 6\n")
    back = spark.read.format("silva").load(str(tmp_path / "*.ply"))
    assert sorted(map(tuple, back.collect())) == [(k * 2**40 + r, *v) for k in range(2) for r, v in enumerate([(1, 2, 3), (4, 5, 6)])]
    assert back.where("x = 4").select("pid").count() == 2
    with pytest.raises(Exception, match="no column label"):
        spark.read.format("silva").option("columns", "x,label").load(str(tmp_path / "0.ply")).collect()
    with pytest.raises(Exception, match="no point files"):
        spark.read.format("silva").load(str(tmp_path / "*.las")).collect()


def test_a_failed_job_leaves_nothing(spark, tmp_path, points):
    folder = tmp_path / "out"
    bad = points.repartition(4).withColumn("x", F.when(F.col("n_z") == 70, F.raise_error(F.lit("no more")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception):
        bad.write.format("silva").option("rowsPerFile", 100).mode("append").save(str(folder))
    assert not folder.exists() or list(folder.iterdir()) == []
    for _ in range(2):
        points.limit(10).write.format("silva").mode("overwrite").save(str(folder))
    assert spark.read.format("silva").load(str(folder)).count() == 10
    with pytest.raises(Exception, match="points lack z"):
        points.drop("z").write.format("silva").mode("append").save(str(folder))
