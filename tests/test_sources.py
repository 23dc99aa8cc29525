"""Point-cloud files: hand-made bytes in, round trips out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silva.sources import clouds

POINTS = [(1.5, -2.0, 0.25, 7), (0.0, 0.0, 0.0, 8), (100.125, 3.5, -9.0, 9)]


def _rows(df):
    return [tuple(r) for r in df.orderBy("pid").collect()]


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian"])
def test_ply_bytes(spark, tmp_path, kind):
    head = f"ply\nformat {kind} 1.0\ncomment a\nelement vertex 3\nproperty double x\nproperty float y\nproperty float64 z\nproperty uchar label\nend_header\n"
    body = "".join("%f %f %f %d\n" % p for p in POINTS).encode() if kind == "ascii" else np.array(POINTS, dtype="<f8,<f4,<f8,u1").tobytes()
    (tmp_path / "a.ply").write_bytes(head.encode() + body)
    path = str(tmp_path / "a.ply")
    assert clouds.column_names(spark, path) == ["x", "y", "z", "label"]
    assert _rows(clouds.read_points(spark, path, ["label"])) == [(i, *map(float, p)) for i, p in enumerate(POINTS)]


@pytest.mark.parametrize("kind", ["ascii", "binary"])
def test_pcd_bytes(spark, tmp_path, kind):
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 3\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 3\nDATA {kind}\n"
    body = "".join("%f %f %f\n" % p[:3] for p in POINTS).encode() if kind == "ascii" else np.array([p[:3] for p in POINTS], dtype="<f4").tobytes()
    (tmp_path / "a.pcd").write_bytes(head.encode() + body)
    assert _rows(clouds.read_points(spark, str(tmp_path / "a.pcd"))) == [(i, *p[:3]) for i, p in enumerate(POINTS)]


@pytest.mark.parametrize("kind", ["ply", "las"])
def test_round_trip(spark, tmp_path, kind):
    points = spark.range(1000).select((F.col("id") / 8).alias("x"), (-F.col("id") / 4).alias("y"), F.lit(2.5).alias("z"), (F.col("id") % 256).cast("int").alias("red"), F.lit(1).alias("green"), F.lit(2).alias("blue"), F.sqrt("id").alias("n_z"), F.lit("no").alias("text"))
    files = clouds.write_points(points.repartition(3), str(tmp_path / "out"), kind, rows_per_file=300)
    assert len(files) == 6 and len(list((tmp_path / "out").iterdir())) == 6
    back = clouds.read_points(spark, str(tmp_path / f"out/*.{kind}"), ["red", "green", "blue", "n_z"], kind)
    got = np.array(back.drop("pid").orderBy("x").collect())
    want = np.array(points.drop("text").orderBy("x").collect()).astype(float)
    assert np.allclose(got[:, :3], want[:, :3], atol=0.00051 if kind == "las" else 0) and np.array_equal(got[:, 3:], want[:, 3:])
    assert back.select("pid").distinct().count() == 1000
    assert "text" not in clouds.column_names(spark, files[0])


def test_pcd_and_csv_out(spark, tmp_path):
    points = spark.createDataFrame([p[:3] for p in POINTS], "x double, y double, z double").coalesce(1)
    clouds.write_points(points, str(tmp_path / "p"), "pcd")
    assert sorted(r[1:] for r in _rows(clouds.read_points(spark, str(tmp_path / "p/*.pcd")))) == sorted(p[:3] for p in POINTS)
    clouds.write_points(points, str(tmp_path / "c"), "csv")
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["1.5 -2.0 0.25", "0.0 0.0 0.0", "100.125 3.5 -9.0"]


def test_refused(spark, tmp_path):
    for content in (b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nelement face 1\nproperty list uchar int v\nend_header\n", b"ply\nformat binary_big_endian 1.0\nelement vertex 0\nproperty float x\nend_header\n"):
        with pytest.raises(ValueError):
            clouds.ply_layout(content)
    with pytest.raises(ValueError):
        clouds.pcd_layout(b"FIELDS x y z\nWIDTH 1\nDATA binary_compressed\n")
    with pytest.raises(ValueError):
        clouds.read_points(spark, str(tmp_path / "a.xyz"))
    empty = spark.createDataFrame([], "x double, y double, z double")
    assert clouds.write_points(empty, str(tmp_path / "e"), "ply") == []
