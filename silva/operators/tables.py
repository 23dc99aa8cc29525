"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode one is made where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = tempfile.mkdtemp(prefix="silva-checkpoint-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/silva-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(*stages: DataFrame) -> None:
    """Delete the files of tables made by :func:`stage`, once nothing reads them any more."""
    for df in stages:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """``df`` with ``name``, its place from 0 in the order of the columns, written once so that the numbers hold. Equal rows are numbered either way.

    Ranges of the order are sorted apart, and each begins after the rows of all before it, so no task meets all rows.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = sizes.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per range
    out = placed.join(F.broadcast(starts), "_part")
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def resumed(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], parameters: dict | None = None) -> DataFrame:
    """The table ``name`` of ``folder``: read back if it was finished there with the same parameters, else made and written with them."""
    path, said = f"{folder}/{name}", f"{folder}/{name}.parameters"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{said}/_SUCCESS")
    wanted = json.dumps(parameters or {}, sort_keys=True)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        if [r.value for r in spark.read.text(said).collect()] == [wanted]:
            return spark.read.parquet(path)
    make().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(said)  # last, as it tells that the table is whole
    return spark.read.parquet(path)
