"""The shared column expressions as temporary SQL functions, which Spark inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_INDEX = "CAST(round((x - x % size) / size) - CASE WHEN x % size < 0 THEN 1 ELSE 0 END AS BIGINT)"
NAMES = {
    "silva_floor_index(x DOUBLE, size DOUBLE) RETURNS BIGINT": _INDEX,
    "silva_floor_origin(x DOUBLE, size DOUBLE) RETURNS DOUBLE": f"{_INDEX} * size",
    "silva_plain_floor(x DOUBLE, size DOUBLE, low DOUBLE) RETURNS BIGINT": "CAST(floor((x - low) / size) AS BIGINT)",
    "silva_voxel_key(x DOUBLE, y DOUBLE, z DOUBLE, size DOUBLE) RETURNS STRUCT<ix: BIGINT, iy: BIGINT, iz: BIGINT>": "named_struct('ix', silva_floor_index(x, size), 'iy', silva_floor_index(y, size), 'iz', silva_floor_index(z, size))",
    "silva_diameter_class(radius DOUBLE) RETURNS DOUBLE": "silva_floor_index(2 * radius, 0.1D) / 10D",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``."""
    for head, body in NAMES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
