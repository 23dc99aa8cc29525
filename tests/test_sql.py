from pyspark.sql import functions as F

from silva.functions import expr, sql


def test_sql_functions_equal_the_expressions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(float(v) / 7,) for v in range(-40, 40)] + [(2.0,), (-0.2,)], "v double")
    rows.createOrReplaceTempView("values_")
    got = spark.sql("SELECT silva_floor_index(v, 0.2D) a, silva_floor_origin(v, 0.2D) b, silva_plain_floor(v, 0.2D, -6D) c, silva_voxel_key(v, v, 1D, 0.2D).iy d, silva_diameter_class(abs(v)) e FROM values_").collect()
    want = rows.select(expr.floor_index("v", 0.2), expr.floor_origin("v", 0.2), expr.plain_floor("v", 0.2, -6.0), expr.floor_index("v", 0.2), expr.diameter_class(F.abs("v"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
