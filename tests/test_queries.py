"""Queries of the catalog against DuckDB at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from silva.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["bbox", "slice_index", "voxel_downsample_first", "cubical_partition_counts", "tile_assign", "join_right_nullsafe", "wood_vote_closed_form", "knn_self", "radius_count", "adjacency_graph", "connected_components", "shortest_paths", "dbscan_2d", "slice_cluster", "linearity", "terrain_normalized_height", "cubical_border", "group_lists", "distinct_in_order", "branch_rules"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    clean = [[(pd.isna(v), 0 if pd.isna(v) else v if isinstance(v, str) else float(v)) for v in r] for r in frame[cols].itertuples(index=False, name=None)]
    return cols, sorted(clean)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_duckdb(spark, duck, name):
    ours = rows(catalog.queries()[name](spark, DATA).toPandas())
    theirs = rows(duck.sql(catalog.oracle_sql()[name]).df())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ix", "iy", "iz", "n", "z_min", "z_max", "z_median"]
