"""Queries of geometry equal their SQL on tables where many places lie exactly on edges and corners."""

from __future__ import annotations

import duckdb
import pytest

from stratagrid.plans import catalog
from tests.test_oracle import rows

TABLES = {
    "customer": "SELECT i AS c_custkey, CAST(hash(i) % 2200 AS BIGINT) * 5.0::DOUBLE - 1000 AS c_acctbal FROM range(1, 1500) AS r(i)",
    "supplier": "SELECT i AS s_suppkey, CAST(hash(i + 7) % 2200 AS BIGINT) * 5.0::DOUBLE - 1000 + (i % 2) * 5.07 AS s_acctbal FROM range(1, 300) AS r(i)",
    "part": "SELECT i AS p_partkey, (900 + CAST(hash(i) % 1200 AS BIGINT))::DOUBLE AS p_retailprice FROM range(1, 1200) AS r(i)",
}


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    c = duckdb.connect()
    for name, sql in TABLES.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c, str(folder)


@pytest.mark.parametrize("name", ["point_in_polygon", "point_tile_left", "polygon_pairs", "rasterize_count", "burn_count", "parted_points"])
def test_edges_and_corners_equal_sql(spark, edges, name):
    duck, folder = edges
    df = catalog.queries()[name](spark, folder)
    q = duck.sql(catalog.oracle_sql()[name])
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(q.columns, q.fetchall())
    assert got[0] == want[0] and len(got[1]) > 0
    assert sorted(set(got[1]) ^ set(want[1]), key=repr) == [] and got[1] == want[1]
