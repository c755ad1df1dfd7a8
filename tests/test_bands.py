"""Queries on bands equal their SQL where roundings fall on ties and where means depend on the order of their sums."""

from __future__ import annotations

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stratagrid.plans import catalog
from stratagrid.plans.frames import BANDS, bands
from tests.test_oracle import rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("bands")
    # 128 + v and 128 - v: normalised differences of n / 3200, half of which end in a 5 at the seventh digit
    ties = ", ".join(f"({u}, '{k}', {v})" for u in range(1, 400) for k, v in (("view", 64 - u / 50), ("click", 64 + u / 50), ("signup", 30.01 + u / 100), ("error", 12.5)))
    duckdb.connect().execute(f"COPY (SELECT CAST(u AS BIGINT) AS user_id, k AS event_type, CAST(v AS DOUBLE) AS value, TIMESTAMP '2024-01-03 00:00:00' AS ts FROM (VALUES {ties}) AS t(u, k, v)) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["spectral_indices", "class_shares_100"])
def test_ties_equal_sql(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df, q = catalog.queries()[name](spark, folder), duck.sql(catalog.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(q.columns, q.fetchall())


@pytest.fixture(scope="module")
def scattered(tmp_path_factory):
    path = tmp_path_factory.mktemp("scattered")
    draw, users = random.Random(7), []
    while len(users) < 200:
        # three values with a mean of 40, whose sum in doubles depends on which two are added first
        a, b = (round(draw.uniform(0, 60), 2) for _ in range(2))
        c = round(120 - a - b, 2)
        if ((a + b) + c == 120) != (a + (b + c) == 120):
            users.append((a, b, c))
    # two row groups, so that a's partial sum stands apart from that of b and c (DuckDB's filter holds back chunks below 64 rows); event ids run against the order of the rows
    at = [[(1000 - 3 * u - i, u or None, users[u][i]) for i in picked for u in range(len(users))] for picked in ((0,), (1, 2))]
    groups = [pa.table({"event_id": e, "user_id": pa.array(u, pa.int64()), "event_type": ["view"] * len(v), "value": v, "ts": [datetime.datetime(2024, 1, 3)] * len(v)}) for e, u, v in (zip(*g) for g in at)]
    with pq.ParquetWriter(path / "events.parquet", groups[0].schema) as out:
        for g in groups:
            out.write_table(g)
    return str(path)


@pytest.mark.parametrize("name", ["bands", "class_shares_100"])
def test_means_add_up_in_row_order(spark, scattered, name):
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{scattered}/events.parquet'")
    q = duck.sql(f"WITH {BANDS} SELECT * FROM bands" if name == "bands" else catalog.oracle_sql()[name])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = bands(spark, scattered) if name == "bands" else catalog.queries()[name](spark, scattered)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows(df.columns, got) == rows(q.columns, q.fetchall())
