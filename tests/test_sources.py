from __future__ import annotations

import datetime
import json
import shutil
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import geometry as G
from stratagrid.operators import series as S
from stratagrid.sources import raster, tables, vector
from stratagrid.streaming import events


def test_raster_round_trip_and_window(spark, tmp_path):
    raster.register(spark)
    v = np.arange(2 * 150 * 40).reshape(2, 150, 40).astype("i2")
    v[0, 3, 4] = -32000
    path = str(tmp_path / "a.tif")
    raster.write_tile(path, v, 32)
    df = spark.read.format("tiletiff").option("nodata", "-32000").option("blocks", "2").load(path)
    assert df.count() == v.size and df.where("value is null").select("row", "col", "band").collect() == [(3, 4, 1)]
    assert df.where("band = 2").agg(F.sum("value")).first()[0] == v[1].sum()
    part = spark.read.format("tiletiff").option("rows", "40,45").option("cols", "3,4").load(path)
    assert sorted(r["value"] for r in part.collect()) == sorted(v[:, 40:46, 3:5].ravel())


def test_geopackage_layers_and_fallback(spark, tmp_path):
    vector.register(spark)
    path = str(tmp_path / "a.gpkg")
    wkb = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        for name in ("ADM1", "other"):
            c.execute(f"CREATE TABLE {name} (fid INTEGER PRIMARY KEY, geom BLOB, NAME TEXT)")
            c.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (name,))
            c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (name,))
            c.execute(f"INSERT INTO {name} VALUES (7, ?, 'x')", (b"GP\0\2" + struct.pack("<i4d", 4326, 3, 3, 4, 4) + wkb,))
    rows = spark.read.format("gpkg").load(path).collect()
    assert {r["layer"] for r in rows} == {"ADM1", "other"} and all(bytes(r["wkb"]) == wkb and r["properties"] == {"NAME": "x"} for r in rows)
    one = spark.read.format("gpkg").option("layer", "al2,ADM1").load(path).collect()
    assert [(r["layer"], r["fid"]) for r in one] == [("ADM1", 7)]


def test_geopackage_key_of_any_name(spark, tmp_path):
    vector.register(spark)
    path = str(tmp_path / "k.gpkg")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        c.execute("CREATE TABLE a (OGC_ID INTEGER PRIMARY KEY, geom BLOB, fid TEXT)")
        c.execute("INSERT INTO gpkg_contents VALUES ('a', 'features')")
        c.execute("INSERT INTO gpkg_geometry_columns VALUES ('a', 'geom')")
        c.execute("INSERT INTO a VALUES (41, NULL, 'text')")
    row = spark.read.format("gpkg").load(path).first()
    assert (row["fid"], row["properties"], row["wkb"]) == (41, {"fid": "text"}, None)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000, 1.0), (2, 2000, float("nan")), (3, 2001, 2.0)], "k int, year int, v double")
    root = str(tmp_path / "p")
    tables.write_partitioned(df, root, ["year"])
    tables.write_partitioned(df.where("year = 2001").withColumn("v", F.lit(9.0)), root, ["year"])
    assert tables.scan_partitions(spark, root, year=2001).first()["v"] == 9.0
    assert tables.scan_partitions(spark, root, year=2000).count() == 2 and tables.scan_partitions(spark, root, year=1999).count() == 0
    tables.append_partitioned(df.where("year = 2001"), root, ["year"])
    assert tables.scan_glob(spark, root).count() == 4
    tables.write_csv(df, str(tmp_path / "s_00_tile042.csv"))
    back = tables.with_file_token(tables.scan_csv(spark, str(tmp_path / "s_00_tile042.csv"), "k int, year int, v double"), "part", 0)
    assert back.where("v is null").count() == 1 and back.first()["part"].startswith("part")
    (tmp_path / "t.txt").write_text("a\nb\nc\n")
    assert [r["value"] for r in tables.scan_lines(spark, str(tmp_path / "t.txt"), 1, 2).collect()] == ["b", "c"]
    (tmp_path / "c.json").write_text(json.dumps({"features": [{"id": "i", "assets": {"m": {"href": "h"}}}, {"id": "j", "assets": {}}]}))
    assert [tuple(r) for r in tables.scan_catalogue(spark, str(tmp_path / "c.json"), "m").collect()] == [("i", "h")]
    m = tables.publish_manifest(df.limit(1).withColumn("uri", F.lit("u")), "c", "year", "uri").first()
    assert json.loads(m["request"])["type"] == "IMAGE"
    assert df.select(tables.shard_of(F.col("k"), 13).alias("s")).where("s < 1 or s > 13").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in")
    q = events.windowed_means(events.read_events(spark, str(tmp_path / "in"), src.schema)).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["event_type"], r["start"], r["n"]) for r in spark.sql("select * from w").collect())
    assert got == sorted((r["event_type"], r["start"], r["n"]) for r in events.windowed_means(src).collect())


@pytest.mark.parametrize("lon,lat", [(0.0, 0.0), (-75.0, 10.0), (10.0, 60.0), (140.0, -70.0), (-100.0, 89.9)])
def test_homolosine_is_equal_area(spark, lon, lat):
    d = 0.01
    corner = lambda a, b: G.homolosine(F.lit(lon + a), F.lit(lat + b))
    pts = [corner(-d, -d), corner(d, -d), corner(d, d), corner(-d, d)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])
    area = spark.range(1).select(F.abs(G.ring_area(ring))).first()[0]
    want = G.RADIUS**2 * np.radians(2 * d) * (np.sin(np.radians(lat + d)) - np.sin(np.radians(lat - d)))
    assert area == pytest.approx(want, rel=2e-3)


def test_smoothing_cube_keeps_a_cubic(spark):
    rows = [(1, t, r, c, float(t**3 - 2 * r * c + c)) for t in range(7) for r in range(7) for c in range(7)]
    out = S.savgol_cube(spark.createDataFrame(rows, "tile int, t int, row int, col int, value double"))
    for r in out.where("t between 2 and 4 and row between 2 and 4 and col between 2 and 4").collect():
        assert r["smooth"] == pytest.approx(r["value"], abs=1e-6)


def test_polygon_with_hole_and_raster(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame([(1, [ring(0.0, 4.0), ring(1.0, 3.0)])], f"k int, rings {G.RINGS}")
    assert df.select(G.polygon_area(F.col("rings"))).first()[0] == 12
    cells = {(r["row"], r["col"]) for r in G.rasterize(df, "rings", 1.0).collect()}
    assert cells == {(i, j) for i in range(4) for j in range(4)} - {(i, j) for i in (1, 2) for j in (1, 2)}
    assert G.least_circle([(0, 0), (2, 0), (1, 1), (1, 0.2)]) == pytest.approx((1, 0, 1))


def test_layer_round_trip_with_types_holes_and_parts(spark, tmp_path):
    ring = lambda a, b, y=0.0: [(a, a + y), (b, a + y), (b, b + y), (a, b + y)]
    day, at = datetime.date(2020, 2, 29), datetime.datetime(2021, 1, 2, 3, 4, 5, 678901)
    rows = [
        (1, "a'\"b", 2.5, True, day, at, "x", [ring(0.0, 4.0), ring(1.0, 3.0), ring(10.0, 11.0)]),
        (2, None, None, None, None, None, None, None),
        (3, "", float("1e300"), False, day, at, "y", []),
        (4, "long " * 5000, -0.1, False, day, at, "y", [[*ring(0.0, 1.0), (0.0, 0.0)]]),
        (4, "twice", -0.1, False, day, at, "y", [ring(0.0, 2.0)]),
    ]
    df = spark.createDataFrame(rows, f"k bigint, name string, v double, ok boolean, d date, t timestamp, wkb string, rings {G.RINGS}").repartition(3)
    folder = str(tmp_path / "layer")
    vector.write_layer(df, folder, "Grid cells", srs=4326, file_rows=1)
    (tmp_path / "layer" / "part-000000-left.gpkg").write_bytes(b"of a failed attempt")
    back = vector.read_layer(spark, folder, "Grid cells")
    assert dict(back.dtypes) == {"fid": "bigint", "k": "bigint", "name": "string", "v": "double", "ok": "boolean", "d": "date", "t": "timestamp", "wkb": "string", "rings": df.schema["rings"].dataType.simpleString()}
    key = lambda r: (r["k"], r["name"] or "")
    got = sorted(back.withColumn("area", G.polygon_area(F.col("rings"))).collect(), key=key)
    for r, want in zip(got, sorted(rows, key=lambda r: (r[0], r[1] or "")), strict=True):
        assert tuple(r)[1:8] == want[:7]
    assert [r["area"] for r in got] == [13, None, None, 1, 4]
    files = vector.files_of(folder)
    assert len(files) == 5
    with sqlite3.connect(files[0]) as c:
        assert c.execute("PRAGMA integrity_check").fetchone() == ("ok",)
        boxes = c.execute('SELECT minx, maxx FROM "rtree_Grid cells_geom"').fetchall()
        assert len(boxes) <= 1 and c.execute("SELECT srs_id FROM gpkg_contents").fetchone() == (4326,)
    vector.write_layer(df.where("k = 1"), folder, "Grid cells", srs=4326)
    assert vector.read_layer(spark, folder, "Grid cells").count() == 6
    empty = str(tmp_path / "empty")
    vector.write_layer(df.where("k < 0"), empty, "e")
    assert vector.read_layer(spark, empty, "e").collect() == []


def test_rings_of_either_byte_order_and_heights():
    flat = struct.pack(">BIIIdddddd", 0, 3, 1, 3, 0, 0, 1, 0, 1, 1)
    high = struct.pack("<BIII9d", 1, 1003, 1, 3, 0, 0, 9, 1, 0, 9, 1, 1, 9)
    want = [[{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}]]
    assert vector.rings_of(flat) == want and vector.rings_of(high) == want
    both = struct.pack("<BII", 1, 7, 3) + flat + struct.pack("<BIdd", 1, 1, 5, 5) + high
    assert vector.rings_of(both) == want * 2 and vector.rings_of(None) is None
