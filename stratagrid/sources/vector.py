"""Vector layers as a Spark data source: format `gpkg`.

A GeoPackage is an SQLite file. Rows are (file, layer, fid, properties map, wkb); one partition a
layer. Without the option `layer` all layers are read; several names separated by commas are
tried in turn and the first that exists is read. Files must be on a path that every executor
sees: SQLite has no other way in. A path may be a folder that write_layer() has written: the files
of its commits are read, a part a file.

Layers are written from the executors: each task makes GeoPackages of at most `file_rows` features
in memory, with typed columns, envelopes and an R-tree, and names them by attempt. The job's commit
lists the files that count, so files of failed or repeated tasks are never read. An empty table
makes one file with an empty layer; null and empty geometries are kept as NULL; repeated features
are each written. An integer column fid is the feature id and may not repeat within a file; a fid
of another type, or a column type that a layer cannot hold, is refused.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DataType, StructField, StructType

from stratagrid.operators.geometry import RINGS, parts_of
from stratagrid.session import free_name

SCHEMA = "file string, layer string, fid long, properties map<string,string>, wkb binary"
# Bytes of the envelope by its code in a GeoPackage geometry header.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def wkb_of(blob: bytes | None) -> bytes | None:
    """The well-known binary after a GeoPackage header."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + ENVELOPE[blob[3] >> 1 & 7] :]

# Column types of a GeoPackage by Spark's, and back.
DECLARED = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "MEDIUMINT", "bigint": "INTEGER", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "TEXT", "date": "DATE", "timestamp": "DATETIME"}
READ_AS = {v: k for k, v in DECLARED.items()} | {"INT": "bigint", "REAL": "double"}
# What a GeoPackage must hold besides its layers.
HEAD = """
PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
INSERT INTO gpkg_spatial_ref_sys VALUES ('undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('undefined geographic', 0, 'NONE', 0, 'undefined', NULL);
"""


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def geometry_of(parts: list, srs: int) -> tuple[bytes | None, tuple | None]:
    """A GeoPackage multipolygon of parts (rings each, the outer one first), and its box (x, x, y, y)."""
    rings = [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in parts or () if part]
    points = [p for part in rings for ring in part for p in ring]
    if not points:
        return None, None
    xs, ys = zip(*points, strict=True)
    box = (min(xs), max(xs), min(ys), max(ys))
    out = [b"GP\0\3", struct.pack("<i4d", srs, *box), struct.pack("<BII", 1, 6, len(rings))]
    for part in rings:
        out.append(struct.pack("<BII", 1, 3, len(part)))
        for ring in part:
            closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
            out.append(struct.pack(f"<I{2 * len(closed)}d", len(closed), *(v for p in closed for v in p)))
    return b"".join(out), box


def rings_of(wkb: bytes | None) -> list | None:
    """All rings of a polygon, a multipolygon or a collection, of either byte order and with z or m; points and lines have none."""
    if wkb is None:
        return None
    rings: list = []

    def geometry(at: int) -> int:
        order = "<" if wkb[at] else ">"
        code, n = struct.unpack_from(f"{order}II", wkb, at + 1)
        # z and m stand in the thousands (ISO) or in the high bits (EWKB)
        kind, flags = code % 1000 if code < 1 << 29 else code & 255, code // 1000 if code < 1 << 29 else 0
        size = 2 + (flags in (1, 3)) + (flags in (2, 3)) + (code >> 31 & 1) + (code >> 30 & 1)
        start = at + 9 + 4 * (code >> 29 & 1)
        if code >> 29 & 1:
            n = struct.unpack_from(f"{order}I", wkb, start - 4)[0]
        if kind == 1:
            return start - 4 + 8 * size
        if kind == 2:
            return start + 8 * size * n
        for _ in range(n):
            if kind != 3:
                start = geometry(start)
                continue
            m = struct.unpack_from(f"{order}I", wkb, start)[0]
            v = struct.unpack_from(f"{order}{m * size}d", wkb, start + 4)
            rings.append([{"x": x, "y": y} for x, y in zip(v[::size], v[1::size], strict=True)])
            start += 4 + 8 * size * m
        return start

    geometry(0)
    return rings


def with_rings(df: DataFrame, wkb: str = "wkb", name: str = "rings") -> DataFrame:
    """df with the rings of a column of well-known binary, as the geometry operators take them."""
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([rings_of(x.as_py()) for x in b.column(wkb)], pa.list_(pa.list_(point)))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, name])

    return df.mapInArrow(parse, StructType([*df.schema.fields, StructField(name, DataType.fromDDL(RINGS))]))


def layers_of(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[0] for r in c.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]


def files_of(path: str) -> list[str]:
    """The path itself, or the files of a folder's commits."""
    if not os.path.isdir(path):
        return [path]
    found = []
    for name in sorted(os.listdir(f"{path}/commits")):
        with open(f"{path}/commits/{name}") as lines:
            found += [f"{path}/{f}" for f in json.load(lines)]
    return found


@dataclass
class Layer(InputPartition):
    path: str
    layer: str


class LayerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.removeprefix("file://").removeprefix("file:") for p in options["path"].split(",") if p]
        self.wanted = [x for x in options.get("layer", "").split(",") if x]

    def partitions(self) -> list[Layer]:
        out = []
        for p in [f for path in self.paths for f in files_of(path)]:
            there = layers_of(p)
            names = there if not self.wanted else [x for x in self.wanted if x in there][:1]
            out += [Layer(p, n) for n in names]
        return out

    def read(self, partition: Layer) -> Iterator[tuple]:
        quoted = '"' + partition.layer.replace('"', '""') + '"'
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as c:
            geom = c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (partition.layer,)).fetchone()[0]
            # the feature id is the integer primary key, whatever its name
            keys = [r[1] for r in c.execute(f"PRAGMA table_info({quoted})") if r[5] == 1 and r[2].upper() == "INTEGER"]
            rows = c.execute(f"SELECT * FROM {quoted}")
            names = [d[0] for d in rows.description]
            for k, row in enumerate(rows):
                v = dict(zip(names, row, strict=True))
                blob, fid = v.pop(geom), v.pop(keys[0]) if keys else k + 1
                yield partition.path, partition.layer, fid, {n: None if x is None else str(x) for n, x in v.items()}, wkb_of(blob)


@dataclass
class TaskLayers(WriterCommitMessage):
    """Names of the files that a task wrote."""

    files: list[str]


class LayerWriter(DataSourceWriter):
    """Rows of typed columns and one column of parts, written as one layer in files of file_rows features."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.layer, self.geom = options["path"].removeprefix("file://").removeprefix("file:").rstrip("/"), options["layer"], options.get("geometry", "geom")
        self.srs, self.file_rows = int(options.get("srs", 0)), int(options.get("filerows", 50_000))
        types = {f.name: f.dataType.simpleString() for f in schema.fields if f.name != self.geom}
        unknown = {n: t for n, t in types.items() if t not in DECLARED}
        if unknown:
            raise ValueError(f"columns that a layer cannot hold: {unknown}")
        self.key = next((n for n, t in types.items() if n.lower() == "fid" and t in ("int", "bigint")), None)
        self.types = {n: t for n, t in types.items() if n != self.key}
        if any(n.lower() in ("fid", self.geom.lower()) for n in self.types):
            raise ValueError("fid is an integer, and no column has the geometry's name")

    def write(self, iterator: Iterator) -> TaskLayers:
        files, rows = [], iter(iterator)
        while batch := list(islice(rows, self.file_rows)):
            files.append(self._file(batch))
        if not files and TaskContext.get().partitionId() == 0:
            files.append(self._file([]))
        return TaskLayers(files)

    def _file(self, batch: list) -> str:
        t, g, tree = quote(self.layer), quote(self.geom), quote(f"rtree_{self.layer}_{self.geom}")
        c = sqlite3.connect(":memory:")
        c.executescript(HEAD)
        if self.srs > 0:
            c.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{self.srs}", self.srs, self.srs))
        declared = "".join(f", {quote(n)} {DECLARED[x]}" for n, x in self.types.items())
        c.execute(f"CREATE TABLE {t} (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, {g} MULTIPOLYGON{declared})")
        c.execute(f"CREATE VIRTUAL TABLE {tree} USING rtree(id, minx, maxx, miny, maxy)")
        marks = ", ".join("?" * (2 + len(self.types)))
        all_boxes = []
        for row in batch:
            blob, box = geometry_of(row[self.geom], self.srs)
            values = [self._value(row[n], x) for n, x in self.types.items()]
            fid = c.execute(f"INSERT INTO {t} VALUES ({marks})", [row[self.key] if self.key else None, blob, *values]).lastrowid
            if box:
                c.execute(f"INSERT INTO {tree} VALUES (?, ?, ?, ?, ?)", (fid, *box))
                all_boxes.append(box)
        lo_x, hi_x, lo_y, hi_y = (f(b[k] for b in all_boxes) if all_boxes else None for k, f in enumerate((min, max, min, max)))
        c.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (self.layer, self.layer, lo_x, lo_y, hi_x, hi_y, self.srs))
        c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'MULTIPOLYGON', ?, 0, 0)", (self.layer, self.geom, self.srs))
        c.execute("INSERT INTO gpkg_extensions VALUES (?, ?, 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (self.layer, self.geom))
        c.commit()
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gpkg"
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/{name}", "wb") as out:
            out.write(c.serialize())
        c.close()
        return name

    @staticmethod
    def _value(x, kind: str):
        if x is None or kind not in ("date", "timestamp"):
            return x
        return x.isoformat() if kind == "date" else x.isoformat(timespec="microseconds")

    def commit(self, messages: list) -> None:
        os.makedirs(f"{self.folder}/commits", exist_ok=True)
        with open(f"{self.folder}/commits/{uuid.uuid4().hex}.json", "w") as out:
            json.dump([f for m in messages if m is not None for f in m.files], out)

    def abort(self, messages: list) -> None:
        for f in (f for m in messages if m is not None for f in m.files):
            os.remove(f"{self.folder}/{f}")


class GeoPackage(DataSource):
    """spark.read.format("gpkg").option("layer", "al2,ADM1").load("a.gpkg,b.gpkg")"""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayerReader:
        return LayerReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LayerWriter:
        if overwrite:
            raise ValueError("layers are appended; choose a new folder to begin anew")
        return LayerWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackage)


def write_layer(df: DataFrame, folder: str, layer: str, rings: str = "rings", srs: int = 0, file_rows: int = 50_000) -> None:
    """Append df to a layer in a folder that every executor sees; rings (in any order, several parts, holes) become multipolygons."""
    register(df.sparkSession)
    geom = free_name(df, "geom")
    rows = df.withColumn(geom, parts_of(F.col(f"`{rings}`"))).drop(rings)
    rows.write.format("gpkg").option("layer", layer).option("geometry", geom).option("srs", srs).option("filerows", file_rows).mode("append").save(folder)


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """fid, the layer's columns in the types that the first file declares, and rings.

    Columns of other types than those that write_layer() knows are strings; columns that only later files have are left out.
    """
    register(spark)
    with sqlite3.connect(f"file:{files_of(path.removeprefix('file://'))[0]}?mode=ro", uri=True) as c:
        geom = c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()[0]
        declared = [(r[1], r[2].upper()) for r in c.execute(f"PRAGMA table_info({quote(layer)})") if r[1] != geom and not (r[5] == 1 and r[2].upper() == "INTEGER")]
    rows = spark.read.format("gpkg").option("layer", layer).load(path)
    typed = [F.col("properties")[n].cast(READ_AS.get(t.split("(")[0], "string")).alias(n) for n, t in declared]
    wkb, rings = (next(x for x in ("_" * k + base for k in range(9)) if x not in dict(declared)) for base in ("wkb", "rings"))
    return with_rings(rows.select("fid", *typed, F.col("wkb").alias(wkb)), wkb, rings).drop(wkb)
