"""Rasters: reading of TIFF tiles, and a sink of cloud-optimised ones that executors write.

read_blocks() takes a DataFrame of file paths. A first pass opens each file's header in a task of
its own and gives out blocks (one level, one window); the blocks are dealt out again and read as
rows (path, band, row, col, height, width, values), so neither the driver nor one task opens all
files, and cells_of() unfolds them in the JVM. The format `tiletiff` reads the cells of named
files in the same way, and is the sink behind write_tiles().

Values are NULL for nodata (an option, else the file's own tag) and where they are not finite.
Codecs: none, LZW, deflate, ZSTD; predictors 1 to 3; strips or tiles; classic and BigTIFF.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stratagrid.sources import tiff
from stratagrid.sources.tiff import Grid, Level, Tiff

SCHEMA = "file string, band int, row int, col int, value double"
BLOCKS = "path string, band int, row int, col int, height int, width int, values array<double>"
EVERYWHERE = (0, 2**31 - 1)


def _open(path: str, mode: str = "r"):
    """A binary stream on any store that Arrow knows, for a path or URI."""
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    if mode == "r":
        return store.open_input_file(p)
    store.create_dir(p.rpartition("/")[0], recursive=True)
    return store.open_output_stream(p)


def _remove(path: str) -> None:
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    store.delete_file(p)


def encode_blocks(values: np.ndarray, block: int, scheme: int, predictor: int) -> Grid:
    """One level of rows x columns x bands as compressed square blocks; blocks at the edge are filled with zeros."""
    height, width, bands = values.shape
    found = {}
    for i in range(-(-height // block)):
        for j in range(-(-width // block)):
            part = values[i * block : (i + 1) * block, j * block : (j + 1) * block]
            whole = np.zeros((block, block, bands), values.dtype)
            whole[: part.shape[0], : part.shape[1]] = part
            found[i, j] = tiff.pack(tiff.apply_predictor(whole, predictor), scheme)
    return Grid(height, width, found)


def write_tile(path: str, values: np.ndarray, block: int = 64, compression: str = "deflate", predictor: int = 1, nodata: float | None = None, overviews: tuple[np.ndarray, ...] = (), big: bool | None = None) -> None:
    """Write one array of bands x rows x columns, and smaller arrays of it as overviews, as a file; for small rasters at hand."""
    block = max(16, -(-block // 16) * 16)
    scheme = tiff.SCHEMES[compression]
    levels = [encode_blocks(np.moveaxis(v, 0, 2), block, scheme, predictor) for v in (values, *overviews)]
    with _open(path, "w") as out:
        for piece in tiff.layout(levels, values.dtype, values.shape[0], block, scheme, predictor, nodata, big=big):
            out.write(piece)


def _values(v: np.ndarray, nodata: float | None) -> tuple[np.ndarray, np.ndarray]:
    x = v.astype("f8")
    return x, ~np.isfinite(x) | (x == nodata) if nodata is not None else ~np.isfinite(x)


def plan_blocks(files: DataFrame, path: str = "path", factor: float = 1.0, rows: tuple[int, int] = EVERYWHERE, cols: tuple[int, int] = EVERYWHERE) -> DataFrame:
    """(path, level, block) of the blocks to read: of the coarsest level whose cells are at most `factor` times as wide, within a window in that level's rows and columns."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"]:
                with _open(p) as f:
                    t = Tiff(f)
                    level = t.level_for(factor)
                    blocks = level.blocks_of(rows, cols)
                    yield pd.DataFrame({"path": p, "level": t.levels().index(level), "block": blocks})

    return files.select(F.col(f"`{path}`").alias("path")).where("path is not null").mapInPandas(plan, "path string, level int, block int")


def read_blocks(files: DataFrame, path: str = "path", factor: float = 1.0, rows: tuple[int, int] = EVERYWHERE, cols: tuple[int, int] = EVERYWHERE, nodata: float | None = None, tasks: int | None = None) -> DataFrame:
    """Blocks of the files as rows, one for each band: where it begins, its size, its values row by row.

    A block that the window cuts comes whole; cells_of() cuts it. Missing files fail the job;
    the order of rows is open; repeated paths are read each time.
    """
    plan = plan_blocks(files.repartition(path) if tasks is None else files.repartition(tasks, path), path, factor, rows, cols)
    dealt = plan.repartition("path", "level", "block") if tasks is None else plan.repartition(tasks, "path", "level", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: dict[tuple[str, int], list[int]] = {}
            for p, level, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked.setdefault((p, level), []).append(block)
            for (p, level), blocks in asked.items():
                with _open(p) as f:
                    t = Tiff(f)
                    own = t.levels()[level]
                    for k in blocks:
                        yield _block_row(p, own, t.block(own, k), nodata)

    return dealt.mapInArrow(read, BLOCKS)


def _block_row(path: str, level: Level, block: tuple[int, int, np.ndarray], nodata: float | None) -> pa.RecordBatch:
    r0, c0, v = block
    height, width, bands = v.shape
    x, bad = _values(v, level.nodata if nodata is None else nodata)
    cells = pa.array(np.moveaxis(x, 2, 0).ravel(), mask=np.moveaxis(bad, 2, 0).ravel())
    ints = lambda n: pa.array([n] * bands, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * bands), pa.array(range(1, bands + 1), pa.int32()), ints(r0), ints(c0), ints(height), ints(width), pa.ListArray.from_arrays(pa.array(range(0, bands * height * width + 1, height * width), pa.int32()), cells)],
        ["path", "band", "row", "col", "height", "width", "values"],
    )


def cells_of(blocks: DataFrame, rows: tuple[int, int] = EVERYWHERE, cols: tuple[int, int] = EVERYWHERE) -> DataFrame:
    """(path, band, row, col, value) of block rows, within a window."""
    at = blocks.select("path", "band", "row", "col", "width", F.posexplode("values").alias("k", "value"))
    cells = at.select("path", "band", (F.col("row") + F.expr("k div width").cast("int")).alias("row"), (F.col("col") + F.col("k") % F.col("width")).alias("col"), "value")
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


@dataclass
class Share(InputPartition):
    path: str
    share: int


class TileReader(DataSourceReader):
    """Cells of named files: a partition opens its file's header and reads its share of the blocks."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.shares, self.factor = int(options.get("shares", 8)), float(options.get("factor", 1))
        self.rows = tuple(int(x) for x in options.get("rows", "0,2147483647").split(","))
        self.cols = tuple(int(x) for x in options.get("cols", "0,2147483647").split(","))

    def partitions(self) -> list[Share]:
        return [Share(p, k) for p in self.paths for k in range(self.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as f:
            t = Tiff(f)
            level = t.level_for(self.factor)
            for k in level.blocks_of(self.rows, self.cols)[partition.share :: self.shares]:
                r0, c0, v = t.block(level, k)
                rr, cc = np.meshgrid(np.arange(r0, r0 + v.shape[0]), np.arange(c0, c0 + v.shape[1]), indexing="ij")
                keep = (rr >= self.rows[0]) & (rr <= self.rows[1]) & (cc >= self.cols[0]) & (cc <= self.cols[1])
                x, bad = _values(v, level.nodata if self.nodata is None else self.nodata)
                n = int(keep.sum())
                for b in range(v.shape[2]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.path] * n), pa.array(np.full(n, b + 1, "i4")), pa.array(rr[keep].astype("i4")), pa.array(cc[keep].astype("i4")), pa.array(x[:, :, b][keep], mask=bad[:, :, b][keep])], ["file", "band", "row", "col", "value"]
                    )


@dataclass
class TaskFiles(WriterCommitMessage):
    """What a task wrote: its list of files, by path."""

    manifest: str
    paths: list[str]


class TileWriter(DataSourceArrowWriter):
    """Rows (file, level, band, row, col, value), sorted by file, level and block, to one file each.

    A task names its files by attempt and lists them in a manifest; the job's commit names the
    manifests that count. Files of failed or repeated tasks are in no commit.
    """

    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")
        self.height, self.width, self.bands = (int(options[c]) for c in ("height", "width", "bands"))
        self.block, self.dtype = int(options.get("block", 512)), np.dtype(options.get("dtype", "f4"))
        self.scheme, self.predictor = tiff.SCHEMES[options.get("compression", "deflate")], int(options.get("predictor", 1))
        self.factors = [1, *(int(x) for x in options.get("overviews", "").split(",") if x)]
        self.nodata = float(options["nodata"])
        self.origin = tuple(float(x) for x in options["origin"].split(",")) if "origin" in options else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        tag, lines, paths = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], []
        now: tuple | None = None  # file, level, block row, block column
        cells = self._empty()
        grids = self._grids()

        def close_block() -> None:
            if now is not None:
                grids[now[1]].blocks[now[2], now[3]] = tiff.pack(tiff.apply_predictor(cells, self.predictor), self.scheme)

        def close_file() -> None:
            if now is None:
                return
            path = f"{self.uri}/{now[0]}-{tag}.tif"
            n = 0
            with _open(path, "w") as out:
                for piece in tiff.layout(grids, self.dtype, self.bands, self.block, self.scheme, self.predictor, self.nodata, self.origin):
                    n += len(piece)
                    out.write(piece)
            paths.append(path)
            lines.append(json.dumps({"manifest": tag, "file": now[0], "path": path, "bytes": n}))

        for batch in iterator:
            file, level, band, row, col, value = (batch.column(batch.schema.get_field_index(c)) for c in ("file", "level", "band", "row", "col", "value"))
            names, level = file.to_pylist(), level.to_numpy()
            row, col, band = row.to_numpy(), col.to_numpy(), band.to_numpy() - 1
            value = value.fill_null(self.nodata).to_numpy(zero_copy_only=False)
            value = np.where(np.isfinite(value), value, self.nodata)
            if len(names) and ((row < 0) | (col < 0) | (band < 0) | (band >= self.bands)).any():
                raise ValueError("a cell lies outside the raster")
            keys = list(zip(names, level.tolist(), (row // self.block).tolist(), (col // self.block).tolist(), strict=True))
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
            a = 0
            for b in ends if keys else []:
                if keys[a] != now:
                    close_block()
                    if now is not None and keys[a][0] != now[0]:
                        close_file()
                        grids = self._grids()
                    now, cells = keys[a], self._empty()
                g = grids[now[1]]
                if row[a:b].max() >= g.height or col[a:b].max() >= g.width:
                    raise ValueError("a cell lies outside the raster")
                cells[row[a:b] % self.block, col[a:b] % self.block, band[a:b]] = self._cast(value[a:b])
                a = b
        close_block()
        close_file()
        manifest = f"{self.uri}/manifests/{tag}.json"
        if lines:
            with _open(manifest, "w") as out:
                out.write("\n".join(lines).encode())
        return TaskFiles(tag if lines else "", paths)

    def _empty(self) -> np.ndarray:
        return np.full((self.block, self.block, self.bands), self.nodata, self.dtype)

    def _grids(self) -> list[Grid]:
        return [Grid(-(-self.height // k), -(-self.width // k), {}) for k in self.factors]

    def _cast(self, x: np.ndarray) -> np.ndarray:
        if self.dtype.kind == "f":
            return x.astype(self.dtype)
        info = np.iinfo(self.dtype)
        return np.clip(np.rint(x), info.min, info.max).astype(self.dtype)

    def commit(self, messages: list) -> None:
        counted = [m.manifest for m in messages if m is not None and m.manifest]
        if not counted:
            _open(f"{self.uri}/manifests/{uuid.uuid4().hex}.json", "w").close()
        with _open(f"{self.uri}/commits/{uuid.uuid4().hex}.json", "w") as out:
            out.write(json.dumps({"manifests": counted}).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            for path in m.paths if m is not None else ():
                _remove(path)


class TileTiff(DataSource):
    """spark.read.format("tiletiff").option("nodata", v).option("rows", "a,b").option("factor", k).load("file1,file2"); write_tiles() writes."""

    @classmethod
    def name(cls) -> str:
        return "tiletiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileTiff)


def write_tiles(
    cells: DataFrame, uri: str, *, height: int, width: int, bands: int = 1, block: int = 512, dtype: str = "f4", compression: str = "zstd", predictor: int = 1, nodata: float = -32000, overviews: tuple[int, ...] = (), origin: tuple[float, float, float] | None = None
) -> DataFrame:
    """Write cells (file, band, row, col, value) as one cloud-optimised file for each `file`; returns committed_files().

    Overviews are means over k x k cells that have values. Cells that are absent, NULL or not
    finite are nodata; whole-number types round and saturate. A file is made by one task, from its
    own cells, so memory is bounded by one raster's compressed blocks. Cells outside the raster
    fail the job; of repeated cells one is kept.
    """
    register(cells.sparkSession)
    base = cells.select("file", *[F.col(c).cast("int").alias(c) for c in ("band", "row", "col")], F.col("value").cast("double").alias("value")).where("file is not null")
    levels = [base.withColumn("level", F.lit(0))]
    for k, factor in enumerate(overviews, 1):
        down = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
        levels.append(base.groupBy("file", "band", *down).agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("value")).withColumn("level", F.lit(k)))
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    sort = ["file", "level", F.floor(F.col("row") / block), F.floor(F.col("col") / block)]
    options = {"height": height, "width": width, "bands": bands, "block": block, "dtype": dtype, "compression": compression, "predictor": predictor, "nodata": nodata, "overviews": ",".join(map(str, overviews))}
    if origin is not None:
        options["origin"] = ",".join(map(str, origin))
    rows.repartition("file").sortWithinPartitions(*sort).select("file", "level", "band", "row", "col", "value").write.format("tiletiff").options(**options).mode("append").save(uri)
    return committed_files(cells.sparkSession, uri)


def committed_files(spark: SparkSession, uri: str) -> DataFrame:
    """(file, path, bytes) of the files that a commit of write_tiles() names."""
    counted = spark.read.schema("manifests array<string>").json(f"{uri}/commits").select(F.explode("manifests").alias("manifest"))
    files = spark.read.schema("manifest string, file string, path string, bytes long").json(f"{uri}/manifests")
    return files.join(counted, "manifest", "left_semi").select("file", "path", "bytes")
