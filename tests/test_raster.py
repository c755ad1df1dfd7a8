from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.sources import raster, tiff


class Counted:
    """A file that counts the bytes read."""

    def __init__(self, path):
        self.f, self.n = open(path, "rb"), 0

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        self.n += n
        return self.f.read(n)


@pytest.mark.parametrize("raw", [b"", b"a", b"aaaaaaa", bytes(range(256)) * 40, b"TOBEORNOTTOBE" * 900, random.Random(0).randbytes(60_000), b"\0" * 200_000])
def test_lzw_round_trip(raw):
    assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


def test_lzw_of_the_published_example():
    # the strip of the TIFF 6.0 text: 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


@pytest.mark.parametrize("dtype", ["u1", "i2", "u4", "f4", "f8"])
@pytest.mark.parametrize("compression", ["none", "lzw", "deflate", "zstd"])
def test_every_codec_and_predictor(tmp_path, dtype, compression):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 200, (2, 45, 70)).astype(dtype)
    v[0, :, :3] = 255
    for predictor in (1, 2, 3) if dtype[0] == "f" else (1, 2):
        for big in (False, True):
            path = str(tmp_path / f"{predictor}{big}.tif")
            raster.write_tile(path, v, 32, compression, predictor, big=big)
            with open(path, "rb") as f:
                t = tiff.Tiff(f)
                level = t.levels()[0]
                assert t.big is big and (level.height, level.width, level.bands) == (45, 70, 2)
                out = np.zeros((45, 70, 2), dtype)
                for k in level.blocks_of((0, 10**9), (0, 10**9)):
                    r, c, b = t.block(level, k)
                    out[r : r + b.shape[0], c : c + b.shape[1]] = b
                assert (out == np.moveaxis(v, 0, 2)).all()


def test_strips_big_endian_and_separate_planes(tmp_path):
    v = np.arange(2 * 5 * 4).reshape(2, 5, 4).astype(">i2")
    strips = [v[b, r : r + 2].tobytes() for b in range(2) for r in (0, 2, 4)]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    import struct

    tags = [(256, 3, [4]), (257, 3, [5]), (258, 3, [16, 16]), (259, 3, [1]), (273, 4, offsets), (277, 3, [2]), (278, 3, [2]), (279, 4, [len(s) for s in strips]), (284, 3, [2]), (339, 3, [2, 2])]
    table, extra, base = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, typ, vals in tags:
        raw = struct.pack(f">{len(vals)}{'H' if typ == 3 else 'I'}", *vals)
        if len(raw) > 4:
            table += struct.pack(">HHII", tag, typ, len(vals), base + len(extra))
            extra += raw
        else:
            table += struct.pack(">HHI", tag, typ, len(vals)) + raw.ljust(4, b"\0")
    path = tmp_path / "m.tif"
    path.write_bytes(struct.pack(">2sHI", b"MM", 42, at) + b"".join(strips) + struct.pack(">H", len(tags)) + table + b"\0\0\0\0" + extra)
    with open(path, "rb") as f:
        t = tiff.Tiff(f)
        parts = [t.block(t.levels()[0], k)[2] for k in range(3)]
    assert (np.concatenate(parts) == np.moveaxis(v, 0, 2)).all()


def test_a_level_is_read_alone(tmp_path):
    path, v = str(tmp_path / "o.tif"), np.random.default_rng(2).random((1, 512, 512)).astype("f4")
    raster.write_tile(path, v, 64, overviews=(v[:, ::2, ::2], v[:, ::4, ::4]))
    f = Counted(path)
    t = tiff.Tiff(f)
    assert [t.level_for(k).width for k in (1, 1.9, 2, 3, 4, 50)] == [512, 512, 256, 256, 128, 128]
    level = t.level_for(4)
    head = f.n
    blocks = level.blocks_of((0, 70), (0, 60))
    assert blocks == [0, 2] and level.overview
    for k in blocks:
        t.block(level, k)
    assert f.n - head == sum(level.counts[k] for k in blocks) and head < 5000
    raw = open(path, "rb").read()
    assert raw[8:38] == b"GDAL_STRUCTURAL_METADATA_SIZE=" and int(raw[38:44]) == len(tiff.GHOST)
    # the data of the coarse levels come first, each block between its size and its last bytes
    assert max(t.levels()[2].offsets) < min(t.levels()[1].offsets) < min(t.levels()[0].offsets)
    for x in t.levels():
        for at, n in zip(x.offsets, x.counts):
            assert int.from_bytes(raw[at - 4 : at], "little") == n and raw[at + n : at + n + 4] == raw[at + n - 4 : at + n]


def grid(spark):
    df = spark.range(3 * 2 * 50 * 40).selectExpr("concat('t', id div 4000) file", "cast(id div 2000 % 2 + 1 as int) band", "cast(id div 40 % 50 as int) row", "cast(id % 40 as int) col", "cast(id % 997 as double) / 3 value")
    return df.withColumn("value", F.when(F.col("row") != 7, F.col("value"))).repartition(6)


@pytest.mark.parametrize("compression,predictor,dtype", [("zstd", 3, "f8"), ("lzw", 2, "i2"), ("deflate", 2, "f4")])
def test_sink_round_trip_with_overviews(spark, tmp_path, compression, predictor, dtype):
    cells = grid(spark)
    files = raster.write_tiles(cells, f"file://{tmp_path}/out", height=50, width=40, bands=2, block=16, dtype=dtype, compression=compression, predictor=predictor, overviews=(2, 4), nodata=-9999, origin=(5.0, 50.0, 0.25))
    assert files.count() == 3
    back = raster.cells_of(raster.read_blocks(files)).join(files, "path").select("file", "band", "row", "col", "value")
    put = F.bround("value") if dtype == "i2" else F.col("value").cast("float" if dtype == "f4" else "double").cast("double")
    want = cells.withColumn("value", put)
    assert back.count() == 12_000 and back.exceptAll(want.select(*back.columns)).count() == 0
    assert back.where("value is null").count() == 6 * 40
    low = raster.cells_of(raster.read_blocks(files, factor=2, rows=(3, 9)), rows=(3, 9)).join(files, "path")
    mean = cells.groupBy("file", "band", F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg("value").alias("mean"))
    both = low.join(mean, ["file", "band", "row", "col"])
    assert both.count() == 6 * 7 * 20 and both.where(F.abs(F.col("value") - F.col("mean")) > (0.51 if dtype == "i2" else 1e-4)).count() == 0
    one = files.first()["path"]
    raster.register(spark)
    assert spark.read.format("tiletiff").option("factor", "4").load(one).count() == 2 * 13 * 10


def test_files_of_failed_jobs_do_not_count(spark, tmp_path):
    uri, cells = f"file://{tmp_path}/out", grid(spark)
    raster.write_tiles(cells.where("file = 't0'"), uri, height=50, width=40, bands=2, block=16)
    with pytest.raises(Exception, match="outside the raster"):
        raster.write_tiles(cells.withColumn("row", F.when(F.col("file") == "t1", F.col("row") + 900).otherwise(F.col("row"))), uri, height=50, width=40, bands=2, block=16)
    assert [r["file"] for r in raster.committed_files(spark, uri).collect()] == ["t0"]
    raster.write_tiles(cells.where("file = 't1'"), uri, height=50, width=40, bands=2, block=16)
    assert sorted(r["file"] for r in raster.committed_files(spark, uri).collect()) == ["t0", "t1"]
    assert raster.write_tiles(cells.where("false"), f"{uri}-none", height=50, width=40, bands=2, block=16).collect() == []
