"""TIFF files as bytes: directories, blocks, codecs and predictors, classic and BigTIFF.

Reading takes one directory (a level) and one block at a time by offset, so a reader fetches only
the blocks that it is asked for. Writing lays a whole cloud-optimised file out from compressed
blocks: structural metadata, directories from the full level down, then the blocks of the
coarsest level first.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# TIFF tags, field types and compression schemes.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, BANDS, ROWS, COUNTS, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, ZSTD = 1, 5, 8, 32946, 50000
SCHEMES = {"none": PLAIN, "lzw": LZW, "deflate": DEFLATE, "zstd": ZSTD}
#: Codes of LZW: clear, end of data, the first of a string.
CLEAR, END, FIRST = 256, 257, 258
#: Structural metadata that tells readers the block order, and that a block has its size before and its last bytes again behind it.
GHOST = b"LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\nBLOCK_LEADER=SIZE_AS_UINT4\nBLOCK_TRAILER=LAST_4_BYTES_REPEATED\nKNOWN_INCOMPATIBLE_EDITION=NO\n "


def lzw_decode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, each width left one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    start = [bytes([b]) for b in range(256)] + [b"", b""]
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == CLEAR:
            table, width, last = start.copy(), 9, None
            continue
        if code == END:
            break
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, word = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    code_of = lambda w: w[0] if len(w) == 1 else table[w]
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code_of(word))
        table[longer] = FIRST + len(table)
        # the reader is one string behind
        if FIRST + len(table) == 4095:
            put(CLEAR)
            table, width = {}, 9
        elif FIRST + len(table) == 1 << width:
            width += 1
        word = raw[k : k + 1]
    if word:
        put(code_of(word))
        # the reader adds a string for this code too
        if FIRST + len(table) + 1 == 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack(raw: bytes, scheme: int) -> bytes:
    if scheme == PLAIN:
        return raw
    if scheme == LZW:
        return lzw_decode(raw)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if scheme == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"compression scheme {scheme}")


def pack(raw: bytes, scheme: int) -> bytes:
    if scheme == PLAIN:
        return raw
    if scheme == LZW:
        return lzw_encode(raw)
    if scheme == ZSTD:
        import zstandard

        return zstandard.ZstdCompressor(level=9).compress(raw)
    return zlib.compress(raw, 6)


def undo_predictor(raw: bytes, kind: int, dtype: np.dtype, shape: tuple[int, int, int]) -> np.ndarray:
    """Values (rows, columns, bands) of decompressed bytes."""
    rows, cols, bands = shape
    size = dtype.itemsize
    if kind == 3:
        # bytes of a row by significance, most significant first, then differences of bytes
        planes = np.frombuffer(raw, "u1", rows * cols * bands * size).reshape(rows, cols * size, bands).cumsum(axis=1, dtype="u1")
        values = np.ascontiguousarray(planes.reshape(rows, size, cols * bands).transpose(0, 2, 1))
        return values.view(dtype.newbyteorder(">")).reshape(shape)
    v = np.frombuffer(raw, dtype, rows * cols * bands).reshape(shape)
    if kind == 2:
        whole = np.dtype(f"u{size}")
        native = v.view(np.dtype(f"{dtype.str[0].replace('|', '=')}u{size}")).astype(whole)
        return native.cumsum(axis=1, dtype=whole).view(dtype.newbyteorder("="))
    return v


def apply_predictor(v: np.ndarray, kind: int) -> bytes:
    rows, cols, bands = v.shape
    size = v.dtype.itemsize
    if kind == 3:
        planes = np.ascontiguousarray(v.astype(v.dtype.newbyteorder(">"))).view("u1").reshape(rows, cols * bands, size).transpose(0, 2, 1).reshape(rows, cols * size, bands)
        return np.diff(planes, axis=1, prepend=np.zeros((rows, 1, bands), "u1")).astype("u1").tobytes()
    if kind == 2:
        whole = np.ascontiguousarray(v).view(f"u{size}")
        return np.diff(whole, axis=1, prepend=np.zeros((rows, 1, bands), whole.dtype)).astype(f"<u{size}").tobytes()
    return np.ascontiguousarray(v).astype(v.dtype.newbyteorder("<")).tobytes()


@dataclass
class Level:
    """One directory: the full raster or an overview."""

    tags: dict[int, tuple]
    end: str
    width: int = field(init=False)

    def __post_init__(self):
        one = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bands = one(WIDTH), one(HEIGHT), one(BANDS, 1)
        self.scheme, self.predictor, self.planar = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1)
        kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
        self.dtype = np.dtype(f"{self.end}{kind}{one(BITS, 8) // 8}")
        self.tiled = TILE_OFFSETS in self.tags
        self.bw, self.bh = (one(TILE_W), one(TILE_H)) if self.tiled else (self.width, min(one(ROWS, self.height), self.height))
        self.offsets, self.counts = (self.tags[t] for t in ((TILE_OFFSETS, TILE_COUNTS) if self.tiled else (OFFSETS, COUNTS)))
        self.across, self.down = -(-self.width // self.bw), -(-self.height // self.bh)
        raw = self.tags.get(NODATA)
        self.nodata = float(bytes(raw).split(b"\0")[0]) if raw else None

    @property
    def overview(self) -> bool:
        return bool(self.tags.get(SUBFILE, (0,))[0] & 1)

    def blocks_of(self, rows: tuple[int, int], cols: tuple[int, int]) -> list[int]:
        """Blocks (of one band's grid) that a window of rows and columns meets, both ends included."""
        r = range(max(rows[0], 0) // self.bh, min(rows[1], self.height - 1) // self.bh + 1)
        c = range(max(cols[0], 0) // self.bw, min(cols[1], self.width - 1) // self.bw + 1)
        return [i * self.across + j for i in r for j in c]


class Tiff:
    """Levels and blocks of a file that has seek and read."""

    def __init__(self, file):
        self.file = file
        head = self._at(0, 16)
        self.end = {b"II": "<", b"MM": ">"}[head[:2]]
        magic = struct.unpack(self.end + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        self.at = struct.unpack(self.end + "Q", head[8:16])[0] if self.big else struct.unpack(self.end + "I", head[4:8])[0]
        self._levels: list[Level] = []

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def levels(self) -> list[Level]:
        """The directories in the file's order; masks and other subfiles are left out."""
        at = self.at if not self._levels else 0
        short, entry, word, code = (8, 20, 8, "Q") if self.big else (2, 12, 4, "I")
        while at:
            n = struct.unpack(self.end + ("Q" if self.big else "H"), self._at(at, short))[0]
            table, tags = self._at(at + short, n * entry + word), {}
            for k in range(n):
                tag, typ, count = struct.unpack_from(f"{self.end}HH{code}", table, k * entry)
                size = SIZES.get(typ, 1) * count
                raw = table[k * entry + entry - word :][:word]
                raw = raw[:size] if size <= word else self._at(struct.unpack(self.end + code, raw)[0], size)
                if typ == 2 or typ == 7:
                    tags[tag] = tuple(raw)
                elif typ in CODES:
                    tags[tag] = struct.unpack(f"{self.end}{count}{CODES[typ]}", raw)
            if not tags.get(SUBFILE, (0,))[0] & ~1:
                self._levels.append(Level(tags, self.end))
            at = struct.unpack(self.end + code, table[n * entry :])[0]
        return self._levels

    def level_for(self, factor: float) -> Level:
        """The coarsest level whose cells are at most `factor` times as wide as those of the full one."""
        full = self.levels()[0]
        fit = [x for x in self.levels() if x.bands == full.bands and x.dtype == full.dtype and round(full.width / x.width) <= factor]
        return min(fit or [full], key=lambda x: x.width)

    def block(self, level: Level, k: int) -> tuple[int, int, np.ndarray]:
        """First row, first column and values (rows, columns, bands) of block k of a level's grid."""
        r0, c0 = k // level.across * level.bh, k % level.across * level.bw
        rows = level.bh if level.tiled else min(level.bh, level.height - r0)
        planes = [k] if level.planar == 1 else [b * level.across * level.down + k for b in range(level.bands)]
        shape = (rows, level.bw, level.bands if level.planar == 1 else 1)
        empty = np.full(shape, level.nodata or 0, level.dtype)
        # a block of no bytes is all nodata
        parts = [undo_predictor(unpack(self._at(level.offsets[p], level.counts[p]), level.scheme), level.predictor, level.dtype, shape) if level.counts[p] else empty for p in planes]
        v = parts[0] if len(parts) == 1 else np.concatenate(parts, axis=2)
        return r0, c0, v[: level.height - r0, : level.width - c0]


@dataclass
class Grid:
    """One level to be written: its size and its compressed blocks by (block row, block column)."""

    height: int
    width: int
    blocks: dict[tuple[int, int], bytes]


def layout(levels: list[Grid], dtype: np.dtype, bands: int, block: int, scheme: int, predictor: int, nodata: float | None = None, origin: tuple[float, float, float] | None = None, big: bool | None = None) -> list[bytes]:
    """The pieces of a cloud-optimised file in order; levels from the full one down, origin (x0, y0, cell size)."""
    size = sum(len(b) + 8 for g in levels for b in g.blocks.values())
    big = size > 3 << 30 if big is None else big
    short, entry, word, code = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    ghost = b"GDAL_STRUCTURAL_METADATA_SIZE=%06d bytes\n" % len(GHOST) + GHOST
    start = (16 if big else 8) + len(ghost)
    start += start % 2
    grids = [[(i, j) for i in range(-(-g.height // block)) for j in range(-(-g.width // block))] for g in levels]

    def tags_of(k: int, offsets: list[int]) -> list[tuple[int, int, list]]:
        g, kind = levels[k], {"u": 1, "i": 2, "f": 3}[dtype.kind]
        found = [(SUBFILE, 4, [1 if k else 0]), (WIDTH, 4, [g.width]), (HEIGHT, 4, [g.height]), (BITS, 3, [dtype.itemsize * 8] * bands), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1]), (BANDS, 3, [bands]), (PLANAR, 3, [1])]
        found += [(PREDICTOR, 3, [predictor]), (TILE_W, 3, [block]), (TILE_H, 3, [block]), (TILE_OFFSETS, 16 if big else 4, offsets), (TILE_COUNTS, 4, [len(g.blocks.get(c, b"")) for c in grids[k]]), (FORMAT, 3, [kind] * bands)]
        if origin is not None and k == 0:
            found += [(PIXEL_SCALE, 12, [origin[2], origin[2], 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0])]
        if nodata is not None:
            found += [(NODATA, 2, list(f"{nodata:.17g}".encode() + b"\0"))]
        return found

    def directory(k: int, at: int, offsets: list[int], following: int) -> bytes:
        tags = tags_of(k, offsets)
        table, extra, base = struct.pack("<Q" if big else "<H", len(tags)), b"", at + short + entry * len(tags) + word
        for tag, typ, vals in tags:
            raw = bytes(vals) if typ == 2 else struct.pack(f"<{len(vals)}{CODES[typ]}", *vals)
            place = raw.ljust(word, b"\0") if len(raw) <= word else struct.pack("<" + code, base + len(extra))
            extra += raw + b"\0" * (-len(raw) % 8) if len(raw) > word else b""
            table += struct.pack(f"<HH{code}", tag, typ, len(vals)) + place
        out = table + struct.pack("<" + code, following) + extra
        return out + b"\0" * (len(out) % 2)

    sizes = [len(directory(k, 0, [0] * len(grids[k]), 0)) for k in range(len(levels))]
    starts = [start + sum(sizes[:k]) for k in range(len(levels))]
    at, offsets, data = start + sum(sizes), {}, []
    for k in reversed(range(len(levels))):
        for c in grids[k]:
            raw = levels[k].blocks.get(c)
            if raw:
                offsets[k, c] = at + 4
                data.append(struct.pack("<I", len(raw)) + raw + raw[-4:].rjust(4, b"\0"))
                at += len(raw) + 8
    head = (struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start)) + ghost
    out = [head.ljust(start, b"\0")]
    for k in range(len(levels)):
        out.append(directory(k, starts[k], [offsets.get((k, c), 0) for c in grids[k]], starts[k + 1] if k + 1 < len(levels) else 0))
    return out + data
