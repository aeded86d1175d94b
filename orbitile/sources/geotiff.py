"""GeoTIFF files as a data source: tiled, of several bands, with their overviews, read by tiles.

``spark.read.format("geotiff").load(folder)`` gives a row a tile: file, level (1 is the full grid), band (from 1),
br, bc, height, width and cells.  Only the directories of the files are read to plan; a partition is a run of
tiles of a file, of which a task reads the bytes of the tiles that it needs.  Filters on file, level, band, br and bc
leave out tiles before any partition is made (with spark.sql.python.filterPushdown.enabled).

``df.write.format("geotiff").mode("append").save(folder)`` writes blocks with the same columns, rows of one file together.  A task
writes whole files under a staging name, tile after tile, holding their places only; the commit renames them, so
a failed or repeated task leaves none.  The folder is one that all executors mount.

Tiles are deflated; the files are BigTIFF where an option says so or their cells could exceed 4 GB.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "file string, level int, band int, br int, bc int, height int, width int, cells array<double>"
#: Tiles of a partition, at most.
TILES = 64
# Tags of the format, and their types' codes and sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR = 256, 257, 258, 259, 262, 277, 284
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, KIND = 322, 323, 324, 325, 339, 254
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d", 16: "Q"}
NONE, DEFLATE = 1, 8


def _entry(tag: int, kind: int, values: list, big: bool, at: int) -> tuple[bytes, bytes]:
    """A directory entry, and what it puts behind the directory, at ``at``."""
    data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
    head = struct.pack("<HHQ" if big else "<HHI", tag, kind, len(values))
    room = 8 if big else 4
    if len(data) <= room:
        return head + data.ljust(room, b"\0"), b""
    return head + struct.pack("<Q" if big else "<I", at), data + b"\0" * (len(data) % 2)


def _directory(tags: dict[int, tuple[int, list]], big: bool, at: int, last: bool) -> bytes:
    """A directory at a place of the file, with its values behind it; the next one follows at once."""
    size = (8 + 20 * len(tags) + 8) if big else (2 + 12 * len(tags) + 4)
    entries, behind = b"", b""
    for tag in sorted(tags):
        entry, data = _entry(tag, *tags[tag], big, at + size + len(behind))
        entries, behind = entries + entry, behind + data
    following = 0 if last else at + size + len(behind)
    return struct.pack("<Q" if big else "<H", len(tags)) + entries + struct.pack("<Q" if big else "<I", following) + behind


class _File:
    """A file that is written tile by tile."""

    def __init__(self, path: str, options: dict):
        self.out = open(path, "wb")  # noqa: SIM115
        self.block, self.big = int(options.get("block", 512)), options.get("bigtiff", "false") == "true"
        self.dtype = np.dtype(options.get("dtype", "float32")).newbyteorder("<")
        self.options, self.tiles = options, {}
        self.shape: dict[int, tuple[int, int]] = {}
        self.out.write(b"\0" * 16)

    def add(self, level: int, band: int, br: int, bc: int, height: int, width: int, cells: list) -> None:
        tile = np.full((self.block, self.block), np.nan, self.dtype)
        h, w = min(self.block, height - br * self.block), min(self.block, width - bc * self.block)
        tile[:h, :w] = np.array(cells, float).reshape(h, w)
        data = zlib.compress(tile.tobytes(), 6)
        self.tiles[level, band, br, bc] = self.out.tell(), len(data)
        self.shape[level] = height, width
        self.out.write(data)

    def close(self) -> None:
        bands = max(b for _, b, _, _ in self.tiles)
        at = self.out.tell()
        at += at % 2
        self.out.seek(at)
        start, levels = at, sorted(self.shape)
        if not self.big and at + 64 * len(self.tiles) >= 1 << 32:
            raise ValueError("the file exceeds 4 GB: set the option bigtiff")
        for level in levels:
            height, width = self.shape[level]
            rows, cols = -(-height // self.block), -(-width // self.block)
            places = [self.tiles.get((level, b, i, j), (0, 0)) for b in range(1, bands + 1) for i in range(rows) for j in range(cols)]
            wide = 16 if self.big else 4
            tags = {
                KIND: (4, [0 if level == levels[0] else 1]), WIDTH: (4, [width]), LENGTH: (4, [height]), BITS: (3, [self.dtype.itemsize * 8] * bands), COMPRESSION: (3, [DEFLATE]), PHOTOMETRIC: (3, [1]),
                SAMPLES: (3, [bands]), PLANAR: (3, [2]), TILE_WIDTH: (3, [self.block]), TILE_LENGTH: (3, [self.block]), TILE_OFFSETS: (wide, [p for p, _ in places]), TILE_BYTES: (wide, [n for _, n in places]),
                SAMPLE_FORMAT: (3, [3] * bands), NODATA: (2, b"nan\0"),
            }
            if "epsg" in self.options:
                x0, y0, step = (float(self.options[k]) for k in ("x0", "y0", "step"))
                tags |= {PIXEL_SCALE: (12, [step * level, step * level, 0.0]), TIEPOINT: (12, [0.0, 0.0, 0.0, x0, y0, 0.0]), GEO_KEYS: (3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, int(self.options["epsg"])])}
            made = _directory(tags, self.big, at, level == levels[-1])
            self.out.write(made)
            at += len(made)
        self.out.seek(0)
        self.out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if self.big else struct.pack("<2sHI", b"II", 42, start))
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.options, self.overwrite = options["path"].removeprefix("file://"), dict(options), overwrite
        self.staging = os.path.join(self.folder, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        name, file, done = None, None, []
        for r in iterator:
            if r.file != name:
                if file:
                    file.close()
                if r.file in [n for _, n in done]:
                    raise ValueError(f"the tiles of {r.file} do not stand together")
                name = r.file
                path = os.path.join(self.staging, f"{uuid.uuid4().hex}.tif")
                done.append((path, name))
                file = _File(path, self.options)
            file.add(r.level, r.band, r.br, r.bc, r.height, r.width, r.cells)
        if file:
            file.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite and os.path.isdir(self.folder):
            for old in os.listdir(self.folder):
                if old.endswith(".tif"):
                    os.remove(os.path.join(self.folder, old))
        for m in messages:
            for path, name in m.files if m else []:
                os.replace(path, os.path.join(self.folder, f"{name}.tif"))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def directories(path: str) -> list[dict[int, tuple]]:
    """The directories of a file: values by tag.  No cells are read."""
    out = []
    with open(path, "rb") as f:
        order, version = struct.unpack("<2sH", f.read(4))
        if order != b"II" or version not in (42, 43):
            raise ValueError(f"not a little-endian TIFF: {path}")
        big = version == 43
        if big:
            f.read(4)
        at = struct.unpack("<Q" if big else "<I", f.read(8 if big else 4))[0]
        while at:
            f.seek(at)
            n = struct.unpack("<Q" if big else "<H", f.read(8 if big else 2))[0]
            raw = f.read(n * (20 if big else 12))
            following = struct.unpack("<Q" if big else "<I", f.read(8 if big else 4))[0]
            tags = {}
            for k in range(n):
                size = 20 if big else 12
                tag, kind, count = struct.unpack("<HHQ" if big else "<HHI", raw[k * size : k * size + (12 if big else 8)])
                if kind not in TYPES:
                    continue
                value = raw[k * size + (12 if big else 8) : (k + 1) * size]
                need = count * struct.calcsize(f"<{TYPES[kind]}")
                if need > len(value):
                    f.seek(struct.unpack("<Q" if big else "<I", value)[0])
                    value = f.read(need)
                tags[tag] = struct.unpack(f"<{count}{TYPES[kind]}", value[:need])
            out.append(tags)
            at = following
    return out


@dataclass
class Tiles(InputPartition):
    path: str
    file: str
    #: (level, band, br, bc, height, width, offset, bytes) of each tile.
    tiles: list[tuple]
    block: tuple[int, int]
    dtype: str
    compression: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute[0] in ("file", "level", "band", "br", "bc"):
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, **of) -> bool:
        compare = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(name not in of or compare[kind](of[name], value) for name, kind, value in self.tests)

    def partitions(self) -> list[Tiles]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            stem, path = name.removesuffix(".tif"), os.path.join(self.folder, name)
            if not name.endswith(".tif") or not self._wanted(file=stem):
                continue
            found = directories(path)
            full = found[0][WIDTH][0]
            for tags in found:
                width, height, bands = tags[WIDTH][0], tags[LENGTH][0], tags.get(SAMPLES, (1,))[0]
                level, block = max(1, round(full / width)), (tags[TILE_LENGTH][0], tags[TILE_WIDTH][0])
                if bands > 1 and tags.get(PLANAR, (1,))[0] != 2 or tags[COMPRESSION][0] not in (NONE, DEFLATE):
                    raise ValueError(f"bands stand apart and tiles are deflated or plain in files of this source: {path}")
                rows, cols = -(-height // block[0]), -(-width // block[1])
                kind = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, (1,))[0]]
                places = [(b, i, j) for b in range(1, bands + 1) for i in range(rows) for j in range(cols)]
                tiles = [(level, b, i, j, height, width, at, n) for (b, i, j), at, n in zip(places, tags[TILE_OFFSETS], tags[TILE_BYTES], strict=True) if n and self._wanted(level=level, band=b, br=i, bc=j)]
                out += [Tiles(path, stem, tiles[k : k + TILES], block, f"<{kind}{tags[BITS][0] // 8}", tags[COMPRESSION][0]) for k in range(0, len(tiles), TILES)]
        return out

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), *[pa.int32()] * 6, pa.list_(pa.float64())]
        with open(partition.path, "rb") as f:
            for level, band, br, bc, height, width, at, n in partition.tiles:
                f.seek(at)
                data = f.read(n)
                cells = np.frombuffer(zlib.decompress(data) if partition.compression == DEFLATE else data, partition.dtype).reshape(partition.block)
                h, w = min(partition.block[0], height - br * partition.block[0]), min(partition.block[1], width - bc * partition.block[1])
                values = pa.array(cells[:h, :w].reshape(-1).astype(float), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array([0, h * w], pa.int32()), values)
                row = [partition.file, level, band, br, bc, height, width]
                yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(row, kinds, strict=False)], lists], names)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_geotiffs(blocks: DataFrame, folder: str, **options) -> None:
    """Blocks (file, level, band, ...) as files in a folder: each is written by one task, which holds a tile at a time."""
    register(blocks.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = blocks.select(*names).repartition("file").sortWithinPartitions("file", F.desc("level"), "band", "br", "bc")
    rows.write.format("geotiff").options(**options).mode("append").save(folder)


def read_geotiffs(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("geotiff").load(folder)


#: Bytes below which a file is too small to be whole, and bands of which a tile is read.
LEAST_BYTES, BANDS_TRIED = 1_024, 4


def file_status(path: str) -> str:
    """The first check that a file fails, else ok: there, not empty, not too small, readable, of some size, with bands, and a tile of each of the first bands."""
    if not os.path.exists(path):
        return "file_not_found"
    size = os.path.getsize(path)
    if size < LEAST_BYTES:
        return "file_too_small" if size else "empty_file"
    try:
        tags = directories(path)[0]
    except (ValueError, struct.error, IndexError, MemoryError, OverflowError, OSError):
        return "io_error"
    if not (tags.get(WIDTH, (0,))[0] and tags.get(LENGTH, (0,))[0]):
        return "zero-dim"
    bands = tags.get(SAMPLES, (0,))[0]
    if not bands:
        return "no_bands"
    each = len(tags[TILE_OFFSETS]) // bands
    with open(path, "rb") as f:
        for band in range(min(bands, BANDS_TRIED)):
            written = [k for k in range(band * each, (band + 1) * each) if tags[TILE_BYTES][k]]
            if not written:
                return f"band_{band + 1}_empty"
            f.seek(tags[TILE_OFFSETS][written[0]])
            data = f.read(tags[TILE_BYTES][written[0]])
            try:
                cells = zlib.decompress(data) if tags[COMPRESSION][0] == DEFLATE else data
            except zlib.error:
                return f"band_{band + 1}_read_error"
            if len(cells) != tags[TILE_WIDTH][0] * tags[TILE_LENGTH][0] * tags[BITS][0] // 8:
                return f"band_{band + 1}_read_error"
    return "ok"


def validated(files: DataFrame, folder: str) -> DataFrame:
    """Rows (file, ...) with ``status``: each task looks at its files, and reads a few tiles of them."""
    base = folder.removeprefix("file://")

    @F.arrow_udf("string")
    def status(names: pa.Array) -> pa.Array:
        return pa.array(["file_not_found" if n is None else file_status(os.path.join(base, f"{n}.tif")) for n in names.to_pylist()], pa.string())

    return files.withColumn("status", status(F.col("file")))
