"""A sink for shapefiles: polygons with their attributes, a set of files for each name.

``write_shapefiles`` takes rows with a name, the parts of a polygon and any other columns, which become
attributes under ten-character names: whole numbers, numbers and texts of at most 254 bytes.  A task writes whole
sets under a staging name, record after record, to the shapes, their index and the table at once; headers are
patched when the last one is known.  The commit renames the sets, so a failed task leaves none.  The folder is one
that all executors mount.
"""

from __future__ import annotations

import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegralType, StructType

# The polygon type, the widest text of the table, and the text of the reference system.
POLYGON, TEXT_BYTES, NAME_CHARS = 5, 254, 10
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
ENDINGS = (".shp", ".shx", ".dbf", ".prj", ".cpg")


def field_names(names: list[str]) -> list[str]:
    """Safe names of at most ten characters, no two alike: those that would be end in a number."""
    out: list[str] = []
    for name in names:
        safe = re.sub(r"\W", "_", name, flags=re.ASCII)[:NAME_CHARS]
        safe = "_" + safe[: NAME_CHARS - 1] if safe[:1].isdigit() else safe or "field"
        k, made = 1, safe
        while made in out:
            made, k = f"{safe[: NAME_CHARS - len(str(k)) - 1]}_{k}", k + 1
        out.append(made)
    return out


def _turned(ring: list, clockwise: bool) -> list:
    """A closed ring that runs as asked."""
    ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
    return ring if (area < 0) == clockwise else ring[::-1]


def shape_record(parts: list) -> tuple[bytes, tuple[float, float, float, float]]:
    """The content of a polygon record and its box: outlines clockwise, holes the other way."""
    rings = [_turned(r, k == 0) for part in parts for k, r in enumerate(part)]
    points = [p for r in rings for p in r]
    x, y = [p[0] for p in points], [p[1] for p in points]
    box = min(x), min(y), max(x), max(y)
    starts, at = [], 0
    for r in rings:
        starts.append(at)
        at += len(r)
    flat = [v for p in points for v in p[:2]]
    return struct.pack(f"<i4d2i{len(starts)}i{len(flat)}d", POLYGON, *box, len(rings), len(points), *starts, *flat), box


class _Set:
    """Shapes, index and table that are written together."""

    def __init__(self, stem: str, schema: list[tuple[str, str]]):
        self.schema, self.n, self.at, self.box = schema, 0, 100, None
        self.shp, self.shx, self.dbf = (open(stem + e, "wb") for e in ENDINGS[:3])  # noqa: SIM115
        for f in (self.shp, self.shx):
            f.write(b"\0" * 100)
        self.dbf.write(self._table())
        for ending, text in ((".prj", WGS84), (".cpg", "UTF-8")):
            with open(stem + ending, "w") as f:
                f.write(text)

    def _table(self) -> bytes:
        """The table's header: a fixed width for each kind of column."""
        width = {"N": 20, "F": 24, "C": TEXT_BYTES}
        fields = b"".join(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width[kind], 15 if kind == "F" else 0) for name, kind in self.schema)
        self.row = 1 + sum(width[kind] for _, kind in self.schema)
        return struct.pack("<4BIHH20x", 3, 100, 1, 1, self.n, 32 + len(fields) + 1, self.row) + fields + b"\r"

    def add(self, parts: list, values: list) -> None:
        content, box = shape_record(parts)
        self.n += 1
        self.shp.write(struct.pack(">2i", self.n, len(content) // 2) + content)
        self.shx.write(struct.pack(">2i", self.at // 2, len(content) // 2))
        self.at += 8 + len(content)
        if self.at >= 1 << 31:
            raise ValueError("a shapefile has at most 2 GB: use more names")
        self.box = box if self.box is None else (*map(min, self.box[:2], box[:2]), *map(max, self.box[2:], box[2:]))
        cells = []
        for (_, kind), v in zip(self.schema, values, strict=True):
            if kind == "C":
                text = ("" if v is None else str(v)).encode()[:TEXT_BYTES].decode(errors="ignore").encode()
                cells.append(text.ljust(TEXT_BYTES))
            else:
                cells.append(("" if v is None else f"{v:d}" if kind == "N" else f"{v:.15g}").encode().rjust(20 if kind == "N" else 24))
        self.dbf.write(b" " + b"".join(cells))

    def close(self) -> None:
        for f, size in ((self.shp, self.at), (self.shx, 100 + 8 * self.n)):
            f.seek(0)
            f.write(struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i4d32x", 1000, POLYGON, *(self.box or (0.0, 0.0, 0.0, 0.0))))
            f.close()
        self.dbf.write(b"\x1a")
        self.dbf.seek(0)
        self.dbf.write(self._table())
        self.dbf.close()


@dataclass
class Written(WriterCommitMessage):
    sets: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.folder = options["path"].removeprefix("file://")
        self.staging = os.path.join(self.folder, f".staging-{uuid.uuid4().hex}")
        self.columns = [f.name for f in schema.fields if f.name not in ("file", "parts")]
        kinds = ["N" if isinstance(f.dataType, IntegralType) else "F" if isinstance(f.dataType, DoubleType | FloatType) else "C" for f in schema.fields if f.name in self.columns]
        self.schema = list(zip(field_names(self.columns), kinds, strict=True))

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        name, made, done = None, None, []
        for r in iterator:
            if made is None or r.file != name:
                if made:
                    made.close()
                name, stem = r.file, os.path.join(self.staging, uuid.uuid4().hex)
                done.append((stem, name))
                made = _Set(stem, self.schema)
            made.add(r.parts, [r[c] for c in self.columns])
        if made:
            made.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for stem, name in m.sets if m else []:
                for ending in ENDINGS:
                    os.replace(stem + ending, os.path.join(self.folder, name + ending))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def write_shapefiles(shapes: DataFrame, folder: str) -> None:
    """Rows (file, parts, attributes) as shapefiles; rows without parts have no place in them and are left out."""
    spark = shapes.sparkSession
    spark.dataSource.register(Shapefile)
    rows = shapes.where("size(parts) > 0").repartition("file").sortWithinPartitions("file")
    rows.write.format("shapefile").mode("append").save(folder)
