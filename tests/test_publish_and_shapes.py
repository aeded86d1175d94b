"""Shapefiles read back byte by byte, and outputs published in one step."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from orbitile.sources import geotiff, publish, shapefile


def plain_shapes(stem):
    """(box, rings) of each record, by the index."""
    with open(f"{stem}.shp", "rb") as f:
        shp = f.read()
    with open(f"{stem}.shx", "rb") as f:
        shx = f.read()
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx)
    out = []
    for k in range(100, len(shx), 8):
        at, size = (2 * v for v in struct.unpack(">2i", shx[k : k + 8]))
        number, length = struct.unpack(">2i", shp[at : at + 8])
        assert (number, 2 * length) == (len(out) + 1, size)
        kind, *box = struct.unpack("<i4d", shp[at + 8 : at + 44])
        n, m = struct.unpack("<2i", shp[at + 44 : at + 52])
        starts = [*struct.unpack(f"<{n}i", shp[at + 52 : at + 52 + 4 * n]), m]
        flat = struct.unpack(f"<{2 * m}d", shp[at + 52 + 4 * n : at + 52 + 4 * n + 16 * m])
        points = list(zip(flat[::2], flat[1::2], strict=True))
        assert kind == 5 and at + 8 + size == at + 52 + 4 * n + 16 * m
        out.append((tuple(box), [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]))
    return out, struct.unpack("<4d", shp[36:68])


def plain_table(stem):
    with open(f"{stem}.dbf", "rb") as f:
        dbf = f.read()
    n, head, width = struct.unpack("<IHH", dbf[4:12])
    fields = [(dbf[k : k + 11].rstrip(b"\0").decode(), dbf[k + 16]) for k in range(32, head - 1, 32)]
    assert len(dbf) == head + n * width + 1
    rows = []
    for k in range(n):
        at, row = head + k * width + 1, []
        for _, size in fields:
            row.append(dbf[at : at + size].decode().strip())
            at += size
        rows.append(row)
    return [name for name, _ in fields], rows


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def test_shapefiles(spark, tmp_path):
    square, hole = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [1.0, 1.0]]
    rows = [(f"f{k % 2}", [[square, hole], [[[9.0, 9.0 + k], [10.0, 9.0], [9.0, 8.0]]]] if k % 3 else [[square]], k, k / 7, f"naïve {'é' * 200} {k}" if k else None) for k in range(11)]
    rows.append(("f0", None, 99, 1.0, "none"))
    df = spark.createDataFrame(rows, "file string, parts array<array<array<array<double>>>>, `long name of it` long, `2nd` double, `long name of that` string").repartition(3)
    shapefile.write_shapefiles(df, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(f"f{k}{e}" for k in range(2) for e in shapefile.ENDINGS)
    for f in range(2):
        shapes, box = plain_shapes(f"{tmp_path}/f{f}")
        names, table = plain_table(f"{tmp_path}/f{f}")
        assert names == ["long_name_", "_2nd", "long_nam_1"]
        assert sorted(int(r[0]) for r in table) == [k for k in range(11) if k % 2 == f] and box[:2] == (0.0, 0.0)
        for (own, rings), (k, number, text) in zip(shapes, table, strict=True):
            want = rows[int(k)]
            assert float(number) == pytest.approx(want[3], rel=1e-14) and (want[4] or "").startswith(text) and len(text.encode()) <= 254
            assert [len(r) for r in rings] == [5, 4, 4][: len(rings)] and len(rings) == (3 if int(k) % 3 else 1)
            assert area(rings[0]) == -16 and all(area(r) > 0 for r in rings[1:2]) and own[2:] == ((10.0, 9.0 + int(k)) if len(rings) > 1 else (4.0, 4.0))


def test_failed_shapes_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]]), ("a", [[[[0.0]]]])], "file string, parts array<array<array<array<double>>>>")
    with pytest.raises(Exception, match="index out of range"):
        shapefile.write_shapefiles(df, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_field_names():
    assert shapefile.field_names(["a b", "a-b", "a_b", "1", "", "x" * 30, "x" * 20]) == ["a_b", "a_b_1", "a_b_2", "_1", "field", "x" * 10, "x" * 8 + "_1"]


def folders(root):
    return sorted(n for n in os.listdir(root) if not n.endswith(".crc"))


def test_publish(spark, tmp_path):
    root, scratch = f"{tmp_path}/out", f"{tmp_path}/scratch"
    spark.range(5).write.parquet(scratch)
    first = publish.publish(spark, {"a": spark.range(10), "b": spark.range(3)}, root)
    assert folders(root) == ["CURRENT.json", first] and publish.read(spark, root, "a").count() == 10
    # stopped before the switch: readers and intermediates are as before
    version, counted = publish.stage(spark, {"a": spark.range(20)}, root)
    publish.validate(spark, root, version, counted)
    assert publish.read(spark, root, "a").count() == 10 and os.path.isdir(scratch)
    second = publish.publish(spark, {"a": spark.range(30)}, root, intermediates=(scratch,))
    assert folders(root) == ["CURRENT.json", second] and publish.read(spark, root, "a").count() == 30 and not os.path.isdir(scratch)
    # stopped after the switch: the next clearing removes what is left
    version, counted = publish.stage(spark, {"a": spark.range(7)}, root)
    publish.switch(spark, root, version, counted)
    assert publish.read(spark, root, "a").count() == 7 and second in folders(root)
    publish.clear(spark, root)
    assert folders(root) == ["CURRENT.json", version]


def test_a_broken_version_is_not_published(spark, tmp_path):
    root = f"{tmp_path}/out"
    with pytest.raises(ValueError):
        publish.read(spark, root, "a")
    kept = publish.publish(spark, {"a": spark.range(10)}, root)
    version, counted = publish.stage(spark, {"a": spark.range(100).repartition(4)}, root)
    part = next(n for n in os.listdir(f"{root}/{version}/a") if n.startswith("part-"))
    os.remove(f"{root}/{version}/a/{part}")
    with pytest.raises(ValueError, match="not written whole"):
        publish.validate(spark, root, version, counted)
    assert publish.read(spark, root, "a").count() == 10 and folders(root) == ["CURRENT.json", kept]


def test_file_checks(spark, tmp_path):
    full = spark.createDataFrame([(f"r{k}", 1, b, 0, 0, 20, 20, [float(i * k % 97) for i in range(400)]) for k in range(3) for b in (1, 2)], geotiff.SCHEMA)
    geotiff.write_geotiffs(full.withColumn("cells", F.transform("cells", lambda x: x + F.rand(3))), str(tmp_path), block=32)
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "small.tif").write_bytes(b"II*\0")
    (tmp_path / "other.tif").write_bytes(b"MM" * 2000)
    data = bytearray((tmp_path / "r2.tif").read_bytes())
    data[20:200] = b"\0" * 180  # in the first tile
    (tmp_path / "r2.tif").write_bytes(bytes(data))
    names = spark.createDataFrame([(n,) for n in ("r0", "r1", "r2", "empty", "small", "other", "none", None)], "file string")
    got = {r.file: r.status for r in geotiff.validated(names, str(tmp_path)).collect()}
    assert got == {"r0": "ok", "r1": "ok", "r2": "band_1_read_error", "empty": "empty_file", "small": "file_too_small", "other": "io_error", "none": "file_not_found", None: "file_not_found"}
