"""Shapes, coverage, warps and raster files against plain versions."""

import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitile.functions import geo
from orbitile.operators import blocks as bk
from orbitile.operators import polygons, warp
from orbitile.sources import geotiff
from tests.test_blocks import as_blocks, as_grids

RING = [[0, 0], [4, 0], [4, 4], [0, 0]]
TEXTS = {
    '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}}': ("polygon", None),
    '{"type":"FeatureCollection","features":[{"geometry":{"coordinates":[[[0,0],[4,0],[4,4]]]}}]}': ("polygon", None),
    '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}': ("polygon", None),
    '{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4]]],[[[5,5],[6,5],[6,6]]]]}': ("polygons", None),
    '{"coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}': ("polygon", None),
    "GEE_BBOX: 1, 2 3,4": ("box", None),
    '{"bbox":[1,2,3,4]}': ("box", None),
    '{"bbox":[1,2,3]}': (None, "bbox of other than four numbers"),
    '{"type":"Point","coordinates":[1,2]}': (None, "no geometry"),
    '{"coordinates":[[[0,0],[4,null],[4,4]]]}': (None, "no geometry"),
    '{"coordinates":[]}': (None, "no geometry"),
    "1,2,3,x": (None, "no geometry"),
    "[1,2]": (None, "no geometry"),
    "": (None, "no geometry"),
}


def test_shapes(spark):
    rows = spark.createDataFrame([*((k,) for k in TEXTS), (None,)], "text string")
    got = {r.text: r for r in polygons.read_shapes(rows).collect()}
    for text, (kind, error) in [*TEXTS.items(), (None, (None, "no geometry"))]:
        assert (got[text].kind, got[text].error, got[text].parts is None) == (kind, error, error is not None)
    assert got['{"bbox":[1,2,3,4]}'].parts == got["GEE_BBOX: 1, 2 3,4"].parts == [[[[1, 2], [3, 2], [3, 4], [1, 4], [1, 2]]]]
    assert polygons.read_shapes(rows.where("false")).count() == 0


def inside(parts, x, y):
    n = 0
    for ring in (r for p in parts for r in p):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x
    return n % 2 == 1


def test_coverage_and_clip(spark):
    rng = np.random.default_rng(8)
    shapes = [(k, [[rng.uniform(-3, 14, (7, 2)).tolist(), rng.uniform(2, 9, (4, 2)).tolist()], [rng.uniform(0, 11, (3, 2)).tolist()]]) for k in range(6)]
    shapes += [(6, [[[[0.5, 0.5], [5.5, 0.5], [5.5, 5.5], [0.5, 5.5]]]]), (7, [[[[20.0, 20.0], [30.0, 20.0], [25.0, 30.0]]]])]
    df = spark.createDataFrame(shapes, f"chip long, parts {polygons.PARTS}")
    runs = polygons.coverage(df, 11, 12, key="chip")
    covered = {(r.chip, r.row, c) for r in runs.collect() for c in range(r.col_from, r.col_to + 1)}
    want = {(k, i, j) for k, parts in shapes for i in range(11) for j in range(12) if inside(parts, j + 0.5, i + 0.5)}
    assert covered == want and {k for k, _, _ in want} >= {0, 6}
    grids = [np.full((11, 12), k + 1.0) for k in range(8)]
    got = as_grids(polygons.clip_blocks(as_blocks(spark, grids, 5), runs, key="chip", block=5), 8, (11, 12), 5)
    assert {(k, i, j) for k in range(8) for i, j in zip(*np.nonzero(~np.isnan(got[k])), strict=True)} == want


def test_series_agree(spark):
    lon, lat = np.array([35.4, 33.1, 38.9]), np.array([31.6, -12.0, 60.0])
    east, north = warp.to_utm(lon, lat, 36, True)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], "lon double, lat double")
    x, y = geo.utm(F.col("lon"), F.col("lat"), F.lit(36), F.lit(True))
    assert np.allclose(sorted((r.x, r.y) for r in rows.select(x.alias("x"), y.alias("y")).collect()), sorted(zip(east, north, strict=True)), atol=1e-6)
    assert np.allclose(warp.to_lonlat(east, north, 36, True), (lon, lat), atol=1e-9)


def test_warp(spark):
    grid = warp.Grid(36, True, 700_000.0, 3_500_000.0, 30.0, 23, 19)
    rng = np.random.default_rng(9)
    cells = np.where(rng.random((23, 19)) < 0.95, rng.random((23, 19)), np.nan)
    source = as_blocks(spark, [cells], 8)
    same = as_grids(warp.reproject(source, grid, grid, keys=["chip"], block=8), 1, (23, 19), 8)[0]
    assert np.allclose(np.where(np.isnan(cells), 0.0, same), np.nan_to_num(cells), atol=1e-4)  # the series are good to a millimetre
    # there and back again, a smooth surface stays, whatever the blocks
    i, j = np.mgrid[:40, :40]
    smooth = np.sin(i / 9.0) + np.cos(j / 11.0)
    a, b = warp.Grid(36, True, 720_000.0, 3_510_000.0, 1_000.0, 40, 40), warp.Grid(37, True, 145_000.0, 3_516_000.0, 1_000.0, 52, 52)
    for block, method in ((16, "cubic"), (9, "cubic"), (16, "linear")):
        there = warp.reproject(as_blocks(spark, [smooth], block), a, b, keys=["chip"], block=block, method=method)
        back = as_grids(warp.reproject(there, b, a, keys=["chip"], block=block, method=method), 1, (40, 40), block)[0]
        assert np.nanmax(np.abs(back - smooth)[4:-4, 4:-4]) < (0.002 if method == "cubic" else 0.02) and not np.isnan(back[4:-4, 4:-4]).any()
    far = warp.Grid(36, True, 100_000.0, 100_000.0, 30.0, 8, 8)
    assert warp.reproject(source, grid, far, keys=["chip"], block=8).count() == 0


def plain_tiff(path):
    """(tags, tiles) of each directory, read without the source."""
    with open(path, "rb") as f:
        data = f.read()
    big = struct.unpack("<H", data[2:4])[0] == 43
    at = struct.unpack("<Q", data[8:16])[0] if big else struct.unpack("<I", data[4:8])[0]
    out = []
    while at:
        n = struct.unpack("<Q" if big else "<H", data[at : at + (8 if big else 2)])[0]
        base, size, tags = at + (8 if big else 2), 20 if big else 12, {}
        for k in range(n):
            raw = data[base + k * size : base + (k + 1) * size]
            tag, kind, count = struct.unpack("<HHQ" if big else "<HHI", raw[: 12 if big else 8])
            form = {2: "c", 3: "H", 4: "I", 12: "d", 16: "Q"}[kind]
            value, need = raw[12 if big else 8 :], count * struct.calcsize(form)
            if need > len(value):
                place = struct.unpack("<Q" if big else "<I", value)[0]
                value = data[place : place + need]
            tags[tag] = struct.unpack(f"<{count}{form}", value[:need])
        assert sorted(tags) == list(tags)
        out.append((tags, [zlib.decompress(data[a : a + b]) for a, b in zip(tags[324], tags[325], strict=True) if b]))
        at = struct.unpack("<Q" if big else "<I", data[base + n * size : base + n * size + (8 if big else 4)])[0]
    return out


def rasters(spark, grids, block=16):
    full = as_blocks(spark, grids, block).withColumn("band", F.lit(1))
    coarse = bk.overviews(full, (2, 4), keys=["chip", "band"], block=block)
    return full.withColumn("level", F.lit(1)).unionByName(coarse).withColumn("file", F.concat(F.lit("r"), F.col("chip").cast("string")))


@pytest.mark.parametrize("big", ["false", "true"])
def test_files(spark, tmp_path, big):
    rng = np.random.default_rng(4)
    grids = [np.where(rng.random((37, 50)) < 0.9, rng.random((37, 50)), np.nan) for _ in range(3)]
    geotiff.write_geotiffs(rasters(spark, grids), str(tmp_path), block=16, dtype="float64", bigtiff=big, epsg=32636, x0=5.0, y0=7.0, step=10.0)
    assert sorted(os.listdir(tmp_path)) == ["r0.tif", "r1.tif", "r2.tif"]
    tags, tiles = plain_tiff(f"{tmp_path}/r1.tif")[0]
    assert (tags[256], tags[257], tags[322], tags[259], tags[33550][:2], tags[33922][3:5]) == ((50,), (37,), (16,), (8,), (10.0, 10.0), (5.0, 7.0))
    assert tags[34735][-1] == 32636 and len(tiles) == 12
    assert np.array_equal(np.frombuffer(tiles[1], "<f8").reshape(16, 16), grids[1][:16, 16:32], equal_nan=True)
    assert [t[256][0] for t, _ in plain_tiff(f"{tmp_path}/r1.tif")] == [50, 25, 13]
    back = geotiff.read_geotiffs(spark, str(tmp_path))
    got = {(r.file, r.row, r.col): r.value for r in bk.to_pixels(back.where("level = 1"), keys=["file"], block=16).collect()}
    assert all(got[f"r{k}", i, j] == (None if math.isnan(g[i, j]) else g[i, j]) for k, g in enumerate(grids) for i in range(37) for j in range(50))
    # levels are the means of known cells
    half = {(r.row, r.col): r.value for r in bk.to_pixels(back.where("level = 2 AND file = 'r2'"), keys=["file"], block=16).collect()}
    assert half[18, 24] == pytest.approx(np.nanmean(grids[2][36:38, 48:50])) and len(half) == 19 * 25


def test_filters_leave_out_tiles(spark, tmp_path):
    geotiff.write_geotiffs(rasters(spark, [np.ones((64, 64))] * 4), str(tmp_path), block=16)
    reader = geotiff.Reader({"path": str(tmp_path)})
    everything = reader.partitions()
    assert sum(len(p.tiles) for p in everything) == 4 * (16 + 4 + 1)
    left = geotiff.Reader({"path": str(tmp_path)})
    kept = list(left.pushFilters([geotiff.EqualTo(("file",), "r2"), geotiff.EqualTo(("level",), 1), geotiff.GreaterThanOrEqual(("br",), 2), geotiff.In(("bc",), (0, 3)), geotiff.EqualTo(("height",), 64)]))
    assert len(kept) == 1 and [(t[2], t[3]) for p in left.partitions() for t in p.tiles] == [(2, 0), (2, 3), (3, 0), (3, 3)]
    some = geotiff.read_geotiffs(spark, str(tmp_path)).where("file = 'r2' AND level = 1 AND br >= 2 AND bc = 3")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 2
    assert geotiff.read_geotiffs(spark, str(tmp_path)).rdd.getNumPartitions() == len(everything)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    good = rasters(spark, [np.ones((20, 20))])
    bad = good.withColumn("cells", F.when(F.col("level") == 1, F.slice("cells", 1, 3)).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="reshape"):
        geotiff.write_geotiffs(bad, str(tmp_path), block=16)
    assert os.listdir(tmp_path) == []
    geotiff.write_geotiffs(good, str(tmp_path), block=16)
    assert os.listdir(tmp_path) == ["r0.tif"]
    (tmp_path / "x.tif").write_bytes(b"MM\0*" + b"\0" * 20)
    with pytest.raises(Exception, match="not a little-endian TIFF"):
        geotiff.read_geotiffs(spark, str(tmp_path)).count()
