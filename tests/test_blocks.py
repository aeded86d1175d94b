"""Blocked rasters against whole-grid versions, and what their exchange moves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitile.functions.indices import mosaic_indices
from orbitile.operators import blocks as bk
from orbitile.operators import mosaic, raster


def as_blocks(spark, grids, block):
    """Blocks of grids (NaN: no value), by number."""
    rows = [(k, i, j, None if math.isnan(g[i, j]) else float(g[i, j])) for k, g in enumerate(grids) for i in range(g.shape[0]) for j in range(g.shape[1])]
    h, w = grids[0].shape
    px = spark.createDataFrame(rows, "chip long, row int, col int, value double").repartition(3)
    return bk.to_blocks(px, keys=["chip"], value="value", height=h, width=w, block=block)


def as_grids(blocks, n, shape, block):
    out = [np.full(shape, np.nan) for _ in range(n)]
    for r in bk.to_pixels(blocks, keys=["chip"], block=block).collect():
        out[r.chip][r.row, r.col] = np.nan if r.value is None else r.value
    return out


def snake(h, w):
    """One component that runs through every other row."""
    g = np.zeros((h, w))
    g[::2] = 1
    for k, r in enumerate(range(1, h - 1, 2)):
        g[r, -1 if k % 2 == 0 else 0] = 1
    return g


def flood(grid):
    seen, groups = {}, []
    for start in zip(*np.nonzero(grid == 1), strict=True):
        if start in seen:
            continue
        stack, cells = [start], []
        while stack:
            p = stack.pop()
            if p in seen or not (0 <= p[0] < grid.shape[0] and 0 <= p[1] < grid.shape[1]) or grid[p] != 1:
                continue
            seen[p] = start
            cells.append(p)
            stack += [(p[0] + i, p[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        groups.append(cells)
    return groups


def test_labels_against_flood_fill():
    rng = np.random.default_rng(6)
    for grid in [*((rng.random((9, 7)) < p).astype(float) for p in (0.2, 0.5, 0.6, 0.8) for _ in range(10)), snake(9, 7), np.zeros((3, 3)), np.ones((3, 3))]:
        labels = bk.label_runs(grid == 1)
        assert (labels > 0).tolist() == (grid == 1).tolist()
        assert sorted(sorted(map(tuple, g)) for g in flood(grid)) == sorted(sorted(zip(*map(np.ndarray.tolist, np.nonzero(labels == k)), strict=True)) for k in range(1, labels.max() + 1))


def test_components_across_blocks(spark):
    """A snake through all blocks is one object; objects that cross corners only are two."""
    rng = np.random.default_rng(1)
    grids = [snake(13, 11), *((rng.random((13, 11)) < 0.55).astype(float) for _ in range(4)), np.zeros((13, 11))]
    grids[2][:, 3] = np.nan
    for least in (6, 60):
        got = as_grids(bk.remove_small(as_blocks(spark, grids, 4), least, keys=["chip"], block=4), len(grids), (13, 11), 4)
        for g, kept in zip(grids, got, strict=True):
            want = np.zeros(g.shape)
            for cells in flood(g):
                if len(cells) >= least:
                    for p in cells:
                        want[p] = 1
            assert (kept == want).all()


def test_connected(spark):
    rng = np.random.default_rng(2)
    pairs = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [tuple(map(int, 200 + rng.integers(0, 60, 2))) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.root for r in bk.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(x, x) == r for x, r in root.items())


@pytest.mark.parametrize("block", [5, 16])
def test_fill_and_ties(spark, block):
    rng = np.random.default_rng(3)
    grids = [np.where(rng.random((14, 17)) < p, rng.integers(1, 99, (14, 17)).astype(float), np.nan) for p in (0.02, 0.1, 0.5, 0.0)]
    got = as_grids(bk.fill_nearest(as_blocks(spark, grids, block), 5, keys=["chip"], block=block), 4, (14, 17), block)
    for g, filled in zip(grids, got, strict=True):
        known = list(zip(*np.nonzero(~np.isnan(g)), strict=True))
        for i in range(14):
            for j in range(17):
                near = min((((i - r) ** 2 + (j - c) ** 2, r, c) for r, c in known), default=None)
                want = g[near[1], near[2]] if near and near[0] <= 25 else np.nan
                assert filled[i, j] == want or math.isnan(filled[i, j]) and math.isnan(want)


@pytest.mark.parametrize("method", ["cubic", "linear"])
def test_resampling_does_not_depend_on_blocks(spark, method):
    rng = np.random.default_rng(4)
    grid = np.where(rng.random((11, 9)) < 0.9, rng.random((11, 9)), np.nan)
    whole, cut = (as_grids(bk.resample(as_blocks(spark, [grid], b), 3, keys=["chip"], block=b, method=method), 1, (33, 27), 3 * b)[0] for b in (16, 4))
    assert np.allclose(whole, cut, equal_nan=True) and np.isnan(whole).sum() < 40
    constant = as_grids(bk.resample(as_blocks(spark, [np.full((11, 9), 2.5)], 4), 3, keys=["chip"], block=4, method=method), 1, (33, 27), 12)[0]
    assert np.allclose(constant, 2.5)


def test_halo_is_held_and_small(spark):
    blocks = as_blocks(spark, [np.ones((64, 64))], 32)
    with pytest.raises(ValueError):
        bk.fill_nearest(blocks, 33, keys=["chip"], block=32)
    # cells that enter the exchange: of each block its own and its strips
    sent = []
    dealt = bk.by_runs

    def spy(rows, *rest):
        sent.append(rows.agg(F.sum(F.size("cells"))).first()[0])
        return dealt(rows, *rest)

    bk.by_runs = spy
    try:
        bk.close_mask(blocks, 1, keys=["chip"], block=32)
    finally:
        bk.by_runs = dealt
    assert 64 * 64 < sent[0] < 1.2 * 64 * 64


def test_closing_leaves_the_frame_open(spark):
    g = np.zeros((9, 9))
    g[0, 0] = g[0, 2] = g[4, 4] = 1
    got = as_grids(bk.close_mask(as_blocks(spark, [g], 4), 1, keys=["chip"], block=4), 1, (9, 9), 4)[0]
    d = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    grown = {(i + a, j + b) for i, j in zip(*np.nonzero(g), strict=True) for a, b in d}
    want = {(i, j) for i in range(9) for j in range(9) if all((i + a, j + b) in grown or not (0 <= i + a < 9 and 0 <= j + b < 9) for a, b in d)}
    assert {tuple(map(int, p)) for p in zip(*np.nonzero(got == 1), strict=True)} == {tuple(map(int, p)) for p in want}


def test_masks_without_values(spark):
    px = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, None), (2, 0, 0, 5.0), (2, 0, 1, 1.0), (3, 0, 0, 1.5), (3, 0, 1, 1.0)], "chip long, row int, col int, value double")
    out = {(r.chip, r.col): (r.threshold, r.mask) for r in raster.water_mask(px).collect()}
    assert out[1, 0] == (0.0, False) and out[2, 0][1] and not out[2, 1][1]
    scaled = {(r.chip, r.col): r.value for r in raster.scaled(px).collect()}
    assert scaled[2, 0] == 1.0 and scaled[2, 1] == pytest.approx(0.2) and scaled[3, 0] == 1.5 and scaled[1, 0] is None
    assert bk.to_blocks(px.where(F.lit(False)), keys=["chip"], value="value", height=1, width=2).count() == 0


def test_indices_of_a_mosaic(spark):
    six = spark.createDataFrame([(1, 0.2, 0.3, 0.1, 0.5, 0.0, 0.2)], "id long, B4 double, B3 double, B2 double, B8 double, B11 double, B12 double")
    row = mosaic_indices(six).first()
    assert row.NDVI == pytest.approx(0.3 / 0.7) and row.MNDWI is None and row.FVI is None
    assert mosaic_indices(six.drop("B12")).columns == six.drop("B12").columns


def test_no_tiles_no_mosaic(spark):
    none = spark.createDataFrame([], "grp long, band int, x0 double, y0 double, step double, row int, col int, value double")
    assert mosaic.merge_tiles(none, 8, 3, 3, keys=["grp"]).collect() == []
