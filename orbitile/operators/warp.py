"""Reprojection of blocked rasters between UTM zones: an inverse warp, block by block.

A raster has an affine grid: ``x0``, ``y0`` are the metres of its first cell's outer corner, ``step`` the
metres of a cell; rows go south.  Each target block projects its outline back to the source, meets the
source blocks under it by an equi-join, and samples them at the centres of its cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.functions.geo import AXIS, FLATTENING, SCALE
from orbitile.operators.blocks import BLOCK, RASTER, _arrays, _cubic, _schema, by_runs

#: Points of a block's outline a side that are projected to find what it covers, and cells added around it:
#: the sides bend by less than a cell between them.
OUTLINE, MARGIN = 9, 3


@dataclass(frozen=True)
class Grid:
    """Where the cells of a raster lie: zone and hemisphere, first corner, metres of a cell, and the frame."""

    zone: int
    north: bool
    x0: float
    y0: float
    step: float
    height: int
    width: int

    def centres(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.x0 + (cols + 0.5) * self.step, self.y0 - (rows + 0.5) * self.step

    def places(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns, in parts of a cell; whole numbers are the centres of cells."""
        return (self.y0 - y) / self.step - 0.5, (x - self.x0) / self.step - 0.5


_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def to_utm(lon: np.ndarray, lat: np.ndarray, zone: int, north: bool) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing by the same series as ``functions.geo.utm``, on arrays."""
    alpha = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
    e = 2 * _N**0.5 / (1 + _N)
    sine, lam = np.sin(np.radians(lat)), np.radians(lon - (zone * 6.0 - 183.0))
    t = np.sinh(np.arctanh(sine) - e * np.arctanh(e * sine))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1.0 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500_000.0 + _RADIUS * x, _RADIUS * y + (0.0 if north else 10_000_000.0)


def to_lonlat(x: np.ndarray, y: np.ndarray, zone: int, north: bool) -> tuple[np.ndarray, np.ndarray]:
    """The inverse series, as ``functions.geo.lonlat``."""
    beta = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
    delta = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)
    xi, eta = (y - (0.0 if north else 10_000_000.0)) / _RADIUS, (x - 500_000.0) / _RADIUS
    u = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    v = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return zone * 6.0 - 183.0 + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(phi)


def source_places(source: Grid, target: Grid, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cells of the target lie in the source."""
    lon, lat = to_lonlat(*target.centres(rows, cols), target.zone, target.north)
    return source.places(*to_utm(lon, lat, source.zone, source.north))


def _blocks_under(source: Grid, target: Grid, block: int, br: int, bc: int) -> list[tuple[int, int]]:
    """The source blocks that a target block needs."""
    rows = np.linspace(br * block - 0.5, min((br + 1) * block, target.height) - 0.5, OUTLINE)
    cols = np.linspace(bc * block - 0.5, min((bc + 1) * block, target.width) - 0.5, OUTLINE)
    edge = [(rows, np.full(OUTLINE, cols[0])), (rows, np.full(OUTLINE, cols[-1])), (np.full(OUTLINE, rows[0]), cols), (np.full(OUTLINE, rows[-1]), cols)]
    r, c = source_places(source, target, np.concatenate([a for a, _ in edge]), np.concatenate([b for _, b in edge]))
    low = [max(0, int(np.floor(v.min())) - MARGIN) // block for v in (r, c)]
    high = [min(size - 1, int(np.ceil(v.max())) + MARGIN) // block for v, size in ((r, source.height), (c, source.width))]
    return [(i, j) for i in range(low[0], high[0] + 1) for j in range(low[1], high[1] + 1)]


def _sampled(cells: np.ndarray, r: np.ndarray, c: np.ndarray, method: str) -> np.ndarray:
    """Samples at places of a grid (NaN: no value): bilinear over the known cells, or cubic where all it needs are known."""

    def gathered(weight, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total, share, known = np.zeros(r.shape), np.zeros(r.shape), np.ones(r.shape, bool)
        base_r, base_c = np.floor(r).astype(int), np.floor(c).astype(int)
        for i in range(low, high):
            for j in range(low, high):
                a, b = base_r + i, base_c + j
                ok = (a >= 0) & (a < cells.shape[0]) & (b >= 0) & (b < cells.shape[1])
                v = np.where(ok, cells[np.clip(a, 0, cells.shape[0] - 1), np.clip(b, 0, cells.shape[1] - 1)], np.nan)
                w, has = weight(r - a) * weight(c - b), ~np.isnan(v)
                total += np.where(has, w * np.where(has, v, 0.0), 0.0)
                share += np.where(has, w, 0.0)
                known &= has
        return total, share, known

    total, share, _ = gathered(lambda d: np.maximum(0.0, 1.0 - np.abs(d)), 0, 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(share > 1e-12, total / share, np.nan)
    if method == "cubic":
        total, _, known = gathered(_cubic, -1, 3)
        out = np.where(known, total, out)
    # a cell whose centre is outside of the source has no value
    inside = (r >= -0.5) & (r <= cells.shape[0] - 0.5) & (c >= -0.5) & (c <= cells.shape[1] - 0.5)
    return np.where(inside, out, np.nan)


def reproject(blocks: DataFrame, source: Grid, target: Grid, *, keys: list[str], block: int = BLOCK, method: str = "linear") -> DataFrame:
    """Rasters of the source grid on the target grid, in blocks; blocks that get no value are left out.

    The pairs of target and source blocks follow from the two grids alone and are planned by tasks, a row of
    target blocks each; every source block is sent once for each target block that needs it, a few at most where
    the cells are about as large.
    """
    if method not in ("linear", "cubic"):
        raise ValueError(f"no such method: {method}")
    spark = blocks.sparkSession
    n_rows, n_cols = -(-target.height // block), -(-target.width // block)

    def plan(batches):
        for b in batches:
            rows = [(br, bc, i, j) for br in b["id"].to_pylist() for bc in range(n_cols) for i, j in _blocks_under(source, target, block, br, bc)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(4)], ["to_br", "to_bc", "br", "bc"])

    pairs = spark.range(n_rows).mapInArrow(plan, "to_br int, to_bc int, br int, bc int")
    met = blocks.join(pairs, ["br", "bc"]).withColumnsRenamed({"br": "from_br", "bc": "from_bc", "to_br": "br", "to_bc": "bc"})

    def work(table: pa.Table) -> list[tuple]:
        br, bc = table["br"][0].as_py(), table["bc"][0].as_py()
        places = list(zip(table["from_br"].to_pylist(), table["from_bc"].to_pylist(), strict=True))
        top, left = (min(p[k] for p in places) * block for k in (0, 1))
        bottom, right = min(source.height, (max(p[0] for p in places) + 1) * block), min(source.width, (max(p[1] for p in places) + 1) * block)
        cells = np.full((bottom - top, right - left), np.nan)
        for (i, j), values in zip(places, _arrays(table["cells"]), strict=True):
            h, w = min(block, source.height - i * block), min(block, source.width - j * block)
            cells[i * block - top : i * block - top + h, j * block - left : j * block - left + w] = values.reshape(h, w)
        rows, cols = np.arange(br * block, min((br + 1) * block, target.height)), np.arange(bc * block, min((bc + 1) * block, target.width))
        r, c = source_places(source, target, *np.meshgrid(rows, cols, indexing="ij"))
        out = _sampled(cells, r - top, c - left, method)
        if np.isnan(out).all():
            return []
        return [(*[table[k][0].as_py() for k in keys], br, bc, target.height, target.width, out)]

    return by_runs(met.select(*keys, "br", "bc", "from_br", "from_bc", F.col("cells")), [*keys, "br", "bc"], work, _schema(blocks, keys, RASTER))
