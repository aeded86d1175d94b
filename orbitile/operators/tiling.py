"""Tiles: grids over areas, months, spatial joins by cells, polygon clipping, priorities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.functions import geo


def month_units(requests: DataFrame) -> DataFrame:
    """One row a request (start, end) and month: first and last day, and the first of the next month."""
    first = F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("month_start")
    out = requests.select("*", first)
    return out.withColumns({"month_end": F.last_day("month_start"), "month_after": F.add_months("month_start", 1)})


def _with_zone(areas: DataFrame) -> DataFrame:
    c = F.col
    centre = (c("lon_min") + c("lon_max")) / 2.0, (c("lat_min") + c("lat_max")) / 2.0
    return areas.withColumns({"zone": geo.utm_zone(centre[0]), "north": centre[1] >= 0, "epsg": geo.utm_epsg(*centre)})


def grid_tiles(areas: DataFrame, max_tiles: int | None = None, *, side_m: float | None = None) -> DataFrame:
    """Tiles of each box in its UTM zone: tile numbers i, j, bounds in metres and their box in degrees.

    The grid has about ``max_tiles`` tiles, or tiles of at most ``side_m`` metres.  Its shape is column
    arithmetic and its cells two exploded sequences, so any number of areas is planned in one pass.
    """
    c = F.col
    out = _with_zone(areas)
    corners = [geo.utm(c(x), c(y), c("zone"), c("north")) for x in ("lon_min", "lon_max") for y in ("lat_min", "lat_max")]
    out = out.withColumns(
        {
            "min_x": F.least(*[p[0] for p in corners]), "max_x": F.greatest(*[p[0] for p in corners]),
            "min_y": F.least(*[p[1] for p in corners]), "max_y": F.greatest(*[p[1] for p in corners]),
        }
    )
    return _degrees(_cells(out, max_tiles, side_m)).drop("min_x", "max_x", "min_y", "max_y")


def _degrees(tiles: DataFrame) -> DataFrame:
    """The box in degrees around the corners of each tile."""
    corners = [geo.lonlat(F.col(x), F.col(y), F.col("zone"), F.col("north")) for x in ("x0", "x1") for y in ("y0", "y1")]
    lon, lat = [p[0] for p in corners], [p[1] for p in corners]
    return tiles.withColumns({"lon_min": F.least(*lon), "lat_min": F.least(*lat), "lon_max": F.greatest(*lon), "lat_max": F.greatest(*lat)})


def _cells(out: DataFrame, max_tiles: int | None, side_m: float | None) -> DataFrame:
    """The tiles i, j of areas with bounds in metres."""
    c = F.col
    width, height = c("max_x") - c("min_x"), c("max_y") - c("min_y")
    if max_tiles:
        nx, ny = geo.grid_shape(width, height, F.lit(max_tiles))
        out = out.withColumns({"nx": nx, "ny": ny})
        nx, ny = geo.grown_shape(c("nx"), c("ny"), max_tiles)
        out = out.withColumns({"nx": nx, "ny": ny})
    elif side_m:
        out = out.withColumns({n: F.greatest(F.lit(1.0), F.ceil(size / side_m).cast("double")) for n, size in (("nx", width), ("ny", height))})
    else:
        raise ValueError("give a number of tiles or their side in metres")
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0), (c("nx") - 1).cast("int")))).withColumn("j", F.explode(F.sequence(F.lit(0), (c("ny") - 1).cast("int"))))
    return out.withColumns(
        {
            "x0": c("min_x") + c("i") * width / c("nx"), "x1": c("min_x") + (c("i") + 1) * width / c("nx"),
            "y0": c("min_y") + c("j") * height / c("ny"), "y1": c("min_y") + (c("j") + 1) * height / c("ny"),
        }
    )


def polygon_tiles(polygons: DataFrame, max_tiles: int | None = None, *, side_m: float | None = None) -> DataFrame:
    """Tiles of polygons (area_id and ``ring``, an array of [lon, lat]): those that meet the polygon, cut to it.

    The ring goes to UTM and back by column functions; the grid is that of its bounds.  Returns area_id, epsg, i,
    j, the box in degrees around what is inside, its ring (``inside``) and its area in square metres.
    """
    lon, lat = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    bounds = {"lon_min": F.array_min(lon), "lon_max": F.array_max(lon), "lat_min": F.array_min(lat), "lat_max": F.array_max(lat)}
    out = _with_zone(polygons.withColumns(bounds))
    out = out.withColumn("ring_m", F.transform("ring", lambda p: F.array(*geo.utm(p[0], p[1], F.col("zone"), F.col("north")))))
    x, y = F.transform("ring_m", lambda p: p[0]), F.transform("ring_m", lambda p: p[1])
    out = out.withColumns({"min_x": F.array_min(x), "max_x": F.array_max(x), "min_y": F.array_min(y), "max_y": F.array_max(y)})
    tiles = _cells(out, max_tiles, side_m).select("area_id", "epsg", "zone", "north", "i", "j", "x0", "y0", "x1", "y1", "ring_m")
    cut = F.pandas_udf(_cut, "struct<ring: array<array<double>>, area: double>")
    tiles = tiles.withColumn("cut", cut("ring_m", "x0", "y0", "x1", "y1")).where(F.col("cut.area") > 0)
    inside = F.transform("cut.ring", lambda p: F.array(*geo.lonlat(p[0], p[1], F.col("zone"), F.col("north"))))
    tiles = tiles.withColumn("inside", inside)
    lon, lat = F.transform("inside", lambda p: p[0]), F.transform("inside", lambda p: p[1])
    box = {"lon_min": F.array_min(lon), "lat_min": F.array_min(lat), "lon_max": F.array_max(lon), "lat_max": F.array_max(lat)}
    return tiles.withColumns(box).select("area_id", "epsg", "i", "j", *box, "inside", F.col("cut.area").alias("area_m2"))


def _cut(ring: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
    rows = []
    for r, *box in zip(ring, x0, y0, x1, y1, strict=True):
        points = [tuple(p) for p in r]
        inside = clip_ring(points[:-1] if points[0] == points[-1] else points, tuple(box))
        rows.append(([list(p) for p in inside], ring_area(inside) if len(inside) >= 3 else 0.0))
    return pd.DataFrame(rows, columns=["ring", "area"])


def with_priority(tiles: DataFrame, days: int) -> DataFrame:
    """Add ``priority``, larger areas first; the tile number breaks ties in an order by it."""
    c = F.col
    return tiles.withColumn("priority", geo.tile_variance(c("lon_min"), c("lat_min"), c("lon_max"), c("lat_max"), F.lit(float(days))))


#: Levels of the cells in which boxes meet: the side of a cell is two to this power, in degrees.
FINEST, COARSEST = -12, 9


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes (left_id, right_id) that overlap.

    A box lies in at most four cells of the level of its size.  Of two boxes the smaller one looks for the
    larger one in the cells of the latter's level, so a box over the whole world has as few cells as a small
    one, and small boxes in one place lie in small cells.  A pair counts only in the cell that holds the
    south-west corner of its intersection, so nothing is deduplicated.
    """
    a, b = levelled(left, "left_id"), levelled(right, "right_id")
    return _met(a, b, 0).unionByName(_met(b, a, 1))


_SIDES = ["lon_min", "lat_min", "lon_max", "lat_max"]


def levelled(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes with their ``own`` level, whose cells are at least as large as they are."""
    size = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"), F.lit(2.0**FINEST))
    return boxes.select(key, *_SIDES, F.least(F.lit(COARSEST), F.ceil(F.log2(size))).cast("int").alias("own"))


def celled(boxes: DataFrame) -> DataFrame:
    """A row for each cell of its ``level`` that a box touches."""
    side = F.pow(F.lit(2.0), F.col("level"))
    spans = {n: F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)) for n, low, high in (("cx", "lon_min", "lon_max"), ("cy", "lat_min", "lat_max"))}
    return boxes.withColumn("cx", F.explode(spans["cx"])).withColumn("cy", F.explode(spans["cy"]))


def _met(large: DataFrame, small: DataFrame, least: int) -> DataFrame:
    """Boxes at their own level with those of the other side that are ``least`` levels smaller or more."""
    c = F.col
    used = [r[0] for r in large.select("own").distinct().collect()]  # as many as there are levels, at most
    levels = F.filter(F.array(*[F.lit(k) for k in used]).cast("array<int>"), lambda k: k >= c("own") + least)
    probes = celled(small.withColumn("level", F.explode(levels))).drop("own")
    stands = celled(large.withColumn("level", c("own"))).drop("own").withColumnsRenamed({n: f"r_{n}" for n in _SIDES})
    both = probes.join(stands, ["level", "cx", "cy"])
    inside = (c("lon_min") < c("r_lon_max")) & (c("r_lon_min") < c("lon_max")) & (c("lat_min") < c("r_lat_max")) & (c("r_lat_min") < c("lat_max"))
    side = F.pow(F.lit(2.0), c("level"))
    once = (F.floor(F.greatest("lon_min", "r_lon_min") / side) == c("cx")) & (F.floor(F.greatest("lat_min", "r_lat_min") / side) == c("cy"))
    return both.where(inside & once).select("left_id", "right_id")


def clip_ring(ring: list, box: tuple[float, float, float, float]) -> list:
    """A polygon ring cut to a box, one side after the other."""
    x0, y0, x1, y1 = box
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                out.append(a)
            if (da > 0 > db) or (da < 0 < db):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            return []
    return ring


def ring_area(ring: list) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2.0


def clip_tiles(tiles: DataFrame, ring: str | list[tuple[float, float]] = "ring") -> DataFrame:
    """Tiles (tile_id and box) that meet a polygon, with the box and area of what is inside.

    The ring is a column, each tile's own, or one for all.
    """
    if not isinstance(ring, str):
        tiles = tiles.withColumn("ring", F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ring]))
        ring = "ring"
    cut = F.pandas_udf(_cut, "struct<ring: array<array<double>>, area: double>")
    out = tiles.select("tile_id", cut(ring, "lon_min", "lat_min", "lon_max", "lat_max").alias("cut")).where(F.col("cut.area") > 0)
    lon, lat = F.transform("cut.ring", lambda p: p[0]), F.transform("cut.ring", lambda p: p[1])
    box = {"lon_min": F.array_min(lon), "lat_min": F.array_min(lat), "lon_max": F.array_max(lon), "lat_max": F.array_max(lat)}
    return out.withColumns(box).select("tile_id", *box, F.col("cut.area").alias("area"))
