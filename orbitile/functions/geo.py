"""Geographic column math: UTM zones and coordinates, distances, tile sizes, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of a degree, download limits in bytes, bytes of a pixel, tile planning constants.
METRES_LON, METRES_LAT = 111_320.0, 111_000.0
SAFE_BYTES, MAX_BYTES, PIXEL_BYTES, MIN_PIXELS = 41_943_040, 50_331_648, 24, 256
REMOTE_SECONDS, MEGABYTES_PER_SECOND, LOCAL_SECONDS, MAX_WORKERS = 4.0, 1.25, 1.5, 8
# WGS84 and the UTM projection.
AXIS, FLATTENING, SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Easting and northing by the third-order Krueger series, good to millimetres within a zone."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6.0 - 183.0))
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        y = y + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return 500_000.0 + SCALE * radius * x, SCALE * radius * y + F.when(north, 0.0).otherwise(10_000_000.0)


def lonlat(east: Column, north_m: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates: the inverse series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    xi = (north_m - F.when(north, 0.0).otherwise(10_000_000.0)) / (SCALE * radius)
    eta = (east - 500_000.0) / (SCALE * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        y = y - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2.0 * j * chi)
    return zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


def box_ok(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    inside = lon_min.between(-180, 180) & lon_max.between(-180, 180) & lat_min.between(-90, 90) & lat_max.between(-90, 90)
    return F.coalesce(inside & (lon_min < lon_max) & (lat_min < lat_max), F.lit(False))


def box_metres(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> tuple[Column, Column]:
    """Width and height by metres of a degree at the centre."""
    return (lon_max - lon_min) * METRES_LON * F.cos(F.radians((lat_min + lat_max) / 2.0)), (lat_max - lat_min) * METRES_LAT


def grid_shape(width: Column, height: Column, max_tiles: Column | int) -> tuple[Column, Column]:
    """Columns and rows nearest to the wanted number of about square tiles, before growth."""
    aspect = F.when(height > 0, width / height).otherwise(1.0)
    return F.greatest(F.lit(1.0), F.rint(F.sqrt(max_tiles * aspect))), F.greatest(F.lit(1.0), F.rint(F.sqrt(max_tiles / aspect)))


def grown_shape(nx: Column, ny: Column, max_tiles: int) -> tuple[Column, Column]:
    """The shape with columns, then rows, added while short of the wanted number and within a tenth above it.

    Adding one column at a time stops at the first number that is enough, or at the last
    within the limit; both are closed forms.
    """
    limit = F.lit(max_tiles * 1.1)

    def grown(n: Column, other: Column) -> Column:
        return F.when(n * other < max_tiles, F.greatest(n, F.least(F.ceil(max_tiles / other), F.floor(limit / other)).cast("double"))).otherwise(n)

    wide = grown(nx, ny)
    return wide, grown(ny, wide)


def automatic_tiles(width: Column, height: Column, resolution: float) -> Column:
    """Tiles of the least side of 256 pixels that cover an area."""
    pixels = F.floor(width / resolution) * F.floor(height / resolution)
    n = F.ceil(pixels / float(MIN_PIXELS * MIN_PIXELS))
    aspect = F.when(height > 0, width / height).otherwise(1.0)
    per_row = F.greatest(F.lit(1), F.ceil(F.sqrt(n * aspect)))
    return per_row * F.ceil(n / per_row)


def tile_megabytes(side_m: Column, resolution: float) -> Column:
    return side_m / resolution * (side_m / resolution) * PIXEL_BYTES / (1024.0 * 1024.0)


def max_tile_pixels(size_bytes: Column, bands: int, bytes_per_band: int) -> Column:
    return F.floor(F.sqrt(size_bytes / float(bands * bytes_per_band)))


def job_seconds(tiles: Column, megabytes: Column, workers: Column) -> Column:
    """Planned time of a job on up to eight workers."""
    return tiles / F.least(workers, F.lit(MAX_WORKERS)) * (REMOTE_SECONDS + megabytes / MEGABYTES_PER_SECOND + LOCAL_SECONDS)


def tile_variance(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column, days: Column) -> Column:
    """Priority of a tile: its area in square degrees, more for longer periods."""
    return (lon_max - lon_min) * (lat_max - lat_min) * (1.0 + days / 365.0)


def map_zoom(span: Column) -> Column:
    # fixed values: zoom by span in degrees
    steps = ((10, 4), (5, 5), (2, 6), (1, 7), (0.5, 8))
    out = F.when(span > steps[0][0], steps[0][1])
    for limit, zoom in steps[1:]:
        out = out.when(span > limit, zoom)
    return out.otherwise(9)
