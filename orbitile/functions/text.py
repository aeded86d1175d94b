"""String, date and JSON columns of the scene pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURE = (
    "type string, properties struct<name: string, category: string, description: string, dates: string, bbox: string, created: string>, "
    "geometry struct<type: string, coordinates: array<array<array<double>>>>"
)


def file_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[ /]", "_")


def field_name(name: Column) -> Column:
    """A valid attribute name of ten characters at most."""
    cut = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), 1, 10)
    return F.when(F.coalesce(F.length(cut), F.lit(0)) == 0, "field").when(cut.rlike(r"^[0-9]"), F.substring(F.concat(F.lit("_"), cut), 1, 10)).otherwise(cut)


def padded(number: Column, width: int = 4) -> Column:
    return F.coalesce(F.lpad(number.cast("string"), width, "0"), F.lit("?" * width))


def tile_prefix(day: Column, tile: Column, project: str = "tile") -> Column:
    return F.concat(F.lit(f"{project}_"), F.date_format(day, "yyyyMMdd"), F.lit("_t"), padded(tile))


def display_name(sensor: Column) -> Column:
    """LANDSAT_8 as Landsat-8."""
    return F.replace(F.initcap(F.replace(sensor, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("-"))


def stars(rank: Column) -> Column:
    return F.repeat(F.lit("*"), rank)


def error_class(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.contains("quota"), "quota").when(m.contains("not found"), "not_found").when(m.contains("too large") | m.contains("limit"), "too_large").otherwise("other")


def parse_box(text: Column) -> Column:
    """struct<lon_min, lat_min, lon_max, lat_max> of four numbers split by commas or blanks, after an optional prefix up to a colon; else null."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(text, r"^\s*[A-Za-z_]+\s*:", "")), r"[,\s]+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    ok = (F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x))
    names = ("lon_min", "lat_min", "lon_max", "lat_max")
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*[F.get(numbers, F.lit(k)).alias(n) for k, n in enumerate(names)]))


def ring_box(ring: Column) -> Column:
    """Bounding box of an array of [lon, lat] points."""
    lon, lat = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(lon).alias("lon_min"), F.array_min(lat).alias("lat_min"), F.array_max(lon).alias("lon_max"), F.array_max(lat).alias("lat_max"))


def box_ring(box: Column) -> Column:
    """Closed ring of five points, counter-clockwise from the south-west."""
    corners = (("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"), ("lon_min", "lat_min"))
    return F.array(*[F.array(box[x], box[y]) for x, y in corners])


def feature_json(box: Column, **properties: Column) -> Column:
    """GeoJSON feature of a box."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(box_ring(box)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties"), geometry.alias("geometry")))


def geometry_box(text: Column) -> Column:
    """Box of an imported text: four numbers first, then a feature, a collection's first feature, a bare polygon."""
    polygon = "struct<type: string, coordinates: array<array<array<double>>>>"
    feature = F.from_json(text, FEATURE)
    collection = F.from_json(text, f"features array<struct<geometry: {polygon}>>")
    bare = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    rings = (feature["geometry"]["coordinates"], F.get(collection["features"], F.lit(0))["geometry"]["coordinates"], bare["coordinates"])
    found = [F.when(F.coalesce(F.size(F.get(r, F.lit(0))), F.lit(0)) > 0, ring_box(F.get(r, F.lit(0)))) for r in rings]
    return F.coalesce(parse_box(text), *found)


def months(start: Column, end: Column) -> Column:
    """Array of the first days of all months from start's to end's."""
    return F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("INTERVAL 1 MONTH"))


def period_days(start: Column, end: Column) -> Column:
    """Days of a period, 365 if it has none."""
    d = F.datediff(end, start)
    return F.when(d > 0, d).otherwise(365)


def suggested_end(today: Column) -> Column:
    """Last day of this month from the 15th on, else of the month before."""
    return F.when(F.dayofmonth(today) >= 15, F.last_day(today)).otherwise(F.last_day(F.add_months(today, -1)))


def elapsed_days(millis: Column, start: Column) -> Column:
    """Whole days from the start of a day to a time in milliseconds, floored."""
    return F.floor((millis - F.unix_millis(start.cast("timestamp"))) / 86_400_000.0).cast("int")
