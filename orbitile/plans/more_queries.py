"""Queries over work units, statuses, names and clipped composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitile.operators import bands, blocks, polygons, progress, status, tiling, warp
from orbitile.sources import geotiff, publish, shapefile
from orbitile.sources.storage import stored, work_folder

from . import views
from .pixel_queries import CUT, MOSAIC, _MOSAIC_SQL, _mosaic, _mosaic_blocks
from .select_queries import SCORED_SQL, scored_scenes
from .work_queries import to_lonlat_sql, to_utm_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH t AS (SELECT o_orderkey AS tile_id, o_custkey % 6 AS scenes, o_orderkey % 9 <> 4 AS rgb, (o_orderkey % 50)::DOUBLE AS mb, CASE WHEN o_orderkey % 8 <> 3 THEN (o_custkey % 5) / 4.0 END AS share,
  CASE WHEN o_orderkey % 31 = 0 THEN 'timeout' END AS err FROM orders)
SELECT tile_id, CASE WHEN err IS NOT NULL THEN 'error' WHEN scenes = 0 THEN 'no_imagery' WHEN NOT rgb THEN 'missing_bands' WHEN mb > 40 THEN 'tile_too_large' WHEN coalesce(share, 0) <= 0 THEN 'validation_failed' ELSE 'ok' END AS status FROM t""")
def tile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    listed = F.when(k % 9 != 4, F.array(F.lit("B4"), F.lit("B3"), F.lit("B2")))
    out = status.tile_status(c % 6, bands.download_bands(F.coalesce(listed, F.array(F.lit("B4")))), (k % 50).cast("double"), F.when(k % 8 != 3, (c % 5) / 4.0), F.when(k % 31 == 0, "timeout"))
    return views.read(spark, sf_dir, "orders").select(k.alias("tile_id"), out.alias("status"))


@query("""WITH d AS (SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month, o_orderkey % 11 AS tile, o_orderkey % 401 <> 0 AS valid FROM orders), ok AS (SELECT year, month FROM d GROUP BY ALL HAVING bool_and(valid))
SELECT year, month, tile FROM (SELECT DISTINCT year, month, tile FROM d) SEMI JOIN ok USING (year, month)""")
def droppable_intermediates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    o = views.read(spark, sf_dir, "orders").select(F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), (F.col("o_orderkey") % 11).alias("tile"), (F.col("o_orderkey") % 401 != 0).alias("valid"))
    return status.safe_to_drop(o.select("year", "month", "tile").distinct(), o)


_NAMES = ["B4", "B3", "B2", "B8", "B11", "B12"]


@query("""WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'scene.sr_b4.tif' WHEN 1 THEN 'x.B11.tif' WHEN 2 THEN 'QA.tif' WHEN 3 THEN 'a_b2.tif' WHEN 4 THEN 'a_B8.tif' WHEN 5 THEN 'b12' WHEN 6 THEN 'B3' ELSE 'readme' END || '-' || (p_partkey % 3) AS name FROM part
), p AS (SELECT id, name, CASE WHEN contains(upper(name), 'B4') THEN 0 WHEN contains(upper(name), 'B3') THEN 1 WHEN contains(upper(name), 'B2') THEN 2 WHEN contains(upper(name), 'B8') THEN 3 WHEN contains(upper(name), 'B11') THEN 4
  WHEN contains(upper(name), 'B12') THEN 5 ELSE 9999 END AS priority FROM f)
SELECT id, name, priority, row_number() OVER (PARTITION BY id // 10 ORDER BY priority, name, id) AS place FROM p""")
def band_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    stems = F.array(*[F.lit(n) for n in ("scene.sr_b4.tif", "x.B11.tif", "QA.tif", "a_b2.tif", "a_B8.tif", "b12", "B3", "readme")])
    f = views.read(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.get(stems, (k % 8).cast("int")), F.lit("-"), (k % 3).cast("string")).alias("name"))
    f = f.withColumn("priority", bands.band_priority(F.col("name"), _NAMES))
    order = Window.partitionBy(F.floor(F.col("id") / 10)).orderBy("priority", "name", "id")
    return f.withColumn("place", F.row_number().over(order))


@query("""WITH b AS (SELECT user_id AS tile_id, list_sort(list_distinct(list(event_type))) AS kinds, list(event_type) AS all_kinds FROM events GROUP BY user_id)
SELECT tile_id, array_to_string(kinds, ',') AS kinds, array_to_string(list_filter(kinds, lambda x: x NOT IN ('view', 'click')), ',') AS without_two, list_contains(kinds, 'error') OR list_contains(kinds, 'signup') AS any_of,
  list_contains(kinds, 'error') AND list_contains(kinds, 'signup') AS all_of, array_to_string(kinds[-2:], ',') AS last_two, coalesce(len(list_filter(all_kinds, lambda x: x = 'purchase')), 0)::BIGINT AS purchases FROM b""")
def name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on band-like names of each tile, and a count map with a default."""
    e = views.read(spark, sf_dir, "events")
    counted = e.groupBy(F.col("user_id").alias("tile_id"), "event_type").agg(F.count("*").alias("n")).groupBy("tile_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    kinds = F.array_sort(F.map_keys("m"))
    wanted = F.array(F.lit("error"), F.lit("signup"))
    return counted.select(
        "tile_id", F.array_join(kinds, ",").alias("kinds"), F.array_join(F.array_except(kinds, F.array(F.lit("view"), F.lit("click"))), ",").alias("without_two"), F.arrays_overlap(kinds, wanted).alias("any_of"),
        F.forall(wanted, lambda w: F.array_contains(F.map_keys("m"), w)).alias("all_of"), F.array_join(F.slice(kinds, F.greatest(F.lit(1), F.size(kinds) - 1), 2), ",").alias("last_two"),
        F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0)).alias("purchases"),
    )


@query("""WITH ev AS (SELECT event_id, user_id % 10 AS grp, floor(epoch(ts))::DOUBLE AS completed_at, value AS seconds FROM events)
SELECT event_id, round(greatest(0, 1500 - row_number() OVER o) * avg(seconds) OVER (PARTITION BY grp ORDER BY completed_at, event_id ROWS 19 PRECEDING), 4) AS remaining FROM ev WINDOW o AS (PARTITION BY grp ORDER BY completed_at, event_id)""")
def estimated_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles left times the rolling mean."""
    e = views.read(spark, sf_dir, "events")
    e = e.select("event_id", (F.col("user_id") % 10).alias("grp"), F.col("ts").cast("timestamp").cast("long").cast("double").alias("completed_at"), F.col("value").alias("seconds"))
    out = progress.rolling_mean(e).withColumn("left", F.greatest(F.lit(0), 1500 - F.col("done")))
    return out.select("event_id", F.round(F.col("left") * F.col("rolling"), 4).alias("remaining"))


@query("""WITH m AS (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-02-01', INTERVAL 1 MONTH))::DATE AS d)
SELECT s_suppkey AS area_id, year(d)::INTEGER AS year, month(d)::INTEGER AS month, last_day(d)::VARCHAR AS month_end FROM supplier, m WHERE NOT ((s_suppkey + month(d)) % 4 = 0)""")
def month_tile_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area and month of a request that is not done yet."""
    period = views.areas(spark, sf_dir).select("area_id", F.lit("2023-11-10").cast("date").alias("start"), F.lit("2024-02-20").cast("date").alias("end"))
    units = tiling.month_units(period).withColumns({"year": F.year("month_start"), "month": F.month("month_start")})
    done = units.where((F.col("area_id") + F.col("month")) % 4 == 0).select("area_id", "year", "month")
    return units.join(done, ["area_id", "year", "month"], "left_anti").select("area_id", "year", "month", F.col("month_end").cast("string").alias("month_end"))


@query(views.with_views("v_scene", f"{SCORED_SQL} SELECT count(*) AS tested, count(*) FILTER (WHERE cloud <= 0.2) AS used, count(DISTINCT tile_id) AS tiles, min(acquired)::VARCHAR AS first_day, max(acquired)::VARCHAR AS last_day, round(sum(1 - cloud), 4)::DOUBLE AS clear FROM scored"))
def report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_scenes(spark, sf_dir).agg(
        F.count("*").alias("tested"), F.count_if(F.col("cloud") <= 0.2).alias("used"), F.countDistinct("tile_id").alias("tiles"), F.min("acquired").cast("string").alias("first_day"),
        F.max("acquired").cast("string").alias("last_day"), F.round(F.sum(1.0 - F.col("cloud")), 4).alias("clear"),
    )


# Outlines of composites, as users give them: features with a hole, several polygons, boxes, coordinates alone, and what is no geometry.
_OUTLINE = [[(0.4, 0.3), (7.7, 1.1), (6.9, 7.6), (0.7, 6.8)], [(2.2, 2.1), (4.6, 2.4), (3.9, 4.7)]]
_PARTS = [[[(0.2, 0.4), (3.1, 0.9), (2.3, 7.8)]], [[(4.2, 1.3), (7.9, 2.2), (6.1, 7.7)], [(5.6, 3.2), (6.6, 3.4), (6.1, 4.8)]]]
_SQUARE = [(1.3, 2.1), (6.2, 2.1), (6.2, 7.4), (1.3, 7.4)]
_OUTLINES = "SELECT s_suppkey AS grp, (s_suppkey % 5) / 16.0 AS s, s_suppkey % 6 AS kind FROM supplier"


def _json(rings: list) -> F.Column:
    """Coordinates as JSON, moved to the right by s."""
    if isinstance(rings, tuple):
        return F.concat(F.lit("["), (F.lit(rings[0]) + F.col("s")).cast("string"), F.lit(f",{rings[1]}]"))
    inner = [x for r in rings for x in (F.lit(","), _json(r))][1:]
    return F.concat(F.lit("["), *inner, F.lit("]"))


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, text) of shapes."""
    k = F.col("s_suppkey")
    s = views.read(spark, sf_dir, "supplier").select(k.alias("grp"), ((k % 5) / 16.0).alias("s"), (k % 6).alias("kind"))
    box = F.concat_ws(",", *[F.col("s") + x if n % 2 == 0 else F.lit(x) for n, x in enumerate((*_SQUARE[0], *_SQUARE[2]))])
    text = F.when(F.col("kind") == 0, F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":'), _json(_OUTLINE), F.lit("}}")))
    text = text.when(F.col("kind") == 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), _json(_PARTS), F.lit("}"))).when(F.col("kind") == 2, box)
    text = text.when(F.col("kind") == 3, F.concat(F.lit('{"coordinates":'), _json(_OUTLINE), F.lit("}"))).when(F.col("kind") == 4, F.concat(F.lit('{"bbox":['), box, F.lit("]}")))
    return s.select("grp", text.otherwise('{"type":"Point","coordinates":[1,2]}').alias("text"))


_RINGS_SQL = f"""rings AS (SELECT grp, s, kind, unnest(CASE WHEN kind IN (0, 3) THEN {[[list(p) for p in r] for r in _OUTLINE]} WHEN kind = 1 THEN {[[list(p) for p in r] for part in _PARTS for r in part]} WHEN kind IN (2, 4) THEN {[[list(p) for p in _SQUARE]]} END) AS ring FROM ({_OUTLINES})
), ends AS (SELECT grp, s, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (SELECT grp, s, ring, unnest(range(1, len(ring) + 1)) AS i FROM rings)
), sides AS (SELECT grp, a[1]::DOUBLE + s AS x1, a[2]::DOUBLE AS y1, b[1]::DOUBLE + s AS x2, b[2]::DOUBLE AS y2 FROM ends)"""


@query(f"SELECT grp, CASE kind WHEN 2 THEN 'box' WHEN 4 THEN 'box' WHEN 1 THEN 'polygons' WHEN 5 THEN NULL ELSE 'polygon' END AS kind, CASE WHEN kind = 5 THEN 'no geometry' END AS error, len(r)::INTEGER AS rings FROM (WITH {_RINGS_SQL} SELECT o.grp, o.kind, list(ring) FILTER (WHERE ring IS NOT NULL) AS r FROM ({_OUTLINES}) o LEFT JOIN rings USING (grp) GROUP BY ALL)")
def input_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of input geometries, and an error for what is none."""
    out = polygons.read_shapes(_outlines(spark, sf_dir))
    return out.select("grp", "kind", "error", F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p)).alias("rings"))


@query(f"WITH {views.SQL['v_chip']}, {_RINGS_SQL}" + """, g AS (SELECT grp, row, col, avg(value) AS v FROM v_chip GROUP BY ALL
), crossed AS (SELECT g.grp, g.row, g.col, any_value(g.v) AS v, count(*) AS n FROM g JOIN sides s ON g.grp = s.grp AND (s.y1 <= g.row + 0.5) <> (s.y2 <= g.row + 0.5) AND s.x1 + (g.row + 0.5 - s.y1) * (s.x2 - s.x1) / (s.y2 - s.y1) <= g.col + 0.5 GROUP BY g.grp, g.row, g.col)
SELECT grp, row, col, round(CASE WHEN v > 0.5 THEN v END, 6) AS value FROM crossed WHERE n % 2 = 1""")
def clipped_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composites clipped to their outlines, weak cells masked after it."""
    cells = views.chips(spark, sf_dir).groupBy("grp", "row", "col").agg(F.avg("value").alias("value"))
    shapes = polygons.read_shapes(_outlines(spark, sf_dir)).where("error IS NULL").select("grp", "parts")
    grids = blocks.to_blocks(cells, keys=["grp"], value="value", height=8, width=8, block=5)
    clipped = polygons.clip_blocks(grids, polygons.coverage(shapes, 8, 8, key="grp"), key="grp", block=5)
    out = blocks.to_pixels(clipped, keys=["grp"], block=5).where("value IS NOT NULL")
    return out.select("grp", "row", "col", F.round(F.when(F.col("value") > 0.5, F.col("value")), 6).alias("value"))


# mosaics of one zone on the grid of the next, and in files

SOURCE = warp.Grid(36, True, 720_000.0, 3_510_000.0, 1_000.0, MOSAIC, MOSAIC)
TARGET = warp.Grid(37, True, 150_000.0, 3_512_000.0, 900.0, 47, 50)


@query(views.with_views("v_chip", _MOSAIC_SQL + f""", cells AS (SELECT r AS row, c AS col, {TARGET.x0} + (c + 0.5::DOUBLE) * {TARGET.step} AS x, {TARGET.y0} - (r + 0.5::DOUBLE) * {TARGET.step} AS y, 37 AS zone, true AS north
  FROM (SELECT unnest(range({TARGET.height}))::INTEGER AS r), (SELECT unnest(range({TARGET.width}))::INTEGER AS c)
), there AS (SELECT row, col, lon, lat, 36 AS zone, true AS north FROM ({to_lonlat_sql("cells")})
), placed AS (SELECT row, col, ({SOURCE.y0} - y) / {SOURCE.step} - 0.5 AS r, (x - {SOURCE.x0}) / {SOURCE.step} - 0.5 AS c FROM ({to_utm_sql("there")})
), met AS (SELECT mosaic, p.row, p.col, sum((1 - abs(r - m.row)) * (1 - abs(c - m.col)) * value) / sum((1 - abs(r - m.row)) * (1 - abs(c - m.col))) AS value
  FROM placed p JOIN mo m ON m.row IN (floor(r), floor(r) + 1) AND m.col IN (floor(c), floor(c) + 1) WHERE r BETWEEN -0.5 AND 39.5 AND c BETWEEN -0.5 AND 39.5 AND (1 - abs(r - m.row)) * (1 - abs(c - m.col)) > 1e-12 GROUP BY ALL)
SELECT mosaic, row, col, round(value, 5) AS value FROM met"""))
def reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of a zone's east on the grid of the next zone."""
    moved = warp.reproject(_mosaic_blocks(_mosaic(spark, sf_dir)), SOURCE, TARGET, keys=["mosaic"], block=CUT)
    return blocks.to_pixels(moved, keys=["mosaic"], block=CUT).where("value IS NOT NULL").withColumn("value", F.round("value", 5))


@query(views.with_views("v_chip", _MOSAIC_SQL + ", b AS (SELECT mosaic, unnest([1, 2]) AS band, row, col, value FROM mo), f AS (SELECT mosaic, band, row, col, value / band AS value FROM b), " + " UNION ALL ".join(
    f"{'l AS (' if k == 1 else ''}SELECT mosaic, {k} AS level, band, (row // {k}) AS row, (col // {k}) AS col, avg(value) AS value FROM f GROUP BY ALL" for k in (1, 2, 4)) + """)
SELECT 'm' || mosaic AS file, level::INTEGER AS level, band::INTEGER AS band, count(*) AS n, round(sum(value), 5) AS total, round(sum(value * (row * 41 + col)), 3) AS placed FROM l WHERE level <> 2 OR row >= 10 GROUP BY ALL"""))
def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of two bands with two overviews, written to files and read by tiles: of the second level the lower half only."""
    px = _mosaic(spark, sf_dir).withColumn("band", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") / F.col("band"))
    side = 16
    full = blocks.to_blocks(px, keys=["mosaic", "band"], value="value", height=MOSAIC, width=MOSAIC, block=side)
    coarse = blocks.overviews(full, (2, 4), keys=["mosaic", "band"], block=side)
    rows = full.withColumn("level", F.lit(1)).unionByName(coarse).withColumn("file", F.concat(F.lit("m"), F.col("mosaic").cast("string")))
    folder = work_folder(spark, "rasters")
    geotiff.write_geotiffs(rows, folder, block=side, dtype="float64", epsg=32636, x0=SOURCE.x0, y0=SOURCE.y0, step=SOURCE.step)
    back = geotiff.read_geotiffs(spark, folder)
    cells = blocks.to_pixels(back, keys=["file", "level", "band"], block=side).where("value IS NOT NULL").where("level <> 2 OR row >= 10")
    placed = F.sum(F.col("value") * (F.col("row") * 41 + F.col("col")))
    return cells.groupBy("file", "level", "band").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"), F.round(placed, 3).alias("placed"))


@query(views.with_views("v_chip", _MOSAIC_SQL + " SELECT 'm' || o.s_suppkey AS file, CASE WHEN m.mosaic IS NULL THEN 'file_not_found' ELSE 'ok' END AS status FROM supplier o LEFT JOIN (SELECT DISTINCT mosaic FROM mo) m ON m.mosaic = o.s_suppkey"))
def validated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of mosaics, checked where they are expected: one for each supplier."""
    grids = blocks.to_blocks(_mosaic(spark, sf_dir), keys=["mosaic"], value="value", height=MOSAIC, width=MOSAIC, block=MOSAIC)
    rows = grids.withColumns({"level": F.lit(1), "band": F.lit(1), "file": F.concat(F.lit("m"), F.col("mosaic").cast("string"))})
    folder = work_folder(spark, "rasters")
    geotiff.write_geotiffs(rows, folder, block=MOSAIC, epsg=32636, x0=0.0, y0=0.0, step=10.0)
    expected = views.read(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("file"))
    return geotiff.validated(expected, folder)


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS tiles, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def published_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months published in one step after their rows and checksums were read back; intermediates go after that."""
    d = F.col("o_orderdate")
    tiles = stored(views.read(spark, sf_dir, "orders").select(F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), "o_totalprice"), "tiles")
    months = tiles.groupBy("year", "month").agg(F.count("*").alias("tiles"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    root = work_folder(spark, "published")
    publish.publish(spark, {"months": months, "mosaics": months.select("year", "month")}, root, intermediates=tuple({f.rsplit("/", 1)[0] for f in tiles.inputFiles()}))
    return publish.read(spark, root, "months")


@query(views.with_views("v_area", " SELECT (area_id % 3)::INTEGER AS part, count(*) AS n, round(min(lon_min), 6) AS lon_min, round(max(lat_max), 6) AS lat_max FROM v_area GROUP BY ALL"))
def shapefiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas as shapefiles, three sets of them, and what the headers of their shapes say."""
    c = F.col
    ring = F.array(*[F.array(c(x), c(y)) for x, y in (("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"))])
    rows = views.areas(spark, sf_dir).select(F.concat(F.lit("part-"), (c("area_id") % 3).cast("string")).alias("file"), F.array(F.array(ring)).alias("parts"), c("area_id").alias("area identifier"), c("lon_min").alias("1st longitude"))
    folder = work_folder(spark, "shapes")
    shapefile.write_shapefiles(rows, folder)
    heads = spark.read.format("binaryFile").option("pathGlobFilter", "*.sh[px]").load(folder)

    def little(at: int) -> F.Column:
        """Eight bytes as hexadecimal, the last one first."""
        digits = F.hex(F.substring("content", at, 8))
        return F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)])

    number = F.regexp_extract("path", r"part-(\d)", 1).cast("int").alias("part")
    shp = heads.where("path LIKE '%.shp'").select(number, little(37).alias("x"), little(61).alias("y"))
    shx = heads.where("path LIKE '%.shx'").select(number, ((F.length("content") - 100) / 8).cast("long").alias("n"))

    def double(bits: F.Column) -> F.Column:
        """The number of sixteen digits, the sign first."""
        high = F.conv(F.substring(bits, 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(bits, 9, 8), 16, 10).cast("double")
        sign, power = F.when(high >= 2**31, -1.0).otherwise(1.0), F.shiftright(high, 20).bitwiseAND(2047)
        return sign * (1 + (high.bitwiseAND(2**20 - 1).cast("double") * 2.0**32 + low) / 2.0**52) * F.pow(F.lit(2.0), power - 1023)

    return shp.join(shx, "part").select("part", "n", F.round(double(c("x")), 6).alias("lon_min"), F.round(double(c("y")), 6).alias("lat_max"))
