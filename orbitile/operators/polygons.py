"""Polygons on rasters: input shapes made one, coverage by scanlines, and blocks cut to it.

A shape is an array of parts, a part an array of rings (the first is its outline, the others are holes), a
ring an array of [x, y].  By the even-odd rule holes need no treatment of their own: the crossings of all
rings with the middle of a row, in order, are where the inside begins and ends.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitile.operators.blocks import BLOCK, _arrays, _lists

PARTS = "array<array<array<array<double>>>>"


def parse_shape(text: str | None) -> tuple[str | None, list | None, str | None]:
    """(kind, parts, error) of an input text."""
    numbers = re.split(r"[,\s]+", re.sub(r"^\s*[A-Za-z_]+\s*:", "", text or "").strip())
    if len(numbers) == 4 and all(_number(x) is not None for x in numbers):
        return "box", _box([_number(x) for x in numbers]), None
    try:
        found = json.loads(text or "")
    except ValueError:
        return None, None, "no geometry"
    if not isinstance(found, dict):
        return None, None, "no geometry"
    features = found.get("features")
    inner = found.get("geometry") or (features[0].get("geometry") if isinstance(features, list) and features and isinstance(features[0], dict) else None) or found
    coordinates = inner.get("coordinates") if isinstance(inner, dict) else None
    for kind, parts in (("polygon", [coordinates]), ("polygons", coordinates)):
        if _whole(parts):
            return kind, [[[[float(x) for x in p[:2]] for p in ring] for ring in part] for part in parts], None
    if isinstance(found.get("bbox"), list):
        four = [_number(x) for x in found["bbox"]]
        return ("box", _box(four), None) if len(four) == 4 and None not in four else (None, None, "bbox of other than four numbers")
    return None, None, "no geometry"


def _number(x) -> float | None:
    try:
        value = float(x)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def _box(four: list[float]) -> list:
    x0, y0, x1, y1 = four
    return [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]


def _whole(parts) -> bool:
    """Whether each part has a ring, and each ring three points of two numbers at least."""
    point = lambda p: isinstance(p, list) and len(p) >= 2 and all(isinstance(x, int | float) for x in p[:2])
    ring = lambda r: isinstance(r, list) and len(r) >= 3 and all(map(point, r))
    return isinstance(parts, list) and bool(parts) and all(isinstance(p, list) and p and all(map(ring, p)) for p in parts)


def read_shapes(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with ``kind``, ``parts`` and ``error`` of their input texts.

    Four numbers are a box.  JSON may be a feature or a collection (of which the first feature counts), a
    polygon, several polygons, coordinates alone, or an object with a bbox of four numbers.  Everything else,
    and a null text, has no parts and says why.
    """

    @F.arrow_udf(f"struct<kind: string, parts: {PARTS}, error: string>")
    def parsed(texts: pa.Array) -> pa.Array:
        found = [parse_shape(t) for t in texts.to_pylist()]
        deep = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
        columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), deep, pa.string()))]
        return pa.StructArray.from_arrays(columns, ["kind", "parts", "error"])

    return rows.withColumn("__shape", parsed(F.col(text))).select(*rows.columns, "__shape.kind", "__shape.parts", "__shape.error")


def edges(shapes: DataFrame, *, key: str, parts: str = "parts") -> DataFrame:
    """(key, x1, y1, x2, y2): the edges of all rings, closed where they are not."""
    rings = shapes.select(key, F.explode(parts).alias("rings")).select(key, F.explode("rings").alias("ring"))
    nexts = F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", F.lit(1), F.lit(1)))
    rings = rings.select(key, F.col("ring").alias("a"), nexts.alias("b"))
    pairs = rings.select(key, F.explode(F.arrays_zip("a", "b")).alias("e"))
    ends = (("a", 0, "x1"), ("a", 1, "y1"), ("b", 0, "x2"), ("b", 1, "y2"))
    return pairs.select(key, *[F.get(F.col("e").getField(f), F.lit(k)).alias(n) for f, k, n in ends])


def coverage(shapes: DataFrame, height: int, width: int, *, key: str, parts: str = "parts") -> DataFrame:
    """(key, row, col_from, col_to): the runs of cells whose centres lie inside, of a grid of unit cells.

    An edge is turned into its crossings with the middles of rows, so a shape costs what its outline is long,
    not its area; a row of a shape has as many crossings as edges pass it.
    """
    e = edges(shapes, key=key, parts=parts)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.lit(0), F.ceil(low - 0.5)), F.least(F.lit(height - 1), F.ceil(high - 0.5) - 1)
    rows = e.where((F.col("y1") != F.col("y2")) & (first <= last)).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    x = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    order = Window.partitionBy(key, "row").orderBy("x")
    paired = rows.select(key, "row", x.alias("x")).withColumns({"n": F.row_number().over(order), "to": F.lead("x").over(order)})
    begin, end = F.greatest(F.lit(0), F.ceil(F.col("x") - 0.5)), F.least(F.lit(width - 1), F.ceil(F.col("to") - 0.5) - 1)
    runs = paired.where("n % 2 = 1").select(key, "row", begin.cast("int").alias("col_from"), end.cast("int").alias("col_to"))
    return runs.where("col_from <= col_to")


def clip_blocks(blocks: DataFrame, runs: DataFrame, *, key: str, block: int = BLOCK) -> DataFrame:
    """Blocks with the cells outside of their shape's runs emptied; blocks that a shape does not reach go.

    Runs are cut at the borders of blocks and meet them by an equi-join; a block has a bounded number of them.
    """
    c = F.col
    cut = runs.withColumn("br", F.floor(c("row") / block).cast("int")).withColumn("bc", F.explode(F.sequence(F.floor(c("col_from") / block).cast("int"), F.floor(c("col_to") / block).cast("int"))))
    here = F.struct((c("row") - c("br") * block).alias("r"), F.greatest(F.lit(0), c("col_from") - c("bc") * block).alias("a"), F.least(F.lit(block - 1), c("col_to") - c("bc") * block).alias("b"))
    cut = cut.groupBy(key, "br", "bc").agg(F.collect_list(here).alias("runs"))

    @F.arrow_udf("array<double>")
    def kept(cells: pa.Array, width: pa.Array, bc: pa.Array, some: pa.Array) -> pa.Array:
        out = []
        for values, w, k, spans in zip(_arrays(cells), width.to_pylist(), bc.to_pylist(), some.to_pylist(), strict=True):
            grid = values.reshape(-1, min(block, w - k * block))
            inside = np.zeros((len(grid), block + 1), np.int32)
            for s in spans:
                inside[s["r"], s["a"]] += 1
                inside[s["r"], s["b"] + 1] -= 1
            out.append(np.where(np.cumsum(inside, axis=1)[:, : grid.shape[1]] > 0, grid, np.nan))
        return _lists(out, pa.list_(pa.float64()))

    met = blocks.join(cut, [key, "br", "bc"])
    return met.withColumn("cells", kept("cells", "width", "bc", "runs")).select(*blocks.columns)
