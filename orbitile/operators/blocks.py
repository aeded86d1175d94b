"""Rasters in blocks: a row is a square block of cells, and what needs neighbours gets a halo of border strips.

A raster is named by key columns (a mosaic, a band) and has a frame of ``height`` x ``width`` cells.  A block
has ``br``, ``bc`` (its place among the blocks) and ``cells``, an array row by row; a cell without a value is
null.  Blocks at the far edges are cut to the frame.  A neighbourhood operator shuffles each block once, and of
its cells twice only those within the halo of a border; everything inside a block is vectorised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orbitile.sources.storage import stored

#: Cells of a block's side.
BLOCK = 512
PIECE = "br int, bc int, height int, width int, row0 int, col0 int, h int, w int, own boolean, cells array<double>"
RASTER = "br int, bc int, height int, width int, cells array<double>"


def _schema(df: DataFrame, keys: list[str], fields: str) -> StructType:
    return StructType([df.schema[k] for k in keys] + StructType.fromDDL(fields).fields)


def _arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays of doubles, null as NaN."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        values = c.flatten().to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))])
        out += [values[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    values = np.concatenate([a.reshape(-1) for a in arrays]) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, kind.value_type, from_pandas=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    made = [_lists(list(c), f.type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def by_runs(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], list[tuple]], schema: StructType) -> DataFrame:
    """Rows of equal keys meet in ``work``, which gives rows of ``schema``: a group is one run of a sorted partition.

    Many small groups share an Arrow batch, so a group costs no round of its own; one group is held at a time.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, out, cells = [], None, [], 0

        def flush() -> None:
            nonlocal cells
            for row in work(pa.Table.from_batches(held)):
                out.append(row)
                cells += sum(v.size for v in row if isinstance(v, np.ndarray))

        for b in batches:
            values = list(zip(*[b[k].to_pylist() for k in keys], strict=True))
            start = 0
            for end in range(1, len(values) + 1):
                if end < len(values) and values[end] == values[start]:
                    continue
                if held and of != values[start]:
                    flush()
                    held = []
                of = values[start]
                held.append(b.slice(start, end - start))
                start = end
            if cells > 1_000_000 or len(out) > 10_000:
                yield _batch(out, arrow)
                out.clear()
                cells = 0
        if held:
            flush()
        if out:
            yield _batch(out, arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def to_blocks(pixels: DataFrame, *, keys: list[str], value: str, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """Pixels (keys, row, col, value) as blocks; places of a block without a pixel are cells without a value.

    Blocks in which no pixel lies are left out.  Pixels outside the frame are dropped; of several of one
    place the last of some order counts.
    """
    at = [F.floor(F.col(c) / block).cast("int").alias(n) for c, n in (("row", "br"), ("col", "bc"))]
    rows = pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    rows = rows.select(*keys, *at, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("value"))

    def gather(table: pa.Table) -> list[tuple]:
        br, bc = table["br"][0].as_py(), table["bc"][0].as_py()
        h, w = min(block, height - br * block), min(block, width - bc * block)
        cells = np.full((h, w), np.nan)
        cells[table["row"].to_numpy() - br * block, table["col"].to_numpy() - bc * block] = table["value"].to_numpy()
        return [(*[table[k][0].as_py() for k in keys], br, bc, height, width, cells)]

    return by_runs(rows, [*keys, "br", "bc"], gather, _schema(pixels, keys, RASTER))


def to_pixels(blocks: DataFrame, *, keys: list[str], value: str = "value", block: int = BLOCK) -> DataFrame:
    """(keys, row, col, value) of every cell, null where it has no value."""
    out = blocks.select(*keys, "br", "bc", F.least(F.lit(block), F.col("width") - F.col("bc") * block).alias("w"), F.posexplode("cells").alias("p", "v"))
    row, col = F.col("br") * block + F.floor(F.col("p") / F.col("w")), F.col("bc") * block + F.col("p") % F.col("w")
    return out.select(*keys, row.cast("int").alias("row"), col.cast("int").alias("col"), F.col("v").alias(value))


def neighbourhoods(blocks: DataFrame, halo: int, work: Callable[[np.ndarray, np.ndarray], np.ndarray], *, keys: list[str], block: int = BLOCK, scale: int = 1) -> DataFrame:
    """``work`` on every block with ``halo`` cells around it.

    It gets the cells (NaN without a value) and which of them lie in the frame, and returns those of the block,
    ``scale`` times as many a side.  Each block sends its neighbours the strips within the halo of their common
    border and nothing else.
    """
    if halo > block:
        raise ValueError("a halo reaches into the next block only")
    schema = _schema(blocks, keys, PIECE)
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [b[k].to_pylist() for k in [*keys, "br", "bc", "height", "width"]]
            for *key, br, bc, height, width, cells in zip(*names, _arrays(b["cells"]), strict=True):
                h, w = min(block, height - br * block), min(block, width - bc * block)
                cells = cells.reshape(h, w)
                rows = [(*key, br, bc, height, width, br * block, bc * block, h, w, True, cells)]
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        to = br + dr, bc + dc
                        if (dr or dc) and halo and 0 <= to[0] * block < height and 0 <= to[1] * block < width:
                            top = max(0, h - halo) if dr > 0 else 0
                            left = max(0, w - halo) if dc > 0 else 0
                            piece = cells[top : halo if dr < 0 else h, left : halo if dc < 0 else w]
                            rows.append((*key, *to, height, width, br * block + top, bc * block + left, *piece.shape, False, piece))
                yield _batch(rows, arrow)

    def assemble(table: pa.Table) -> list[tuple]:
        br, bc, height, width = (table[c][0].as_py() for c in ("br", "bc", "height", "width"))
        own = table["own"].to_pylist()
        if not any(own):
            return []  # strips for a block that has no pixel
        h, w = min(block, height - br * block), min(block, width - bc * block)
        top, left = br * block - halo, bc * block - halo
        cells = np.full((h + 2 * halo, w + 2 * halo), np.nan)
        for row0, col0, ph, pw, piece in zip(*[table[c].to_pylist() for c in ("row0", "col0", "h", "w")], _arrays(table["cells"]), strict=True):
            cells[row0 - top : row0 - top + ph, col0 - left : col0 - left + pw] = piece.reshape(ph, pw)
        rows, cols = np.arange(top, top + h + 2 * halo), np.arange(left, left + w + 2 * halo)
        inside = ((rows >= 0) & (rows < height))[:, None] & ((cols >= 0) & (cols < width))[None, :]
        return [(*[table[k][0].as_py() for k in keys], br, bc, height * scale, width * scale, work(cells, inside))]

    return by_runs(blocks.mapInArrow(cut, schema), [*keys, "br", "bc"], assemble, _schema(blocks, keys, RASTER))


# --- what works on neighbourhoods ------------------------------------------------------------


def _any_of(mask: np.ndarray, offsets: list[tuple[int, int]], reach: int) -> np.ndarray:
    """Cells, without the outer ``reach``, that have a set one at some offset."""
    h, w = mask.shape
    out = np.zeros((h - 2 * reach, w - 2 * reach), bool)
    for i, j in offsets:
        out |= mask[reach + i : h - reach + i, reach + j : w - reach + j]
    return out


def disk(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(i, j) for i in r for j in r if i * i + j * j <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(i, j) for i in r for j in r]


def dilate(blocks: DataFrame, offsets: list[tuple[int, int]], *, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Masks (1 is set) with the cells set that have a set neighbour at one of the offsets."""
    reach = max(max(abs(i), abs(j)) for i, j in offsets)
    return neighbourhoods(blocks, reach, lambda cells, inside: _any_of(cells == 1, offsets, reach).astype(float), keys=keys, block=block)


def close_mask(blocks: DataFrame, radius: int = 2, *, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Binary closing with a disk: dilation and erosion by one exchange of twice the radius.  Outside the frame counts as set when it erodes."""
    offsets = disk(radius)

    def work(cells: np.ndarray, inside: np.ndarray) -> np.ndarray:
        grown = _any_of(cells == 1, offsets, radius)
        unset = ~grown & inside[radius:-radius, radius:-radius]
        return (~_any_of(unset, offsets, radius)).astype(float)

    return neighbourhoods(blocks, 2 * radius, work, keys=keys, block=block)


def fill_nearest(blocks: DataFrame, radius: int, *, keys: list[str], block: int = BLOCK, where: Column | None = None) -> DataFrame:
    """Cells without a value take the nearest known one within ``radius``; ties go to the smallest (row, col).

    Distances are separable: first each cell's nearest known one in its column, then the best of the columns
    within the radius, so a cell costs as many steps as the radius and not as its square.  ``where`` picks the
    blocks to fill, such as those of some bands; others stay as they are.
    """

    def work(cells: np.ndarray, inside: np.ndarray) -> np.ndarray:
        h, w = cells.shape
        known = ~np.isnan(cells)
        row = np.arange(h)[:, None]
        above = np.maximum.accumulate(np.where(known, row, -2 * h), axis=0)
        below = np.minimum.accumulate(np.where(known, row, 3 * h)[::-1], axis=0)[::-1]
        source = np.where(row - above <= below - row, above, below)  # the upper one of two as near
        up = (source - row) ** 2
        own = slice(radius, h - radius), slice(radius, w - radius)
        best = np.full((h - 2 * radius, w - 2 * radius), np.iinfo(np.int64).max)
        span = h + w  # larger than any row or column here
        for dc in range(-radius, radius + 1):
            at = own[0], slice(radius + dc, w - radius + dc)
            distance = up[at] + dc * dc
            place = (distance * span + source[at]) * span + np.arange(w)[at[1]]
            best = np.where((distance <= radius * radius) & (place < best), place, best)
        found = best < np.iinfo(np.int64).max
        out = cells[own].copy()
        fill = found & np.isnan(out)
        out[fill] = cells[(best[fill] // span) % span, best[fill] % span]
        return out

    picked = blocks if where is None else blocks.where(where)
    filled = neighbourhoods(picked, radius, work, keys=keys, block=block)
    return filled if where is None else filled.unionByName(blocks.where(~F.coalesce(where, F.lit(False))).select(*filled.columns))


def _cubic(d: np.ndarray) -> np.ndarray:
    """Weight of a sample at a distance: the cubic convolution kernel with parameter -1/2."""
    a = np.abs(d)
    return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1.0, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4.0 * a + 2.0, 0.0))


def sample_weights(at: np.ndarray, size: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places along an axis of ``size`` cells: weights (places x n cells from ``first`` on) of cubic and linear
    sampling, and which cells the cubic one needs.  Samples beyond the edge are those of the edge."""
    cubic, needed, linear = (np.zeros((len(at), n)) for _ in range(3))
    base = np.floor(at).astype(int)
    which = np.arange(len(at))
    for k in range(-1, 3):
        cell = np.clip(base + k, 0, size - 1) - first
        np.add.at(cubic, (which, cell), _cubic(at - (base + k)))
        needed[which, cell] = 1.0
    held = np.clip(at, 0, size - 1)
    for k in (0, 1):
        cell = np.floor(held).astype(int) + k
        ok = cell <= size - 1
        np.add.at(linear, (which[ok], cell[ok] - first), 1.0 - np.abs(held[ok] - cell[ok]))
    return cubic, linear, needed


def _merge(cells: np.ndarray, rows: tuple, cols: tuple, method: str) -> np.ndarray:
    """Samples of a grid of places: cubic where all cells needed are known, else linear over the known ones."""
    known = ~np.isnan(cells)
    values = np.where(known, cells, 0.0)
    weight = rows[1] @ known @ cols[1].T
    with np.errstate(invalid="ignore", divide="ignore"):
        linear = np.where(weight > 1e-12, (rows[1] @ values @ cols[1].T) / weight, np.nan)
    if method == "linear":
        return linear
    whole = rows[2].sum(1)[:, None] * cols[2].sum(1)[None, :]
    return np.where(rows[2] @ known @ cols[2].T > whole - 0.5, rows[0] @ values @ cols[0].T, linear)


def resample(blocks: DataFrame, factor: int, *, keys: list[str], block: int = BLOCK, method: str = "cubic") -> DataFrame:
    """Grids ``factor`` times as fine, in blocks of ``factor`` times the side.

    Cubic convolution where all cells around are known, else bilinear over the known ones; a cell without any
    has no value.
    """
    if method not in ("cubic", "linear"):
        raise ValueError(f"no such method: {method}")
    halo = 2

    def along(inside: np.ndarray) -> tuple:
        """The weights along an axis; what lies in the frame are its cells, and no sample of the block reaches the others."""
        at = (np.arange((len(inside) - 2 * halo) * factor) + 0.5) / factor - 0.5
        first, n = int(np.argmax(inside)), int(inside.sum())
        return sample_weights(at + halo - first, n, -first, len(inside))

    def work(cells: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return _merge(cells, along(inside[:, halo]), along(inside[halo, :]), method)

    return neighbourhoods(blocks, halo, work, keys=keys, block=block, scale=factor)


def overviews(blocks: DataFrame, levels: tuple[int, ...], *, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Blocks of coarser grids, with their ``level``: a cell is the mean of level x level known ones.

    Each block is averaged where it lies, and only the means are shuffled to the blocks of their level.
    """
    if any(block % k for k in levels):
        raise ValueError("a level divides the side of a block")
    named = [*keys, "level"]
    schema = StructType([blocks.schema[k] for k in keys] + StructType.fromDDL(f"level int, {PIECE}").fields)
    arrow = to_arrow_schema(schema)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [b[k].to_pylist() for k in [*keys, "br", "bc", "height", "width"]]
            rows = []
            for *key, br, bc, height, width, cells in zip(*names, _arrays(b["cells"]), strict=True):
                h, w = min(block, height - br * block), min(block, width - bc * block)
                for k in levels:
                    padded = np.full((-(-h // k) * k, -(-w // k) * k), np.nan)
                    padded[:h, :w] = cells.reshape(h, w)
                    parts = padded.reshape(len(padded) // k, k, -1, k)
                    n = (~np.isnan(parts)).sum(axis=(1, 3))
                    mean = np.where(n > 0, np.nansum(parts, axis=(1, 3)) / np.maximum(n, 1), np.nan)
                    rows.append((*key, k, br // k, bc // k, -(-height // k), -(-width // k), br * block // k, bc * block // k, *mean.shape, True, mean))
            if rows:
                yield _batch(rows, arrow)

    def assemble(table: pa.Table) -> list[tuple]:
        br, bc, height, width = (table[c][0].as_py() for c in ("br", "bc", "height", "width"))
        cells = np.full((min(block, height - br * block), min(block, width - bc * block)), np.nan)
        for row0, col0, ph, pw, piece in zip(*[table[c].to_pylist() for c in ("row0", "col0", "h", "w")], _arrays(table["cells"]), strict=True):
            cells[row0 - br * block : row0 - br * block + ph, col0 - bc * block : col0 - bc * block + pw] = piece.reshape(ph, pw)
        return [(*[table[k][0].as_py() for k in named], br, bc, height, width, cells)]

    return by_runs(blocks.mapInArrow(means, schema), [*named, "br", "bc"], assemble, StructType([blocks.schema[k] for k in keys] + StructType.fromDDL(f"level int, {RASTER}").fields))


# --- components ------------------------------------------------------------------------------


def label_runs(mask: np.ndarray) -> np.ndarray:
    """Numbers (1 on, in the order of their first cells) of the 4-connected components: union-find over the runs of each row."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    root = list(range(len(row)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = np.searchsorted(row, np.arange(h + 1)).tolist()
    starts, ends = start.tolist(), end.tolist()
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    _, number = np.unique([find(k) for k in range(len(root))], return_inverse=True)
    out = np.zeros((h, w), np.int64)
    for r, a, b, n in zip(row.tolist(), starts, ends, number.tolist(), strict=True):
        out[r, a:b] = n + 1
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph of edges (a, b): the smallest node that each can reach.

    Every round links the larger neighbours of a node, then its smaller ones, to the smallest: components
    become stars in a number of rounds that grows with the logarithm of their length.  Minima combine before
    the shuffle, and the joins on one row a node split where a node has many edges.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small.where("a <> b"), "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


LABELLED = "br int, bc int, height int, width int, cells array<double>, labels array<long>, sizes array<long>"


def remove_small(blocks: DataFrame, min_size: int, *, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Unset the 4-connected components of fewer than ``min_size`` cells, also those that cross blocks.

    Components are numbered inside each block; only labels along common borders meet to tell which are one,
    and the graph of these is contracted over rounds.  No task holds more than a block.
    """
    schema = _schema(blocks, keys, LABELLED)
    arrow = to_arrow_schema(schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [b[k].to_pylist() for k in [*keys, "br", "bc", "height", "width"]]
            rows = []
            for *key, br, bc, height, width, cells in zip(*names, _arrays(b["cells"]), strict=True):
                h, w = min(block, height - br * block), min(block, width - bc * block)
                labels = label_runs(cells.reshape(h, w) == 1)
                rows.append((*key, br, bc, height, width, cells, labels, np.bincount(labels.reshape(-1))[1:]))
            if rows:
                yield _batch(rows, arrow)

    labelled = stored(blocks.mapInArrow(label, schema), "labelled")
    c = F.col
    across = F.ceil(c("width") / block).cast("long")
    place = c("br").cast("long") * across + c("bc")
    h, w = F.least(F.lit(block), c("height") - c("br") * block), F.least(F.lit(block), c("width") - c("bc") * block)
    named = labelled.withColumn("place", place)

    def node(where: Column, number: Column) -> Column:
        return F.struct(*[c(k).alias(k) for k in keys], where.alias("place"), number.alias("label"))

    sides = {
        "right": (F.transform(F.sequence(F.lit(1), h), lambda r: F.get("labels", (r * w - 1).cast("int"))), c("br"), c("bc"), False),
        "left": (F.transform(F.sequence(F.lit(1), h), lambda r: F.get("labels", ((r - 1) * w).cast("int"))), c("br"), c("bc") - 1, False),
        "low": (F.slice("labels", ((h - 1) * w + 1).cast("int"), w.cast("int")), c("br"), c("bc"), True),
        "high": (F.slice("labels", F.lit(1), w.cast("int")), c("br") - 1, c("bc"), True),
    }
    strips = {n: named.select(*keys, "place", border.alias("strip"), r.alias("r"), k.alias("k"), F.lit(down).alias("down")) for n, (border, r, k, down) in sides.items()}
    one = strips["right"].unionByName(strips["low"])
    other = strips["left"].unionByName(strips["high"]).withColumnsRenamed({"place": "place2", "strip": "strip2"})
    met = one.join(other, [*keys, "r", "k", "down"]).select(*keys, "place", "place2", F.explode(F.arrays_zip("strip", "strip2")).alias("s")).where("s.strip > 0 AND s.strip2 > 0")
    links = met.select(node(c("place"), c("s.strip")).alias("a"), node(c("place2"), c("s.strip2")).alias("b"))
    roots = stored(connected(links), "roots")
    sized = named.select(*keys, "place", F.posexplode("sizes").alias("label", "size")).select(node(c("place"), (c("label") + 1).cast("long")).alias("node"), "size")
    whole = sized.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    totals = whole.groupBy("root").agg(F.sum("size").alias("total")).where(c("total") < min_size)
    small = whole.join(totals, "root", "left_semi")
    dropped = small.groupBy(*[c(f"node.{k}").alias(k) for k in keys], c("node.place").alias("place")).agg(F.collect_list("node.label").alias("dropped"))
    out = named.join(dropped, [*keys, "place"], "left")

    @F.arrow_udf("array<double>")
    def kept(labels: pa.Array, gone: pa.Array) -> pa.Array:
        made = []
        for numbers, some in zip(_arrays(labels), gone.to_pylist(), strict=True):
            stays = np.ones(int(numbers.max(initial=0)) + 1)
            stays[[0, *(some or [])]] = 0
            made.append(stays[numbers.astype(np.int64)])
        return _lists(made, pa.list_(pa.float64()))

    return out.select(*keys, "br", "bc", "height", "width", kept("labels", "dropped").alias("cells"))
