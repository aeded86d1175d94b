"""Merkle manifest of a dataset: an associative monoid of sparse forests.

Every row is a leaf.  The leaves of a group (a language) form a tree of known arity in the
order of their keys, and the trees' roots, in the order of the groups, form one tree above
them.  A forest holds the nodes whose sibling runs are not complete, keyed by tree, level
and index; merging two forests unites their nodes and turns every run that is now complete
into its parent, so forests can be merged in any order and grouping.  Sizes are counted
first, which is what makes the arity of a last, shorter run known.

Only digests are shuffled.  Leaves meet in aligned blocks of ``ARITY ** BLOCK_LEVELS``; the
roots of the blocks are merged over rounds of fewer and fewer tasks, and the runs completed
on the way are kept as rows, out of which every block gets the siblings above it.  The
driver gets the sizes of these tables and one root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BROADCAST_ROWS, discard, materialise

#: Children of a node.
ARITY = 8
#: Levels of the tree inside a block of leaves, which one call works on.
BLOCK_LEVELS = 4
#: Open nodes that one task merges at first, and tasks whose forests the next round merges in one.
NODES_PER_TASK, FAN_IN = 4_096, 16
#: The number of the tree over the groups' roots.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value for hashing: its bytes' number, a colon and itself; a dash if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest (32 bytes) of a row's values."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def joined(digests: list[str]) -> str:
    """The digest of a sibling run, all in hexadecimal."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def level_size(n: int, level: int) -> int:
    return -(-n // ARITY**level)


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    level = 0
    while level_size(n, level) > 1:
        level += 1
    return level


class Forest:
    """Nodes of trees whose sibling runs are not complete.

    ``sizes`` has the leaves of each tree it has met, ``trees`` their number.  What became complete since
    ``closed`` was last emptied stands there as (tree, level of the children, index of the parent, children).
    """

    def __init__(self, trees: int):
        self.trees, self.sizes = trees, {TOP: trees}
        self.open: dict[tuple[int, int, int], dict[int, str]] = {}
        self.root: str | None = None
        self.closed: list[tuple[int, int, int, list[str]]] = []

    def add(self, tree: int, n: int, level: int, index: int, digest: str) -> None:
        self.sizes[tree] = n
        while True:
            if level_size(n, level) == 1:  # the root of its tree
                if tree == TOP:
                    self.root = digest
                    return
                tree, n, level, index = TOP, self.trees, 0, tree
                continue
            parent = index // ARITY
            run = self.open.setdefault((tree, level, parent), {})
            run[index % ARITY] = digest
            if len(run) < min(ARITY, level_size(n, level) - ARITY * parent):
                return
            children = [run[k] for k in sorted(run)]
            del self.open[tree, level, parent]
            self.closed.append((tree, level, parent, children))
            digest, level, index = joined(children), level + 1, parent

    def merge(self, other: Forest) -> Forest:
        self.root = self.root or other.root
        for tree, n, level, index, digest in other.nodes():
            self.add(tree, n, level, index, digest)
        return self

    def nodes(self) -> Iterator[tuple[int, int, int, int, str]]:
        for (tree, level, parent), run in self.open.items():
            for k, digest in run.items():
                yield tree, self.sizes[tree], level, ARITY * parent + k, digest


#: Nodes as rows: open ones have a digest, completed runs their children, and then the index is that of the parent.
NODES = "tree long, n long, trees long, level int, index long, digest string, children array<string>"
ARROW_NODES = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("trees", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's nodes: the runs completed in it, then its open nodes."""
    forest = None
    for b in batches:
        for tree, n, trees, level, index, digest in zip(*[b[c].to_pylist() for c in ("tree", "n", "trees", "level", "index", "digest")], strict=True):
            forest = forest or Forest(trees)
            forest.add(tree, n, level, index, digest)
        if forest and forest.closed:
            rows = [(t, forest.sizes[t], forest.trees, level, parent, None, children) for t, level, parent, children in forest.closed]
            forest.closed = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW_NODES, strict=True)], schema=ARROW_NODES)
    if forest:
        rows = [(t, n, forest.trees, level, index, digest, None) for t, n, level, index, digest in forest.nodes()]
        if forest.root:
            rows.append((TOP, forest.trees, forest.trees, height(forest.trees), 0, forest.root, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW_NODES, strict=True)], schema=ARROW_NODES)


def tree_reduce(nodes: DataFrame, count: int) -> list[DataFrame]:
    """Merge the forests of all tasks, ``FAN_IN`` at a time, until one is left.

    Each round is a stored table of runs that became complete and nodes that are still open; the last has
    the root as its only open node.  A round's open nodes are few: a run's part at either edge of a task's
    range, for each level.
    """
    tasks, rounds = max(1, -(-count // NODES_PER_TASK)), []
    while True:
        at = F.col("index") * F.pow(F.lit(float(ARITY)), F.col("level"))
        dealt = nodes.repartitionByRange(tasks, "tree", at) if tasks > 1 else nodes.coalesce(1)
        rounds.append(materialise(dealt.mapInArrow(_fold, NODES)))
        if tasks == 1:
            return rounds
        nodes, tasks = rounds[-1].where("digest IS NOT NULL"), -(-tasks // FAN_IN)


@dataclass
class Manifest:
    """The leaves with their places, the siblings above each block of them, and the root (null without rows)."""

    leaves: DataFrame
    above: DataFrame
    root: str | None
    block_levels: int = BLOCK_LEVELS


def _places(narrow: DataFrame, block_levels: int) -> tuple[DataFrame, int, int]:
    """Stored leaves with tree, n, trees and index; the number of blocks, and the height of the tallest tree.

    Ranges of (group, key) are numbered each for itself and counted; a window over the counts, a row for each
    task and group, gives what stands before.
    """
    order = [F.col("by").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged).withColumns({"part": F.shiftrightunsigned("at", 33), "inside": F.col("at").bitwiseAND((1 << 33) - 1)})
    parts = ranged.groupBy("by", "part").agg(F.count("*").alias("rows"), F.min("inside").alias("first"))
    of_tree = Window.partitionBy("by")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"n": F.sum("rows").over(of_tree), "before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "one": F.row_number().over(of_tree.orderBy("part"))})
    trees = parts.where("one = 1").select(F.col("by").alias("group"), (F.row_number().over(Window.orderBy(F.col("by").asc_nulls_first())) - 1).cast("long").alias("tree"))
    parts = parts.join(trees, F.col("by").eqNullSafe(F.col("group"))).select(F.col("group"), F.col("part").alias("of"), "tree", "n", "first", "before", "one")
    parts = materialise(parts)
    block = ARITY**block_levels
    total = parts.agg(F.count("*"), F.sum(F.when(F.col("one") == 1, F.ceil(F.col("n") / block))), F.max("n"), F.max("tree")).first()
    right = F.broadcast(parts) if total[0] <= BROADCAST_ROWS else parts
    placed = ranged.join(right, (F.col("part") == F.col("of")) & F.col("by").eqNullSafe(F.col("group")))
    index = F.col("before") + F.col("inside") - F.col("first")
    out = placed.select("key", "leaf", "seen", "tree", "n", F.lit((total[3] or 0) + 1).cast("long").alias("trees"), index.alias("index"))
    return out, total[1] or 0, height(total[2] or 1)


def _block_root(block_levels: int):
    def run(table: pa.Table) -> pa.Table:
        """The node that a block of leaves comes to."""
        tree, n, trees, first = (table[c][0].as_py() for c in ("tree", "n", "trees", "block"))
        level = min(block_levels, height(n))
        digest = _levels(_digests(table), level)[level][0]
        return pa.table([[tree], [n], [trees], [level], [first], [digest], [None]], schema=ARROW_NODES)

    return run


def _digests(table: pa.Table) -> list[str]:
    order = sorted(zip(table["index"].to_pylist(), table["leaf"].to_pylist(), strict=True))
    return [d.hex() for _, d in order]


def _levels(leaves: list[str], top: int) -> list[list[str]]:
    out = [leaves]
    for _ in range(top):
        out.append([joined(out[-1][k : k + ARITY]) for k in range(0, len(out[-1]), ARITY)])
    return out


def build(docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", by: str = "lang", seen: dict[str, Column] | None = None, when: Column | None = None, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of ``docs``: a leaf for every row, of the given columns in their order.

    Rows are ordered by (by, key), nulls first, rows of one key by their digest; equal rows are equal leaves
    and each has a place.  Other columns are neither read nor hashed.  ``seen`` has columns as a later reader
    finds them, where ``when`` holds; their leaves are kept beside the original ones for ``prove``.
    """
    original = leaf(*[F.col(f"`{c}`") for c in columns])
    found = leaf(*[(seen or {}).get(c, F.col(f"`{c}`")) for c in columns])
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{by}`").alias("by"), original.alias("leaf"), F.when(F.lit(False) if when is None else when, found).alias("seen"))
    leaves, blocks, tallest = _places(narrow, block_levels)
    leaves = leaves.withColumn("block", F.floor(F.col("index") / ARITY**block_levels))
    roots = leaves.drop("key", "seen").groupBy("tree", "block").applyInArrow(_block_root(block_levels), NODES)
    rounds = tree_reduce(roots, blocks)
    found = rounds[-1].where("digest IS NOT NULL").take(1)
    runs = rounds[0]
    for r in rounds[1:]:
        runs = runs.unionByName(r)
    above = _above(runs.where("children IS NOT NULL"), found[0]["trees"] if found else 1, tallest, block_levels)
    discard(*rounds)
    return Manifest(leaves, above, found[0]["digest"] if found else None, block_levels)


def _above(runs: DataFrame, trees: int, tallest: int, block_levels: int) -> DataFrame:
    """(tree, block, steps): what stands above each block, a step a level, with the place in its run and the run.

    Runs get the steps above them from the run that holds their parent, from the top down: each join gives a
    run at most eight below it, so no run is a hot key.
    """
    steps = F.array().cast("array<struct<slot: int, run: array<string>>>")
    up = height(trees)

    def below(runs_here: DataFrame, from_top: DataFrame, parent: Column) -> DataFrame:
        """Runs, with the steps above the children of ``from_top``'s runs put before theirs."""
        slot = (parent % ARITY).cast("int")
        mine = runs_here.select("tree", "n", F.col("index").alias("mine"), F.col("children").alias("own"), F.floor(parent / ARITY).alias("holder"), slot.alias("slot"))
        met = mine.join(from_top, ["holder"] if "tree" not in from_top.columns else ["tree", "holder"])
        return met.select("tree", "n", "mine", "own", F.concat(F.array(F.struct("slot", F.col("children").alias("run"))), "steps").alias("steps"))

    def as_holder(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.select(*keys, F.col("mine").alias("holder"), F.col("own").alias("children"), "steps")

    top = runs.where(F.col("tree") == TOP)
    here = None
    for level in range(up - 1, -1, -1):
        at = top.where(F.col("level") == level)
        here = at.select("tree", "n", F.col("index").alias("mine"), F.col("children").alias("own"), steps.alias("steps")) if here is None else below(at, as_holder(here), F.col("index"))
    if here is not None:
        here = materialise(here)

    def to_top(rows: DataFrame) -> DataFrame:
        """Rows (tree, n, mine, own) whose parent is the root of its tree, with the steps of the tree over the trees."""
        if here is None:
            return rows.withColumn("steps", steps)
        holder = as_holder(here).withColumnRenamed("holder", "top")
        met = rows.withColumns({"top": F.floor(F.col("tree") / ARITY), "slot": (F.col("tree") % ARITY).cast("int")}).join(holder, "top")
        return met.select(*rows.columns, F.concat(F.array(F.struct("slot", F.col("children").alias("run"))), "steps").alias("steps"))

    lower = runs.where(F.col("tree") != TOP)
    held, out = None, []
    for level in range(tallest - 1, block_levels - 1, -1):
        at = lower.where(F.col("level") == level)
        last = at.where(F.col("n") <= ARITY ** (level + 1))
        made = to_top(last.select("tree", "n", F.col("index").alias("mine"), F.col("children").alias("own")))
        if held is not None:
            made = made.unionByName(below(at.where(F.col("n") > ARITY ** (level + 1)), as_holder(held, "tree"), F.col("index")))
        held = made
    if held is not None:
        # every block is a child of one of these runs
        children = held.select("tree", "mine", F.posexplode("own").alias("slot", "digest"), "own", "steps")
        out.append(children.select("tree", (F.col("mine") * ARITY + F.col("slot")).alias("block"), F.concat(F.array(F.struct(F.col("slot").cast("int").alias("slot"), F.col("own").alias("run"))), "steps").alias("steps")))
    # trees of one block have only the tree over the trees above them
    if here is not None:
        whole = here.select(F.col("mine"), F.col("own"), "steps", F.posexplode("own").alias("slot", "digest"))
        whole = whole.select((F.col("mine") * ARITY + F.col("slot")).alias("tree"), F.lit(0).cast("long").alias("block"), F.concat(F.array(F.struct(F.col("slot").cast("int").alias("slot"), F.col("own").alias("run"))), "steps").alias("steps"))
        taller = lower.where(F.col("level") >= block_levels).select("tree").distinct()
        out.append(whole.join(taller, "tree", "left_anti"))
    if not out:
        return materialise(runs.where("false").select("tree", F.col("index").alias("block"), steps.alias("steps")))
    made = out[0]
    for o in out[1:]:
        made = made.unionByName(o)
    made = materialise(made)
    if here is not None:
        discard(here)
    return made


PROOF = "leaf string, subroot string, proof_sha256 string, folded_root string"


def prove(manifest: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    The proof is the digest of all siblings from the leaf up to the root, left to right in each run.
    folded_root comes of the leaf as ``seen`` (the original where nothing was changed) and the original
    siblings; verified says whether it is the root.  A table without rows gives none.
    """

    block_levels = manifest.block_levels

    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        leaves = leaves.sort_by("index")
        n = leaves["n"][0].as_py()
        tall = height(n)
        top = min(block_levels, tall)
        levels = _levels([d.hex() for d in leaves["leaf"].to_pylist()], top)
        steps = above["steps"][0].as_py() if above.num_rows else []
        upper, node, subroot = [], levels[top][0], levels[top][0]
        for k, step in enumerate(steps):
            upper += step["run"][: step["slot"]] + step["run"][step["slot"] + 1 :]
            node = joined(step["run"])
            if top + k + 1 == tall:
                subroot = node
        proofs, folded = [], []
        for i, (own, seen) in enumerate(zip(levels[0], leaves["seen"].to_pylist(), strict=True)):
            node, siblings, k = own if seen is None else seen.hex(), [], i
            for level in levels[:top]:
                first, slot = k - k % ARITY, k % ARITY
                left, right = level[first : first + slot], level[first + slot + 1 : first + ARITY]
                siblings += left + right
                node, k = joined([*left, node, *right]), k // ARITY
            for step in steps:
                node = joined([*step["run"][: step["slot"]], node, *step["run"][step["slot"] + 1 :]])
            proofs.append(joined(siblings + upper))
            folded.append(node)
        return pa.table([leaves["key"], levels[0], [subroot] * len(proofs), proofs, folded], schema=pa.schema(list(zip(names, types, strict=True))))

    kind = manifest.leaves.schema["key"].dataType
    names, types = ["key", "leaf", "subroot", "proof_sha256", "folded_root"], [to_arrow_type(kind), *[pa.string()] * 4]
    met = manifest.leaves.groupBy("tree", "block").cogroup(manifest.above.groupBy("tree", "block"))
    out = met.applyInArrow(run, f"key {kind.simpleString()}, {PROOF}")
    root = F.lit(manifest.root).cast("string")
    return out.select("key", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def drop(manifest: Manifest) -> None:
    """Remove the stored tables of a manifest that is not read any more."""
    discard(manifest.leaves, manifest.above)
