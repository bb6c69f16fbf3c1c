"""Face-connected components of thresholded maps, at one height or many, by bricks of the grid and the seams between them.

Levels are whole numbers: at level s the voxels of level s or more form components, and a component of level s lies in one
of level s - 1. A task has a brick of one map: union-find over its voxels in order of falling level gives the brick's
component tree. Nodes that no outer face of the brick touches are whole and are summed up where they are. The others are
named by their first voxel; faces of neighbouring bricks meet at the seam, where two nodes of one level are linked, and the
components of these links (by map, side and level) tell which nodes are one. So no task holds a map, and what is shuffled
are faces and open nodes.

A piece is a row of one of four kinds: a face voxel with the names of its nodes at levels 1, 2, ...; an open node with its
size; an open node with the names of those around it and the greatest sum of the whole nodes inside; and a voxel with its
innermost open node, the first voxel of its outermost node in the brick, and the sum of the whole nodes that hold it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: Voxels along each edge of a brick.
BRICK = 16
FACE, NODE, INNERMOST, VOXEL = range(4)
#: Name of the node of a voxel that is in no open one, and of none.
NONE = -1
_BITS = 21
_SHIFT = 1 << 20

PIECES = "side int, kind int, axis int, cell long, level int, n long, names array<long>, value double"
_TYPES = {"side": pa.int32(), "kind": pa.int32(), "axis": pa.int32(), "cell": pa.int64(), "level": pa.int32(), "n": pa.int64(), "names": pa.list_(pa.int64()), "value": pa.float64()}


def packed(cells: np.ndarray) -> np.ndarray:
    """One number a voxel, in C order; coordinates are within 2**20 of 0."""
    c = np.asarray(cells, np.int64) + _SHIFT
    return (c[:, 0] << 2 * _BITS) | (c[:, 1] << _BITS) | c[:, 2]


def packed_column(i: str = "i", j: str = "j", k: str = "k") -> Column:
    c = [F.col(x).cast("long") + _SHIFT for x in (i, j, k)]
    return F.shiftleft(c[0], 2 * _BITS).bitwiseOR(F.shiftleft(c[1], _BITS)).bitwiseOR(c[2])


def unpacked(cell: Column) -> list[Column]:
    """i, j, k of packed numbers."""
    part = [F.shiftright(cell, 2 * _BITS), F.shiftright(cell, _BITS).bitwiseAND((1 << _BITS) - 1), cell.bitwiseAND((1 << _BITS) - 1)]
    return [(x - _SHIFT).cast("int") for x in part]


def brick_of(brick: int, cells: tuple[str, str, str] = ("i", "j", "k")) -> list[Column]:
    return [F.floor(F.col(c) / brick).cast("int").alias(f"_b{c}") for c in cells]


@dataclass
class Weights:
    """What a component of n voxels adds to each of its voxels at level s: share(n) * steps[s - 1]."""

    share: Callable[[np.ndarray], np.ndarray]
    column: Callable[[Column], Column]
    steps: np.ndarray
    total: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.total = np.concatenate([[0.0], np.cumsum(self.steps)])


def size_weights() -> Weights:
    """One level; a voxel gets the size of its component."""
    return Weights(lambda n: np.asarray(n, float), lambda n: n.cast("double"), np.ones(1))


def tfce_weights(steps: int) -> Weights:
    """Level s is the height s * dh; a voxel gets sqrt(n) * s**2 at each, in units of dh**3."""
    return Weights(np.sqrt, F.sqrt, np.arange(1, steps + 1, dtype=float) ** 2)


def tree(level: np.ndarray, at: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Parents of voxels in the component tree: level above 0 of voxels at flat places `at` of a box.

    A voxel's parent is the first voxel of its own node, and of that one the first voxel of the node around it; the first
    voxel of an outermost node is its own parent. Voxels are taken in order of falling level, and sets of them united.
    """
    n = len(level)
    order = np.lexsort((at, -level)).tolist()
    place = np.full(int(np.prod(np.add(shape, 2))), -1)
    grown = np.add(shape, 2)
    where = np.ravel_multi_index(tuple(np.add(np.unravel_index(at, shape), 1)), tuple(grown))
    place[where] = np.arange(n)
    step = (grown[1] * grown[2], grown[2], 1)
    near = np.stack([place[where + d] for s in step for d in (-s, s)], 1).tolist()
    parent, root, seen = list(range(n)), list(range(n)), [False] * n
    for v in order:
        seen[v] = True
        for w in near[v]:
            if w >= 0 and seen[w]:
                r = w
                while root[r] != r:
                    root[r] = root[root[r]]
                    r = root[r]
                if r != v:
                    root[r] = v
                    parent[r] = v
    # Now from the outermost: a parent of equal level that is not the first of its node is passed over.
    levels = level.tolist()
    for v in reversed(order):
        p = parent[v]
        if levels[parent[p]] == levels[p]:
            parent[v] = parent[p]
    return np.array(parent, np.int64)


def pieces(cells: np.ndarray, level: np.ndarray, low: np.ndarray, brick: int, weights: Weights, side: int, voxels: bool) -> list[tuple]:
    """The pieces of one brick that begins at low: levels of its voxels, 0 or less for those in no component."""
    up = level > 0
    cells, level = cells[up], level[up]
    if not len(level):
        return []
    inner = cells - low
    parent = tree(level, np.ravel_multi_index(tuple(inner.T), (brick,) * 3), (brick,) * 3)
    name = packed(cells).tolist()
    n = len(level)
    levels = level.tolist()
    first = [v if parent[v] == v or levels[parent[v]] != levels[v] else int(parent[v]) for v in range(n)]
    outer = [-1 if parent[f] == f else int(parent[f]) for f in first]
    on_face = ((inner == 0) | (inner == brick - 1)).any(1)
    size, open_, least = [0] * n, [False] * n, list(name)
    for v in range(n):
        f = first[v]
        size[f] += 1
        open_[f] |= bool(on_face[v])
        least[f] = min(least[f], name[v])
    nodes = sorted({*first}, key=lambda f: -levels[f])
    for f in nodes:
        o = outer[f]
        if o >= 0:
            size[o] += size[f]
            open_[o] |= open_[f]
            least[o] = min(least[o], least[f])
    share = weights.share(np.array(size))
    out: list[tuple] = []
    names: dict[int, list[int]] = {}
    inside, innermost, outermost, best = [0.0] * n, [NONE] * n, list(range(n)), {}
    for f in reversed(nodes):
        o = outer[f]
        below = levels[o] if o >= 0 else 0
        outermost[f] = outermost[o] if o >= 0 else f
        if open_[f]:
            names[f] = (names[o] if o >= 0 else []) + [least[f]] * (levels[f] - below)
            innermost[f] = f
            best[f] = 0.0
            out += [(side, NODE, None, least[f], s, size[f], None, None) for s in range(below + 1, levels[f] + 1)]
        else:
            inside[f] = share[f] * (weights.total[levels[f]] - weights.total[below]) + (inside[o] if o >= 0 else 0.0)
            innermost[f] = innermost[o] if o >= 0 else NONE
            best[innermost[f]] = max(best.get(innermost[f], 0.0), inside[f])
    out += [(side, INNERMOST, None, name[f] if f != NONE else NONE, None, None, names.get(f, []), b) for f, b in best.items()]
    for axis in range(3):
        for edge, back in ((0, 1), (brick - 1, 0)):
            for v in np.flatnonzero(inner[:, axis] == edge).tolist():
                lower = cells[v].copy()
                lower[axis] -= back
                out.append((side, FACE, axis, int(packed(lower[None])[0]), None, None, names[first[v]], None))
    if voxels:
        for v in range(n):
            f = first[v]
            at = innermost[f]
            out.append((side, VOXEL, None, name[v], None, None, [NONE if at == NONE else name[at], least[outermost[f]]], inside[f]))
    return out


def as_table(found: list[tuple], by: str, keys: pa.Array) -> pa.Table:
    """Pieces with the map of each."""
    columns = zip(*found) if found else [[] for _ in _TYPES]
    return pa.table({by: keys} | {name: pa.array(x, kind) for (name, kind), x in zip(_TYPES.items(), columns)})


def pieces_of_rows(rows: DataFrame, by: str, weights: Weights, brick: int = BRICK, voxels: bool = True) -> DataFrame:
    """Pieces of rows (by, side, i, j, k, level): a brick of a map and side is a group."""
    kind = rows.schema[by].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        cells = np.column_stack([t.column(c).to_numpy() for c in "ijk"]).astype(np.int64)
        found = pieces(cells, t.column("level").to_numpy(), cells[0] // brick * brick, brick, weights, t.column("side")[0].as_py(), voxels)
        return as_table(found, by, t.column(by).combine_chunks().take(pa.array(np.zeros(len(found), np.int64))))

    return rows.groupBy(by, "side", *brick_of(brick)).applyInArrow(run, f"`{by}` {kind}, {PIECES}")


def merged(made: DataFrame, by: str, weights: Weights) -> tuple[DataFrame, DataFrame]:
    """(innermost, voxels): by, side, name, base, best, root of innermost open nodes and of NONE; by, side, cell, name, own, inside.

    base is what the open nodes around a voxel add up to at their whole sizes, over all bricks, and root the first voxel of
    the innermost of them; the greatest value of a map is that of base + best, and a voxel's value is base + inside. made is
    read several times: give it as a stored table.
    """
    faces = made.where(F.col("kind") == FACE).groupBy(by, "side", "axis", "cell").agg(F.collect_list("names").alias("m")).where(F.size("m") == 2)
    both = faces.select(by, "side", F.posexplode(F.arrays_zip(F.col("m")[0].alias("a"), F.col("m")[1].alias("b"))).alias("s", "ab"))
    links = both.select(by, "side", (F.col("s") + 1).alias("level"), "ab.a", "ab.b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    found = components(links, [by, "side", "level"]).withColumnRenamed("node", "cell")
    nodes = made.where(F.col("kind") == NODE).select(by, "side", "level", "cell", "n")
    rooted = nodes.join(found, [by, "side", "level", "cell"], "left").withColumn("root", F.coalesce("root", "cell"))
    whole = rooted.groupBy(by, "side", "level", "root").agg(F.sum("n").alias("whole"))
    sized = rooted.join(whole, [by, "side", "level", "root"]).select(by, "side", "level", F.col("cell").alias("around"), "whole", "root")
    step = F.array(*[F.lit(float(x)) for x in weights.steps])
    inner = made.where(F.col("kind") == INNERMOST).select(by, "side", F.col("cell").alias("name"), "names", F.col("value").alias("best"))
    spread = inner.select(by, "side", "name", F.posexplode("names").alias("s", "around")).withColumn("level", F.col("s") + 1).drop("s")
    sums = spread.join(sized, [by, "side", "level", "around"]).groupBy(by, "side", "name").agg(F.sum(weights.column(F.col("whole")) * F.element_at(step, F.col("level"))).alias("base"), F.max_by("root", "level").alias("root"))
    # NONE stands for a brick's closed trees, so it may come from many bricks.
    closed = inner.where(F.col("name") == NONE).groupBy(by, "side", "name").agg(F.max("best").alias("best")).select(by, "side", "name", F.lit(0.0).alias("base"), "best", F.lit(None).cast("long").alias("root"))
    opened = inner.where(F.col("name") != NONE).select(by, "side", "name", "best").join(sums, [by, "side", "name"]).select(by, "side", "name", "base", "best", "root")
    voxels = made.where(F.col("kind") == VOXEL).select(by, "side", "cell", F.col("names")[0].alias("name"), F.col("names")[1].alias("own"), F.col("value").alias("inside"))
    return opened.unionByName(closed), voxels


def voxel_values(inner: DataFrame, voxels: DataFrame, by: str) -> DataFrame:
    """by, side, i, j, k, value, outermost: a voxel's sum over the components that hold it, and the first voxel of the largest.

    outermost is exact for one level; of several, it is that of the innermost open node.
    """
    found = voxels.join(inner.select(by, "side", "name", "base", "root"), [by, "side", "name"])
    i, j, k = unpacked(F.col("cell"))
    return found.select(by, "side", i.alias("i"), j.alias("j"), k.alias("k"), (F.col("base") + F.col("inside")).alias("value"), F.coalesce("root", "own").alias("outermost"))
