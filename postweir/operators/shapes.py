"""Polygon edges in a grid, and Arrow kernels that look points up in it.

The grid has at most (GRID + 2) squared cells, fewer for few edges. A cell holds the edges that pass through it and says which polygons contain its lower left
corner; a cell without edges lies wholly inside those. Points meet only their own cell (containment), or the cells that may hold their nearest edge. Within a cell
a kernel descends: it quarters the cell and its edges until a point meets at most LEAF of them, the corner's parity being carried along the way.

Points travel in pieces of one cell, so a cell with very many points is many rows, which a skewed join may deal to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweir.session import stage

#: Cells along the longer side of the polygons' extent at most, and edges of a cell that are aimed at.
GRID, CELL_EDGES = 64, 16
#: Points of a piece, edges a point meets at most where halving can separate them, and halvings of a cell.
PIECE, LEAF, DEPTH = 4096, 32, 40

_CELL = "cx bigint, cy bigint, ords array<bigint>, isos array<string>, inside array<boolean>, edges binary, owner binary"


@dataclass(frozen=True)
class Grid:
    size: float
    low_x: float
    low_y: float
    high_x: float
    high_y: float

    def cell(self, v: Column, low: float, high: float) -> Column:
        """Number of the cell of a coordinate. Far outside the polygons' extent all points share the outermost cells."""
        far = self.size * 1e6
        return F.floor(F.least(F.greatest(v, F.lit(low - far)), F.lit(high + far)) / self.size).cast("bigint")

    def x(self, v: Column) -> Column:
        return self.cell(v, self.low_x, self.high_x)

    def y(self, v: Column) -> Column:
        return self.cell(v, self.low_y, self.high_y)


def grid_of(edges: DataFrame) -> Grid | None:
    """The grid of the edges' extent, or None without edges; the size of a cell is a power of two."""
    found = edges.agg(
        F.min(F.least("x1", "x2")).alias("a"), F.min(F.least("y1", "y2")).alias("b"), F.max(F.greatest("x1", "x2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"), F.count(F.lit(1)).alias("n")
    ).first()
    if found["a"] is None:
        return None
    extent = max(found["c"] - found["a"], found["d"] - found["b"])
    along = min(np.ceil(np.sqrt(found["n"] / CELL_EDGES)), GRID)
    return Grid(float(2.0 ** np.ceil(np.log2(extent / along))) if extent else 1.0, *[found[c] for c in "abcd"])


_EDGE = ("x1", "y1", "x2", "y2")


def grid_cells(edges: DataFrame, grid: Grid) -> DataFrame:
    """The cells that hold an edge or lie inside a polygon, from (ord, iso_a2, x1, y1, x2, y2); written below the shared folder and read back."""
    size = grid.size
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size).cast("bigint"), F.floor(F.greatest(a, b) / size).cast("bigint"))
    spread = edges.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # how far the cell's centre is from the edge's line, against how far its corners reach
    off = F.abs(((F.col("cy") + 0.5) * size - F.col("y1")) * dx - ((F.col("cx") + 0.5) * size - F.col("x1")) * dy)
    passing = spread.where(off <= 0.5000001 * size * (F.abs(dx) + F.abs(dy)))
    # corners whose ray to the right crosses the edge; a ray that meets a vertex or runs along an edge is taken as a little higher, and a little to the right
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    lines = edges.withColumn("first", F.ceil(low / size).cast("bigint")).withColumn("last", F.ceil(high / size).cast("bigint") - 1).where("first <= last")
    rows = lines.withColumn("cy", F.explode(F.sequence("first", "last")))
    west = F.lit(int(np.floor(grid.low_x / size))).cast("bigint")

    def crosses(cx: Column) -> Column:
        side = (F.col("cy") * size - F.col("y1")) * dx - (cx * size - F.col("x1")) * dy
        left = F.when(side != 0, side > 0).when(dx != 0, dx > 0).otherwise(dy < 0)
        return left == (F.col("y2") > F.col("y1"))

    # all corners up to the last one left of the edge: where the edge meets the line tells it but for rounding, so the corners around are asked; an edge is one row for each line, not for each corner
    about = F.floor((F.col("x1") + (F.col("cy") * size - F.col("y1")) * (dx / dy)) / size).cast("bigint")
    last = F.col("about") - 2 + sum((F.when(crosses(F.col("about") + k), 1).otherwise(0) for k in (-1, 0, 1)), F.lit(0))
    upto = F.least(last, F.floor(F.greatest("x1", "x2") / size).cast("bigint"))
    met = rows.withColumn("about", about).withColumn("upto", upto).groupBy("cy", "ord", "iso_a2", "upto").agg(F.count(F.lit(1)).alias("n")).where(F.col("upto") >= west)
    corners = met.where("n % 2 = 1").withColumn("cx", F.explode(F.sequence(west, "upto")))
    crossed = corners.groupBy("cx", "cy", "ord", "iso_a2").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    names = ["cx", "cy", "ord", "iso_a2"]
    both = passing.select(*names, *_EDGE).unionByName(crossed.select(*names), allowMissingColumns=True)
    return stage(both.withColumn("ord", F.col("ord").cast("bigint")).repartition("cx", "cy").sortWithinPartitions("cx", "cy").mapInArrow(_pack_cells, _CELL), "cells")


def _pack_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a cell from the rows of (cx, cy, ord, iso_a2, x1, y1, x2, y2), whole columns at a time; those of a cell come together."""
    key, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ords, isos = (rows[c].combine_chunks().dictionary_encode("encode") for c in ("ord", "iso_a2"))
        found, which = np.unique(ords.indices.to_numpy().astype(np.int64) * len(isos.dictionary) + isos.indices.to_numpy(), return_inverse=True)
        ord_values, iso_values = ords.dictionary.to_pylist(), isos.dictionary.to_pylist()
        names = [(ord_values[k // len(iso_values)], iso_values[k % len(iso_values)]) for k in found.tolist()]
        order = sorted(range(len(names)), key=lambda k: (names[k][0], names[k][1] or "", names[k][1] is not None))
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        line = rows["x1"].is_valid().to_numpy()
        owner, inside = place[which], np.zeros(len(names), bool)
        inside[owner[~line]] = True
        edges = np.stack([rows[c].to_numpy()[line] for c in _EDGE], axis=1).astype(np.float64)
        yield pa.RecordBatch.from_arrays([
            pa.array([key[0]]), pa.array([key[1]]), pa.array([[names[k][0] for k in order]], pa.list_(pa.int64())), pa.array([[names[k][1] for k in order]], pa.list_(pa.string())),
            pa.array([inside.tolist()], pa.list_(pa.bool_())), pa.array([edges.tobytes()], pa.binary()), pa.array([owner[line].tobytes()], pa.binary()),
        ], ["cx", "cy", "ords", "isos", "inside", "edges", "owner"])

    for batch in batches:
        cx, cy = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])).tolist() if len(cx) else []
        for i, j in zip(first, [*first[1:], len(cx)], strict=False):
            here = (int(cx[i]), int(cy[i]))
            if here != key:
                yield from close()
                key = here
            held.append(batch.slice(i, j - i))
    yield from close()


def _side(px: np.ndarray, py: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Is the point left of the edge (upwards)? A point on its line is taken as a little higher, then as a little to the right."""
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    turn = (py - e[:, 1]) * dx - (px - e[:, 0]) * dy
    return np.where(turn != 0, turn > 0, np.where(dx != 0, dx > 0, dy < 0))


def _on_way(px: np.ndarray, py: np.ndarray, corner: tuple[float, float], e: np.ndarray) -> np.ndarray:
    """Whether the way from the corner straight up and then to the right to the point crosses each edge an odd number of times."""
    ax, ay = corner
    at_turn = _side(ax, py, e)
    across = ((e[:, 1] > py) != (e[:, 3] > py)) & (_side(px, py, e) != at_turn)
    upwards = ((e[:, 0] > ax) != (e[:, 2] > ax)) & (_side(np.float64(ax), np.float64(ay), e) != at_turn)
    return across ^ upwards


def _odd(crossed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Parity of the crossed edges of each of n polygons, for each row of `crossed`."""
    return np.stack([crossed[:, owner == k].sum(axis=1) % 2 == 1 for k in range(n)], axis=1) if n else np.zeros((len(crossed), 0), bool)


def containing(px: np.ndarray, py: np.ndarray, corner: tuple[float, float], size: float, e: np.ndarray, owner: np.ndarray, inside: np.ndarray,
               met: np.ndarray | None = None) -> np.ndarray:
    """The first polygon that strictly contains each point of a cell, or -1. `met`, if given, receives the number of edges each point was held against."""
    found = np.full(len(px), -1)
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    open_ = [(np.arange(len(px)), np.arange(len(e)), corner, size, inside, 0)]
    while open_:
        p, at, (x0, y0), size, inside, depth = open_.pop()
        here = e[at]
        if len(at) <= LEAF or depth >= DEPTH:
            x, y = px[p][:, None], py[p][:, None]
            odd = _odd(_on_way(x, y, (x0, y0), here), owner[at], len(inside)) ^ inside
            turn = (y - here[:, 1]) * (here[:, 2] - here[:, 0]) - (x - here[:, 0]) * (here[:, 3] - here[:, 1])
            touching = (turn == 0) & (x >= left[at]) & (x <= right[at]) & (y >= low[at]) & (y <= high[at])
            for k in np.unique(owner[at][touching.any(axis=0)]):
                odd[:, k] &= ~touching[:, owner[at] == k].any(axis=1)
            found[p] = np.where(odd.any(axis=1), odd.argmax(axis=1), -1) if odd.shape[1] else -1
            if met is not None:
                met[p] = len(at)
            continue
        half = size / 2
        for cx in (x0, x0 + half):
            for cy in (y0, y0 + half):
                q = p[((px[p] >= x0 + half) == (cx > x0)) & ((py[p] >= y0 + half) == (cy > y0))]
                if not len(q):
                    continue
                off = np.abs((cy + half / 2 - here[:, 1]) * (here[:, 2] - here[:, 0]) - (cx + half / 2 - here[:, 0]) * (here[:, 3] - here[:, 1]))
                reach = 0.5000001 * half * (np.abs(here[:, 2] - here[:, 0]) + np.abs(here[:, 3] - here[:, 1]))
                near = (right[at] >= cx) & (left[at] <= cx + half) & (high[at] >= cy) & (low[at] <= cy + half) & (off <= reach)
                way = _on_way(np.array([[cx]]), np.array([[cy]]), (x0, y0), here)
                open_.append((q, at[near], (cx, cy), half, inside ^ _odd(way, owner[at], len(inside))[0], depth + 1))
    return found


def _distances(px: np.ndarray, py: np.ndarray, e: np.ndarray) -> np.ndarray:
    """From each point to each edge."""
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    length2 = dx * dx + dy * dy
    along = ((px[:, None] - e[:, 0]) * dx + (py[:, None] - e[:, 1]) * dy) / np.where(length2 > 0, length2, 1)
    t = np.clip(np.where(length2 > 0, along, 0), 0, 1)
    ox, oy = px[:, None] - (e[:, 0] + t * dx), py[:, None] - (e[:, 1] + t * dy)
    return np.sqrt(ox * ox + oy * oy)


def nearest(px: np.ndarray, py: np.ndarray, e: np.ndarray, owner: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance and polygon (the first of equal ones) of the nearest edge of each point.

    Points are halved; a group keeps the edges that are no farther from its box than the nearest vertex is from its farthest corner.
    """
    best, who = np.zeros(len(px)), np.zeros(len(px), np.int64)
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    open_ = [(np.arange(len(px)), np.arange(len(e)))]
    while open_:
        p, at = open_.pop()
        x, y = px[p], py[p]
        x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        least = np.hypot(np.maximum(np.maximum(left[at] - x1, x0 - right[at]), 0), np.maximum(np.maximum(low[at] - y1, y0 - high[at]), 0))
        most = np.hypot(np.maximum(np.abs(e[at, 0] - x0), np.abs(e[at, 0] - x1)), np.maximum(np.abs(e[at, 1] - y0), np.abs(e[at, 1] - y1))).min()
        at = at[least <= most * (1 + 1e-12)]
        if len(at) <= LEAF or (x0 == x1 and y0 == y1):
            d = _distances(x, y, e[at])
            best[p] = d.min(axis=1)
            who[p] = np.where(d == best[p][:, None], owner[at], np.iinfo(np.int32).max).min(axis=1)
            if met is not None:
                met[p] = len(at)
            continue
        wide = x1 - x0 >= y1 - y0
        v, cut = (x, (x0 + x1) / 2) if wide else (y, (y0 + y1) / 2)
        lower = v <= cut
        if lower.all():  # neighbouring numbers: the middle is the upper one
            lower = v < v.max()
        open_ += [(p[lower], at), (p[~lower], at)]
    return best, who


def _pieces(points: DataFrame, grid: Grid) -> DataFrame:
    """(cx, cy, xs, ys): at most PIECE distinct points of a cell in a row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cx, cy, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            first = np.flatnonzero(np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])) if len(cx) else []
            cuts = [k for i, j in zip(first, [*first[1:], len(cx)], strict=True) for k in range(i, j, PIECE)]
            ends = [*cuts[1:], len(cx)]
            yield pa.RecordBatch.from_arrays([
                pa.array([cx[i] for i in cuts], pa.int64()), pa.array([cy[i] for i in cuts], pa.int64()),
                pa.array([x[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()), pa.array([y[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()),
            ], ["cx", "cy", "xs", "ys"])

    # the points themselves deal out the cells' rows, so a busy cell is no key; sorting brings those of a cell together
    placed = points.select(grid.x(F.col("lon")).alias("cx"), grid.y(F.col("lat")).alias("cy"), F.col("lon").cast("double"), F.col("lat").cast("double"))
    dealt = placed.repartitionByRange("cx", "cy", "lon", "lat").sortWithinPartitions("cx", "cy", "lon", "lat")
    return dealt.mapInArrow(pack, "cx bigint, cy bigint, xs binary, ys binary")


def _answers(kernel: Callable, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (cx, cy, xs, ys, ords, isos, inside, edges, owner) to answers; the edges of the last cell are kept, as its rows come together."""
    names = [c.split()[0] for c in schema.split(", ")]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cx, cy, xs, ys, ords, isos, inside, edges, owner in zip(*batch.columns, strict=True):
                x, y = np.frombuffer(xs.as_py(), np.float64), np.frombuffer(ys.as_py(), np.float64)
                e = np.frombuffer(edges.as_py() or b"", np.float64).reshape(-1, 4)
                columns = kernel(cx.as_py(), cy.as_py(), x, y, ords.as_py() or [], isos.as_py() or [], np.array(inside.as_py() or [], bool), e, np.frombuffer(owner.as_py() or b"", np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *columns], names)

    return answer


def locate(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(lon, lat, iso_a2) of the given points: the first polygon strictly around each, NULL if none."""
    size = grid.size

    def kernel(cx, cy, x, y, ords, isos, inside, e, owner):
        found = containing(x, y, (cx * size, cy * size), size, e, owner, inside)
        return [pa.array([isos[k] if k >= 0 else None for k in found.tolist()], pa.string())]

    schema = "lon double, lat double, iso_a2 string"
    met = _pieces(points, grid).join(cells, ["cx", "cy"], "left")
    return met.select("cx", "cy", "xs", "ys", "ords", "isos", "inside", "edges", "owner").mapInArrow(_answers(kernel, schema), schema)


def nearest_edges(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(lon, lat, distance, ord, iso_a2): for each given point and each cell that may hold its nearest edge, the nearest one there.

    A vertex of each occupied cell, a bounded table, tells the farthest a point's nearest edge can be; only cells whose box is not farther are met.
    """
    with_edges = cells.where(F.length("edges") > 0)
    first = F.substring("edges", 1, 16)
    known = with_edges.select("cx", "cy", first.alias("vertex")).collect()  # at most (GRID + 2) squared rows
    cx, cy = np.array([r["cx"] for r in known], np.int64), np.array([r["cy"] for r in known], np.int64)
    vertex = np.array([np.frombuffer(r["vertex"], np.float64) for r in known])
    size = grid.size

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for xs, ys in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(xs.as_py(), np.float64), np.frombuffer(ys.as_py(), np.float64)
                x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
                farthest = np.hypot(np.maximum(np.abs(vertex[:, 0] - x0), np.abs(vertex[:, 0] - x1)), np.maximum(np.abs(vertex[:, 1] - y0), np.abs(vertex[:, 1] - y1)))
                away = np.hypot(np.maximum(np.maximum(cx * size - x1, x0 - (cx + 1) * size), 0), np.maximum(np.maximum(cy * size - y1, y0 - (cy + 1) * size), 0))
                near = np.flatnonzero(away <= farthest.min() * (1 + 1e-12))
                bound = np.hypot(vertex[near, 0] - x[:, None], vertex[near, 1] - y[:, None]).min(axis=1) * (1 + 1e-12)
                for k in near.tolist():
                    off = np.hypot(np.maximum(np.maximum(cx[k] * size - x, x - (cx[k] + 1) * size), 0), np.maximum(np.maximum(cy[k] * size - y, y - (cy[k] + 1) * size), 0))
                    some = off <= bound
                    if some.any():
                        for column, value in zip(out, (cx[k], cy[k], x[some].tobytes(), y[some].tobytes()), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cx", "cy", "xs", "ys"])

    def kernel(cx, cy, x, y, ords, isos, inside, e, owner):
        distance, who = nearest(x, y, e, owner)
        return [pa.array(distance), pa.array([ords[k] for k in who.tolist()], pa.int64()), pa.array([isos[k] for k in who.tolist()], pa.string())]

    schema = "lon double, lat double, distance double, ord bigint, iso_a2 string"
    asked = _pieces(points, grid).mapInArrow(ask, "cx bigint, cy bigint, xs binary, ys binary").join(with_edges, ["cx", "cy"])
    return asked.select("cx", "cy", "xs", "ys", "ords", "isos", "inside", "edges", "owner").mapInArrow(_answers(kernel, schema), schema)
