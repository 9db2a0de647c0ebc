"""Planar geometry over degrees, as columns. Rings are arrays of [x, y] arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges(ring: Column) -> Column:
    """Array of (x1, y1, x2, y2), the closing edge included."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(
        a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")
    ))


def _centroid_of(ring: Column) -> Column:
    x0, y0 = ring[0][0], ring[0][1]
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    # relative to the first vertex, which keeps small rings far from the origin exact
    def edge(a: Column, b: Column) -> Column:
        x1, y1, x2, y2 = a[0] - x0, a[1] - y0, b[0] - x0, b[1] - y0
        return F.struct(
            (x1 + x2).alias("sx"), (y1 + y2).alias("sy"), (x1 * y2 - x2 * y1).alias("cross"),
            F.hypot(x2 - x1, y2 - y1).alias("length"),
        )

    def add(acc: Column, e: Column) -> Column:
        return F.struct(
            (acc["a"] + e["cross"]).alias("a"),
            (acc["ax"] + e["sx"] * e["cross"]).alias("ax"),
            (acc["ay"] + e["sy"] * e["cross"]).alias("ay"),
            (acc["l"] + e["length"]).alias("l"),
            (acc["lx"] + e["sx"] * e["length"]).alias("lx"),
            (acc["ly"] + e["sy"] * e["length"]).alias("ly"),
        )

    def centre(acc: Column) -> Column:
        def along(area_sum: Column, line_sum: Column, origin: Column) -> Column:
            shift = F.when(acc["a"] != 0, F.try_divide(area_sum, 3 * acc["a"])).when(
                acc["l"] != 0, F.try_divide(line_sum, 2 * acc["l"])
            )
            return origin + F.coalesce(shift, F.lit(0.0))

        return F.struct(along(acc["ax"], acc["lx"], x0).alias("x"), along(acc["ay"], acc["ly"], y0).alias("y"))

    start = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "ax", "ay", "l", "lx", "ly")])
    return F.aggregate(F.zip_with(ring, following, edge), start, add, centre)


def centroid(ring: Column) -> Column:
    """Struct (x, y): centre of area; of a ring without area the centre of its line, of a point the point."""
    rings = F.filter(F.array(ring.cast("array<array<double>>")), lambda r: F.size(r) > 0)
    # inside transform the ring has a name and is computed once
    return F.get(F.transform(rings, _centroid_of), F.lit(0))


def _turn(px: Column, py: Column, e: dict[str, Column]) -> Column:
    return (py - e["y1"]) * (e["x2"] - e["x1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])


def crosses_ray(px: Column, py: Column, e: dict[str, Column]) -> Column:
    """Does the edge cross the horizontal ray from the point to the right? No division, safe in ANSI mode."""
    turn = _turn(px, py, e)
    return ((e["y1"] > py) != (e["y2"] > py)) & (turn != 0) & ((turn > 0) == (e["y2"] > e["y1"]))


def on_edge(px: Column, py: Column, e: dict[str, Column]) -> Column:
    return (
        (_turn(px, py, e) == 0)
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def edge_distance(px: Column, py: Column, e: dict[str, Column]) -> Column:
    """Distance from the point to the segment."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length2 = dx * dx + dy * dy
    along = F.coalesce(F.try_divide((px - e["x1"]) * dx + (py - e["y1"]) * dy, length2), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ox, oy = px - (e["x1"] + t * dx), py - (e["y1"] + t * dy)
    return F.sqrt(ox * ox + oy * oy)
