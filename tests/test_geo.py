from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postweir.functions import geo as G
from postweir.operators import geo, shapes

SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
HOLE = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]
STAR = [[20.0, 0.0], [24.0, 3.0], [30.0, 1.5], [25.5, 5.0], [28.0, 11.0], [22.0, 7.0], [17.5, 9.0], [19.0, 4.0]]
FAR = [[150.0, 70.0], [151.0, 70.0], [151.0, 71.0]]


def polygons(spark, *rows):
    return spark.createDataFrame(list(rows), "ord int, iso_a2 string, rings array<array<array<double>>>")


def points(spark, pairs):
    return spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "lon double, lat double")


def inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def distance(ring, x, y):
    best = math.inf
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = x2 - x1, y2 - y1
        t = min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0), 1)
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


def test_lookup_equals_plain_ray_cast_and_distance(spark):
    shapes = {"SQ": SQUARE, "ST": STAR, "FA": FAR}
    table = polygons(spark, *[(i, k, [v]) for i, (k, v) in enumerate(shapes.items())])
    rng = random.Random(3)
    pairs = [(rng.uniform(-5, 35), rng.uniform(-5, 15)) for _ in range(400)]
    pairs += [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)]
    got = {(r["lon"], r["lat"]): r["iso_a2"] for r in geo.countries_of_points(points(spark, pairs + pairs), table).collect()}
    assert len(got) == len(set(pairs))
    for x, y in pairs:
        within = [k for k, ring in shapes.items() if inside(ring, x, y)]
        assert got[(x, y)] == (within[0] if within else min(shapes, key=lambda k: distance(shapes[k], x, y)))
    edges = geo.polygon_edges(table)
    for r in geo.nearest_countries(points(spark, pairs), edges).collect():
        assert math.isclose(r["distance"], min(distance(v, r["lon"], r["lat"]) for v in shapes.values()), abs_tol=1e-9)


def test_boundary_is_outside_and_first_polygon_wins(spark):
    table = polygons(spark, (2, "B", [SQUARE]), (1, "A", [SQUARE, HOLE]))
    edges = geo.polygon_edges(table)
    pairs = [(1, 1), (5, 5), (0, 5), (10, 10), (5, 0), (4, 5), (1, 4), (1, 6)]
    got = {(r["lon"], r["lat"]): r["iso_a2"] for r in geo.countries_containing(points(spark, pairs), edges).collect()}
    # in the hole only B contains the point; on the hole's border as well
    assert got == {(1.0, 1.0): "A", (5.0, 5.0): "B", (4.0, 5.0): "B", (1.0, 4.0): "A", (1.0, 6.0): "A"}


def test_nearest_ties_go_to_the_first_polygon(spark):
    other = [[x + 20, y] for x, y in SQUARE]
    edges = geo.polygon_edges(polygons(spark, (7, "R", [other]), (3, "L", [SQUARE])))
    assert geo.nearest_countries(points(spark, [(15, 5)]), edges).first()["iso_a2"] == "L"


def test_centroid(spark):
    rings = [SQUARE, SQUARE + [[0.0, 0.0]], [[1.0, 1.0]] * 4, [[0.0, 0.0], [4.0, 0.0], [4.0, 0.0], [0.0, 0.0]], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, r array<array<double>>")
    got = [r[0] and tuple(r[0]) for r in df.orderBy("i").select(G.centroid(F.col("r"))).collect()]
    assert got == [(5.0, 5.0), (5.0, 5.0), (1.0, 1.0), (2.0, 0.0), None]


def test_patch_countries_appends_aliases(spark):
    rows = [(1, "-99", "FRA", "France", "E", "W"), (2, "RS", "SRB", "Serbia", "E", "S"), (3, "-99", "X", "Nowhere", "N", "N"), (4, "DM", "DMA", "Dominica", "L", "C")]
    df = spark.createDataFrame(rows, "ord int, iso_a2 string, iso_a3 string, name_en string, region string, subregion string")
    got = [(r["ord"], r["iso_a2"], r["name_en"]) for r in geo.patch_countries(df).orderBy("ord").collect()]
    assert got == [(1, "FR", "France"), (2, "RS", "Serbia"), (4, "DM", "Dominica"), (5, "CS", "Serbia"), (6, "MQ", "Dominica"), (7, "GP", "Dominica")]


def test_cascade(spark):
    schema = "id string, user_location string, post struct<coordinates:struct<coordinates:array<double>>, place:struct<country_code:string,bounding_box:struct<coordinates:array<array<array<double>>>>>>"
    box = [[[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]]
    rows = [
        ("coords", "x", (([5.0, 5.0],), None)), ("place", "x", (None, ("ZZ", (box,)))), ("empty", "x", (None, ("", (box,)))),
        ("nobox", " ROME ", (None, ("SQ", None))), ("none", "unknown", (None, None)), ("null", None, (None, None)),
        ("sea", None, (([-100.0, 0.0],), None)),
    ]
    posts = spark.createDataFrame(rows, schema)
    countries = spark.createDataFrame([(0, "SQ", "r", "s")], "ord int, iso_a2 string, region string, subregion string")
    gazetteer = spark.createDataFrame([("Rome", 2.0, 2.0, "")], "location string, lon double, lat double, country_code string")
    done = geo.geo_cascade(geo.with_geo_candidates(posts).drop("post"), polygons(spark, (0, "SQ", [SQUARE])), countries, gazetteer)
    got = {r["id"]: (r["country_code"], r["region"], r["geo_type"], r["lon"]) for r in done.collect()}
    assert got == {
        "coords": ("SQ", "r", 1, 5.0), "place": ("ZZ", None, 2, 2.0), "empty": ("SQ", "r", 2, 2.0), "nobox": ("SQ", "r", 3, 2.0),
        "none": (None, None, 0, None), "null": (None, None, 0, None), "sea": ("SQ", "r", 1, -100.0),
    }


@pytest.fixture(scope="module")
def coast():
    """An island of 20 000 edges whose coast is jagged, all of it along a short stretch but for three edges."""
    rng = random.Random(11)
    jagged = [[x * 0.0005, 2.0 + math.sin(x / 700) + rng.uniform(-0.02, 0.02)] for x in range(20_000)]
    return [*jagged, [10.0, -30.0], [0.0, -30.0]]


def edges_of(*rings):
    lines = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    return np.array(lines, np.float64), np.repeat(np.arange(len(rings)), [len(r) for r in rings]).astype(np.int32)


def test_points_meet_few_edges_of_a_dense_coast(spark, coast):
    e, owner = edges_of(coast, SQUARE)
    rng = np.random.default_rng(2)
    near = np.stack([rng.uniform(0, 10, 2000), 2 + np.sin(rng.uniform(0, 10, 2000) / 0.35) + rng.normal(0, 0.1, 2000)], axis=1)
    x, y = np.concatenate([near, rng.uniform(-60, 60, (2000, 2))]).T
    corner, size = (-64.0, -64.0), 128.0
    met, asked = np.zeros(len(x), int), np.zeros(len(x), int)
    got = shapes.containing(x, y, corner, size, e, owner, np.array([False, False]), met)
    distance, who = shapes.nearest(x, y, e, owner, asked)
    assert met.max() < 100 and asked.max() < 100
    crossing = (e[:, 1] > y[:, None]) != (e[:, 3] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = e[:, 0] + (y[:, None] - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    for k in range(2):
        odd = (crossing & (x[:, None] < at))[:, owner == k].sum(axis=1) % 2 == 1
        assert ((got == k) == (odd if k == 0 else odd & (got != 0))).all()
    every = shapes._distances(x, y, e)
    assert np.allclose(distance, every.min(axis=1), rtol=0, atol=1e-12) and (owner[every.argmin(axis=1)] == who).mean() > 0.999
    # the same through Spark: a cell's points are spread over rows of at most PIECE
    table = polygons(spark, (0, "CO", [coast]), (1, "SQ", [SQUARE]))
    grid = shapes.grid_of(geo.polygon_edges(table))
    pieces = shapes._pieces(points(spark, zip(x.tolist(), y.tolist())), grid).collect()
    assert max(len(r["xs"]) for r in pieces) <= 8 * shapes.PIECE and len({(r["cx"], r["cy"]) for r in pieces}) > 20
    found = {(r["lon"], r["lat"]): r["iso_a2"] for r in geo.countries_of_points(points(spark, zip(x.tolist(), y.tolist())), table).collect()}
    for i in range(len(x)):
        assert found[x[i], y[i]] == ("CO", "SQ")[got[i] if got[i] >= 0 else who[i]]


def test_lookups_on_grid_lines_and_far_away(spark):
    """Points, vertices and edges on the lines of the grid, holes, shared borders, and positions far outside it."""
    left, right = [[0.0, 0.0], [2.0, 0.0], [2.0, 4.0], [0.0, 4.0]], [[2.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 4.0]]
    hole = [[2.5, 1.0], [3.5, 1.0], [3.5, 2.0], [2.5, 2.0]]
    kite = [[6.0, 0.0], [8.0, 2.0], [6.0, 4.0], [4.0, 2.0]]
    table = polygons(spark, (0, "L", [left]), (1, "R", [right, hole]), (2, "K", [kite]), (3, "L2", [left]))
    pairs = [(x / 4, y / 4) for x in range(-2, 36) for y in range(-2, 19)] + [(1e300, -1e300), (-1e12, 5.0)]
    shapes_ = {"L": [left], "R": [right, hole], "K": [kite]}
    got = {(r["lon"], r["lat"]): r["iso_a2"] for r in geo.countries_containing(points(spark, pairs), geo.polygon_edges(table)).collect()}
    for x, y in pairs:
        on_border = lambda ring: distance(ring, x, y) == 0
        want = [k for k, rings in shapes_.items() if sum(inside(r, x, y) for r in rings) % 2 and not any(map(on_border, rings))]
        assert got.get((x, y)) == (want[0] if want else None), (x, y)
    odd = spark.createDataFrame([(float("nan"), 1.0), (None, 1.0), (1.0, 1.0)], "lon double, lat double")
    assert [r["iso_a2"] for r in geo.countries_of_points(odd, table).collect()] == ["L"]
    assert geo.countries_of_points(odd, table.limit(0)).collect()[0]["iso_a2"] is None and geo.nearest_countries(odd, geo.polygon_edges(table.limit(0))).count() == 0


def test_posts_without_a_question_are_not_shuffled(spark, tmp_path):
    posts = spark.range(50).select(
        F.col("id"), F.when(F.col("id") < 5, 1.0 * F.col("id")).alias("lon"), F.when(F.col("id") < 5, 2.0).alias("lat"), F.when(F.col("id") < 5, "").alias("country_code"),
        F.when(F.col("id") < 5, 1).otherwise(0).alias("geo_type"), F.when(F.col("id") % 9 == 7, "rome ").alias("user_location"),
    )
    posts.write.parquet(str(tmp_path / "posts"))
    countries = spark.createDataFrame([(0, "SQ", "r", "s")], "ord int, iso_a2 string, region string, subregion string")
    gazetteer = spark.createDataFrame([("Rome", 2.0, 2.0, "")], "location string, lon double, lat double, country_code string")
    done = geo.geo_cascade(spark.read.parquet(str(tmp_path / "posts")), polygons(spark, (0, "SQ", [SQUARE])), countries, gazetteer)
    plan = done._jdf.queryExecution().executedPlan().toString()
    silent = plan[[m.start() for m in re.finditer(r"\n +\+- Project", plan)][-1] :]
    assert "Union" in plan and "Scan" in silent and "Exchange" not in silent and "Join" not in silent
    # the answers are few: the posts that ask are not shuffled either
    assert "Exchange hash" not in plan and "BroadcastHashJoin" in plan
    assert done.filter("region = 'r'").count() == 10 and done.count() == 50


def test_cells_are_packed_by_columns():
    """A cell's rows may lie in several batches; a row without an edge says that the polygon holds the corner. 400 000 rows take no seconds."""
    n = 400_000
    columns = [np.repeat([0, 1], n // 2), np.zeros(n, np.int64), np.arange(n) % 3, None, *(np.arange(n) + k / 8 for k in range(4))]
    whole = pa.RecordBatch.from_arrays([pa.array(c) if c is not None else pa.array(["b", "a", None, "c"] * (n // 4)) for c in columns], ["cx", "cy", "ord", "iso_a2", "x1", "y1", "x2", "y2"])
    corner = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([7]), pa.array(["z"]), *[pa.array([None], pa.float64())] * 4], whole.schema.names)
    begin = time.perf_counter()
    cells = [r for b in shapes._pack_cells(iter([whole.slice(0, 150_000), whole.slice(150_000), corner])) for r in b.to_pylist()]
    assert time.perf_counter() - begin < 1.5
    assert [(c["cx"], c["cy"]) for c in cells] == [(0, 0), (1, 0)]
    assert list(zip(cells[1]["ords"], cells[1]["isos"], strict=True)) == [(o, i) for o in range(3) for i in (None, "a", "b", "c")] + [(7, "z")]
    assert cells[0]["inside"] == [False] * 12 and cells[1]["inside"] == [False] * 12 + [True]
    for c, first in zip(cells, (0, n // 2), strict=True):
        edges, owner = np.frombuffer(c["edges"]).reshape(-1, 4), np.frombuffer(c["owner"], np.int32)
        assert len(edges) == len(owner) == n // 2 and edges[5].tolist() == [first + 5 + k / 8 for k in range(4)]
        assert c["ords"][owner[5]] == (first + 5) % 3 and c["isos"][owner[5]] == ["b", "a", None, "c"][(first + 5) % 4]
