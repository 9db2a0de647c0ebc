"""Polygons, regions and the enrichment cascade."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.functions import geo as G
from postweir.operators import geo
from postweir.plans import adapters as A

# names that the patching step knows, by nation key
_PATCHED = {3: "France", 4: "Norway", 7: "Serbia", 8: "Dominica", 9: "Madagascar", 10: "Suriname"}


def patch_countries(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.countries(spark, sf)
    names = F.create_map(*[x for k, v in _PATCHED.items() for x in (F.lit(k), F.lit(v))])
    renamed = rows.withColumns({
        "name_en": F.coalesce(F.element_at(names, F.col("ord").cast("int")), F.col("name_en")),
        "iso_a2": F.when(F.col("ord").isin(3, 4, 11), "-99").otherwise(F.col("iso_a2")),
    })
    return geo.patch_countries(renamed).select("ord", "iso_a2", "iso_a3", "name_en", "region", "subregion")


def region_lookup(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("XX")).otherwise(F.format_string("C%02d", "c_nationkey"))
    customers = A.table(spark, sf, "customer").select("c_custkey", code.alias("country_code"))
    # a second row per code that must not win
    rows = A.countries(spark, sf)
    later = rows.withColumns({"ord": F.col("ord") + 1000, "region": F.lit("later")})
    return geo.with_regions(customers, rows.unionByName(later))


def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    inside = geo.countries_containing(points.select("lon", "lat").distinct(), geo.polygon_edges(A.shapes(spark, sf)))
    return points.join(inside, ["lon", "lat"]).select("c_custkey", "iso_a2")


def point_in_dense_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """One island around the origin with a vertex for each event, as far out as the event's value says."""
    events = A.table(spark, sf, "events").select(F.col("event_id").alias("i"), (20 + F.pmod(F.col("value"), F.lit(10.0))).alias("r"))
    found = events.agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n")).first()
    low, n = found["low"], found["n"]
    angle = (F.col("i") - low) * (2 * math.pi / n)
    vertices = events.select("i", (F.col("r") * F.cos(angle)).alias("x"), (F.col("r") * F.sin(angle)).alias("y"))
    ends = vertices.select(F.when(F.col("i") == low, low + n - 1).otherwise(F.col("i") - 1).alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = vertices.join(ends, "i").select(F.lit(0).alias("ord"), F.lit("IS").alias("iso_a2"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    points = A.points(spark, sf)
    inside = geo.countries_containing(points.select("lon", "lat").distinct(), edges)
    return points.join(inside, ["lon", "lat"]).select("c_custkey", "iso_a2")


def nearest_polygon(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    near = geo.nearest_countries(points.select("lon", "lat").distinct(), geo.polygon_edges(A.shapes(spark, sf)))
    return points.join(near, ["lon", "lat"]).select("c_custkey", "iso_a2", F.round("distance", 6).alias("distance"))


def centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = G.centroid(F.element_at("rings", 1))
    return A.shapes(spark, sf).select("iso_a2", F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))


def geo_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """One market segment per way of locating a post; the location text is the nation's name or unknown."""
    nation = A.table(spark, sf, "nation")
    rows = A.points(spark, sf).join(A.table(spark, sf, "customer"), "c_custkey").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    segment, lon, lat = F.col("c_mktsegment"), F.col("lon"), F.col("lat")
    box = F.array(*[F.array(lon + dx, lat + dy) for dx, dy in ((-0.5, -0.25), (0.5, -0.25), (0.5, 0.25), (-0.5, 0.25))])
    code = F.when(segment == "FURNITURE", F.lit("")).otherwise(F.format_string("C%02d", "c_nationkey"))
    post = F.struct(
        F.when(segment == "AUTOMOBILE", F.struct(F.array(lon, lat).alias("coordinates"))).alias("coordinates"),
        F.when(segment.isin("BUILDING", "FURNITURE"), F.struct(
            code.alias("country_code"), F.struct(F.array(box).alias("coordinates")).alias("bounding_box")
        )).alias("place"),
    )
    posts = rows.select(
        "c_custkey", post.alias("post"),
        F.when(segment == "MACHINERY", F.concat(F.lit(" "), F.lower("n_name"))).when(F.col("c_custkey") % 2 == 0, F.lit("nowhere")).alias("user_location"),
    )
    candidates = geo.with_geo_candidates(posts).drop("post")
    shapes = A.shapes(spark, sf)
    centre = G.centroid(F.element_at("rings", 1))
    gazetteer = shapes.join(nation, F.col("ord") == F.col("n_nationkey")).select(
        F.col("n_name").alias("location"), centre["x"].alias("lon"), centre["y"].alias("lat"),
        F.when(F.col("ord") % 2 == 0, F.col("iso_a2")).otherwise(F.lit("")).alias("country_code"),
    )
    done = geo.geo_cascade(candidates, shapes, A.countries(spark, sf), gazetteer)
    return done.select(
        "c_custkey", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "country_code", "region", "subregion", "geo_type"
    )


QUERIES = {
    "patch_countries": patch_countries,
    "region_lookup": region_lookup,
    "point_in_polygon": point_in_polygon,
    "point_in_dense_polygon": point_in_dense_polygon,
    "nearest_polygon": nearest_polygon,
    "centroid": centroid,
    "geo_cascade": geo_cascade,
}

_CODE = "printf('C%02d', n_nationkey)"
_GEO = """points AS (
  SELECT c_custkey, (c_custkey * 37) % 1301 / 10.0::DOUBLE - 62.35::DOUBLE AS lon, (c_custkey * 53) % 1009 / 10.0::DOUBLE - 51.15::DOUBLE AS lat
  FROM customer),
corner AS (
  SELECT 0 AS odd, i, dx, dy FROM (VALUES (1, 0, 0), (2, 14, 0), (3, 14, 10), (4, 0, 10)) v(i, dx, dy)
  UNION ALL
  SELECT 1, i, dx, dy FROM (VALUES (1, 4, 0), (2, 12, 0), (3, 16, 5), (4, 12, 10), (5, 4, 10), (6, 0, 5)) v(i, dx, dy)),
vertex AS (
  SELECT n_nationkey AS ord, printf('C%02d', n_nationkey) AS iso_a2, i, (n_nationkey % 5) * 20.0::DOUBLE - 50 + dx AS x,
         floor(n_nationkey / 5) * 16.0::DOUBLE - 40 + dy AS y
  FROM nation JOIN corner ON n_nationkey % 2 = odd),
edge AS (
  SELECT ord, iso_a2, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM vertex WINDOW w AS (PARTITION BY ord ORDER BY i)),
pair AS (
  SELECT p.*, e.*, (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) AS turn,
         least(greatest(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t
  FROM points p CROSS JOIN edge e),
inside AS (
  SELECT c_custkey, min(iso_a2) AS iso_a2
  FROM (SELECT c_custkey, ord, iso_a2 FROM pair GROUP BY ALL HAVING min(turn) > 0) GROUP BY c_custkey),
near AS (
  SELECT c_custkey, ord, iso_a2, min(sqrt(pow(lon - x1 - t * (x2 - x1), 2) + pow(lat - y1 - t * (y2 - y1), 2))) AS distance
  FROM pair GROUP BY ALL),
nearest AS (SELECT c_custkey, arg_min(iso_a2, (distance, ord)) AS iso_a2, min(distance) AS distance FROM near GROUP BY c_custkey)"""
_NAME = "CASE n_nationkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PATCHED.items()) + " ELSE n_name END"
ORACLES = {
    "patch_countries": f"""
WITH c AS (
  SELECT n_nationkey AS ord, CASE n_nationkey WHEN 3 THEN 'FR' WHEN 4 THEN 'NO' WHEN 11 THEN '-99' ELSE {_CODE} END AS iso_a2,
         printf('C%03d', n_nationkey) AS iso_a3, {_NAME} AS name_en, r_name AS region, r_name || '/' || n_name AS subregion
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM c WHERE iso_a2 <> '-99'
UNION ALL
SELECT (SELECT max(n_nationkey) FROM nation) + pos, code, iso_a3, name_en, region, subregion
FROM c JOIN (VALUES (1, 'Serbia', 'CS'), (2, 'Dominica', 'MQ'), (3, 'Dominica', 'GP'), (4, 'Madagascar', 'RE'),
                    (5, 'Madagascar', 'YT'), (6, 'Suriname', 'GF')) a(pos, name, code) ON name_en = name""",
    "region_lookup": f"""
SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'XX' ELSE {_CODE} END AS country_code,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN r_name END AS region,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN r_name || '/' || n_name END AS subregion
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "point_in_polygon": f"WITH {_GEO} SELECT * FROM inside",
    "point_in_dense_polygon": f"""
WITH {_GEO},
v AS (
  SELECT i, n, r * cos(i * 2 * pi() / n) AS x, r * sin(i * 2 * pi() / n) AS y
  FROM (SELECT event_id - min(event_id) OVER () AS i, count(*) OVER () AS n, 20 + value - 10 * floor(value / 10) AS r FROM events)),
p AS (SELECT c_custkey, lon, lat, (atan2(lat, lon) + CASE WHEN lat < 0 THEN 2 * pi() ELSE 0 END) / (2 * pi()) AS turn FROM points)
SELECT c_custkey, 'IS' AS iso_a2
FROM p JOIN v a ON a.i = CAST(floor(turn * a.n) AS BIGINT) % a.n JOIN v b ON b.i = (a.i + 1) % a.n
WHERE (b.x - a.x) * (lat - a.y) - (b.y - a.y) * (lon - a.x) > 0""",
    "nearest_polygon": f"WITH {_GEO} SELECT c_custkey, iso_a2, round(distance, 6) AS distance FROM nearest",
    "centroid": """
SELECT printf('C%02d', n_nationkey) AS iso_a2,
       (n_nationkey % 5) * 20.0::DOUBLE - 50 + CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 8 END AS x,
       floor(n_nationkey / 5) * 16.0::DOUBLE - 40 + 5 AS y
FROM nation""",
    "geo_cascade": f"""
WITH {_GEO},
centre AS (
  SELECT n_nationkey, (n_nationkey % 5) * 20.0::DOUBLE - 50 + CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 8 END AS cx,
         floor(n_nationkey / 5) * 16.0::DOUBLE - 40 + 5 AS cy
  FROM nation),
found AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN round(lon, 6) WHEN c_mktsegment = 'MACHINERY' THEN cx END AS lon,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN round(lat, 6) WHEN c_mktsegment = 'MACHINERY' THEN cy END AS lat,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN coalesce(inside.iso_a2, nearest.iso_a2)
              WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN printf('C%02d', c_nationkey) END AS country_code,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 0 END AS geo_type
  FROM customer JOIN points USING (c_custkey) LEFT JOIN inside USING (c_custkey) LEFT JOIN nearest USING (c_custkey)
       JOIN centre ON c_nationkey = centre.n_nationkey)
SELECT found.*, r_name AS region, r_name || '/' || n_name AS subregion
FROM found LEFT JOIN nation ON country_code = printf('C%02d', n_nationkey) LEFT JOIN region ON n_regionkey = r_regionkey""",
}
