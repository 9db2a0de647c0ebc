"""Country of a point, region of a country, and the enrichment cascade over posts.

Polygons are a table (ord, iso_a2, rings); all rings of a country, holes included, are in one
list and count by the even-odd rule. Points are looked up once per distinct coordinate pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweir.functions import geo as G
from postweir.functions import posts as P
from postweir.operators import shapes
from postweir.operators.keyed import first_per_key, spread_join
from postweir.session import stage

# Corrections of the country table. Codes by English name, and former or
# overseas codes with the country that stands in for them.
NAME_CODES = {"France": "FR", "Norway": "NO"}
ALIASES = {
    "Serbia": ["CS"],
    "Dominica": ["MQ", "GP"],
    "Madagascar": ["RE", "YT"],
    "Suriname": ["GF"],
}
NO_CODE = "-99"


def patch_countries(countries: DataFrame) -> DataFrame:
    """Missing codes filled, alias rows appended after the originals, countries without a code dropped."""
    code = F.col("iso_a2")
    for name, iso in NAME_CODES.items():
        code = F.when(F.col("name_en") == name, iso).otherwise(code)
    fixed = countries.withColumn("iso_a2", code)
    last = fixed.select(F.max("ord").alias("m")).scalar()
    order = [alias for codes in ALIASES.values() for alias in codes]
    aliases = F.create_map(*[x for n, codes in ALIASES.items() for x in (F.lit(n), F.array(*[F.lit(c) for c in codes]))])
    originals = first_per_key(fixed.filter(F.col("name_en").isin(list(ALIASES))), ["name_en"], ["ord"])
    extra = originals.withColumn("iso_a2", F.explode(F.element_at(aliases, F.col("name_en")))).withColumn(
        "ord", (last + F.array_position(F.array(*[F.lit(c) for c in order]), F.col("iso_a2"))).cast(fixed.schema["ord"].dataType)
    )
    return fixed.unionByName(extra.select(fixed.columns)).filter(F.col("iso_a2") != NO_CODE)


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(ord, iso_a2, x1, y1, x2, y2)"""
    rings = polygons.select("ord", "iso_a2", F.explode("rings").alias("ring"))
    return rings.select("ord", "iso_a2", F.inline(G.ring_edges(F.col("ring"))))


def _valid(points: DataFrame) -> DataFrame:
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    return points.select(lon.alias("lon"), lat.alias("lat")).where(lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))


def countries_containing(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(lon, lat, iso_a2) of distinct points strictly inside a polygon; the first polygon in table order wins.

    Points meet the cell of a grid they lie in, and there only the edges near them; see `shapes`.
    """
    grid = shapes.grid_of(edges)
    if grid is None:
        return _valid(points).limit(0).withColumn("iso_a2", F.lit(None).cast("string"))
    return shapes.locate(_valid(points), shapes.grid_cells(edges, grid), grid).where("iso_a2 IS NOT NULL")


def _closest(candidates: DataFrame) -> DataFrame:
    best = candidates.groupBy("lon", "lat").agg(F.min(F.struct("distance", "ord", "iso_a2")).alias("best"))
    return best.select("lon", "lat", "best.iso_a2", "best.distance")


def nearest_countries(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(lon, lat, iso_a2, distance) of the polygon with the closest edge for distinct points, ties by table order. Exact."""
    grid = shapes.grid_of(edges)
    if grid is None:
        return _valid(points).limit(0).withColumns({"iso_a2": F.lit(None).cast("string"), "distance": F.lit(None).cast("double")})
    return _closest(shapes.nearest_edges(_valid(points), shapes.grid_cells(edges, grid), grid))


def countries_of_points(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(lon, lat, iso_a2) of every distinct point: the polygon around it, else the nearest one; NULL if there is no polygon.

    The first answer is a written table: it is small next to the posts and used twice.
    """
    edges = polygon_edges(polygons)
    grid = shapes.grid_of(edges)
    if grid is None:
        return _valid(points).distinct().withColumn("iso_a2", F.lit(None).cast("string"))
    cells = shapes.grid_cells(edges, grid)
    answered = stage(shapes.locate(_valid(points).distinct(), cells, grid), "located")
    open_points = answered.where("iso_a2 IS NULL").select("lon", "lat")
    return answered.where("iso_a2 IS NOT NULL").unionByName(_closest(shapes.nearest_edges(open_points, cells, grid)).drop("distance"))


def with_regions(df: DataFrame, countries: DataFrame, code: str = "country_code") -> DataFrame:
    """Add region and subregion by country code, from the first row of the code; unknown codes get NULL."""
    first = first_per_key(countries.filter(F.col("iso_a2").isNotNull()), ["iso_a2"], ["ord"])
    regions = first.select(F.col("iso_a2").alias(code), "region", "subregion")
    return spread_join(df, regions, [code], F.col(code).isNotNull())


def with_geo_candidates(df: DataFrame, post: str = "post") -> DataFrame:
    """Add (lon, lat, country_code, geo_type) from coordinates, else from the place's bounding box.

    An empty country code asks for a lookup by position.
    """
    struct = F.col(post)
    by_coords, by_place = P.has_coordinates(struct), P.has_place_bounding_box(struct)
    # in a projection of its own, so that the centroid is computed once for both coordinates
    box = F.get(struct["place"]["bounding_box"]["coordinates"], F.lit(0))
    centred = df.withColumn("_centre", F.when(~by_coords & by_place, G.centroid(box)))
    coords = struct["coordinates"]["coordinates"]
    return centred.withColumns({
        "lon": F.when(by_coords, F.get(coords, F.lit(0))).otherwise(F.col("_centre.x")),
        "lat": F.when(by_coords, F.get(coords, F.lit(1))).otherwise(F.col("_centre.y")),
        "country_code": F.when(by_coords, F.lit("")).when(by_place, struct["place"]["country_code"]),
        "geo_type": F.when(by_coords, 1).when(by_place, 2).otherwise(0),
    }).drop("_centre")


def place_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def with_gazetteer(df: DataFrame, gazetteer: DataFrame, location: str = "user_location") -> DataFrame:
    """Third step: rows still without a position take the one of their author's location.

    The gazetteer is (location, lon, lat, country_code); of locations that differ in case or outer blanks only, the first by
    spelling, then by position, counts.
    """
    asks = (F.col("geo_type") == 0) & (F.trim(F.col(location)) != "")
    known = gazetteer.select(place_key(F.col("location")).alias("_key"), F.col("lon").alias("_lon"),
                             F.col("lat").alias("_lat"), F.col("country_code").alias("_code"), F.col("location").alias("_spelling"))
    known = first_per_key(known, ["_key"], ["_spelling", "_lon", "_lat", "_code"]).drop("_spelling")
    joined = spread_join(df.withColumn("_key", place_key(F.col(location))), known, ["_key"], asks)
    found = F.col("_lon").isNotNull()
    filled = joined.withColumns({
        "lon": F.coalesce("_lon", "lon"), "lat": F.coalesce("_lat", "lat"),
        "country_code": F.when(found, F.col("_code")).otherwise(F.col("country_code")),
        "geo_type": F.when(found, 3).otherwise(F.col("geo_type")),
    })
    return filled.select(df.columns)


#: What a post asks: nothing, the position of a location, the country of a position, the region of a country.
_NOTHING, _LOCATION, _POSITION, _CODE = range(4)


def _questions(df: DataFrame, location: str | None) -> DataFrame:
    """Add the question of each row: what it asks and about which text or position."""
    by_code = (F.col("geo_type") > 0) & F.col("country_code").isNotNull()
    kind = F.when(by_code & (F.col("country_code") == ""), _POSITION).when(by_code, _CODE)
    text = F.when(by_code, F.col("country_code"))
    if location:
        named = (F.col("geo_type") == 0) & (F.trim(F.col(location)) != "")
        kind, text = kind.when(named, _LOCATION), text.when(named, place_key(F.col(location)))
    positioned = by_code & (F.col("country_code") == "")
    return df.withColumns({
        "_asks": F.coalesce(kind, F.lit(_NOTHING)), "_text": F.coalesce(text, F.lit("")),
        "_x": F.when(positioned, F.coalesce("lon", F.lit(float("nan")))).otherwise(0.0), "_y": F.when(positioned, F.coalesce("lat", F.lit(float("nan")))).otherwise(0.0),
    })


def geo_cascade(df: DataFrame, polygons: DataFrame, countries: DataFrame, gazetteer: DataFrame | None = None, location: str = "user_location") -> DataFrame:
    """Complete the candidates of `with_geo_candidates` to countries and regions.

    The distinct questions of the posts are answered in tables of their own: locations by the gazetteer, positions by the polygons, countries by the region table.
    The answers, a written table whose size Spark knows, are joined to the posts that ask; it is broadcast if it is small, else those posts alone
    are shuffled. Posts that ask nothing go by a branch of their own and are never shuffled. The input is read three times.
    """
    key = ["_asks", "_text", "_x", "_y"]
    asked = _questions(df, location if gazetteer is not None else None)
    questions = stage(asked.where(F.col("_asks") != _NOTHING).select(*key).distinct(), "questions")
    of = lambda kind: questions.where(F.col("_asks") == kind)
    none = lambda kind: F.lit(None).cast(kind)
    rows = of(_POSITION).select(*key, F.col("_x").alias("lon"), F.col("_y").alias("lat"), F.lit("").alias("country_code")).unionByName(
        of(_CODE).select(*key, none("double").alias("lon"), none("double").alias("lat"), F.col("_text").alias("country_code")))
    if gazetteer is not None:
        known = gazetteer.select(place_key(F.col("location")).alias("_text"), "lon", "lat", "country_code", F.col("location").alias("_spelling"))
        known = first_per_key(known, ["_text"], ["_spelling", "lon", "lat", "country_code"]).drop("_spelling")
        rows = rows.unionByName(of(_LOCATION).join(known.where("lon IS NOT NULL"), "_text").select(*key, "lon", "lat", "country_code"))
    rows = stage(rows, "placed")
    found = countries_of_points(rows.where("country_code = ''").select("lon", "lat"), polygons)
    open_, closed = rows.where("country_code = ''"), rows.where("country_code <> '' OR country_code IS NULL")
    solved = open_.drop("country_code").join(found, ["lon", "lat"], "left").withColumnRenamed("iso_a2", "country_code").unionByName(closed, allowMissingColumns=True)
    answers = stage(with_regions(solved, countries).select(
        *key, *[F.col(c).alias(f"_{c}") for c in ("lon", "lat", "country_code")], "region", "subregion", F.lit(True).alias("_known")
    ), "answers")
    joined = asked.where(F.col("_asks") != _NOTHING).join(answers, key, "left")
    located = F.col("_known") & (F.col("_asks") == _LOCATION)
    filled = joined.withColumns({
        "lon": F.when(located, F.col("_lon")).otherwise(F.col("lon")), "lat": F.when(located, F.col("_lat")).otherwise(F.col("lat")),
        "country_code": F.when(F.col("_known"), F.col("_country_code")).otherwise(F.col("country_code")),
        "geo_type": F.when(located, 3).otherwise(F.col("geo_type")),
    })
    silent = asked.where(F.col("_asks") == _NOTHING).withColumns({"region": none("string"), "subregion": none("string")})
    columns = [*df.columns, "region", "subregion"]
    return filled.select(columns).unionByName(silent.select(columns))
