"""Choice of places to show in areas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions import wind as W
from cumula.operators.requests import contains_mode
from cumula.shared import written

AREA_KEYS = ["area_id", "place_id"]
AREA = ("west", "east", "south", "north")
#: Places of an area up to which its best are taken one by one.
FEW = 64
CROP = ("crop_west", "crop_east", "crop_south", "crop_north")


def _width(west: Column, east: Column) -> Column:
    """Degrees from west to east; bounds whose east is the lesser number cross the date line."""
    return F.when(east < west, F.pmod(east - west, F.lit(360.0))).otherwise(F.least(east - west, F.lit(360.0)))


def _meet(places: DataFrame, areas: DataFrame, reach: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Pairs of places and areas that share a bucket of one degree, once each; ``reach``: bounds of a place."""
    tiles = areas.withColumn("_by", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn("_bx", F.explode(W.lon_buckets(F.col("west"), F.col("west") + _width(F.col("west"), F.col("east")))))
    own = places.withColumn("_by", F.explode(F.sequence(F.floor(reach[2]), F.floor(reach[3])))).withColumn("_bx", F.explode(W.lon_buckets(reach[0], reach[1])))
    return own.join(tiles, ["_by", "_bx"]).drop("_by", "_bx").dropDuplicates(["area_id", "place_id"])


def score_places(places: DataFrame, areas: DataFrame) -> DataFrame:
    """Places inside each area (area_id, west, east, south, north) with their score.

    55 % how far inside, 35 % how central, 10 % their order in the catalogue.
    Areas and places meet in buckets of one degree, across the date line too;
    places and areas without coordinates have no score.
    """
    tiles = areas.withColumn("_by", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn("_bx", F.explode(W.lon_buckets(F.col("west"), F.col("west") + _width(F.col("west"), F.col("east")))))
    own = places.withColumns({"_by": F.floor("lat"), "_bx": W.lon_bucket(F.col("lon"))})
    hw, hh = _width(F.col("west"), F.col("east")) / 2, (F.col("north") - F.col("south")) / 2
    cx, cy = F.col("west") + hw, (F.col("north") + F.col("south")) / 2
    east = W.dlon(F.col("lon") - cx)
    j = own.join(tiles, ["_by", "_bx"]).where(F.col("lat").between(F.col("south"), F.col("north")) & (F.abs(east) <= hw)).drop("_by", "_bx")
    inner = F.least(F.lit(1.0), F.least((hw - F.abs(east)) / hw, (hh - F.abs(F.col("lat") - cy)) / hh))
    central = 1 - F.least(F.lit(1.0), F.sqrt(F.pow(east / hw, 2.0) + F.pow((F.col("lat") - cy) / hh, 2.0)) / 2**0.5)
    return j.withColumn("score", 0.55 * inner + 0.35 * central + 0.1 / (1 + F.col("source_index")))


def rank_places(places: DataFrame, areas: DataFrame, mode: str = "center") -> DataFrame:
    """Places (place_id, lat, lon, source_index, crop bounds) that belong to areas, with what their order rests on.

    ``mode`` as in ``contains_mode``: the centre lies inside, the crop meets the
    area, or lies within it. Adds center_km (from the area's centre), margin_km
    (to its nearest edge) and score: 55 % margin over the lesser half of the area,
    35 % nearness to its centre over its diagonal, 10 % place in the catalogue.
    Longitudes, those of the crop too, come back within half a turn of the area's centre.
    """
    at = F.col
    reach = tuple(at(c) for c in CROP) if mode != "center" else (at("lon"), at("lon"), at("lat"), at("lat"))
    size = places.agg(F.max("source_index")).first()[0] or 0
    j = _meet(places, areas.withColumn("east", at("west") + _width(at("west"), at("east"))), reach)
    cx, cy = (at("west") + at("east")) / 2, (at("south") + at("north")) / 2
    near = cx + W.dlon(at("lon") - cx)
    j = j.withColumns({"lon": F.when(at("lon").between(at("west"), at("east")), at("lon")).otherwise(near), "_was": at("lon")})
    j = j.withColumns({c: at(c) + (at("lon") - at("_was")) for c in CROP[:2]}).drop("_was")
    bounds = tuple(at(c) for c in AREA)
    j = j.where(contains_mode(mode, at("lon"), at("lat"), tuple(at(c) for c in CROP), bounds))
    diagonal = F.greatest(F.lit(1.0), W.haversine(at("south"), at("west"), at("north"), at("east")))
    half = F.least(F.greatest(F.lit(1.0), (at("east") - at("west")) * F.abs(F.cos(F.radians(cy))) * W.KM_PER_DEG / 2), F.greatest(F.lit(1.0), (at("north") - at("south")) * W.KM_PER_DEG / 2))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    j = j.withColumns({"center_km": W.haversine(cy, cx, at("lat"), at("lon")), "margin_km": W.edge_margin(at("lon"), at("lat"), bounds)})
    score = 0.55 * unit(at("margin_km") / half) + 0.35 * unit(1 - at("center_km") / diagonal) + 0.1 * (1 - at("source_index") / F.lit(float(max(size, 1))))
    return j.withColumn("score", score)


def declutter(ranked: DataFrame, order: list[Column], spacing_km: float = 0.0, most_overlap: float | None = None, most: int | None = None, tile: float = 0.25) -> DataFrame:
    """The rows of ``ranked`` (area_id, place_id, lat, lon, ...) left when places of an area must not crowd, with their ``rank``.

    In ``order`` (which no two places of an area share) a place stays unless a
    better one that stays is under ``spacing_km`` away or their crops share more
    than ``most_overlap`` of the smaller (null bounds share nothing). ``most``
    places of each area at most, all by default.

    Places in conflict share a tile, since each covers its crop and the surroundings
    of its centre. In a round a place stays if it is the best left in all of its tiles:
    none that could oust it is undecided. What conflicts with those kept then leaves;
    a tile keeps one place a round at most, so no pairs of one area are formed. Rounds
    follow the longest chain of places that wait for each other. If few are wanted
    (``most`` up to ``FEW``), a round takes the best left of each area instead, and no tiles are formed.
    """
    at = F.col
    place = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)))
    crop = [at(c) for c in CROP] if most_overlap is not None else []
    high = spacing_km / 111.0
    wide = F.least(F.lit(180.0), high / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + high))), F.lit(0.01)))
    south, north = F.least(at("lat") - high, *crop[2:3]) if crop else at("lat") - high, F.greatest(at("lat") + high, *crop[3:]) if crop else at("lat") + high
    west, east = F.least(at("lon") - wide, *crop[:1]) if crop else at("lon") - wide, F.greatest(at("lon") + wide, *crop[1:2]) if crop else at("lon") + wide
    turns = max(1, round(360 / tile))
    columns = F.transform(F.sequence(F.floor(west / tile), F.least(F.floor(east / tile), F.floor(west / tile) + turns)), lambda x: F.pmod(x, F.lit(turns)))
    rows = F.sequence(F.floor(south / tile), F.floor(north / tile))
    tiles = F.array_distinct(F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("y"), x.alias("x"))))))
    named = ["area_id", "place_id", "lat", "lon", *(CROP if crop else ())]

    def crowds() -> Column:
        close = (at("place_id") == at("_k_place_id")) | (W.haversine(at("lat"), at("lon"), at("_k_lat"), at("_k_lon")) < spacing_km)
        return close | F.coalesce(W.overlap_fraction(tuple(crop), tuple(at(f"_k_{c}") for c in CROP)) > most_overlap, F.lit(False)) if crop else close

    placed = ranked.where("lat is not null and lon is not null")
    if most is not None and most <= FEW:
        left, found = placed.select(*named, place.alias("_p")), []
        for n in range(most):
            left = written(left)
            best = written(left.groupBy("area_id").agg(F.min(F.struct("_p", *named[1:])).alias("_b")).select("area_id", *(at(f"_b.{c}").alias(f"_k_{c}") for c in named[1:])))
            if best.isEmpty():
                break
            found.append(best.select("area_id", at("_k_place_id").alias("place_id"), F.lit(n + 1).alias("rank")))
            left = left.join(best, "area_id").where(~F.coalesce(crowds(), F.lit(False))).select(left.columns)
        numbered = reduce(DataFrame.unionByName, found) if found else placed.select("area_id", "place_id", F.lit(0).alias("rank"))
        return ranked.join(numbered, AREA_KEYS)
    state, kept = written(placed.select(*named, place.alias("_p"), tiles.alias("_tiles"), F.lit(False).alias("_kept"))), None
    while not (left := state.where("not _kept")).isEmpty():
        spread = left.select("area_id", "place_id", "_p", F.explode("_tiles").alias("_t"))
        first = spread.groupBy("area_id", "_t").agg(F.min(F.struct("_p", "place_id")).alias("_b"))
        wins = first.groupBy("area_id", at("_b.place_id").alias("place_id")).agg(F.count("*").alias("_n"))
        best = left.join(wins, AREA_KEYS).where(at("_n") == F.size("_tiles")).drop("_n")
        other = best.select("area_id", F.explode("_tiles").alias("_t"), *(at(c).alias(f"_k_{c}") for c in named[1:]))
        out = left.withColumn("_t", F.explode("_tiles")).join(other, ["area_id", "_t"]).where(crowds()).select(*AREA_KEYS).distinct()
        state = written(left.join(out, AREA_KEYS, "left_anti").unionByName(best.withColumn("_kept", F.lit(True))))
        now = state.where("_kept")
        kept = now if kept is None else kept.unionByName(now)
    if kept is None:
        kept = state
    numbered = kept.select("area_id", "place_id", F.row_number().over(Win.partitionBy("area_id").orderBy("_p")).alias("rank"))
    return ranked.join(numbered if most is None else numbered.where(at("rank") <= most), AREA_KEYS)


def select_places(scored: DataFrame, spacing_km: float, most: int | None = None) -> DataFrame:
    """Best places of each area, each ``spacing_km`` or more from every better one kept, ``most`` at most. Ties go to the lesser ``place_id``."""
    return declutter(scored, [-F.col("score"), F.col("place_id")], spacing_km, most=most).select("area_id", "rank", "place_id", "score")
