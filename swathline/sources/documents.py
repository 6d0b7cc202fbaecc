"""Document sources and sinks: contours as GeoJSON, waypoint missions as JSON, worlds as XML."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FEATURES = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
_MISSION = (
    "origin struct<latitude: double, lat: double, longitude: double, lon: double, lng: double, yaw: double>, "
    "default_reach_radius_m double, waypoints array<string>"
)
_POINT = "id string, latitude double, lat double, longitude double, lon double, lng double, x double, y double, reach_radius_m double"


def contours(docs: DataFrame, text: str = "body", all_features: bool = False, close_deg: float = 1e-7) -> DataFrame:
    """(id, error, feature, i, lat, lon) of GeoJSON texts (id, ``text``).

    Of each document the first usable feature, a Polygon's outer ring or a
    LineString, closed if its ends differ; with ``all_features`` every one. A
    document without one gets a row with the error and no point.
    """
    parsed = docs.select("id", F.from_json(F.col(text), _FEATURES).alias("d"), F.col(text).alias("raw"))
    bad = parsed.where(F.col("d").isNull() | F.col("d.features").isNull())
    each = parsed.where("d.features is not null").select("id", F.posexplode_outer("d.features").alias("feature", "g"))
    kind = F.col("g.geometry.type")
    coordinates = F.when(kind == "Polygon", F.expr("from_json(g.geometry.coordinates, 'array<array<array<double>>>')[0]")).when(kind == "LineString", F.from_json("g.geometry.coordinates", "array<array<double>>"))
    each = each.select("id", "feature", F.filter(coordinates, lambda p: F.size(p) >= 2).alias("pts"))
    usable = each.where(F.size("pts") > 0)
    if not all_features:
        usable = usable.groupBy("id").agg(F.min(F.struct("feature", "pts")).alias("f")).select("id", "f.*")
    open_ = (F.abs(F.expr("pts[0][0] - element_at(pts, -1)[0]")) > close_deg) | (F.abs(F.expr("pts[0][1] - element_at(pts, -1)[1]")) > close_deg)
    closed = F.when(open_, F.concat("pts", F.slice("pts", 1, 1))).otherwise(F.col("pts"))
    found = usable.select("id", F.lit(None).cast("string").alias("error"), "feature", F.posexplode(closed).alias("i", "p")).select("id", "error", "feature", "i", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))
    none = each.select("id").distinct().join(usable.select("id").distinct(), "id", "left_anti").select("id", F.lit("no usable feature").alias("error"))
    failed = bad.select("id", F.when(F.col("raw").isNull() | (F.trim("raw") == "") | ~F.trim("raw").startswith("{"), "not an object").otherwise("no features").alias("error")).union(none)
    blank = failed.select("id", "error", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return found.union(blank)


def _lat(p: Column) -> Column:
    return F.coalesce(p["latitude"], p["lat"])


def _lon(p: Column) -> Column:
    return F.coalesce(p["longitude"], p["lon"], p["lng"])


def missions(docs: DataFrame, text: str = "body", default_radius: float = 0.9) -> DataFrame:
    """(id, lat0, lon0, yaw, i, wid, latitude, longitude, x, y, reach_radius_m) of mission texts.

    A waypoint is an object, with a geographic place or (x, y), or a pair [lat,
    lon]; the origin is the document's, else the first waypoint with a place.
    """
    parsed = docs.select("id", F.from_json(F.col(text), _MISSION).alias("m"))
    each = parsed.select("id", "m", F.posexplode_outer("m.waypoints").alias("i", "w"))
    pair = F.from_json("w", "array<double>")
    point = F.from_json("w", _POINT)
    each = each.withColumns({"p": F.when(~F.startswith("w", F.lit("[")), point), "q": F.when(F.startswith("w", F.lit("[")), pair)})
    each = each.select("id", "m", "i", F.coalesce("p.id", F.concat(F.lit("wp_"), F.col("i") + 1)).alias("wid"), F.coalesce(_lat(F.col("p")), F.col("q")[0]).alias("latitude"), F.coalesce(_lon(F.col("p")), F.col("q")[1]).alias("longitude"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.greatest(F.lit(0.05), F.coalesce("p.reach_radius_m", "m.default_reach_radius_m", F.lit(default_radius))).alias("reach_radius_m"))
    first = each.where("latitude is not null and longitude is not null").groupBy("id").agg(F.min(F.struct("i", "latitude", "longitude")).alias("f"))
    joined = each.join(first, "id", "left")
    return joined.select("id", F.coalesce(_lat(F.col("m.origin")), F.col("f.latitude")).alias("lat0"), F.coalesce(_lon(F.col("m.origin")), F.col("f.longitude")).alias("lon0"), F.coalesce("m.origin.yaw", F.lit(0.0)).alias("yaw"), "i", "wid", "latitude", "longitude", "x", "y", "reach_radius_m").where("i is not null")


def world_models(docs: DataFrame, text: str = "body") -> DataFrame:
    """(id, i, name) of the models in world XML texts, without generated waypoints (``wp_``)."""
    names = F.expr(f"xpath({text}, '/sdf/world/model/@name')")
    return docs.select("id", F.posexplode(names).alias("i", "name")).where(~F.col("name").startswith("wp_"))


def world_documents(models: DataFrame, origins: DataFrame) -> DataFrame:
    """One world XML text per id from models (id, i, name, x, y) and origins (id, lat, lon, heading_deg)."""
    number = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    model = F.concat(F.lit('<model name="'), F.col("name"), F.lit('"><static>true</static><pose>'), number("x", 4), F.lit(" "), number("y", 4), F.lit(" 0 0 0 0</pose></model>"))
    listed = models.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", model.alias("m")))).alias("ms")).select("id", F.concat_ws("", F.transform("ms", lambda m: m["m"])).alias("models"))
    place = F.concat(F.lit("<spherical_coordinates><latitude_deg>"), number("lat", 12), F.lit("</latitude_deg><longitude_deg>"), number("lon", 12), F.lit("</longitude_deg><heading_deg>"), number("heading_deg", 12), F.lit("</heading_deg></spherical_coordinates>"))
    return listed.join(origins, "id").select("id", F.concat(F.lit('<sdf version="1.9"><world name="world">'), place, F.col("models"), F.lit("</world></sdf>")).alias("body"))


def mission_file(given: str, packaged: str) -> str:
    """The mission file to use: the given one if it is a file, else the packaged one; either must be JSON."""
    path = given if given and Path(given).is_file() else packaged
    if Path(path).suffix != ".json":
        raise ValueError(f"not a .json file: {path}")
    return path


def parameters(defaults: dict, overrides: str | dict, limits: dict[str, tuple[float, float]]) -> dict:
    """Parameters from defaults and overrides (a mapping or JSON), numbers held within their limits."""
    given = json.loads(overrides) if isinstance(overrides, str) else overrides
    out = {k: given.get(k, v) for k, v in defaults.items()}
    for k, (low, high) in limits.items():
        out[k] = max(low, min(high, out[k]))
    return out
