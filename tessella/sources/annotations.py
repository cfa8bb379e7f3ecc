"""Annotation files as rows: ASAP XML, GeoJSON, Darwin V7 JSON and EMPAIA JSON, with one geometry type for all.

Every reader gives a row an annotation with a ``geometry`` of ``functions.geometry.GEOMETRY`` (points have one ring of one point)
and the file's ``path``. Files are read whole, one at a time, by Spark's readers; parsing is done by JSON and XML functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import GEOMETRY, close_ring

ASAP = "_Name string, _Type string, _PartOfGroup string, _Color string, Coordinates struct<Coordinate: array<struct<_Order: int, _X: double, _Y: double>>>"


def starts_with_match(value: Column, pattern: str) -> Column:
    """Whether the pattern matches at the value's start. A null never matches."""
    return F.coalesce(value.cast("string").rlike(f"^(?:{pattern})"), F.lit(False))


def _geometry(kind: Column, rings: Column) -> Column:
    return F.struct(kind.alias("type"), rings.alias("rings")).cast(GEOMETRY)


def polygons(annotations: DataFrame) -> DataFrame:
    return annotations.where("geometry.type = 'Polygon'")


def points(annotations: DataFrame) -> DataFrame:
    return annotations.where("geometry.type = 'Point'")


def _whole(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


# ASAP


def read_asap(spark: SparkSession, paths: str | Sequence[str], name: str = ".*", part_of_group: str = ".*") -> DataFrame:
    """path, name, type, part_of_group, color, geometry. Polygons and splines are polygons, a point or dot is a row a coordinate.

    Coordinates keep the order of the document.
    """
    rows = spark.read.format("xml").option("rowTag", "Annotation").schema(ASAP).load(paths).select("*", F.col("_metadata.file_path").alias("path"))
    rows = rows.where(starts_with_match(F.col("_Name"), name) & starts_with_match(F.col("_PartOfGroup"), part_of_group))
    corners = F.transform(F.coalesce(F.col("Coordinates.Coordinate"), F.array()), lambda c: F.struct(c["_X"].alias("x"), c["_Y"].alias("y")))
    shape = F.when(F.col("_Type").isin("Polygon", "Spline"), F.array(_geometry(F.lit("Polygon"), F.array(close_ring(corners)))))
    shape = shape.when(F.col("_Type").isin("Point", "Dot"), F.transform(corners, lambda p: _geometry(F.lit("Point"), F.array(F.array(p)))))
    return rows.select("path", F.col("_Name").alias("name"), F.col("_Type").alias("type"), F.col("_PartOfGroup").alias("part_of_group"), F.col("_Color").alias("color"), F.explode(shape).alias("geometry"))


# GeoJSON


def _rings_of(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def geojson_geometries(kind: Column, coordinates: Column) -> Column:
    """Array of simple geometries of a GeoJSON geometry whose coordinates are JSON text; multi-geometries give several."""
    pair, line = "array<double>", "array<array<double>>"
    one = F.array(_geometry(F.lit("Point"), _rings_of(F.array(F.array(F.from_json(coordinates, pair))))))
    many = F.transform(F.from_json(coordinates, line), lambda p: _geometry(F.lit("Point"), _rings_of(F.array(F.array(p)))))
    polygon = F.array(_geometry(F.lit("Polygon"), _rings_of(F.from_json(coordinates, f"array<{line}>"))))
    multi = F.transform(F.from_json(coordinates, f"array<array<{line}>>"), lambda c: _geometry(F.lit("Polygon"), _rings_of(c)))
    path = F.array(_geometry(F.lit("LineString"), _rings_of(F.array(F.from_json(coordinates, line)))))
    paths = F.transform(F.from_json(coordinates, f"array<{line}>"), lambda c: _geometry(F.lit("LineString"), _rings_of(F.array(c))))
    out = F.when(kind == "Point", one).when(kind == "MultiPoint", many).when(kind == "Polygon", polygon)
    return out.when(kind == "MultiPolygon", multi).when(kind == "LineString", path).when(kind == "MultiLineString", paths)


def _fields(text: Column) -> Column:
    """A JSON object as a map of variants."""
    return F.try_parse_json(text).cast("map<string,variant>")


def read_geojson(spark: SparkSession, paths: str | Sequence[str], join_key: str | None = "presetID", suffix: str = "_def") -> DataFrame:
    """path, id, properties (JSON object as text), definition (likewise, or null), geometry.

    Features without geometry are definitions. Where any exists and some feature has the property ``join_key``, a feature gets
    the definitions with the same key; several fan out, and a null key meets null keys. A definition's properties are added
    to the feature's, with ``suffix`` where some feature of the file has a value of that name. Without ``join_key`` features
    stay as they are. A file is parsed once and stays in its row until its features are matched.
    """
    one = "array<struct<id: string, type: string, geometry: struct<type: string, coordinates: string>, properties: string>>"
    doc = F.from_json("value", f"struct<features {one}>")
    features = F.coalesce(doc["features"], F.when(F.ltrim("value").startswith("["), F.from_json("value", one)))
    key = lambda f: F.get_json_object(f["properties"], f"$.{join_key}") if join_key else F.lit(None).cast("string")
    files = _whole(spark, paths).select("path", F.transform(features, lambda f: F.struct(f["id"].alias("id"), f["geometry"].alias("shape"), f["properties"].alias("properties"), key(f).alias("key"))).alias("features"))
    files = files.withColumn("drawn", F.filter("features", lambda f: f["shape"]["type"].isNotNull())).withColumn("others", F.filter("features", lambda f: f["shape"]["type"].isNull()))
    named = F.transform("drawn", lambda f: F.map_keys(F.map_filter(_fields(f["properties"]), lambda k, v: ~F.is_variant_null(v))))
    files = files.withColumn("known", F.array_distinct(F.flatten(F.filter(named, lambda n: n.isNotNull())))).withColumn("keyed", F.exists("features", lambda f: f["key"].isNotNull()))
    met = lambda f: F.filter("others", lambda d: F.col("keyed") & d["key"].eqNullSafe(f["key"]))
    rows = files.select("path", "known", F.explode(F.transform("drawn", lambda f: F.struct(f.alias("f"), met(f).alias("met")))).alias("r"))
    rows = rows.select("path", "known", "r.f.*", F.explode_outer(F.transform("r.met", lambda d: d["properties"])).alias("definition"))
    own = F.coalesce(_fields(F.col("properties")), F.create_map().cast("map<string,variant>"))
    added = F.map_filter(_fields(F.col("definition")), lambda k, v: k != F.lit(join_key or ""))
    added = F.transform_keys(added, lambda k, v: F.when(F.array_contains("known", k), F.concat(k, F.lit(suffix))).otherwise(k))
    rows = rows.withColumn("own", own).withColumn("added", added)
    # a name that no feature of the file gives a value is the definition's
    kept = F.map_filter("own", lambda k, v: ~F.coalesce(F.map_contains_key("added", k), F.lit(False)) | F.array_contains("known", k))
    fresh = F.map_filter("added", lambda k, v: ~F.map_contains_key("own", k) | ~F.array_contains("known", k))
    merged = F.when(F.col("added").isNull(), F.col("properties")).otherwise(F.to_json(F.map_concat(kept, fresh)))
    geometries = geojson_geometries(F.col("shape.type"), F.col("shape.coordinates"))
    return rows.select("path", "id", merged.alias("properties"), "definition", F.explode(geometries).alias("geometry"))


def with_definitions(annotations: DataFrame, definitions: DataFrame, key: str, suffix: str = "_def") -> DataFrame:
    """The relation join on plain columns: left join, null keys meet, clashing columns of ``definitions`` get ``suffix``."""
    clash = {c: f"{c}{suffix}" for c in definitions.columns if c in annotations.columns and c != key}
    right = definitions.select(*[F.col(c).alias("__key" if c == key else clash.get(c, c)) for c in definitions.columns])
    return annotations.join(right, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def nested(value: Column, steps: Sequence[str]) -> Column:
    """Text at a path of object keys and, as digits, list positions inside JSON text; null where any step fails."""
    path = "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)
    parsed = F.try_parse_json(value)
    return F.try_variant_get(parsed, path, "string")


def filtered(annotations: DataFrame, separator: str = "_", null_as_text: bool = False, **patterns: str) -> DataFrame:
    """Rows that match all patterns. A pattern's name is a column, or a column and steps into its JSON text.

    The longest column name that the pattern's name begins with is taken; for GeoJSON names that begin with no column are steps into
    ``properties``. An unknown name matches nothing. Nulls match nothing, or the text "None" with ``null_as_text``.
    """
    for name, pattern in patterns.items():
        column = next((c for c in sorted(annotations.columns, key=len, reverse=True) if name == c or name.startswith(c + separator)), None)
        if column is None and "properties" in annotations.columns:
            value = nested(F.col("properties"), name.split(separator))
        elif column is None:
            return annotations.where(F.lit(False))
        else:
            rest = name[len(column) + len(separator) :]
            value = nested(F.col(column), rest.split(separator)) if rest else F.col(column).cast("string")
        if null_as_text:
            value = F.coalesce(value, F.lit("None"))
        annotations = annotations.where(starts_with_match(value, pattern))
    return annotations


def json_value(text: Column) -> Column:
    """JSON text as a variant; text that is not JSON as a text variant; null stays null."""
    quoted = F.variant_get(F.try_parse_json(F.to_json(F.array(text))), "$[0]", "variant")
    return F.when(text.isNotNull(), F.coalesce(F.try_parse_json(text), quoted))


# Darwin V7


def read_darwin(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, id, name, properties and slot_names (JSON text), geometry.

    A polygon takes precedence over a box, a box over a point. An outer ring of fewer than three corners leaves the geometry
    null, holes of fewer are dropped.
    """
    corner = "struct<x: double, y: double>"
    shape = f"annotations array<struct<id: string, name: string, polygon: struct<paths: array<array<{corner}>>>, bounding_box: struct<x: double, y: double, w: double, h: double>, point: {corner}, properties: string, slot_names: string>>"
    rows = _whole(spark, paths).select("path", F.inline(F.from_json("value", f"struct<{shape}>")["annotations"]))
    paths_ = F.col("polygon.paths")
    holes = F.filter(F.slice(paths_, 2, F.greatest(F.size(paths_) - 1, F.lit(0))), lambda r: F.size(r) >= 3)
    outer = F.get(paths_, F.lit(0))
    polygon = F.when(F.size(outer) >= 3, _geometry(F.lit("Polygon"), F.transform(F.concat(F.array(outer), holes), close_ring)))
    b = F.col("bounding_box")
    corners = [(b["x"], b["y"]), (b["x"] + b["w"], b["y"]), (b["x"] + b["w"], b["y"] + b["h"]), (b["x"], b["y"] + b["h"]), (b["x"], b["y"])]
    box = _geometry(F.lit("Polygon"), F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])))
    dot = _geometry(F.lit("Point"), F.array(F.array(F.col("point"))))
    geometry = F.when(F.col("polygon").isNotNull(), polygon).when(b.isNotNull(), box).when(F.col("point").isNotNull(), dot)
    return rows.select("path", "id", "name", "properties", "slot_names", geometry.alias("geometry"))


# EMPAIA


def read_empaia(spark: SparkSession, paths: str | Sequence[str], name: str = ".*") -> DataFrame:
    """path, name, type, geometry of the polygons and points whose name matches."""
    shape = "items array<struct<name: string, type: string, coordinates: string>>"
    rows = _whole(spark, paths).select("path", F.inline(F.from_json("value", f"struct<{shape}>")["items"]))
    ring = F.transform(F.from_json("coordinates", "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    dot = F.from_json("coordinates", "array<double>")
    geometry = F.when(F.col("type") == "polygon", _geometry(F.lit("Polygon"), F.array(close_ring(ring))))
    geometry = geometry.when(F.col("type") == "point", _geometry(F.lit("Point"), F.array(F.array(F.struct(F.get(dot, F.lit(0)).alias("x"), F.get(dot, F.lit(1)).alias("y"))))))
    return rows.where(starts_with_match(F.col("name"), name) & F.col("type").isin("polygon", "point")).select("path", "name", "type", geometry.alias("geometry"))


__all__ = ["filtered", "geojson_geometries", "json_value", "nested", "points", "polygons", "read_asap", "read_darwin", "read_empaia", "read_geojson", "starts_with_match", "with_definitions"]
