"""The sources, sinks and pixel functions applied to files made from the driver's tables, with DuckDB SQL over those tables.

Annotation files hold up to ``PER_FILE`` annotations of a ``customer`` each, slides are one TIFF a ``supplier``. They are written
to the shared folder and read back through the library's readers.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.geometry import polygon_area, rectangle
from tessella.operators import imaging, rows, stain
from tessella.operators.grid import grid_tiles
from tessella.plans.queries import RGB, query, rgb, table
from tessella.sources import annotations, slides
from tessella.sources.files import shared_folder

PER_FILE = 500
SLIDES_A_TASK = 500
PNG_FOLDERS = 256


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessella-{name}-{uuid.uuid4().hex}"


# Annotation files: boxes, and for every third customer a point

SHAPES = """SELECT c_custkey, c_name, c_mktsegment, (c_custkey % 97 * 10)::DOUBLE AS x, (c_custkey % 89 * 10)::DOUBLE AS y,
  (5 + c_custkey % 13)::DOUBLE AS w, (4 + c_custkey % 11)::DOUBLE AS h, c_custkey % 3 = 0 AS dot FROM customer"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("x", k % 97 * 10).withColumn("y", k % 89 * 10)
    return c.withColumn("w", 5 + k % 13).withColumn("h", 4 + k % 11).withColumn("dot", k % 3 == 0)


def _written(rows_: DataFrame, name: str, item: Column, head: str, between: str, tail: str, last: str = "") -> str:
    """A file of ``item`` for every ``PER_FILE`` customers; returns the folder."""
    path = _folder(rows_.sparkSession, name)
    files = rows_.select(F.floor(F.col("c_custkey") / PER_FILE).alias("file"), item.alias("item")).groupBy("file")
    text = files.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("item")), between), F.lit(last + tail)).alias("value"))
    text.write.partitionBy("file").text(path)
    return path


def _corners(start: str, between: str, end: str) -> Column:
    """The open ring of a box, a corner written as start x between y end."""
    c = [(F.col("x"), F.col("y")), (F.col("x") + F.col("w"), F.col("y")), (F.col("x") + F.col("w"), F.col("y") + F.col("h")), (F.col("x"), F.col("y") + F.col("h"))]
    return F.array(*[F.concat(F.lit(start), a.cast("string"), F.lit(between), b.cast("string"), F.lit(end)) for a, b in c])


def _asap(spark: SparkSession, sf_dir: str) -> str:
    corners = F.when(F.col("dot"), F.slice(_corners('<Coordinate Order="0" X="', '" Y="', '" />'), 1, 1)).otherwise(_corners('<Coordinate Order="0" X="', '" Y="', '" />'))
    kind = F.when(F.col("dot"), "Dot").otherwise("Polygon")
    item = F.concat(F.lit('<Annotation Name="'), "c_name", F.lit('" Type="'), kind, F.lit('" PartOfGroup="'), "c_mktsegment", F.lit('" Color="#F4FA58"><Coordinates>'), F.array_join(corners, ""), F.lit("</Coordinates></Annotation>"))
    return _written(_shapes(spark, sf_dir), "asap", item, '<?xml version="1.0"?><ASAP_Annotations><Annotations>', "", "</Annotations></ASAP_Annotations>")


def _boxes(found: DataFrame, *names: str) -> DataFrame:
    ring = F.get("geometry.rings", F.lit(0))
    return annotations.polygons(found).select(*names, F.get(ring, F.lit(0))["x"].alias("x"), F.size(ring).alias("corners"), polygon_area(F.col("geometry.rings")).alias("area"))


def _dots(found: DataFrame, *names: str) -> DataFrame:
    dot = F.get(F.get("geometry.rings", F.lit(0)), F.lit(0))
    return annotations.points(found).select(*names, dot["x"].alias("x"), dot["y"].alias("y"))


@query(f"SELECT c_name AS name, c_mktsegment AS part_of_group, x, 5 AS corners, w * h AS area FROM ({SHAPES}) WHERE NOT dot AND starts_with(c_mktsegment, 'A')")
def asap_polygons(spark, sf_dir):
    return _boxes(annotations.read_asap(spark, _asap(spark, sf_dir), part_of_group="A"), "name", "part_of_group")


@query(f"SELECT c_name AS name, x, y FROM ({SHAPES}) WHERE dot AND regexp_matches(c_name, '^Customer#0*[1-4]')")
def asap_points(spark, sf_dir):
    return _dots(annotations.read_asap(spark, _asap(spark, sf_dir), name="Customer#0*[1-4]"), "name")


PRESETS = 5


def _geojson(spark: SparkSession, sf_dir: str) -> str:
    ring = F.array_join(F.concat(_corners("[", ",", "]"), F.slice(_corners("[", ",", "]"), 1, 1)), ",")
    shape = F.when(F.col("dot"), F.concat(F.lit('{"type":"Point","coordinates":'), F.get(_corners("[", ",", "]"), F.lit(0)), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))
    preset = F.col("c_custkey") % 7
    properties = F.concat(F.lit('{"name":"'), "c_name", F.lit('","stats":{"segment":"'), "c_mktsegment", F.lit('","ids":[0,'), F.col("c_custkey").cast("string"), F.lit("]}"), F.when(preset < 6, F.concat(F.lit(',"presetID":"k'), preset.cast("string"), F.lit('"'))).otherwise(F.lit("")), F.lit("}"))
    item = F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}"))
    definitions = "".join("," + json.dumps({"type": "Feature", "geometry": None, "properties": {"presetID": f"k{k}", "name": f"class {k}", "meta": {"rank": k * k}}}) for k in range(PRESETS))
    return _written(_shapes(spark, sf_dir), "geojson", item, '{"type":"FeatureCollection","features":[', ",", "]}", definitions)


@query(f"SELECT c_name AS name, x, 5 AS corners, w * h AS area FROM ({SHAPES}) WHERE NOT dot")
def geojson_polygons(spark, sf_dir):
    found = annotations.read_geojson(spark, _geojson(spark, sf_dir))
    return _boxes(found.withColumn("name", annotations.nested(F.col("properties"), ["name"])), "name")


@query(f"SELECT c_name AS name, x, y FROM ({SHAPES}) WHERE dot AND starts_with(c_mktsegment, 'BUILD') AND starts_with(c_custkey::VARCHAR, '1')")
def geojson_filtered_points(spark, sf_dir):
    found = annotations.filtered(annotations.read_geojson(spark, _geojson(spark, sf_dir)), stats_segment="BUILD", stats_ids_1="1")
    return _dots(found.withColumn("name", annotations.nested(F.col("properties"), ["name"])), "name")


@query(f"""SELECT c_name AS name, CASE WHEN c_custkey % 7 < 6 THEN 'k' || c_custkey % 7 END AS preset, CASE WHEN c_custkey % 7 < {PRESETS} THEN 'class ' || c_custkey % 7 END AS name_def,
CASE WHEN c_custkey % 7 < {PRESETS} THEN (c_custkey % 7 * (c_custkey % 7))::VARCHAR END AS rank FROM customer""")
def geojson_relations(spark, sf_dir):
    found = annotations.read_geojson(spark, _geojson(spark, sf_dir))
    of = lambda *steps: annotations.nested(F.col("properties"), list(steps))
    return found.select(of("name").alias("name"), of("presetID").alias("preset"), of("name_def").alias("name_def"), of("meta", "rank").alias("rank"))


def _darwin(spark: SparkSession, sf_dir: str) -> str:
    t = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n = lambda c: F.col(c).cast("string")
    shape = F.when(F.col("dot"), t('"point":{"x":', n("x"), ',"y":', n("y"), "}")).when(F.col("c_custkey") % 2 == 0, t('"bounding_box":{"x":', n("x"), ',"y":', n("y"), ',"w":', n("w"), ',"h":', n("h"), "}"))
    shape = shape.otherwise(t('"polygon":{"paths":[[', F.array_join(_corners('{"x":', ',"y":', "}"), ","), ']]},"bounding_box":{"x":0,"y":0,"w":1,"h":1}'))
    item = t('{"id":"', n("c_custkey"), '","name":"', F.col("c_name"), '",', shape, ',"properties":[{"name":"segment","value":"', F.col("c_mktsegment"), '"}],"slot_names":["0"]}')
    return _written(_shapes(spark, sf_dir), "darwin", item, '{"version":"2.0","annotations":[', ",", "]}")


@query(f"SELECT c_custkey::VARCHAR AS id, c_name AS name, x, 5 AS corners, w * h AS area FROM ({SHAPES}) WHERE NOT dot AND starts_with(c_mktsegment, 'M')")
def darwin_polygons(spark, sf_dir):
    return _boxes(annotations.filtered(annotations.read_darwin(spark, _darwin(spark, sf_dir)), properties_0_value="M"), "id", "name")


@query(f"SELECT c_custkey::VARCHAR AS id, x, y FROM ({SHAPES}) WHERE dot")
def darwin_points(spark, sf_dir):
    return _dots(annotations.read_darwin(spark, _darwin(spark, sf_dir)), "id")


def _empaia(spark: SparkSession, sf_dir: str) -> str:
    kind = F.when(F.col("dot"), "point").otherwise("polygon")
    coordinates = F.when(F.col("dot"), F.get(_corners("[", ",", "]"), F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(_corners("[", ",", "]"), ","), F.lit("]")))
    item = F.concat(F.lit('{"name":"'), "c_name", F.lit('","type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))
    return _written(_shapes(spark, sf_dir), "empaia", item, '{"item_count":1,"items":[', ",", "]}")


@query(f"SELECT c_name AS name, x, 5 AS corners, w * h AS area FROM ({SHAPES}) WHERE NOT dot")
def empaia_polygons(spark, sf_dir):
    return _boxes(annotations.read_empaia(spark, _empaia(spark, sf_dir)), "name")


@query(f"SELECT c_name AS name, x, y FROM ({SHAPES}) WHERE dot AND regexp_matches(c_name, '^Customer#0*2')")
def empaia_points(spark, sf_dir):
    return _dots(annotations.read_empaia(spark, _empaia(spark, sf_dir), name="Customer#0*2"), "name")


# Slides: TIFFs written by the sink, read by the source and by pixel functions

TIFFS = "SELECT s_suppkey AS k, 56 + s_suppkey % 5 * 8 AS w, 40 + s_suppkey % 3 * 8 AS h, 16 + s_suppkey % 4 * 8 AS edge FROM supplier"
TIFF_TILES = f"SELECT k, w, h, edge, i * 16 AS tx, j * 16 AS ty FROM ({TIFFS}), LATERAL (SELECT unnest(range(0, ((w - 16 + 15) // 16 + 1)::BIGINT)) AS i), LATERAL (SELECT unnest(range(0, ((h - 16 + 15) // 16 + 1)::BIGINT)) AS j)"
PIXELS = f"SELECT k, tx, ty, dx, dy, c, tx + dx < w AND ty + dy < h AS inside, ((tx + dx) * 3 + (ty + dy) * 5 + k + c * 7) % 256 AS v FROM ({TIFF_TILES}), unnest(range(0, 16)) AS a(dx), unnest(range(0, 16)) AS b(dy), unnest(range(0, 3)) AS d(c)"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    out = table(spark, sf_dir, "supplier").select(k.alias("k"), (56 + k % 5 * 8).cast("int").alias("w"), (40 + k % 3 * 8).cast("int").alias("h"), (16 + k % 4 * 8).cast("int").alias("edge"))
    # a task has the pixels of its slides in few batches
    return out.repartition(max(8, -(-out.count() // SLIDES_A_TASK)))


@F.arrow_udf(T.BinaryType())
def _slide_pixels(k: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
    out = []
    for key, width, height in zip(k.to_pylist(), w.to_pylist(), h.to_pylist(), strict=True):
        y, x, c = np.ogrid[:height, :width, :3]
        out.append(((x * 3 + y * 5 + key + c * 7) % 256).astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def _overlay_pixels(w: pa.Array, h: pa.Array, edge: pa.Array) -> pa.Array:
    out = []
    for width, height, at in zip(w.to_pylist(), h.to_pylist(), edge.to_pylist(), strict=True):
        row = np.where(np.arange(width) * 2 < at, 255, 0).astype(np.uint8)
        out.append(np.tile(row, height).tobytes())
    return pa.array(out, pa.binary())


def _slides(spark: SparkSession, sf_dir: str) -> str:
    s, path = _suppliers(spark, sf_dir), _folder(spark, "slides")
    k = F.col("k")
    options = F.concat(F.lit('{"mpp":['), (0.25 * (1 + k % 3)).cast("string"), F.lit(',0.5],"compression":"'), F.when(k % 2 == 0, "none").otherwise("deflate"), F.lit('"}'))
    out = s.select(F.concat(F.lit("s_"), k.cast("string"), F.lit(".tiff")).alias("name"), F.array("h", "w", F.lit(3)).alias("shape"), _slide_pixels("k", "w", "h").alias("data"), options.alias("options"))
    slides.register(spark)
    out.write.format("tiff_tiles").option("defaults", '{"tile":[16,16]}').mode("append").save(path)
    return path


def _overlays(spark: SparkSession, sf_dir: str) -> str:
    """One channel at half the resolution: 255 left of the edge, else 0."""
    s, path = _suppliers(spark, sf_dir), _folder(spark, "overlays")
    w, h = F.floor(F.col("w") / 2).cast("int"), F.floor(F.col("h") / 2).cast("int")
    data = _overlay_pixels(w, h, "edge")
    options = F.concat(F.lit('{"mpp":['), (0.5 * (1 + F.col("k") % 3)).cast("string"), F.lit(',1.0],"tile":[16,16]}'))
    slides.register(spark)
    s.select(F.concat(F.lit("s_"), F.col("k").cast("string"), F.lit(".tiff")).alias("name"), F.array(h, w, F.lit(1)).alias("shape"), data.alias("data"), options.alias("options")).write.format("tiff_tiles").mode("append").save(path)
    return path


def _key(path: Column) -> Column:
    return F.regexp_extract(rows.stem(path), r"s_(\d+)", 1).cast("long")


@query(f"SELECT k, w::BIGINT AS extent_x, h::BIGINT AS extent_y, 16::BIGINT AS tile_extent_x, 12::BIGINT AS stride_y, round(0.25 * (1 + k % 3), 4)::DOUBLE AS mpp_x, 0.5::DOUBLE AS mpp_y, 0::BIGINT AS level, 1.0::DOUBLE AS downsample FROM ({TIFFS})")
def slide_metadata(spark, sf_dir):
    found = slides.read_slides(spark, _slides(spark, sf_dir), 16, 12, mpp=0.5)
    return found.select(_key(F.col("path")).alias("k"), "extent_x", "extent_y", "tile_extent_x", "stride_y", F.round("mpp_x", 4).alias("mpp_x"), F.round("mpp_y", 4).alias("mpp_y"), "level", "downsample")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid_tiles(slides.read_slides(spark, _slides(spark, sf_dir), 16, 16, level=0))
    return found.withColumn("k", _key(F.col("path")))


def _at() -> list[Column]:
    return [F.col("path"), F.col("tile_x"), F.col("tile_y"), F.col("tile_extent_x"), F.col("tile_extent_y"), F.col("level")]


@query(f"SELECT k, tx AS tile_x, ty AS tile_y, sum(CASE WHEN inside THEN v ELSE 255 END)::BIGINT AS total FROM ({PIXELS}) GROUP BY k, tx, ty")
def slide_tile_pixels(spark, sf_dir):
    """Tiles on a white background, a tile's place and pixels from the files."""
    t = slides.together(_tiles(spark, sf_dir), "path", ["tile_y", "tile_x"])
    t = t.withColumn("tile", slides.read_slide_tiles(*_at()))
    return t.select("k", "tile_x", "tile_y", slides.byte_sum(F.col("tile.data")).alias("total"))


@query(f"SELECT k, tx AS tile_x, ty AS tile_y, sum(CASE WHEN inside THEN v WHEN c = 0 THEN 10 WHEN c = 1 THEN 0 ELSE 200 END)::BIGINT AS total FROM ({PIXELS}) GROUP BY k, tx, ty")
def slide_tile_background(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("tile", slides.slide_tiles(10, 0, 200)(*_at()))
    return t.select("k", "tile_x", "tile_y", slides.byte_sum(F.col("tile.data")).alias("total"))


@query(f"SELECT k, tx AS tile_x, ty AS tile_y, sum(CASE WHEN inside THEN v + (c = 0)::INTEGER * 255 ELSE 0 END)::BIGINT AS total, count(*) FILTER (WHERE inside AND c = 0) AS seen FROM ({PIXELS}) GROUP BY k, tx, ty")
def slide_regions_rgba(spark, sf_dir):
    """Red, green, blue and alpha; what lies outside the slide is transparent black."""
    t = _tiles(spark, sf_dir).withColumn("region", slides.read_slide_regions(*_at()))
    return t.select("k", "tile_x", "tile_y", slides.byte_sum(F.col("region.data")).alias("total"), slides.opaque_pixels("region.data").alias("seen"))


@query(f"SELECT k, tx AS tile_x, ty AS tile_y, round(stddev_pop(CASE WHEN inside THEN v ELSE 255 END), 6) AS std FROM ({PIXELS}) GROUP BY k, tx, ty HAVING stddev_pop(CASE WHEN inside THEN v ELSE 255 END) > 30")
def slide_tiles_with_tissue(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("std", F.round(slides.pixel_std(slides.read_slide_tiles(*_at())), 6))
    return t.where("std > 30").select("k", "tile_x", "tile_y", "std")


@query(f"SELECT k, tx AS tile_x, ty AS tile_y, count(*) FILTER (WHERE tx + 2 * a.i < edge AND tx + 2 * a.i < w AND ty + 2 * b.j < h) / 64.0::DOUBLE AS share FROM ({TIFF_TILES}), unnest(range(0, 8)) AS a(i), unnest(range(0, 8)) AS b(j) GROUP BY k, tx, ty")
def overlay_shares_of_files(spark, sf_dir):
    folder = _overlays(spark, sf_dir)
    t = _tiles(spark, sf_dir).withColumn("overlay", F.concat(F.lit(f"{folder}/"), rows.basename(F.col("path"))))
    roi = rectangle(F.lit(0.0), F.lit(0.0), F.col("tile_extent_x"), F.col("tile_extent_y"))
    shares = slides.tile_overlay_overlap(*[F.col(c) for c in ("overlay", "tile_x", "tile_y", "mpp_x", "mpp_y")], roi)
    return t.select("k", "tile_x", "tile_y", F.coalesce(F.element_at(shares, "255"), F.lit(0.0)).alias("share"))


@query(f"SELECT k, tx AS tile_x, ty AS tile_y, 255 * count(*) FILTER (WHERE tx + 2 * a.i < edge AND tx + 2 * a.i < w AND ty + 2 * b.j < h) AS total, 0::BIGINT AS outside FROM ({TIFF_TILES}), unnest(range(2, 6)) AS a(i), unnest(range(2, 6)) AS b(j) GROUP BY k, tx, ty")
def overlay_patches_of_files(spark, sf_dir):
    """The overlay's pixels under the middle of each tile."""
    folder = _overlays(spark, sf_dir)
    t = _tiles(spark, sf_dir).withColumn("overlay", F.concat(F.lit(f"{folder}/"), rows.basename(F.col("path"))))
    patch = slides.tile_overlay(*[F.col(c) for c in ("overlay", "tile_x", "tile_y", "mpp_x", "mpp_y")], rectangle(F.lit(4.0), F.lit(4.0), F.lit(8.0), F.lit(8.0)))
    t = t.withColumn("patch", patch)
    channels = F.element_at("patch.shape", 3)
    return t.select("k", "tile_x", "tile_y", F.floor(slides.byte_sum(F.col("patch.data")) / channels).alias("total"), slides.byte_sum(F.col("patch.mask")).alias("outside"))


@query(f"SELECT k, count(*) AS tiles, 16::BIGINT AS width, 16::BIGINT AS height FROM ({TIFF_TILES}) GROUP BY k")
def png_of_tiles(spark, sf_dir):
    """Tiles as PNG files, whose headers give their sizes."""
    folder = _folder(spark, "png")
    slides.register(spark)
    t = _tiles(spark, sf_dir).withColumn("tile", slides.read_slide_tiles(*_at()))
    name = F.concat_ws("_", rows.stem(F.col("path")), "tile_x", "tile_y")
    # in folders, for the tasks to list: the driver would hold every file's name
    name = F.concat((F.col("k") % PNG_FOLDERS).cast("string"), F.lit("/"), name, F.lit(".png"))
    t.select(name.alias("name"), "tile.shape", "tile.data", F.lit(None).cast("string").alias("options")).write.format("png_tiles").mode("append").save(folder)
    files = spark.read.format("png_tiles").load(folder)
    return files.groupBy(_key(F.col("path")).alias("k")).agg(F.count("*").alias("tiles"), F.max("width").alias("width"), F.max("height").alias("height"))


@query(f"SELECT k, w::BIGINT * h * 3 AS pixel_bytes, 16::BIGINT * 16 * 3 AS tile_bytes FROM ({TIFFS})")
def slide_sizes(spark, sf_dir):
    found = slides.read_slides(spark, _slides(spark, sf_dir), 16, 16, level=0)
    pixel, tile = slides.pixel_bytes(), slides.tile_bytes()
    return found.select(_key(F.col("path")).alias("k"), pixel.alias("pixel_bytes"), tile.alias("tile_bytes"))


# Pixels


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, r, g, b, greatest(r, g, b) AS top, least(r, g, b) AS low, {' + '.join(f"{k!r} * CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END" for k, c in zip(imaging.REC709, 'rgb', strict=True))} AS light FROM ({RGB}))
SELECT l_orderkey, l_linenumber, round_even(255 * CASE WHEN light <= 0.0031308 THEN light * 12.92 ELSE 1.055 * pow(light, 1 / 2.4::DOUBLE) - 0.055 END, 0)::INTEGER AS gray,
  CASE WHEN top > 0 THEN floor((top - low) * 255.0::DOUBLE / top)::INTEGER ELSE 0 END AS saturation FROM p""")
def gray_and_saturation(spark, sf_dir):
    c = [F.col(n) for n in "rgb"]
    return rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", imaging.gray(*c).alias("gray"), imaging.saturation(*c).alias("saturation"))


def _combined_sql() -> str:
    import math

    amounts = ["(l_partkey % 7) / 20.0::DOUBLE", "(l_suppkey % 5) / 20.0::DOUBLE", "(l_linenumber % 3) / 20.0::DOUBLE"]
    scale = -math.log(stain.FLOOR)
    colours = [f"round(least(greatest(exp(-({' + '.join(f'{a} * {scale * float(stain.HE[k][i])!r}' for k, a in enumerate(amounts))})), 0), 1), 7) AS {n}" for i, n in enumerate("rgb")]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(colours)} FROM lineitem"


@query(_combined_sql())
def stain_combine(spark, sf_dir):
    amounts = [F.col(c) % n / 20.0 for c, n in (("l_partkey", 7), ("l_suppkey", 5), ("l_linenumber", 3))]
    out = stain.combine(amounts)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 7).alias(n) for v, n in zip(out, "rgb", strict=True)])


@query(f"SELECT l_orderkey % 5 AS image, count(*) AS n, count(DISTINCT (r, g, b)) AS colours, count(DISTINCT (r, g, b)) AS changes, true AS near FROM ({RGB}) GROUP BY 1")
def stain_augment(spark, sf_dir):
    """Equal colours of an image change alike, and without jitter comes back what the stains can express."""
    before = rgb(spark, sf_dir).withColumn("image", F.col("l_orderkey") % 5).withColumns({f"old_{c}": F.col(c) for c in "rgb"})
    after = stain.augment(before, "image", alpha=0.1, beta=0.05, seed=4)
    old, new = [F.col(f"old_{c}") for c in "rgb"], [F.col(c) for c in "rgb"]
    counted = after.groupBy("image").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*old)).alias("colours"), F.count_distinct(F.struct(*old, *new)).alias("changes"))
    near = F.lit(True)
    for c, v in zip("rgb", stain.combine(stain.separate(*[v / 255.0 for v in old])), strict=True):
        near = near & (F.abs(F.col(c) - v * 255) <= 1)
    same = stain.augment(before, "image", alpha=0.0, beta=0.0).groupBy(F.col("image").alias("of")).agg(F.bool_and(near).alias("near"))
    return counted.join(same, F.col("image") == F.col("of")).select("image", "n", "colours", "changes", "near")
