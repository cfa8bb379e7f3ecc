"""The library's operators applied to the driver's tables, with DuckDB SQL of the same meaning.

Slides, tiles, pixels and tensors are derived from the tables by plain arithmetic that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import polygon_area, rectangle
from tessella.operators import annotations, grid, imaging, levels, masks, overlays, rows, splits, stain, tensors
from tessella.operators.ranking import hash_rank
from tessella.sources.annotations import nested, starts_with_match, with_definitions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Slides and levels

SLIDES = "SELECT p_partkey AS slide_id, 600 + p_size * 113 AS extent_x, 500 + (p_partkey % 37) * 71 AS extent_y, 512 AS tile, 384 AS stride FROM part"


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("slide_id"), (600 + F.col("p_size") * 113).cast("long").alias("extent_x"), (500 + F.col("p_partkey") % 37 * 71).alias("extent_y"), F.lit(512).alias("tile"), F.lit(384).alias("stride"))


def _grid(spark: SparkSession, sf_dir: str, last: str) -> DataFrame:
    out = grid.grid_tiles(slides(spark, sf_dir), ("extent_x", "extent_y"), ("tile", "tile"), ("stride", "stride"), last)
    return out.select("slide_id", "tile_x", "tile_y")


def _grid_sql(turn: str, at: str = "{i} * stride") -> str:
    axis = lambda n: f"unnest(range(0, greatest(0, {turn}((extent_{n} - tile) / stride::DOUBLE)::BIGINT + 1)))"
    x, y = at.format(i="i", e="extent_x"), at.format(i="j", e="extent_y")
    return f"WITH s AS ({SLIDES}), a AS (SELECT *, {axis('x')} AS i FROM s), b AS (SELECT *, {axis('y')} AS j FROM a) SELECT slide_id, ({x})::BIGINT AS tile_x, ({y})::BIGINT AS tile_y FROM b"


@query(_grid_sql("ceil"))
def grid_keep(spark, sf_dir):
    return _grid(spark, sf_dir, "keep")


@query(_grid_sql("floor"))
def grid_drop(spark, sf_dir):
    return _grid(spark, sf_dir, "drop")


@query(_grid_sql("ceil", "least({i} * stride, {e} - tile)"))
def grid_shift(spark, sf_dir):
    return _grid(spark, sf_dir, "shift")


@query(f"SELECT slide_id, (greatest(0, ceil((extent_x - tile) / stride::DOUBLE)::BIGINT + 1) * greatest(0, ceil((extent_y - tile) / stride::DOUBLE)::BIGINT + 1))::BIGINT AS n FROM ({SLIDES})")
def tiles_per_slide(spark, sf_dir):
    c = F.col
    return slides(spark, sf_dir).select("slide_id", grid.tiles_per_slide((c("extent_x"), c("extent_y")), (c("tile"), c("tile")), (c("stride"), c("stride"))).alias("n"))


@query("""
WITH s AS (SELECT p_partkey, 0.2::DOUBLE + (p_partkey % 5) * 0.05::DOUBLE AS bx, 0.2::DOUBLE + (p_size % 7) * 0.05::DOUBLE AS ry, 0.3::DOUBLE + (p_partkey % 23) * 0.1713::DOUBLE AS mpp FROM part),
l AS (SELECT p_partkey, lv, abs(power(2, lv) - (mpp / bx + mpp / ry) / 2) AS d FROM s, unnest([0, 1, 2, 3]) AS t(lv))
SELECT p_partkey AS slide_id, arg_min(lv, round(d, 9) * 10 + lv * 1e-6)::INTEGER AS level FROM l GROUP BY p_partkey""")
def level_by_downsample(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bx, by, mpp = 0.2 + F.col("p_partkey") % 5 * 0.05, 0.2 + F.col("p_size") % 7 * 0.05, 0.3 + F.col("p_partkey") % 23 * 0.1713
    downsamples = F.array(*[F.lit(float(2**k)) for k in range(4)])
    return p.select(F.col("p_partkey").alias("slide_id"), levels.closest_level_by_downsample(downsamples, bx, by, mpp).alias("level"))


@query("""
WITH s AS (SELECT p_partkey, 0.2::DOUBLE + (p_partkey % 5) * 0.05::DOUBLE AS bx, 0.2::DOUBLE + (p_size % 7) * 0.05::DOUBLE AS ry, 0.3::DOUBLE + (p_partkey % 23) * 0.1713::DOUBLE AS mpp FROM part),
l AS (SELECT p_partkey, lv, (abs(bx * power(2, lv) - mpp) + abs(ry * power(2, lv) - mpp)) / 2 AS d FROM s, unnest([0, 1, 2, 3]) AS t(lv))
SELECT p_partkey AS slide_id, arg_min(lv, round(d, 9) * 10 + lv * 1e-6)::INTEGER AS level FROM l GROUP BY p_partkey""")
def level_by_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bx, by, mpp = 0.2 + F.col("p_partkey") % 5 * 0.05, 0.2 + F.col("p_size") % 7 * 0.05, 0.3 + F.col("p_partkey") % 23 * 0.1713
    found = F.array(*[levels.level_resolution(bx, by, F.lit(float(2**k))) for k in range(4)])
    return p.select(F.col("p_partkey").alias("slide_id"), levels.closest_level_by_resolution(found, mpp).alias("level"))


@query("""
SELECT p_partkey AS slide_id, CASE 2 + p_size % 4 WHEN 2 THEN 25400.0 WHEN 3 THEN 10000.0 WHEN 4 THEN 1000.0 END / ((p_partkey % 900 + 100)::DOUBLE / 3) AS mpp
FROM part WHERE p_size % 4 < 3 UNION ALL SELECT p_partkey, (p_partkey % 900 + 100)::DOUBLE / 3 FROM part WHERE p_size % 4 = 3""")
def level_resolution_tiff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    value = levels.tiff_resolution((F.col("p_partkey") % 900 + 100).cast("double"), F.lit(3.0), 2 + F.col("p_size") % 4)
    return p.select(F.col("p_partkey").alias("slide_id"), value.alias("mpp"))


# Rows


@query("SELECT c_custkey, sha256(concat_ws(chr(31), c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment)) AS id, md5(c_name) AS short FROM customer")
def row_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", rows.row_hash(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("id"), rows.row_hash(["c_name"], "md5").alias("short"))


PATHS = "SELECT o_orderkey, '/slides/' || CASE WHEN o_orderkey % 3 = 0 THEN 'tumor' ELSE 'normal' END || '/P' || o_custkey || '_' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.ome.tiff' ELSE '.svs' END AS path FROM orders"


@query(f"""
SELECT o_orderkey, split_part(regexp_extract(path, '([^/]*)$', 1), '_', 1) AS patient_id, contains(path, 'tumor') AS label,
       regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, CASE WHEN ends_with(path, '.svs') THEN substr(path, 1, length(path) - 4) || '_mask.tiff' ELSE path END AS overlay_path,
       ends_with(lower(path), '.ome.tiff') OR ends_with(lower(path), '.ome.tif') AS ome FROM ({PATHS})""")
def path_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind, ending = F.when(F.col("o_orderkey") % 3 == 0, "tumor").otherwise("normal"), F.when(F.col("o_orderkey") % 2 == 0, ".ome.tiff").otherwise(".svs")
    o = o.select("o_orderkey", F.concat(F.lit("/slides/"), kind, F.lit("/P"), F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"), ending).alias("path"))
    p = F.col("path")
    return o.select("o_orderkey", rows.patient_id(p).alias("patient_id"), p.contains("tumor").alias("label"), rows.stem(p).alias("stem"), rows.with_suffix(p, ".svs", "_mask.tiff").alias("overlay_path"), rows.is_ome(p).alias("ome"))


@query("SELECT l_orderkey, min(r) - 1 AS start, max(r) AS stop FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS r FROM lineitem) GROUP BY l_orderkey")
def slide_run_index(spark, sf_dir):
    return rows.run_index(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def split_membership(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.members(table(spark, sf_dir, "lineitem"), ids, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def split_non_membership(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.members(table(spark, sf_dir, "lineitem"), ids, "l_orderkey", False).select("l_orderkey", "l_linenumber")


# Overlays


@query("""
SELECT p_partkey AS slide_id, greatest(0, round_even((p_partkey * 37 % 5000 - 200)::DOUBLE * (0.25::DOUBLE / (0.1::DOUBLE * (1 + p_size % 9))), 0)::BIGINT) AS x,
       greatest(0, round_even((p_partkey * 91 % 7000)::DOUBLE * (0.5::DOUBLE / (0.1::DOUBLE * (1 + p_size % 9))), 0)::BIGINT) AS y,
       round_even(512::DOUBLE * (0.25::DOUBLE / (0.1::DOUBLE * (1 + p_size % 9))), 0)::BIGINT AS width, round_even(512::DOUBLE * (0.5::DOUBLE / (0.1::DOUBLE * (1 + p_size % 9))), 0)::BIGINT AS height FROM part""")
def overlay_scale(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    o = F.lit(0.1) * (1 + F.col("p_size") % 9)
    at = overlays.scale_window(F.col("p_partkey") * 37 % 5000 - 200, F.col("p_partkey") * 91 % 7000, F.lit(512), F.lit(512), F.lit(0.25), F.lit(0.5), o, o)
    return p.select(F.col("p_partkey").alias("slide_id"), at.alias("w")).select("slide_id", "w.*")


@query("""
SELECT l_orderkey, l_returnflag, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_orderkey) AS fraction
FROM lineitem WHERE NOT l_linestatus = 'X' GROUP BY l_orderkey, l_returnflag""")
def overlay_fraction(spark, sf_dir):
    return overlays.value_fractions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", F.col("l_linestatus") == "X")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'N') >= 0.5 * count(*)")
def coverage_filter(spark, sf_dir):
    found = overlays.fraction_map(overlays.value_fractions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag"), ["l_orderkey"], "l_returnflag")
    return found.where(overlays.covered(F.col("overlap"), "N", 0.5)).select("l_orderkey")


ROI = [(2.0, 1.0), (30.0, 4.0), (26.0, 31.0), (5.0, 27.0)]


@query("""
WITH e(x0, y0, x1, y1) AS (VALUES (2.0, 1.0, 30.0, 4.0), (30.0, 4.0, 26.0, 31.0), (26.0, 31.0, 5.0, 27.0), (5.0, 27.0, 2.0, 1.0)),
p AS (SELECT DISTINCT (l_partkey % 32)::INTEGER AS x, (l_suppkey % 32)::INTEGER AS y FROM lineitem)
SELECT p.x, p.y, sum(CASE WHEN p.y + 0.5 >= least(e.y0, e.y1) AND p.y + 0.5 < greatest(e.y0, e.y1) AND p.x + 0.5 < e.x0 + (p.y + 0.5 - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) THEN 1 ELSE 0 END) % 2 = 0 AS masked
FROM p, e GROUP BY p.x, p.y""")
def overlay_mask(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_suppkey") % 32).cast("int").alias("y")).distinct()
    return p.select("x", "y", (~overlays.inside_convex(F.col("x"), F.col("y"), ROI)).alias("masked"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda v: v::DOUBLE), 'stddev_pop'), 9) AS std FROM embeddings WHERE list_aggregate(list_transform(embedding, lambda v: v::DOUBLE), 'stddev_pop') > 0.124")
def tile_std_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("s", overlays.tile_std(F.col("embedding").cast("array<double>")))
    return e.where("s > 0.124").select("vec_id", F.round("s", 9).alias("std"))


# Tensors: an embedding of 64 numbers is a tensor of 8 by 8

FLAT = "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings"


def _tensor_sql(cell: str, ddof: int, by: str = "") -> str:
    keys = ", ".join(k for k in (by, "cell") if k)
    std = "stddev_samp" if ddof else "stddev_pop"
    return f"SELECT {keys}, count(*) AS n, round(avg(v), 9) AS mean, round({std}(v), 9) AS std FROM (SELECT *, ({cell})::INTEGER AS cell FROM ({FLAT})) GROUP BY {keys}"


def _tensor(spark: SparkSession, sf_dir: str, axis, ddof: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    out = tensors.tensor_stats(table(spark, sf_dir, "embeddings"), "embedding", (8, 8), axis, ddof, by=by)
    return out.select(*by, "cell", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(_tensor_sql("0", 1))
def tensor_all(spark, sf_dir):
    return _tensor(spark, sf_dir, None)


@query(_tensor_sql("p", 1))
def tensor_axis0(spark, sf_dir):
    return _tensor(spark, sf_dir, 0)


@query(_tensor_sql("p", 0))
def tensor_axis0_population(spark, sf_dir):
    return _tensor(spark, sf_dir, 0, 0.0)


@query(_tensor_sql("p % 8", 1))
def tensor_axis01(spark, sf_dir):
    return _tensor(spark, sf_dir, 1)


@query(_tensor_sql("p // 8", 1))
def tensor_axis02(spark, sf_dir):
    return _tensor(spark, sf_dir, (0, 2))


@query(_tensor_sql("p // 8", 0, "label"))
def tensor_by_label(spark, sf_dir):
    return _tensor(spark, sf_dir, (0, 2), 0.0, ("label",))


# Annotations

BOXES = "SELECT o_orderkey, (o_orderkey % 11)::BIGINT AS slide_id, (o_orderkey * 131 % 4000)::DOUBLE AS x, (o_custkey * 57 % 4000)::DOUBLE AS y, (20 + o_orderkey % 90)::DOUBLE AS w, (15 + o_custkey % 70)::DOUBLE AS h FROM orders"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    out = table(spark, sf_dir, "orders").select(o, (o % 11).alias("slide_id"), (o * 131 % 4000).cast("double").alias("x"), (c * 57 % 4000).cast("double").alias("y"), (20 + o % 90).cast("double").alias("w"), (15 + c % 70).cast("double").alias("h"))
    return out.withColumn("box", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")))


def box_tiles(spark: SparkSession) -> DataFrame:
    out = spark.range(11).select(F.col("id").alias("slide_id"), F.lit(4000).alias("e"), F.lit(256).alias("t"))
    return grid.grid_tiles(out, ("e", "e"), ("t", "t"), ("t", "t")).select("slide_id", "tile_x", "tile_y")


@query(f"""
WITH b AS ({BOXES}), t AS (SELECT s AS slide_id, i * 256 AS tile_x, j * 256 AS tile_y FROM unnest(range(0, 11)) AS a(s), unnest(range(0, 16)) AS c(i), unnest(range(0, 16)) AS d(j))
SELECT t.slide_id, t.tile_x::BIGINT AS tile_x, t.tile_y::BIGINT AS tile_y, count(*) AS n,
       sum(greatest(least(t.tile_x + 256, b.x + b.w) - greatest(t.tile_x, b.x), 0) * greatest(least(t.tile_y + 256, b.y + b.h) - greatest(t.tile_y, b.y), 0))::DOUBLE AS area
FROM t JOIN b ON t.slide_id = b.slide_id AND t.tile_x <= b.x + b.w AND b.x <= t.tile_x + 256 AND t.tile_y <= b.y + b.h AND b.y <= t.tile_y + 256 GROUP BY ALL""")
def annotation_join(spark, sf_dir):
    x, y = F.col("tile_x").cast("double"), F.col("tile_y").cast("double")
    tiles = box_tiles(spark).withColumn("box", F.struct(x.alias("x0"), y.alias("y0"), (x + 256).alias("x1"), (y + 256).alias("y1")))
    pairs = annotations.box_join(tiles, boxes(spark, sf_dir).select("slide_id", F.col("box").alias("abox")), ["slide_id"], 512.0, "box", "abox")
    return pairs.groupBy("slide_id", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.sum(annotations.rectangle_overlap(F.col("box"), F.col("abox"))).alias("area"))


@query("""
WITH b AS (SELECT (p_partkey % 50)::BIGINT AS slide_id, (p_partkey // 50) * 60 AS x, 10 + p_size AS w, 5 + p_size * 2 AS h FROM part),
t AS (SELECT s AS slide_id, i * 100 AS tile_x, j * 100 AS tile_y FROM unnest(range(0, 50)) AS a(s), unnest(range(0, 10)) AS c(i), unnest(range(0, 2)) AS d(j)),
p AS (SELECT t.*, greatest(0, least(t.tile_x + 100, b.x + b.w) - greatest(t.tile_x, b.x)) * greatest(0, least(t.tile_y + 100, b.h) - greatest(t.tile_y, 0)) AS area FROM t LEFT JOIN b ON t.slide_id = b.slide_id)
SELECT slide_id, tile_x::BIGINT AS tile_x, tile_y::BIGINT AS tile_y, round(coalesce(sum(area), 0)::DOUBLE, 6) AS covered_area, round(coalesce(sum(area), 0)::DOUBLE / 10000.0, 6) AS coverage FROM p GROUP BY ALL""")
def annotation_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, w, h = F.floor(F.col("p_partkey") / 50) * 60, 10 + F.col("p_size"), 5 + F.col("p_size") * 2
    shapes = p.select((F.col("p_partkey") % 50).alias("slide_id"), F.array(rectangle(x.cast("double"), F.lit(0.0), w.cast("double"), h.cast("double"))).alias("rings"))
    tiles = spark.range(50).select(F.col("id").alias("slide_id"), F.lit(1000).alias("ex"), F.lit(200).alias("ey"), F.lit(100).alias("t"))
    tiles = grid.grid_tiles(tiles, ("ex", "ey"), ("t", "t"), ("t", "t")).select("slide_id", "tile_x", "tile_y")
    out = annotations.tile_annotations(tiles, shapes, annotations.full_tile(F.lit(100.0), F.lit(100.0)), F.lit(1.0), size=256.0)
    return out.select("slide_id", "tile_x", "tile_y", F.round("covered_area", 6).alias("covered_area"), F.round(F.col("covered_area") / F.col("roi_area"), 6).alias("coverage"))


@query("SELECT o_orderkey, w * h - 4 * 3 AS area FROM (" + BOXES + ")")
def polygon_areas(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    hole = rectangle(x + 2, y + 2, F.lit(4.0), F.lit(3.0))
    return boxes(spark, sf_dir).select("o_orderkey", polygon_area(F.array(rectangle(x, y, w, h), hole)).alias("area"))


# Annotation files' filters and joins


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE regexp_matches(json_extract_string(props, '$.k'), '^(?:[1-4]|9)') AND regexp_matches(event_type, '^(?:p|c)')")
def json_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", nested(F.col("props"), ["k"]))
    return e.where(starts_with_match(F.col("k"), "[1-4]|9") & starts_with_match(F.col("event_type"), "p|c")).select("event_id", "k")


@query("SELECT event_id, json_extract_string(doc, '$.a.b[1]') AS second, json_extract_string(doc, '$.a.x') AS missing FROM (SELECT event_id, '{\"a\": {\"b\": [' || user_id || ', ' || event_id || ']}}' AS doc FROM events)")
def nested_extract(spark, sf_dir):
    doc = F.concat(F.lit('{"a": {"b": ['), F.col("user_id").cast("string"), F.lit(", "), F.col("event_id").cast("string"), F.lit("]}}"))
    e = table(spark, sf_dir, "events").withColumn("doc", doc)
    return e.select("event_id", nested(F.col("doc"), ["a", "b", "1"]).alias("second"), nested(F.col("doc"), ["a", "x"]).alias("missing"))


@query("""
WITH a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS k, s_name AS name FROM supplier),
d AS (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS k, n_name AS name FROM nation)
SELECT a.s_suppkey, a.k, a.name, d.name AS name_def FROM a LEFT JOIN d ON a.k IS NOT DISTINCT FROM d.k""")
def relations_left_join(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("k"), F.col("s_name").alias("name"))
    d = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("k"), F.col("n_name").alias("name"))
    return with_definitions(a, d, "k")


# Masks

GEOMETRY = masks.MaskGeometry.of((120, 160), (12, 12), (3, 3), (8, 8))
MASK_TILES = "SELECT (l_suppkey % 5)::BIGINT AS slide_id, (l_orderkey % 15) * 8 AS y, (l_partkey % 20) * 8 AS x, list_transform(range(0, 9), lambda p: ((l_linenumber + p) % 7)::DOUBLE) AS v FROM lineitem WHERE l_orderkey % 15 < 14 AND l_partkey % 20 < 19"

ALL_TILES = MASK_TILES.partition(" WHERE ")[0]


def mask_tiles(spark: SparkSession, sf_dir: str, edge: bool = False) -> DataFrame:
    """Tiles of the masks; with ``edge`` all rows, with the last row and column of tiles, which reach over the slide."""
    li = table(spark, sf_dir, "lineitem")
    li = li if edge else li.where("l_orderkey % 15 < 14 and l_partkey % 20 < 19")
    v = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda p: ((F.col("l_linenumber") + p) % 7).cast("double"))
    return li.select((F.col("l_suppkey") % 5).alias("slide_id"), (F.col("l_orderkey") % 15 * 8).alias("y"), (F.col("l_partkey") % 20 * 8).alias("x"), v.alias("values"))


def _mask_sql(value: str, low: int = 0, high: int = 3, tiles: str = MASK_TILES) -> str:
    # tile 12, output 3, stride 8: unit gcd(12, 24) = 12, one cell an output pixel, two cells from tile to tile
    return f"""WITH t AS ({tiles}), c AS (SELECT slide_id, (y // 8) * 2 + p // 3 AS y, (x // 8) * 2 + p % 3 AS x, v[p + 1] AS v FROM t, unnest(range(0, 9)) AS o(p)
WHERE p // 3 >= {low} AND p // 3 < {high} AND p % 3 >= {low} AND p % 3 < {high}) SELECT slide_id, 0 AS channel, y::BIGINT AS y, x::BIGINT AS x, {value} AS value, count(*) AS overlap FROM c GROUP BY slide_id, y, x"""


@query(_mask_sql("round(avg(v), 9)"))
def mask_mean(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir), GEOMETRY, by=("slide_id",)).withColumn("value", F.round("value", 9))


@query(_mask_sql("greatest(max(v), 0)"))
def mask_max(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir), GEOMETRY, "max", by=("slide_id",))


@query(_mask_sql("round(avg(v), 9)", 1, 2))
def mask_clip(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir), GEOMETRY, clip=1, by=("slide_id",)).withColumn("value", F.round("value", 9))


@query(_mask_sql("sum(v)"))
def mask_custom_merge(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir), GEOMETRY, lambda v: F.sum(v), by=("slide_id",))


@query(_mask_sql("round(avg(v), 9)", tiles=ALL_TILES))
def mask_mean_edge(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir, True), GEOMETRY, by=("slide_id",)).withColumn("value", F.round("value", 9))


@query(_mask_sql("greatest(max(v), 0)", tiles=ALL_TILES))
def mask_max_edge(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir, True), GEOMETRY, "max", by=("slide_id",))


@query(_mask_sql("round(avg(v), 9)", 1, 2, ALL_TILES))
def mask_clip_edge(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir, True), GEOMETRY, clip=1, by=("slide_id",)).withColumn("value", F.round("value", 9))


@query(_mask_sql("sum(v)", tiles=ALL_TILES))
def mask_custom_merge_edge(spark, sf_dir):
    return masks.assemble(mask_tiles(spark, sf_dir, True), GEOMETRY, lambda v: F.sum(v), by=("slide_id",))


SCALAR = masks.MaskGeometry.of((96, 96), (12, 12), (1, 1), (8, 8))


@query("""WITH t AS (SELECT DISTINCT (l_orderkey % 11) * 8 AS y, (l_partkey % 11) * 8 AS x FROM lineitem), v AS (SELECT y, x, ((y + x) // 8)::DOUBLE AS v FROM t)
SELECT 0 AS channel, ((y // 8) * 2 + i)::BIGINT AS y, ((x // 8) * 2 + j)::BIGINT AS x, round(avg(v), 9) AS value, count(*) AS overlap FROM v, unnest(range(0, 3)) AS a(i), unnest(range(0, 3)) AS b(j) GROUP BY 2, 3""")
def mask_scalar(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 11 * 8).alias("y"), (F.col("l_partkey") % 11 * 8).alias("x")).distinct()
    t = t.withColumn("values", F.array(((F.col("y") + F.col("x")) / 8).cast("double")))
    return masks.assemble(t, SCALAR).withColumn("value", F.round("value", 9))


@query("""
WITH s AS (SELECT p_partkey, 30 + p_size * 7 AS e, 4 + p_size % 9 AS t, 1 + p_size % 4 AS o, 2 + p_partkey % 5 AS st FROM part),
g AS (SELECT *, (ceil(greatest(0, e - t) / st::DOUBLE)::BIGINT) * st + t AS span, gcd(t, st * o) AS g FROM s)
SELECT p_partkey AS slide_id, (span * o // g)::BIGINT AS extent, (t // g)::BIGINT AS upscale, (st * o // g)::BIGINT AS step FROM g""")
def mask_extents(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (30 + F.col("p_size") * 7).alias("e"), (4 + F.col("p_size") % 9).alias("t"), (1 + F.col("p_size") % 4).alias("o"), (2 + F.col("p_partkey") % 5).cast("int").alias("st"))
    sizes = p.select("e", "t", "o", "st").distinct().collect()  # as many as the parameters have values: 50 * 5 at most
    found = []
    for e, t, o, st in sizes:
        g = masks.MaskGeometry.of((e,), (t,), (o,), (st,))
        found.append((e, t, o, st, g.extents[0], g.upscale[0], g.step[0]))
    derived = spark.createDataFrame(found, "e int, t int, o int, st int, extent long, upscale long, step long")
    return p.join(F.broadcast(derived), ["e", "t", "o", "st"]).select(F.col("p_partkey").alias("slide_id"), "extent", "upscale", "step")


# Imaging

PIXELS = "SELECT DISTINCT ON (y, x) (l_orderkey % 40)::BIGINT AS y, (l_partkey % 40)::BIGINT AS x, ((l_orderkey % 40) * 13 + (l_partkey % 40) * 7) % 32 AS v FROM lineitem"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("l_orderkey") % 40, F.col("l_partkey") % 40
    return table(spark, sf_dir, "lineitem").select(y.alias("y"), x.alias("x"), ((y * 13 + x * 7) % 32).cast("int").alias("v")).distinct()


def _morph_sql(steps: list[str], radius: int = 2) -> str:
    out = PIXELS
    for s in steps:
        out = f"SELECT a.y, a.x, {s}(b.v) AS v FROM ({out}) a JOIN ({out}) b ON power(a.y - b.y, 2) + power(a.x - b.x, 2) <= {radius * radius} GROUP BY a.y, a.x"
    return f"SELECT y, x, v::INTEGER AS v FROM ({out})"


@query(_morph_sql(["max"]))
def morph_dilate(spark, sf_dir):
    return imaging.morph(pixels(spark, sf_dir), "v", 2, "dilate")


@query(_morph_sql(["min"]))
def morph_erode(spark, sf_dir):
    return imaging.morph(pixels(spark, sf_dir), "v", 2, "erode")


@query(_morph_sql(["min", "max"], 1))
def morph_open(spark, sf_dir):
    return imaging.opening(pixels(spark, sf_dir), "v", 1)


@query(_morph_sql(["max", "min"], 1))
def morph_close(spark, sf_dir):
    return imaging.closing(pixels(spark, sf_dir), "v", 1)


BRIGHT = "SELECT p_size % 3 AS image, (floor((p_retailprice - 900) / 4)::INTEGER * (1 + p_size % 2)) % 25 AS v FROM part"


@query(f"SELECT image, v, count(*) AS n FROM ({BRIGHT}) GROUP BY image, v")
def histogram(spark, sf_dir):
    return imaging.histogram(_bright(spark, sf_dir), "v", ["image"])


def _bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor((F.col("p_retailprice") - 900) / 4).cast("int") * (1 + F.col("p_size") % 2) % 25
    return table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("image"), v.alias("v"))


@query(f"""
WITH p AS ({BRIGHT}), h AS (SELECT v, sum(n) AS n FROM (SELECT v, count(*) AS n FROM p GROUP BY v UNION ALL SELECT unnest(range(0, 25))::INTEGER, 0) GROUP BY v),
c AS (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE AS w, sum(n * v) OVER (ORDER BY v)::DOUBLE AS m FROM h),
t AS (SELECT max(w) AS w, max(m) AS m FROM c),
k AS (SELECT a.v AS t1, b.v AS t2, d.v AS t3,
  CASE WHEN a.w > 0 THEN a.m * a.m / a.w ELSE 0 END + CASE WHEN b.w > a.w THEN (b.m - a.m) * (b.m - a.m) / (b.w - a.w) ELSE 0 END
  + CASE WHEN d.w > b.w THEN (d.m - b.m) * (d.m - b.m) / (d.w - b.w) ELSE 0 END + CASE WHEN t.w > d.w THEN (t.m - d.m) * (t.m - d.m) / (t.w - d.w) ELSE 0 END AS score
  FROM c a, c b, c d, t WHERE a.v < b.v AND b.v < d.v)
SELECT round(max(score) / (SELECT w FROM t), 6) AS between_groups FROM k""")
def otsu_score(spark, sf_dir):
    """What the thresholds found reach of the criterion: ties between cuts through empty values don't matter."""
    p = _bright(spark, sf_dir).select("v")
    t = imaging.otsu_threshold(p, "v", bins=25)
    group = F.aggregate("thresholds", F.lit(0), lambda s, c: s + (F.col("v") > c).cast("int"))
    parts = p.join(F.broadcast(t)).groupBy(group.alias("g")).agg(F.count("*").alias("w"), F.sum("v").cast("double").alias("m"))
    return parts.agg(F.round(F.sum(F.col("m") * F.col("m") / F.col("w")) / F.sum("w"), 6).alias("between_groups"))


# Stains

RGB = "SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 256)::INTEGER AS r, (l_suppkey * 13 % 256)::INTEGER AS g, (l_orderkey * 29 % 256)::INTEGER AS b FROM lineitem"
DENSE = f"SELECT *, -log10(greatest(r, 1) / 256.0) AS od_r, -log10(greatest(g, 1) / 256.0) AS od_g, -log10(greatest(b, 1) / 256.0) AS od_b FROM ({RGB})"
STAINED = f"SELECT * FROM ({DENSE}) WHERE od_r * od_r + od_g * od_g + od_b * od_b <= 1 AND od_r >= 0.05 AND od_g >= 0.05 AND od_b >= 0.05 AND (od_r + od_g + od_b) / sqrt(3) / sqrt(od_r * od_r + od_g * od_g + od_b * od_b) < cos(0.15)"


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 256).cast("int").alias("r"), (F.col("l_suppkey") * 13 % 256).cast("int").alias("g"), (F.col("l_orderkey") * 29 % 256).cast("int").alias("b"))


@query(f"SELECT l_orderkey, l_linenumber, round(od_r, 9) AS od_r, round(od_g, 9) AS od_g, round(od_b, 9) AS od_b FROM ({STAINED})")
def od_filter(spark, sf_dir):
    out = stain.stained(stain.with_density(rgb(spark, sf_dir)))
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"od_{n}", 9).alias(f"od_{n}") for n in "rgb"])


@query(f"SELECT {', '.join(f'round(covar_samp(od_{a}, od_{b}), 9) AS cov_{a}{b}' for a, b in ('rr', 'rg', 'rb', 'gg', 'gb', 'bb'))}, count(*) AS n FROM ({STAINED})")
def od_covariance(spark, sf_dir):
    out = stain.covariance(stain.stained(stain.with_density(rgb(spark, sf_dir))))
    return out.select(*[F.round(f"cov_{p}", 9).alias(f"cov_{p}") for p in ("rr", "rg", "rb", "gg", "gb", "bb")], "n")


def _separated_sql() -> str:
    import numpy as np

    inverse = np.linalg.inv(np.array(stain.HE))
    logs = [f"ln(greatest({c} / 255.0::DOUBLE, 1e-6)) / {float(np.log(1e-6))!r}" for c in "rgb"]
    stains = [f"round(greatest(0, {' + '.join(f'({logs[i]}) * ({float(inverse[i, k])!r})' for i in range(3))}), 7) AS s{k}" for k in range(3)]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(stains)} FROM ({RGB})"


@query(_separated_sql())
def stain_separate(spark, sf_dir):
    found = stain.separate(*[F.col(c) / 255.0 for c in "rgb"])
    return rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(s, 7).alias(f"s{k}") for k, s in enumerate(found)])


# Splits


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= count(*) OVER () - ceil(count(*) OVER () * 0.3) THEN 'train' ELSE 'test' END AS split FROM documents")
def split_ordered(spark, sf_dir):
    return splits.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", test=0.3, shuffle=False)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) <= ceil(count(*) OVER () * 0.3) THEN 'test' ELSE 'train' END AS split FROM documents")
def split_hash(spark, sf_dir):
    return splits.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", test=0.3, seed=7)


@query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':3'), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT d.doc_id, d.source, CASE WHEN g.r <= ceil(g.n * 0.25) THEN 'test' ELSE 'train' END AS split FROM documents d JOIN g ON d.source IS NOT DISTINCT FROM g.source""")
def split_group(spark, sf_dir):
    return splits.train_test_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", seed=3, groups="source")


@query("""
WITH n AS (SELECT lang, count(*) AS n, ceil(sum(count(*)) OVER () * 0.25) AS t, sum(count(*)) OVER () AS a FROM documents GROUP BY lang),
q AS (SELECT lang, floor(t * n / a::DOUBLE) AS base, t * n / a::DOUBLE - floor(t * n / a::DOUBLE) AS part, t FROM n),
z AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY part DESC, lang) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS test FROM q)
SELECT d.doc_id, d.lang, CASE WHEN row_number() OVER (PARTITION BY d.lang ORDER BY md5(d.doc_id || ':0'), d.doc_id) <= z.test THEN 'test' ELSE 'train' END AS split FROM documents d JOIN z ON d.lang IS NOT DISTINCT FROM z.lang""")
def split_stratified(spark, sf_dir):
    return splits.train_test_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", stratify="lang")


@query("SELECT (SELECT count(*) FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)::BIGINT AS placed, 0::BIGINT AS shared_groups, true AS both_sides")
def split_group_stratified(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", "source", "lang")
    out = splits.train_test_split(docs, "doc_id", groups="source", stratify="lang", test=0.25)
    sides = out.groupBy("source").agg(F.count("split").alias("n"), F.countDistinct("split").alias("sides"), F.max((F.col("split") == "test").cast("int")).alias("t"))
    return sides.agg(F.sum("n").alias("placed"), F.sum((F.col("sides") > 1).cast("long")).alias("shared_groups"), (F.min("t") < F.max("t")).alias("both_sides"))


@query("SELECT doc_id, r AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':1'), doc_id) AS r FROM documents)")
def hash_order(spark, sf_dir):
    return hash_rank(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 1)


@query("SELECT label, n, n::DOUBLE / sum(n) OVER () AS share FROM (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic)")
def class_distribution(spark, sf_dir):
    counts = overlays.value_fractions(table(spark, sf_dir, "labels").withColumn("all", F.lit(0)), ["all"], "toxic")
    return counts.select(F.col("toxic").alias("label"), "n", F.col("fraction").alias("share"))


@query(f"""
WITH s AS ({SLIDES}), g AS ({_grid_sql('ceil')}), t AS (SELECT slide_id, count(*) AS tiles FROM g GROUP BY slide_id)
SELECT s.slide_id, t.tiles, sha256(s.slide_id::VARCHAR) AS id FROM s JOIN t USING (slide_id)""")
def flagship_tiling(spark, sf_dir):
    """Slides, their identities, their tiles, counted: the first stages of a tiling job in one plan."""
    s = slides(spark, sf_dir).withColumn("id", rows.row_hash(["slide_id"]))
    out = grid.grid_tiles(s, ("extent_x", "extent_y"), ("tile", "tile"), ("stride", "stride"))
    return out.groupBy("slide_id", "id").agg(F.count("*").alias("tiles")).select("slide_id", "tiles", "id")
