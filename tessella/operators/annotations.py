"""Vector annotations on tiles: a spatial join over grid bins, and covered areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import bounds, polygon_area, rectangle, scaled, shift, union_area, union_pieces


def _bins(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def box_join(left: DataFrame, right: DataFrame, on: Sequence[str], size: float, left_box: str = "box", right_box: str = "box") -> DataFrame:
    """Pairs of rows with equal ``on`` whose boxes (structs x0, y0, x1, y1) touch or overlap, each pair once.

    Both sides are dealt into square bins of ``size`` and joined on the bin. A pair that shares several bins counts only in the
    one that holds the lower corner of the common part, so no distinct is needed. Columns of the right side get the suffix
    ``_r`` where names clash.
    """
    names = {c: f"{c}_r" for c in right.columns if c in left.columns and c not in on}
    box = names.get(right_box, right_box)
    r = right.select(*[F.col(c).alias(names.get(c, f"__{c}" if c in on else c)) for c in right.columns])
    a = left.withColumn("__bx", _bins(F.col(left_box)["x0"], F.col(left_box)["x1"], size)).withColumn("__by", _bins(F.col(left_box)["y0"], F.col(left_box)["y1"], size))
    b = r.withColumn("__cx", _bins(F.col(box)["x0"], F.col(box)["x1"], size)).withColumn("__cy", _bins(F.col(box)["y0"], F.col(box)["y1"], size))
    keys = (F.col("__bx") == F.col("__cx")) & (F.col("__by") == F.col("__cy"))
    for c in on:
        keys = keys & (F.col(c) == F.col(f"__{c}"))
    p, q = F.col(left_box), F.col(box)
    meets = (p["x0"] <= q["x1"]) & (q["x0"] <= p["x1"]) & (p["y0"] <= q["y1"]) & (q["y0"] <= p["y1"])
    once = (F.floor(F.greatest(p["x0"], q["x0"]) / size) == F.col("__bx")) & (F.floor(F.greatest(p["y0"], q["y0"]) / size) == F.col("__by"))
    return a.join(b, keys & meets & once).drop("__bx", "__by", "__cx", "__cy", *[f"__{c}" for c in on])


def tile_annotations(tiles: DataFrame, annotations: DataFrame, roi: Column, downsample: Column, on: Sequence[str] = ("slide_id",), x: str = "tile_x", y: str = "tile_y", size: float = 4096.0, frame: str = "slide", pieces: bool = False) -> DataFrame:
    """``tiles`` with ``covered_area`` and ``roi_area`` in level pixels, and ``pieces`` of the covered part on demand.

    ``roi`` is a ring in tile pixels, ``annotations`` (on, rings) are in level-0 pixels. The union of all polygons that touch a
    tile's ROI is clipped to it. Tiles without annotation have area 0. Pieces are in the slide's level pixels, or with
    ``frame="tile"`` relative to the tile. Only the polygons at one tile are gathered, with an id made from the tile's columns.
    """
    if frame not in ("slide", "tile"):
        raise ValueError("frame must be slide or tile")
    at = tiles.withColumn("__d", downsample.cast("double")).withColumn("__roi", shift(scaled(roi, F.col("__d")), F.col(x) * F.col("__d"), F.col(y) * F.col("__d")))
    at = at.withColumn("__box", bounds(F.array("__roi"))).withColumn("__id", F.xxhash64(*on, x, y))
    shapes = annotations.select(*on, F.col("rings").alias("__rings"), bounds(F.col("rings")).alias("__abox"))
    pairs = box_join(at.select(*on, "__id", "__box"), shapes, on, size, "__box", "__abox")
    found = pairs.groupBy(F.col("__id").alias("__of")).agg(F.collect_list("__rings").alias("__polygons"))
    out = at.join(found, F.col("__id") == F.col("__of"), "left")
    squared = F.col("__d") * F.col("__d")
    out = out.withColumn("covered_area", F.when(F.col("__polygons").isNull(), 0.0).otherwise(union_area("__polygons", "__roi") / squared))
    out = out.withColumn("roi_area", polygon_area(F.array("__roi")) / squared)
    if pieces:
        level = F.transform(union_pieces("__polygons", "__roi"), lambda r: scaled(r, 1 / F.col("__d")))
        out = out.withColumn("pieces", level if frame == "slide" else F.transform(level, lambda r: shift(r, -F.col(x), -F.col(y))))
    return out.drop("__d", "__roi", "__box", "__id", "__of", "__polygons")


def rectangle_overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def full_tile(width: Column, height: Column) -> Column:
    """The ring of a whole tile."""
    return rectangle(F.lit(0.0), F.lit(0.0), width, height)
