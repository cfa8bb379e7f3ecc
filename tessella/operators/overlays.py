"""Overlays: scaling tile windows to the overlay's level, and value fractions of tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scale(value: Column, ratio: Column) -> Column:
    """``value * ratio`` rounded half to even, 0 at least."""
    return F.greatest(F.lit(0).cast("long"), F.bround(value * ratio, 0).cast("long"))


def scale_window(x: Column, y: Column, width: Column, height: Column, mpp_x: Column, mpp_y: Column, overlay_mpp_x: Column, overlay_mpp_y: Column) -> Column:
    """Struct of x, y, width and height in the overlay's pixels."""
    rx, ry = mpp_x / overlay_mpp_x, mpp_y / overlay_mpp_y
    return F.struct(scale(x, rx).alias("x"), scale(y, ry).alias("y"), scale(width, rx).alias("width"), scale(height, ry).alias("height"))


def inside_convex(x: Column, y: Column, roi: Sequence[tuple[float, float]]) -> Column:
    """Whether a pixel's centre lies inside a polygon given by its corners (even-odd rule over its edges)."""
    cx, cy = x + 0.5, y + 0.5
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(roi, [*roi[1:], roi[0]], strict=True):
        if y0 == y1:
            continue
        at = F.lit(float(x0)) + (cy - float(y0)) * ((x1 - x0) / (y1 - y0))
        crossings = crossings + ((cy >= min(y0, y1)) & (cy < max(y0, y1)) & (cx < at)).cast("int")
    return crossings % 2 == 1


def value_fractions(pixels: DataFrame, tile: Sequence[str], value: str, masked: Column | None = None) -> DataFrame:
    """(tile, value, n, fraction) of the pixels of each tile that are not ``masked``."""
    if masked is not None:
        pixels = pixels.where(~masked)
    counts = pixels.groupBy(*tile, value).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*tile)))


def fraction_map(fractions: DataFrame, tile: Sequence[str], value: str) -> DataFrame:
    """(tile, overlap): a map from the value as text to its fraction. Tiles without pixels have no row."""
    return fractions.groupBy(*tile).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value).cast("string"), "fraction")))).alias("overlap"))


def covered(overlap: Column, value: str, least: float) -> Column:
    """Whether ``value`` covers at least that share, missing values counting as 0."""
    return F.coalesce(F.try_element_at(overlap, F.lit(value)), F.lit(0.0)) >= least


def tile_std(tile: Column) -> Column:
    """Population standard deviation of all numbers of a tile, in one pass over the array."""
    mean = F.aggregate(tile, F.lit(0.0), lambda s, v: s + v) / F.size(tile)
    total = F.aggregate(tile, F.lit(0.0), lambda s, v: s + v)
    squares = F.aggregate(tile, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return F.when(F.size(tile) > 0, F.sqrt(F.greatest(squares / F.size(tile) - (total / F.size(tile)) * mean, F.lit(0.0))))
