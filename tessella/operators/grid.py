"""Tile grids: every slide row becomes a row for each of its tiles. Generators over sequences, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = ("shift", "drop", "keep")


def tiles_along(extent: Column, tile: Column, stride: Column, last: str = "keep") -> Column:
    """Number of tiles along one axis; none where the tile is so much larger that no step fits."""
    if last not in LAST:
        raise ValueError(f"last must be one of {', '.join(LAST)}, not {last!r}")
    steps = (extent - tile) / stride
    steps = F.floor(steps) if last == "drop" else F.ceil(steps)
    return F.greatest(steps.cast("long") + 1, F.lit(0).cast("long"))


def _places(extent: Column, tile: Column, stride: Column, last: str) -> Column:
    n = tiles_along(extent, tile, stride, last)
    at = lambda i: F.least(i * stride, extent - tile) if last == "shift" else i * stride
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), at)
    return F.when(n > 0, places).otherwise(F.array().cast("array<bigint>"))


def grid_tiles(slides: DataFrame, extents: Sequence[str] = ("extent_x", "extent_y"), tiles: Sequence[str] = ("tile_extent_x", "tile_extent_y"), strides: Sequence[str] = ("stride_x", "stride_y"), last: str = "keep", names: Sequence[str] = ("tile_x", "tile_y")) -> DataFrame:
    """All columns of ``slides`` and the origin of a tile in ``names``; x runs fastest within a slide.

    ``last`` treats tiles that reach over the far edge: keep them, drop them, or shift them back by as much as needed
    (below zero where the slide is smaller than the tile). Any number of axes. Slides with a null extent have no tiles.
    """
    if not len(extents) == len(tiles) == len(strides) == len(names):
        raise ValueError("one extent, tile, stride and name is needed for each axis")
    out = slides
    for e, t, s, n in reversed(list(zip(extents, tiles, strides, names, strict=True))):
        out = out.withColumn(n, F.explode(_places(F.col(e).cast("long"), F.col(t).cast("long"), F.col(s).cast("long"), last)))
    return out.select(*slides.columns, *names)


def tiles_per_slide(extents: Sequence[Column], tiles: Sequence[Column], strides: Sequence[Column], last: str = "keep") -> Column:
    """How many tiles ``grid_tiles`` would make, without making them."""
    out = F.lit(1).cast("long")
    for e, t, s in zip(extents, tiles, strides, strict=True):
        out = out * tiles_along(e, t, s, last)
    return out
