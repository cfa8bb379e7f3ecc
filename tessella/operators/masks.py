"""Mask assembly: tiles are scattered into the cells of a compressed raster and merged there. Explode and aggregate.

The raster is as coarse as the tiles allow: along each axis cells have the size of the greatest common divisor of the tile's
extent and ``stride * output extent``, in units in which the tile's output has ``output extent`` pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, gcd, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Clip = int | Sequence[int] | Sequence[tuple[int, int]]


@dataclass(frozen=True)
class MaskGeometry:
    """Derived sizes of a mask, one entry an axis (y, x, ...)."""

    source: tuple[int, ...]
    tile: tuple[int, ...]
    output: tuple[int, ...]
    stride: tuple[int, ...]

    @classmethod
    def of(cls, source: Sequence[int], tile: int | Sequence[int], output: int | Sequence[int], stride: int | Sequence[int]) -> MaskGeometry:
        n = len(source)
        wide = lambda v: (v,) * n if isinstance(v, int) else tuple(v)
        out = cls(tuple(source), wide(tile), wide(output), wide(stride))
        if any(len(v) != n for v in (out.tile, out.output, out.stride)):
            raise ValueError(f"tile, output and stride need {n} entries, or one number for all")
        return out

    @property
    def unit(self) -> tuple[int, ...]:
        return tuple(gcd(t, s * o) for t, o, s in zip(self.tile, self.output, self.stride, strict=True))

    @property
    def span(self) -> tuple[int, ...]:
        """Source pixels that a grid covering the source reaches over."""
        return tuple(ceil(max(0, e - t) / s) * s + t for e, t, s in zip(self.source, self.tile, self.stride, strict=True))

    @property
    def extents(self) -> tuple[int, ...]:
        return tuple(p * o // u for p, o, u in zip(self.span, self.output, self.unit, strict=True))

    @property
    def upscale(self) -> tuple[int, ...]:
        return tuple(t // u for t, u in zip(self.tile, self.unit, strict=True))

    @property
    def step(self) -> tuple[int, ...]:
        """Cells between neighbouring tiles."""
        return tuple(s * o // u for s, o, u in zip(self.stride, self.output, self.unit, strict=True))


def clip_pairs(clip: Clip, axes: int) -> list[tuple[int, int]]:
    """(start, end) of each axis from one number, a number an axis, or a pair an axis."""
    if isinstance(clip, int):
        return [(clip, clip)] * axes
    if len(clip) == axes and all(isinstance(c, int) for c in clip):
        return [(c, c) for c in clip]
    if len(clip) == axes and all(not isinstance(c, int) and len(c) == 2 and all(isinstance(v, int) for v in c) for c in clip):
        return [(a, b) for a, b in clip]
    raise ValueError(f"clip must be a number, {axes} numbers or {axes} pairs of numbers")


AXES = ("y", "x", "z", "w")


def scatter(tiles: DataFrame, geometry: MaskGeometry, channels: int = 1, values: str = "values", clip: Clip = 0, by: Sequence[str] = (), origin: Sequence[str] = ("y", "x")) -> DataFrame:
    """``by``, channel, a coordinate an axis, and value of every cell that a tile covers.

    ``values`` holds a number a channel, or channels * output pixels in row-major order. Origins off the grid are floored to
    it. A cell outside the mask raises.
    """
    n = len(geometry.source)
    pairs = clip_pairs(clip, n)
    pixels = prod(geometry.output)
    size = F.size(values)
    dense = F.col(values).cast("array<double>")
    full = F.when(size == channels * pixels, dense).when(size == channels, F.flatten(F.transform(dense, lambda v: F.array_repeat(v, pixels))))
    full = full.otherwise(F.raise_error(F.lit(f"{values} must have {channels} or {channels * pixels} numbers")).cast("array<double>"))
    rows = tiles.select(*by, *[F.col(o).cast("long").alias(f"__t{k}") for k, o in enumerate(origin)], F.posexplode(full).alias("__p", "value"))
    rows = rows.withColumn("channel", F.floor(F.col("__p") / pixels).cast("int"))
    for k in range(n):
        inner = prod(geometry.output[k + 1 :])
        rows = rows.withColumn(f"__o{k}", F.floor(F.col("__p") / inner) % geometry.output[k])
    for k, (a, b) in enumerate(pairs):
        rows = rows.where((F.col(f"__o{k}") >= a) & (F.col(f"__o{k}") < geometry.output[k] - b))
    for k in range(n):
        first = F.floor(F.col(f"__t{k}") / geometry.stride[k]) * geometry.step[k] + F.col(f"__o{k}") * geometry.upscale[k]
        if geometry.upscale[k] > 1:
            rows = rows.withColumn(AXES[k], F.explode(F.sequence(first, first + geometry.upscale[k] - 1)))
        else:
            rows = rows.withColumn(AXES[k], first)
        at = F.col(AXES[k])
        rows = rows.withColumn(AXES[k], F.when((at >= 0) & (at < geometry.extents[k]), at).otherwise(F.raise_error(F.lit("a tile reaches over the mask's edge")).cast("long")))
    return rows.select(*by, "channel", *AXES[:n], "value")


def assemble(tiles: DataFrame, geometry: MaskGeometry, merge: str | Callable[[Column], Column] = "mean", **how) -> DataFrame:
    """Covered cells with their merged ``value`` and the number of tiles, ``overlap``.

    ``merge``: mean; max, which is 0 at least as masks start from 0; or any aggregate of the value column.
    """
    cells = scatter(tiles, geometry, **how)
    keys = [c for c in cells.columns if c != "value"]
    if callable(merge):
        value = merge(F.col("value"))
    elif merge == "mean":
        value = F.avg("value")
    elif merge == "max":
        value = F.greatest(F.max("value"), F.lit(0.0))
    else:
        raise ValueError("merge must be mean, max or a function that aggregates a column")
    return cells.groupBy(*keys).agg(value.alias("value"), F.count("*").alias("overlap"))


def densify(cells: DataFrame, geometry: MaskGeometry, channels: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """All cells of each mask, 0 where no tile lies."""
    n = len(geometry.source)
    grid = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    grid = grid.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    for k in range(n):
        grid = grid.withColumn(AXES[k], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(geometry.extents[k] - 1).cast("long"))))
    keys = [*by, "channel", *AXES[:n]]
    return grid.join(cells, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def at_source(pixels: DataFrame, cells: DataFrame, geometry: MaskGeometry, by: Sequence[str] = (), y: str = "source_y", x: str = "source_x") -> DataFrame:
    """``pixels`` (by, y, x in source coordinates) with the value of the cell that each falls into, the nearest-neighbour resize."""
    cell = lambda c, k: F.floor(F.col(c) * geometry.extents[k] / geometry.source[k])
    placed = pixels.withColumn("__y", cell(y, 0)).withColumn("__x", cell(x, 1))
    found = cells.withColumnRenamed("y", "__y").withColumnRenamed("x", "__x")
    return placed.join(found, [*by, "__y", "__x"], "left").drop("__y", "__x").fillna({"value": 0.0})
