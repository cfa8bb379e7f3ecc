"""Pyramid levels: resolutions, and the level nearest to a wanted resolution. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels per unit to microns per pixel: microns in an inch, a centimetre, a millimetre. TIFF's unit codes 2 to 4.
MICRONS = {2: 25400.0, 3: 10000.0, 4: 1000.0}


def _first_least(distances: Column) -> Column:
    """Position, from 0, of the least entry; of equal ones the first."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def closest_level_by_downsample(downsamples: Column, base_x: Column, base_y: Column, mpp_x: Column, mpp_y: Column | None = None) -> Column:
    """Level whose downsample is nearest to the mean of the ratios of wanted to base resolution."""
    mpp_y = mpp_x if mpp_y is None else mpp_y
    wanted = (mpp_x / base_x + mpp_y / base_y) / 2
    return _first_least(F.transform(downsamples, lambda d: F.abs(d - wanted)))


def closest_level_by_resolution(levels: Column, mpp_x: Column, mpp_y: Column | None = None) -> Column:
    """Level whose resolution, struct (x, y) in ``levels``, has the least mean distance to the wanted one."""
    mpp_y = mpp_x if mpp_y is None else mpp_y
    return _first_least(F.transform(levels, lambda r: (F.abs(r["x"] - mpp_x) + F.abs(r["y"] - mpp_y)) / 2))


def level_resolution(base_x: Column, base_y: Column, downsample: Column) -> Column:
    return F.struct((base_x * downsample).alias("x"), (base_y * downsample).alias("y"))


def tiff_resolution(numerator: Column, denominator: Column, unit: Column, strict: bool = False) -> Column:
    """Microns per pixel from a TIFF rational and its unit code.

    Code 5 (microns) gives the value itself; with ``strict`` its inverse, which is what the tag says. Others raise.
    """
    value = numerator / denominator
    out = F.when(unit == 5, 1 / value if strict else value)
    for code, microns in MICRONS.items():
        out = out.when(unit == code, F.lit(microns) / value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported resolution unit: "), F.coalesce(unit.cast("string"), F.lit("none")))).cast("double"))
