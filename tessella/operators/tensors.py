"""Mean and standard deviation of tensor columns along chosen axes. One partial aggregate, no Python.

A tensor is a row-major array; axis 0 counts the rows and axis k the tensor's own dimension k. Reduced axes are folded into
the address of an output cell, (cell, value) pairs are aggregated, and cells are packed back into an array.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Axis = int | Sequence[int] | None


def kept_axes(shape: Sequence[int], axis: Axis) -> list[int]:
    """Dimensions (from 1) that the result keeps. ``None`` reduces all; a tuple must name axis 0."""
    if axis is None:
        return []
    if isinstance(axis, int):
        axis = (0, axis)
    elif 0 not in axis:
        raise ValueError("axis must include 0, the axis of the rows")
    reduced = set(axis)
    if bad := [a for a in reduced if not 0 <= a <= len(shape)]:
        raise ValueError(f"axis {bad[0]} is out of range for {len(shape)} dimensions")
    return [k for k in range(1, len(shape) + 1) if k not in reduced]


def cell_of(position: Column, shape: Sequence[int], kept: Sequence[int]) -> Column:
    """Row-major address over the kept dimensions of a flat position."""
    out = F.lit(0)
    for k in kept:
        inner = prod(shape[k:])
        out = out * shape[k - 1] + F.floor(position / inner) % shape[k - 1]
    return out.cast("int")


def tensor_stats(rows: DataFrame, on: str, shape: Sequence[int], axis: Axis = None, ddof: float = 1.0, ignore_nulls: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``by``, cell, n, mean and std of every output cell, in long form.

    n counts elements. std is NaN where ``n - ddof`` is not positive. A null tensor is skipped, or raises with
    ``ignore_nulls=False``; one of another size than ``shape`` raises.
    """
    kept = kept_axes(shape, axis)
    column = F.col(on)
    if ignore_nulls:
        rows = rows.where(column.isNotNull())
    else:
        column = F.coalesce(column, F.raise_error(F.lit(f"column {on} contains null values")).cast("array<double>"))
    size = prod(shape)
    checked = F.when(F.size(column) == size, column).otherwise(F.raise_error(F.lit(f"a tensor in {on} does not have the shape {tuple(shape)}")).cast("array<double>"))
    cells = rows.select(*by, F.posexplode(checked.cast("array<double>")).alias("__p", "__v"))
    cells = cells.select(*by, cell_of(F.col("__p"), shape, kept).alias("cell"), "__v")
    grouped = cells.groupBy(*by, "cell").agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.var_pop("__v").alias("__var"))
    free = F.col("n") - F.lit(float(ddof))
    std = F.when(free > 0, F.sqrt(F.greatest(F.col("__var") * F.col("n") / free, F.lit(0.0)))).otherwise(F.lit(float("nan")))
    return grouped.select(*by, "cell", "n", F.coalesce("mean", F.lit(float("nan"))).alias("mean"), std.alias("std"))


def tensor_aggregate(rows: DataFrame, on: str, shape: Sequence[int], axis: Axis = None, ddof: float = 1.0, ignore_nulls: bool = True, by: Sequence[str] = (), mean: str | None = None, std: str | None = None) -> DataFrame:
    """``by`` and the packed results: arrays over the kept dimensions, numbers if none is kept.

    Columns are named ``mean(<on>)`` and ``std(<on>)`` unless other names are given. Without rows and without ``by`` the
    result is one row of NaN.
    """
    kept = kept_axes(shape, axis)
    cells = prod(shape[k - 1] for k in kept)
    stats = tensor_stats(rows, on, shape, axis, ddof, ignore_nulls, by)
    packed = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cell", "mean", "std"))).alias("__c"))  # as many as the result has
    out = []
    for name, field in ((mean or f"mean({on})", "mean"), (std or f"std({on})", "std")):
        values = F.col(f"__c.{field}")
        if not kept:
            out.append(F.coalesce(F.get(values, F.lit(0)), F.lit(float("nan"))).alias(name))
        else:
            out.append(F.when(F.size("__c") > 0, values).otherwise(F.array_repeat(F.lit(float("nan")), cells)).alias(name))
    return packed.select(*by, *out)
