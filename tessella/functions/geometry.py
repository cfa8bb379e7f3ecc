"""Polygons as columns: rings are arrays of struct (x, y), a polygon is an array of rings, the outer one first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = "array<struct<x:double,y:double>>"
RINGS = f"array<{RING}>"
GEOMETRY = f"struct<type:string,rings:{RINGS}>"
# as objects, which need no session when a function is declared
RING_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def rectangle(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Closed ring of a box."""
    return F.array(point(x, y), point(x + width, y), point(x + width, y + height), point(x, y + height), point(x, y))


def close_ring(ring: Column) -> Column:
    """The ring with its first point at its end."""
    last = F.get(ring, F.size(ring) - 1)
    return F.when((F.size(ring) == 0) | (F.get(ring, F.lit(0)) == last), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def ring_area(ring: Column) -> Column:
    """Absolute area by the shoelace formula; the ring may be open or closed."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) > 2, F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, c: s + c)) / 2).otherwise(0.0)


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less that of the holes."""
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring_area(r))
    return F.when(F.size(rings) > 0, ring_area(F.get(rings, F.lit(0))) - holes).otherwise(0.0)


def shift(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def scaled(ring: Column, factor: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))


def bounds(rings: Column) -> Column:
    """Struct x0, y0, x1, y1 around all rings."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


# Areas of unions, for general polygons: vertical slabs between all vertices and crossings hold no vertex inside, so edges
# cross a slab as straight lines in a fixed order, and the covered height is read off at its middle.


def _edges(rings) -> np.ndarray:
    """Rows x0, y0, x1, y1 with x0 < x1; vertical edges bound no slab from above or below."""
    out = []
    for ring in rings:
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        if len(p) < 3:
            continue
        q = np.roll(p, -1, axis=0)
        e = np.concatenate([p, q], axis=1)
        e = e[p[:, 0] != q[:, 0]]
        flip = e[:, 0] > e[:, 2]
        e[flip] = e[flip][:, [2, 3, 0, 1]]
        out.append(e)
    return np.concatenate(out) if out else np.empty((0, 4))


def _crossings(e: np.ndarray) -> np.ndarray:
    """x of all points where two edges cross."""
    if len(e) < 2:
        return np.empty(0)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    rise = e[:, 1] - slope * e[:, 0]
    a, b = np.triu_indices(len(e), 1)
    differ = slope[a] != slope[b]
    a, b = a[differ], b[differ]
    x = (rise[b] - rise[a]) / (slope[a] - slope[b])
    return x[(x > np.maximum(e[a, 0], e[b, 0])) & (x < np.minimum(e[a, 2], e[b, 2]))]


def _odd(x: np.ndarray, y: float) -> np.ndarray:
    """Horizontal edges at ``y`` over the parts that an odd number of the intervals with these ends covers."""
    ends, times = np.unique(x, return_counts=True)
    ends = ends[times % 2 == 1].reshape(-1, 2)
    return np.stack([ends[:, 0], np.full(len(ends), y), ends[:, 1], np.full(len(ends), y)], axis=1)


def _clipped(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Edges that bound the same area within a box.

    What lies left or right of the box is left out. Of what lies above or below it only the parity counts, so that it becomes
    a few edges on the box's border, however many vertices it has.
    """
    e = e[(e[:, 2] > x0) & (e[:, 0] < x1)]
    if not len(e) or ((e[:, [0]] >= x0).all() and (e[:, 2] <= x1).all() and (e[:, [1, 3]] >= y0).all() and (e[:, [1, 3]] <= y1).all()):
        return e
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    at = lambda x: np.where(x == e[:, 0], e[:, 1], np.where(x == e[:, 2], e[:, 3], e[:, 1] + (x - e[:, 0]) * slope))
    left, right = np.maximum(e[:, 0], x0), np.minimum(e[:, 2], x1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cuts = [np.where(slope != 0, e[:, 0] + (y - e[:, 1]) / slope, left) for y in (y0, y1)]
    cuts = np.sort(np.stack([np.clip(np.nan_to_num(c, nan=0.0), left, right) for c in cuts]), axis=0)
    inside, above, below = [], [], []
    for a, b in ((left, cuts[0]), (cuts[0], cuts[1]), (cuts[1], right)):
        some = b > a
        low, high = at(a), at(b)
        middle = (low + high) / 2
        within = some & (middle > y0) & (middle < y1)
        inside.append(np.stack([a, np.clip(low, y0, y1), b, np.clip(high, y0, y1)], axis=1)[within])
        above += [a[some & (middle >= y1)], b[some & (middle >= y1)]]
        below += [a[some & (middle <= y0)], b[some & (middle <= y0)]]
    return np.concatenate([*inside, _odd(np.concatenate(above), y1), _odd(np.concatenate(below), y0)])


def slabs(polygons: list, roi) -> tuple[float, list[list[tuple[float, float]]]]:
    """Area and trapezoids of the union of ``polygons`` (lists of rings) within the ring ``roi``."""
    frame = _edges([roi])
    if not len(frame):
        return 0.0, []
    box = frame[:, 0].min(), frame[:, [1, 3]].min(), frame[:, 2].max(), frame[:, [1, 3]].max()
    shapes = [_clipped(_edges(p), *box) for p in polygons]
    shapes = [s for s in shapes if len(s)]
    if not shapes:
        return 0.0, []
    every = np.concatenate([*shapes, frame])
    xs = np.unique(np.concatenate([every[:, 0], every[:, 2], _crossings(every)]))
    xs = xs[(xs >= frame[:, 0].min()) & (xs <= frame[:, 2].max())]
    area, pieces = 0.0, []

    def spans(e: np.ndarray, left: float, right: float) -> list[tuple[float, float, float, float, float]]:
        middle = (left + right) / 2
        e = e[(e[:, 0] <= left) & (e[:, 2] >= right)]
        at = lambda x: e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        rows = sorted(zip(at(middle), at(left), at(right), strict=True))
        return [(low[0], high[0], low, high) for low, high in zip(rows[::2], rows[1::2], strict=False)]

    for left, right in zip(xs[:-1], xs[1:], strict=True):
        covered = sorted((s for e in shapes for s in spans(e, left, right)), key=lambda s: s[:2])
        merged: list = []
        for low_at, high_at, low, high in covered:
            if merged and low_at <= merged[-1][1]:
                if high_at > merged[-1][1]:
                    merged[-1][1], merged[-1][3] = high_at, high
            else:
                merged.append([low_at, high_at, low, high])
        for low_at, high_at, low, high in merged:
            for frame_low_at, frame_high_at, frame_low, frame_high in spans(frame, left, right):
                bottom = low if low_at >= frame_low_at else frame_low
                top = high if high_at <= frame_high_at else frame_high
                if top[0] > bottom[0]:
                    area += (top[0] - bottom[0]) * (right - left)
                    pieces.append([(left, bottom[1]), (right, bottom[2]), (right, top[2]), (left, top[1])])
    return float(area), pieces


@F.arrow_udf(T.DoubleType())
def union_area(polygons: pa.Array, roi: pa.Array) -> pa.Array:
    """Area of the union of an array of polygons within a ring; a null array counts as empty."""
    return pa.array([slabs(p or [], r or [])[0] for p, r in zip(polygons.to_pylist(), roi.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.ArrayType(RING_TYPE))
def union_pieces(polygons: pa.Array, roi: pa.Array) -> pa.Array:
    """The union within a ring as trapezoids that do not overlap."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    rows = [[[{"x": x, "y": y} for x, y in piece] for piece in slabs(p or [], r or [])[1]] for p, r in zip(polygons.to_pylist(), roi.to_pylist(), strict=True)]
    return pa.array(rows, kind)
