"""Images as pixel tables (keys, y, x, ...): colour to gray and saturation, histograms, multi-Otsu, morphology, tissue masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of linear red, green and blue in luminance (Rec. 709), and the disc's size in microns per (micron per pixel).
REC709 = (0.2126, 0.7152, 0.0722)
DISC_FACTOR = 10
CLASSES = 4


def linear(channel: Column) -> Column:
    """sRGB value of 0 to 255 as linear light of 0 to 1."""
    v = channel / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance as an sRGB-encoded gray of 0 to 255."""
    light = linear(r) * REC709[0] + linear(g) * REC709[1] + linear(b) * REC709[2]
    encoded = F.when(light <= 0.0031308, light * 12.92).otherwise(1.055 * F.pow(light, F.lit(1 / 2.4)) - 0.055)
    return F.least(F.greatest(F.bround(encoded * 255.0, 0), F.lit(0.0)), F.lit(255.0)).cast("int")


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation of HSV, 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, F.floor((top - low) * 255.0 / top)).otherwise(0).cast("int")


def histogram(pixels: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return pixels.groupBy(*by, value).agg(F.count("*").alias("n"))


def multi_otsu(counts: np.ndarray, classes: int = CLASSES) -> list[int]:
    """Thresholds between ``classes`` groups of the values 0 .. len(counts) - 1 with the greatest variance between groups.

    A threshold is the last value of its group. Fewer distinct values than classes raise. A table of the terms of all intervals is
    filled once, and every choice of cuts is a sum of its entries.
    """
    used = np.flatnonzero(counts)
    if len(used) < classes:
        raise ValueError(f"{len(used)} distinct values cannot be parted into {classes} classes")
    p = np.asarray(counts, float) / np.sum(counts)
    mass = np.concatenate([[0], np.cumsum(p)])
    first = np.concatenate([[0], np.cumsum(p * np.arange(len(p)))])
    w, m = mass[None, 1:] - mass[:-1, None], first[None, 1:] - first[:-1, None]  # [from, to]
    with np.errstate(divide="ignore", invalid="ignore"):
        term = np.where(w > 0, m * m / w, 0.0)
    n = len(p)
    # best[k][j]: greatest sum of k + 1 groups over the values 0 .. j; the first of equal cuts is kept
    best, cuts = [term[0].copy()], []
    for _ in range(1, classes):
        total = best[-1][:, None] + np.vstack([term[1:], np.full((1, n), -np.inf)])
        total = np.where(np.arange(n)[:, None] < np.arange(n)[None, :], total, -np.inf)
        cuts.append(total.argmax(axis=0))
        best.append(total.max(axis=0))
    out, j = [], n - 1
    for cut in reversed(cuts):
        j = int(cut[j])
        out.append(j)
    return out[::-1]


def otsu_threshold(pixels: DataFrame, value: str, by: Sequence[str] = (), bins: int = 256, classes: int = CLASSES) -> DataFrame:
    """``by`` and ``thresholds`` of each image. Only histograms, of ``bins`` numbers each, leave the aggregate; images are apart."""
    counts = histogram(pixels.where(F.col(value).isNotNull()), value, by).withColumn("v", F.col(value).cast("int"))

    def search(pairs: np.ndarray) -> list[int]:
        full = np.zeros(bins, np.int64)
        for v, n in pairs:
            full[v] += n
        return multi_otsu(full, classes)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def thresholds(found):
        import pyarrow as pa

        return pa.array([search([(e["v"], e["n"]) for e in row]) for row in found.to_pylist()], pa.list_(pa.int32()))

    packed = counts.groupBy(*by).agg(F.collect_list(F.struct("v", "n")).alias("h"))
    return packed.select(*by, thresholds("h").alias("thresholds"))


def foreground(pixels: DataFrame, value: str, by: Sequence[str] = (), bins: int = 256, name: str = "mask") -> DataFrame:
    """``pixels`` with ``name``: 255 below the third of three thresholds, 0 from there on."""
    found = otsu_threshold(pixels, value, by, bins).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("thresholds")[2].alias("__t"))
    keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    joined = pixels.join(F.broadcast(found), keys if keys else F.lit(True)) if not by else pixels.join(found, keys)
    return joined.withColumn(name, F.when(F.col(value) < F.col("__t"), 255).otherwise(0)).drop("__t", *[f"__{c}" for c in by])


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets within a radius."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def disc_radius(mpp: Sequence[float], factor: float = DISC_FACTOR) -> int:
    return round(factor / (sum(mpp) / len(mpp)))


def _runs(radius: int) -> dict[int, int]:
    """Half width of the disc in each row."""
    return {dy: max(dx for y, dx in disc(radius) if y == dy) for dy in range(-radius, radius + 1)}


def morph(pixels: DataFrame, value: str, radius: int, how: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, value): the greatest (dilate) or least (erode) value within the disc around each pixel.

    Only pixels that exist count, which repeats the border. A disc is a stack of row segments: each pixel goes once to every row
    that the disc reaches, and there a window of the segment's width finds the extreme at each pixel of that row. So a pixel is
    written twice for each row of the disc, not once for each of its pixels.
    """
    if how not in ("dilate", "erode"):
        raise ValueError("how must be dilate or erode")
    merge = F.max if how == "dilate" else F.min
    widths = _runs(radius)
    places = pixels.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).alias("v"))
    rows = places.withColumn("dy", F.explode(F.array(*[F.lit(d) for d in widths])))
    given = rows.select(*by, (F.col("y") + F.col("dy")).alias("y"), "x", "dy", "v", F.lit(False).alias("asks"))
    asked = rows.select(*by, "y", "x", "dy", F.lit(None).cast(places.schema["v"].dataType).alias("v"), F.lit(True).alias("asks"))
    along = Window.partitionBy(*by, "y", "dy").orderBy("x")
    found = F.lit(None)
    for w in sorted(set(widths.values())):
        mine = F.abs("dy").isin([abs(d) for d, width in widths.items() if width == w])
        found = F.when(mine, merge("v").over(along.rangeBetween(-w, w))).otherwise(found)
    out = given.unionByName(asked).withColumn("found", found).where("asks")
    return out.groupBy(*by, "y", "x").agg(merge("found").alias(value))


def opening(pixels: DataFrame, value: str, radius: int, by: Sequence[str] = ()) -> DataFrame:
    return morph(morph(pixels, value, radius, "erode", by), value, radius, "dilate", by)


def closing(pixels: DataFrame, value: str, radius: int, by: Sequence[str] = ()) -> DataFrame:
    return morph(morph(pixels, value, radius, "dilate", by), value, radius, "erode", by)


Step = Callable[[DataFrame, tuple[float, float]], DataFrame]


def compose(steps: Sequence[Step]) -> Step:
    """Applies steps in turn, each to (image, mpp)."""

    def run(pixels: DataFrame, mpp: tuple[float, float]) -> DataFrame:
        for step in steps:
            pixels = step(pixels, mpp)
        return pixels

    return run


def tissue_mask(pixels: DataFrame, mpp: tuple[float, float], by: Sequence[str] = (), steps: Sequence[Step] | None = None) -> DataFrame:
    """(by, y, x, mask) of pixels (by, y, x, r, g, b): gray, foreground, closing, opening, unless other ``steps`` are given."""
    keys = list(by)
    if steps is None:
        steps = (
            lambda p, _: p.select(*keys, "y", "x", gray(F.col("r"), F.col("g"), F.col("b")).alias("gray")),
            lambda p, _: foreground(p, "gray", keys).select(*keys, "y", "x", "mask"),
            lambda p, m: closing(p, "mask", disc_radius(m), keys),
            lambda p, m: opening(p, "mask", disc_radius(m), keys),
        )
    return compose(steps)(pixels, mpp)


def exhaustive_otsu(counts: np.ndarray, classes: int) -> list[int]:
    """The same thresholds by trying all cuts; for tests on short histograms."""
    p = np.asarray(counts, float) / np.sum(counts)
    values = np.arange(len(p))

    def score(cuts: tuple[int, ...]) -> float:
        edges = [0, *[c + 1 for c in cuts], len(p)]
        parts = [(p[a:b].sum(), (p * values)[a:b].sum()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return sum(m * m / w for w, m in parts if w > 0)

    return list(max(combinations(range(len(p) - 1), classes - 1), key=score))
