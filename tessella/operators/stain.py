"""Stains: optical density, Macenko's estimate of stain vectors, separation, combination and augmentation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import cos, pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit-like stain vectors over red, green and blue (fixed values).
HEMATOXYLIN = (0.65, 0.70, 0.29)
EOSIN = (0.2159, 0.8012, 0.5581)
DAB = (0.27, 0.57, 0.78)
#: Least intensity in separation.
FLOOR = 1e-6
GRAY = cos(0.15)
#: Bins of half a turn in which angles are counted.
ANGLES = 1 << 16


def residual(a: Sequence[float], b: Sequence[float]) -> tuple[float, ...]:
    """The unit vector across two stains."""
    out = np.cross(a, b)
    return tuple(float(v) for v in out / np.linalg.norm(out))


HE = (HEMATOXYLIN, EOSIN, residual(HEMATOXYLIN, EOSIN))
HDAB = (HEMATOXYLIN, DAB, residual(HEMATOXYLIN, DAB))


def optical_density(channel: Column, i0: float = 256.0) -> Column:
    return -F.log10(F.greatest(channel.cast("double"), F.lit(1.0)) / i0)


def with_density(pixels: DataFrame, channels: Sequence[str] = ("r", "g", "b"), i0: float = 256.0) -> DataFrame:
    """Adds od_r, od_g and od_b."""
    return pixels.withColumns({f"od_{n}": optical_density(F.col(c), i0) for n, c in zip("rgb", channels, strict=True)})


def stained(pixels: DataFrame, least: float = 0.05, most: float = 1.0, gray: float = GRAY) -> DataFrame:
    """Pixels with densities that are neither faint, nor dark, nor gray. The cheap tests come before the root."""
    r, g, b = (F.col(f"od_{n}") for n in "rgb")
    square = r * r + g * g + b * b
    kept = pixels.where((square <= most * most) & (r >= least) & (g >= least) & (b >= least) & (square > 0))
    return kept.where((r + g + b) * (1 / 3**0.5) / F.sqrt(square) < gray)


def covariance(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The six sample covariances of the densities in one aggregate."""
    pairs = [(a, b) for i, a in enumerate("rgb") for b in "rgb"[i:]]
    return pixels.groupBy(*by).agg(*[F.covar_samp(f"od_{a}", f"od_{b}").alias(f"cov_{a}{b}") for a, b in pairs], F.count("*").alias("n"))


def angle_quantiles(rows: DataFrame, angle: Column, shares: Sequence[float]) -> list[float]:
    """Exact quantiles of ``angle`` (-pi to pi), interpolated between neighbours; the angles never meet in one task.

    One aggregate counts ``2 * ANGLES`` bins at most; a second counts the different angles of the bins that hold the wanted
    ranks. Pixels of 8 bits have 2 ** 24 colours, of which few share a bin.
    """
    placed = rows.select(angle.alias("v")).where("v is not null").select(F.floor(F.col("v") * (ANGLES / pi)).alias("bin"), "v")
    bins = np.array(sorted(tuple(r) for r in placed.groupBy("bin").count().collect()), np.int64).reshape(-1, 2)
    if not len(bins):
        raise ValueError("no angles")
    ends = np.cumsum(bins[:, 1])
    at = np.asarray(shares, float) * (ends[-1] - 1)
    ranks = np.stack([np.floor(at), np.ceil(at)]).astype(np.int64)
    held = np.unique(np.searchsorted(ends, ranks, side="right"))
    found = placed.where(F.col("bin").isin(bins[held, 0].tolist())).groupBy("bin", "v").count().collect()
    values = {}
    for k in held.tolist():
        own = sorted((r["v"], r["count"]) for r in found if r["bin"] == bins[k, 0])
        reached = ends[k] - bins[k, 1] + np.cumsum([n for _, n in own])
        for rank in ranks[np.searchsorted(ends, ranks, side="right") == k].tolist():
            values[rank] = own[int(np.searchsorted(reached, rank, side="right"))][0]
    return [values[a] + (values[b] - values[a]) * (p - a) for a, b, p in zip(*ranks.tolist(), at.tolist(), strict=True)]


def estimate_stain_vectors(pixels: DataFrame, default: Sequence[Sequence[float]] = HE, channels: Sequence[str] = ("r", "g", "b"), i0: float = 256.0, least: float = 0.05, most: float = 1.0, alpha: float = 0.01) -> np.ndarray:
    """Three stain vectors of an image, the first two in the order of ``default`` (Macenko et al., 2009).

    ``alpha`` is in percent. Three aggregates over the pixels: covariances, and two for the percentiles of the angle in their
    main plane; the 3 by 3 eigenvectors are found on the driver.
    """
    dense = stained(with_density(pixels, channels, i0), least, most)
    c = covariance(dense).first()
    if not c["n"] or c["n"] < 2:
        raise ValueError("too few stained pixels")
    matrix = np.array([[c["cov_rr"], c["cov_rg"], c["cov_rb"]], [c["cov_rg"], c["cov_gg"], c["cov_gb"]], [c["cov_rb"], c["cov_gb"], c["cov_bb"]]])
    plane = np.linalg.eigh(matrix)[1][:, 1:]
    along = [sum((F.col(f"od_{n}") * float(plane[i, k]) for i, n in enumerate("rgb")), F.lit(0.0)) for k in range(2)]
    low, high = angle_quantiles(dense, F.atan2(along[1], along[0]), [alpha / 100, 1 - alpha / 100])
    found = [plane @ np.array([np.cos(a), np.sin(a)]) for a in (low, high)]
    found = [v / np.linalg.norm(v) for v in found]
    match = np.array([[float(np.dot(v, d)) for d in default[:2]] for v in found])
    if max(match[0, 1], match[1, 0]) > max(match[0, 0], match[1, 1]):
        found.reverse()
    return np.array([found[0], found[1], residual(found[0], found[1])])


def separate(r: Column, g: Column, b: Column, vectors: Sequence[Sequence[float]] = HE) -> list[Column]:
    """Amounts of the three stains in a pixel of 0 to 1."""
    inverse = np.linalg.inv(np.asarray(vectors, float))
    logs = [F.ln(F.greatest(c, F.lit(FLOOR))) / float(np.log(FLOOR)) for c in (r, g, b)]
    return [F.greatest(F.lit(0.0), sum((logs[i] * float(inverse[i, k]) for i in range(3)), F.lit(0.0))) for k in range(3)]


def combine(stains: Sequence[Column], vectors: Sequence[Sequence[float]] = HE) -> list[Column]:
    """Red, green and blue of 0 to 1 from amounts of stains."""
    m = np.asarray(vectors, float)
    scale = -float(np.log(FLOOR))
    return [F.least(F.greatest(F.exp(-sum((stains[k] * (scale * float(m[k, i])) for k in range(3)), F.lit(0.0))), F.lit(0.0)), F.lit(1.0)) for i in range(3)]


def jitter(key: Column, channel: int, seed: int, salt: int) -> Column:
    """A number from -1 to 1, the same for all pixels of an image and on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(channel), F.lit(salt)), F.lit(1 << 30)) / float((1 << 29) - 0.5) - 1


def augment(pixels: DataFrame, image: str, vectors: Sequence[Sequence[float]] | Callable[[DataFrame], Sequence[Sequence[float]]] = HE, alpha: float = 0.02, beta: float = 0.02, seed: int = 0, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """``pixels`` with the channels of 0 to 255 augmented: amounts are multiplied within 1 +- alpha and shifted within +- beta.

    ``vectors``: a matrix, or a function that estimates one from the pixels. Values are cut down to whole numbers.
    """
    m = vectors(pixels) if callable(vectors) else vectors
    stains = separate(*[F.col(c) / 255.0 for c in channels], m)
    key = F.col(image)
    changed = [s * (1 + jitter(key, k, seed, 0) * alpha) + jitter(key, k, seed, 1) * beta for k, s in enumerate(stains)]
    return pixels.withColumns({c: F.floor(v * 255).cast("int") for c, v in zip(channels, combine(changed, m), strict=True)})
