import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import imaging, stain


def test_otsu_equals_exhaustive_search():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = rng.integers(0, 50, 14)
        counts[[1, 5, 9, 13]] += 1
        fast, slow = imaging.multi_otsu(counts, 4), imaging.exhaustive_otsu(counts, 4)
        parts = lambda cuts, c=counts: [c[a:b].sum() for a, b in zip([0, *[k + 1 for k in cuts]], [*[k + 1 for k in cuts], len(c)], strict=True)]
        assert parts(fast) == parts(slow)
    with pytest.raises(ValueError, match="cannot be parted"):
        imaging.multi_otsu(np.array([1, 0, 3]), 4)


def image(spark, values):
    return spark.createDataFrame([(y, x, int(v)) for (y, x), v in np.ndenumerate(values)], "y int, x int, v int")


def raster(df, name="v"):
    rows = df.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), -1)
    for r in rows:
        out[r["y"], r["x"]] = r[name]
    return out


def brute(values, radius, how):
    merge = max if how == "dilate" else min
    h, w = values.shape
    return np.array([[merge(values[y + dy, x + dx] for dy, dx in imaging.disc(radius) if 0 <= y + dy < h and 0 <= x + dx < w) for x in range(w)] for y in range(h)])


def test_dilating_a_pixel_gives_the_disc(spark):
    values = np.zeros((9, 9), int)
    values[4, 4] = 255
    out = raster(imaging.morph(image(spark, values), "v", 2, "dilate"))
    assert (out == 255).sum() == 13 == len(imaging.disc(2))


@pytest.mark.parametrize("how", ["dilate", "erode"])
@pytest.mark.parametrize("radius", [1, 3])
def test_morphology_equals_brute_force(spark, how, radius):
    values = np.random.default_rng(radius).integers(0, 99, (11, 13))
    assert (raster(imaging.morph(image(spark, values), "v", radius, how)) == brute(values, radius, how)).all()


def test_tissue_mask(spark):
    rng = np.random.default_rng(5)
    levels = np.full((24, 24), 240)
    levels[4:20, 4:20] = rng.choice([60, 110, 160], (16, 16))
    levels[0, 0] = 100  # a speck, which opening removes
    df = image(spark, levels).select("y", "x", *[F.col("v").alias(c) for c in "rgb"])
    mask = raster(imaging.tissue_mask(df, (5.0, 5.0)), "mask")
    assert mask[12, 12] == 255 and mask[0, 0] == 0 and mask[23, 23] == 0


def test_gray_and_saturation(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0), (10, 20, 30)], "r int, g int, b int")
    got = df.select(imaging.gray(*map(F.col, "rgb")), imaging.saturation(*map(F.col, "rgb"))).collect()
    assert [r[0] for r in got][:2] == [255, 0] and [r[1] for r in got] == [0, 0, 255, 170]


def test_stain_round_trip(spark):
    rng = np.random.default_rng(1)
    amounts = (rng.uniform(0, 0.1, (200, 3)) * (1, 1, 0)).tolist()  # the residual has a negative part, which clipping would cut
    df = spark.createDataFrame(amounts, "a double, b double, c double")
    mixed = df.select("*", *[v.alias(n) for v, n in zip(stain.combine([F.col(c) for c in "abc"]), "xyz", strict=True)])
    back = mixed.select("a", "b", "c", *stain.separate(F.col("x"), F.col("y"), F.col("z"))).collect()
    assert all(np.allclose(r[:3], r[3:], atol=1e-6) for r in back)


def test_residuals():
    assert np.allclose(stain.HE[2], (0.3155, -0.5982, 0.7367), atol=1e-4)
    assert np.allclose(stain.HDAB[2], (0.6330, -0.7129, 0.3018), atol=1e-4)


def test_macenko_finds_the_stains(spark):
    rng = np.random.default_rng(2)
    h, e = np.array(stain.HEMATOXYLIN), np.array(stain.EOSIN)
    h, e = h / np.linalg.norm(h), e / np.linalg.norm(e)
    amounts = np.concatenate([rng.uniform(0.2, 0.8, (1500, 1)) * [1, 0], rng.uniform(0.2, 0.8, (1500, 1)) * [0, 1], rng.uniform(0.1, 0.4, (1000, 2))])
    od = amounts @ np.stack([h, e])
    df = spark.createDataFrame((256 * 10**-od).tolist(), "r double, g double, b double")
    found = stain.estimate_stain_vectors(df, alpha=1.0)
    assert found[0] @ h > 0.995 and found[1] @ e > 0.995 and abs(found[2] @ found[0]) < 1e-6


def test_augmentation_is_repeatable_and_small(spark):
    df = spark.createDataFrame([(i % 3, 100 + i, 90 + i, 120) for i in range(30)], "image int, r int, g int, b int")
    one, two = (stain.augment(df, "image", seed=4).collect() for _ in range(2))
    assert one == two
    still = stain.augment(df, "image", alpha=0.0, beta=0.0).collect()
    assert all(abs(a[k] - b[k]) <= 1 for a, b in zip(still, df.collect(), strict=True) for k in (1, 2, 3))


@pytest.mark.parametrize("values", [[0.3], [-3.14159, 3.14159], [0.5] * 40 + [0.500001, -1.0], None])
def test_angle_quantiles_are_exact(spark, values):
    values = np.random.default_rng(2).normal(0.4, 0.3, 3000).clip(-3, 3).tolist() if values is None else values
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "a double")
    shares = [0.0, 0.0001, 0.25, 0.5, 0.9999, 1.0]
    got = stain.angle_quantiles(rows, F.col("a"), shares)
    assert got == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    with pytest.raises(ValueError):
        stain.angle_quantiles(rows.limit(0), F.col("a"), shares)
