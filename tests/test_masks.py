from math import gcd, prod

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import masks


def brute(geometry, tiles, channels, clip, merge):
    total, n = np.zeros((channels, *geometry.extents)), np.zeros(geometry.extents, int)
    pairs = masks.clip_pairs(clip, 2)
    for (y, x), values in tiles:
        block = np.broadcast_to(np.asarray(values, float).reshape(channels, *(geometry.output if len(values) > channels else (1, 1))), (channels, *geometry.output))
        at = [c // s * g + p[0] * u for c, s, g, p, u in zip((y, x), geometry.stride, geometry.step, pairs, geometry.upscale, strict=True)]
        block = block[:, pairs[0][0] : geometry.output[0] - pairs[0][1], pairs[1][0] : geometry.output[1] - pairs[1][1]]
        block = block.repeat(geometry.upscale[0], 1).repeat(geometry.upscale[1], 2)
        where = (slice(None), slice(at[0], at[0] + block.shape[1]), slice(at[1], at[1] + block.shape[2]))
        if merge == "mean":
            total[where] += block
        else:
            total[where] = np.maximum(total[where], block)
        n[where[1:]] += 1
    return (total / np.maximum(n, 1) if merge == "mean" else total), n


@pytest.mark.parametrize("merge", ["mean", "max"])
@pytest.mark.parametrize(
    ("source", "tile", "output", "stride", "clip", "dense"),
    [((16, 16), 4, (1, 1), 4, 0, False), ((32, 64), 8, (1, 1), 4, 0, False), ((33, 53), 8, (8, 8), 4, 1, True), ((30, 40), (12, 9), (12, 9), 4, ((1, 2), (0, 3)), True), ((40, 40), 12, (3, 3), 8, 1, True)],
)
def test_equals_numpy(spark, merge, source, tile, output, stride, clip, dense):
    g = masks.MaskGeometry.of(source, tile, output, stride)
    rng, channels = np.random.default_rng(1), 2
    places = [(int(rng.integers(0, (p - t) // s + 1)) * s, int(rng.integers(0, (q - t) // s + 1)) * s) for p, q, t, s in [(*g.span, max(g.tile), g.stride[0])] for _ in range(20)]
    tiles = [(p, rng.normal(size=channels * (prod(g.output) if dense else 1)).tolist()) for p in places]
    df = spark.createDataFrame([(y, x, v) for (y, x), v in tiles], "y int, x int, values array<double>")
    want, n = brute(g, tiles, channels, clip, merge)
    cells = masks.densify(masks.assemble(df, g, merge, channels=channels, clip=clip), g, channels).collect()
    assert len(cells) == want.size
    assert all(np.isclose(c["value"], want[c["channel"], c["y"], c["x"]]) and c["overlap"] == n[c["y"], c["x"]] for c in cells)


def test_sum_of_ones(spark):
    g = masks.MaskGeometry.of((32, 64), 8, 1, 4)
    df = spark.createDataFrame([(y, x, [1.0]) for y in (0, 8) for x in (0, 4, 40)], "y int, x int, values array<double>")
    cells = masks.assemble(df, g, lambda v: F.sum(v)).agg(F.sum("value"), F.sum("overlap")).first()
    assert tuple(cells) == (6 * (8 // gcd(8, 4)) ** 2,) * 2


def test_shapes():
    assert masks.MaskGeometry.of((33, 53), 8, 4, 4).extents == (18, 28)
    assert masks.MaskGeometry.of((33, 53), 8, 1, 4).extents == (9, 14)
    assert masks.MaskGeometry.of((8, 8), 8, 1, 8).extents == (1, 1)


def test_bad_input(spark):
    with pytest.raises(ValueError, match="clip must be"):
        masks.clip_pairs((1, 2, 3), 2)
    g = masks.MaskGeometry.of((16, 16), 8, 1, 8)
    outside = spark.createDataFrame([(16, 0, [1.0])], "y int, x int, values array<double>")
    with pytest.raises(Exception, match="over the mask"):
        masks.assemble(outside, g).collect()
    with pytest.raises(Exception, match="must have"):
        masks.assemble(spark.createDataFrame([(0, 0, [1.0, 2.0])], "y int, x int, values array<double>"), g).collect()


def test_resize_to_source(spark):
    g = masks.MaskGeometry.of((8, 8), 4, 1, 4)
    df = spark.createDataFrame([(0, 0, [1.0]), (4, 4, [3.0])], "y int, x int, values array<double>")
    pixels = spark.createDataFrame([(y, x) for y in range(8) for x in range(8)], "source_y int, source_x int")
    got = {(r["source_y"], r["source_x"]): r["value"] for r in masks.at_source(pixels, masks.assemble(df, g), g).collect()}
    assert got[0, 3] == 1.0 and got[4, 4] == 3.0 and got[0, 4] == 0.0 and len(got) == 64
