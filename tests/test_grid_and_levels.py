import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import grid, levels


def tiles(spark, extent, tile, stride, last):
    df = spark.createDataFrame([(*extent, *tile, *stride)], "extent_x int, extent_y int, tile_extent_x int, tile_extent_y int, stride_x int, stride_y int")
    return [tuple(r) for r in grid.grid_tiles(df, last=last).select("tile_x", "tile_y").collect()]


@pytest.mark.parametrize(
    ("last", "xs"),
    [("drop", [0, 2]), ("keep", [0, 2, 4]), ("shift", [0, 2, 3])],
)
def test_edge_policies(spark, last, xs):
    assert tiles(spark, (5, 5), (2, 2), (2, 2), last) == [(x, y) for y in xs for x in xs]


def test_tiles_larger_than_the_slide(spark):
    assert tiles(spark, (5, 5), (6, 6), (2, 2), "keep") == [(0, 0)]
    assert tiles(spark, (5, 5), (6, 6), (2, 2), "drop") == []
    assert tiles(spark, (5, 5), (6, 6), (2, 2), "shift") == [(-1, -1)]
    assert tiles(spark, (5, 5), (8, 8), (2, 2), "keep") == []


def test_unknown_policy_raises(spark):
    with pytest.raises(ValueError, match="last must be"):
        tiles(spark, (5, 5), (2, 2), (2, 2), "wrap")


def test_three_axes(spark):
    df = spark.createDataFrame([(4, 2, 2)], "a int, b int, c int").withColumns({"t": F.lit(2), "s": F.lit(2)})
    found = grid.grid_tiles(df, "abc", "ttt", "sss", names=("x", "y", "z")).select("x", "y", "z").collect()
    assert [tuple(r) for r in found] == [(0, 0, 0), (2, 0, 0)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 12))
def test_keep_covers_every_pixel(spark, extent, tile, stride):
    if tile < stride or tile > extent:
        return
    xs = sorted({x for x, _ in tiles(spark, (extent, tile), (tile, tile), (stride, stride), "keep")})
    assert set(range(extent)) <= {p for x in xs for p in range(x, x + tile)}


def test_grid_has_no_python_in_its_plan(spark):
    df = spark.range(3).select(*[F.lit(9).alias(c) for c in ("extent_x", "extent_y", "tile_extent_x", "tile_extent_y", "stride_x", "stride_y")])
    plan = grid.grid_tiles(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def level(spark, column):
    return spark.range(1).select(column.alias("l")).first()[0]


def test_closest_level(spark):
    downsamples = F.array(*[F.lit(float(2**k)) for k in range(4)])
    base = F.lit(0.25)
    assert level(spark, levels.closest_level_by_downsample(downsamples, base, base, F.lit(0.5))) == 1
    assert level(spark, levels.closest_level_by_downsample(downsamples, base, base, F.lit(0.75))) == 1
    found = F.array(*[F.struct(F.lit(0.25 * 2**k).alias("x"), F.lit(0.25 * 2**k).alias("y")) for k in range(4)])
    assert level(spark, levels.closest_level_by_resolution(found, F.lit(0.75))) == 1
    assert level(spark, levels.closest_level_by_resolution(found, F.lit(9.0))) == 3


def test_tiff_resolution(spark):
    at = lambda unit, strict=False: level(spark, levels.tiff_resolution(F.lit(20000.0), F.lit(1.0), F.lit(unit), strict))
    assert [at(2), at(3), at(4), at(5)] == [1.27, 0.5, 0.05, 20000.0]
    assert at(5, True) == 1 / 20000
    with pytest.raises(Exception, match="unsupported resolution unit"):
        at(1)
