import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators import annotations


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


@pytest.mark.parametrize(("roi", "want"), [([(0, 0), (8, 0), (8, 8), (0, 8)], [64, 16, 16, 4]), ([(1, 1), (7, 1), (7, 7), (1, 7)], [36, 6, 6, 1])])
def test_tile_coverage(spark, roi, want):
    tiles = spark.createDataFrame([("s", x, y) for x, y in ((0, 0), (8, 0), (0, 8), (8, 8))], "slide_id string, tile_x int, tile_y int")
    shapes = spark.createDataFrame([("s", [ring(SQUARE)]), ("t", [ring(SQUARE)])], f"slide_id string, rings {g.RINGS}")
    area = F.array(*[g.point(float(x), float(y)) for x, y in roi])
    out = annotations.tile_annotations(tiles, shapes, area, F.lit(1.0), pieces=True).orderBy("tile_y", "tile_x").collect()
    assert [r["covered_area"] for r in out] == pytest.approx(want)
    pieces = spark.createDataFrame([(r["pieces"],) for r in out], f"p array<{g.RING}>").select(F.aggregate(F.transform("p", g.ring_area), F.lit(0.0), lambda s, a: s + a)).collect()
    assert [p[0] for p in pieces] == pytest.approx(want)


def test_downsample_and_empty_tiles(spark):
    tiles = spark.createDataFrame([("s", 0, 0), ("s", 100, 100)], "slide_id string, tile_x int, tile_y int")
    shapes = spark.createDataFrame([("s", [ring(SQUARE)])], f"slide_id string, rings {g.RINGS}")
    out = annotations.tile_annotations(tiles, shapes, annotations.full_tile(F.lit(4.0), F.lit(4.0)), F.lit(4.0)).orderBy("tile_x").collect()
    assert out[0]["covered_area"] == pytest.approx(100 / 16) and out[0]["roi_area"] == pytest.approx(16) and out[1]["covered_area"] == 0


def test_union_counts_common_parts_once_and_holes_not():
    frame = ring([(-50, -50), (50, -50), (50, 50), (-50, 50)])
    a, b = [ring(SQUARE)], [ring([(5, 5), (15, 5), (15, 15), (5, 15)])]
    assert g.slabs([a, b], frame)[0] == pytest.approx(175)
    holed = [ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (3, 1), (3, 3), (1, 3)])]
    assert g.slabs([holed], frame)[0] == pytest.approx(12)
    assert g.slabs([], frame)[0] == 0


corners = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=6, unique=True)


@settings(max_examples=40, deadline=None)
@given(st.lists(corners, min_size=1, max_size=3))
def test_union_is_bounded_and_keeps_its_area_when_turned(polygons):
    frame = [(-25, -25), (25, -25), (25, 25), (-25, 25)]
    area = g.slabs([[ring(p)] for p in polygons], ring(frame))[0]
    turned = g.slabs([[ring([(-y, x) for x, y in p])] for p in polygons], ring(frame))[0]
    assert -1e-9 <= area <= 2500 + 1e-9 and np.isclose(area, turned, atol=1e-6)


def test_box_join_finds_each_pair_once(spark):
    rng = np.random.default_rng(3)
    box = lambda: (lambda x, y: {"x0": x, "y0": y, "x1": x + float(rng.integers(1, 60)), "y1": y + float(rng.integers(1, 60))})(float(rng.integers(-100, 100)), float(rng.integers(-100, 100)))
    schema = "k int, id int, box struct<x0:double,y0:double,x1:double,y1:double>"
    left, right = ([(int(i % 2), i, box()) for i in range(60)] for _ in range(2))
    out = annotations.box_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], 16.0).select("id", "id_r").collect()
    meets = lambda a, b: a["x0"] <= b["x1"] and b["x0"] <= a["x1"] and a["y0"] <= b["y1"] and b["y0"] <= a["y1"]
    want = sorted((i, j) for k, i, a in left for m, j, b in right if k == m and meets(a, b))
    assert sorted(map(tuple, out)) == want


def test_areas(spark):
    row = spark.range(1).select(g.polygon_area(F.array(g.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0)), g.rectangle(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)))).alias("a"), g.bounds(F.array(g.rectangle(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)))).alias("b")).first()
    assert row["a"] == 12 and tuple(row["b"]) == (1, 2, 4, 6)


def test_clipping_keeps_the_area_within_the_box(monkeypatch):
    from tessella.functions import geometry

    rng = np.random.default_rng(3)
    clipped = geometry._clipped
    for n in range(60):
        shapes = []
        for _ in range(3):
            angles, radius = np.sort(rng.uniform(0, 2 * np.pi, 12)), rng.uniform(2, 40, 12)
            ring = [{"x": float(20 + r * np.cos(a)), "y": float(20 + r * np.sin(a))} for a, r in zip(angles, radius, strict=True)]
            shapes.append([ring, [{"x": 15.0, "y": 15.0}, {"x": 22.0, "y": 16.0}, {"x": 18.0, "y": 24.0}]] if n % 2 else [ring])
        corners = [(8, 10), (30, 9), (27, 33), (10, 28)] if n % 3 else [(8, 10), (30, 10), (30, 31), (8, 31)]
        roi = [{"x": float(x), "y": float(y)} for x, y in corners]
        monkeypatch.setattr(geometry, "_clipped", clipped)
        got = g.slabs(shapes, roi)[0]
        monkeypatch.setattr(geometry, "_clipped", lambda e, *_: e)
        assert abs(got - g.slabs(shapes, roi)[0]) < 1e-6


def test_polygon_of_many_vertices_over_many_tiles():
    import time

    angles = np.linspace(0, 2 * np.pi, 50_000, endpoint=False)
    ring = [{"x": float(x), "y": float(y)} for x, y in zip(1000 + 900 * np.cos(angles), 1000 + 900 * np.sin(angles), strict=True)]
    began, total = time.process_time(), 0.0
    for x in range(0, 2000, 400):
        for y in range(0, 2000, 400):
            roi = [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + 400, y), (x + 400, y + 400), (x, y + 400))]
            total += g.slabs([[ring]], roi)[0]
    assert abs(total / (np.pi * 900**2) - 1) < 1e-6 and time.process_time() - began < 120
