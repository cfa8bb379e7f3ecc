import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.geometry import rectangle
from tessella.operators.grid import grid_tiles
from tessella.sources import slides, tiff
from tessella.streaming import landing


def gradient(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([x % 251, y % 241, (x + y) % 239], axis=2).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("slides")
    for name, unit in (("a.tiff", 3), ("b.ome.tiff", 2)):
        (out / name).write_bytes(tiff.encode_tiff(tiff.pyramid(gradient(300, 420), 100), (0.25, 0.25), (64, 48), unit=unit))
    mask = np.zeros((150, 210, 1), np.uint8)
    mask[:, 105:] = 255
    (out / "m.tif").write_bytes(tiff.encode_tiff([mask], (0.5, 0.5), (64, 64), "none", big=False))
    (out / "notes.txt").write_text("no slide")
    return out


@pytest.mark.parametrize("big", [True, False])
@pytest.mark.parametrize("compression", ["none", "deflate"])
def test_tiff_round_trip(tmp_path, big, compression):
    import io

    pixels = gradient(70, 90)
    file = tiff.TiffFile(io.BytesIO(tiff.encode_tiff([pixels, tiff.halved(pixels)], (0.5, 0.25), (32, 16), compression, big)))
    assert (file.pages[0].read(0, 0, 90, 70) == pixels).all() and (file.pages[1].read(0, 0, 45, 35) == tiff.halved(pixels)).all()
    assert file.pages[0].resolution() == pytest.approx((0.5, 0.25), rel=1e-4) and file.pages[1].resolution() == pytest.approx((1.0, 0.5), rel=1e-4)
    outside = file.pages[0].read(80, -5, 20, 10, (1, 2, 3))
    assert (outside[5:, :10] == pixels[:5, 80:]).all() and (outside[:5] == (1, 2, 3)).all() and (outside[:, 10:] == (1, 2, 3)).all()


def test_unpacking():
    assert tiff.unpack_bits(bytes([2, 1, 2, 3, 254, 7, 128])) == b"\x01\x02\x03\x07\x07\x07"
    # clear, then a run: each code is the string before and one more
    codes, bits = [256, 65, 258, 259, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    bits += "0" * (-len(bits) % 8)
    assert tiff.unpack_lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == b"A" * 6


def test_read_slides(spark, folder):
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in slides.read_slides(spark, str(folder), 64, (48, 32), mpp=0.5, files_per_partition=1).collect()}
    assert set(rows) == {"a.tiff", "b.ome.tiff", "m.tif"}
    a = rows["a.tiff"]
    assert (a["extent_x"], a["extent_y"], a["level"], a["downsample"], a["stride_y"]) == (210, 150, 1, 2.0, 32) and a["mpp_x"] == pytest.approx(0.5, rel=1e-4)
    assert rows["b.ome.tiff"]["level"] == 1
    assert slides.read_slides(spark, str(folder), 64, 64, level=0).where(F.col("path") == str(folder / "a.tiff")).count() == 1
    assert slides.read_slides(spark, [str(folder / "a.tiff"), str(folder / "gone.tiff")], 64, 64, level=0, ignoreMissingFiles="true").count() == 1
    with pytest.raises(ValueError, match="exactly one"):
        slides.read_slides(spark, str(folder), 64, 64)


def test_tiles_and_filters(spark, folder):
    rows = slides.read_slides(spark, str(folder / "a.tiff"), 64, 64, level=0)
    tiles = grid_tiles(rows).withColumn("tile", slides.read_slide_tiles("path", "tile_x", "tile_y", "tile_extent_x", "tile_extent_y", "level"))
    pixels = gradient(300, 420)
    found = tiles.select("tile_x", "tile_y", "tile", slides.pixel_std("tile").alias("std")).collect()
    assert len(found) == 7 * 5
    for r in found:
        got = np.frombuffer(r["tile"]["data"], np.uint8).reshape(r["tile"]["shape"])
        want = np.full((64, 64, 3), 255, np.uint8)
        part = pixels[r["tile_y"] : r["tile_y"] + 64, r["tile_x"] : r["tile_x"] + 64]
        want[: part.shape[0], : part.shape[1]] = part
        assert (got == want).all() and r["std"] == pytest.approx(want.std())
    plan = tiles.where("tile_x > 300")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")  # pixels are read above the filter


@pytest.mark.parametrize("mpp", [0.5, 0.25])
def test_overlay_fractions(spark, folder, mpp):
    # at 0.25 the overlay has half the tiles' resolution
    scale = 0.5 / mpp
    df = spark.createDataFrame([(str(folder / "m.tif"), int(x * scale), 0, mpp, mpp) for x in (0, 85, 120)], "path string, x int, y int, mpp_x double, mpp_y double")
    roi = rectangle(F.lit(0.0), F.lit(0.0), F.lit(40.0 * scale), F.lit(40.0 * scale))
    got = [r[0] for r in df.select(slides.tile_overlay_overlap("path", "x", "y", "mpp_x", "mpp_y", roi)).collect()]
    assert got == [{"0": 1.0}, {"0": 0.5, "255": 0.5}, {"255": 1.0}]
    patch = df.select(slides.tile_overlay("path", "x", "y", "mpp_x", "mpp_y", roi).alias("p")).first()["p"]
    assert patch["shape"] == [40, 40, 3] and not any(patch["mask"])


def test_sink_round_trip(spark, tmp_path):
    slides.register(spark)
    rows = [(f"{k}.tiff", [20, 30, 3], gradient(20, 30).tobytes(), json.dumps({"mpp": [0.5, 0.5]}) if k else None) for k in range(3)]
    df = spark.createDataFrame(rows, "name string, shape array<int>, data binary, options string")
    df.write.format("tiff_tiles").mode("append").option("defaults", json.dumps({"mpp": [2.0, 2.0], "tile": [16, 16]})).save(str(tmp_path / "out"))
    back = {r["path"].rsplit("/", 1)[-1]: r["mpp_x"] for r in slides.read_slides(spark, str(tmp_path / "out"), 8, 8, level=0).collect()}
    assert back == pytest.approx({"0.tiff": 2.0, "1.tiff": 0.5, "2.tiff": 0.5}, rel=1e-3)
    with open(tmp_path / "out" / "0.tiff", "rb") as f:
        assert (tiff.TiffFile(f).pages[0].read(0, 0, 30, 20) == gradient(20, 30)).all()


def test_landing_folder(spark, folder, tmp_path):
    stream = landing.landing_tiles(landing.landing_slides(spark, str(folder), (64, 64), (64, 64), (0.25, 0.25)))
    query = stream.writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = {r["path"].rsplit("/", 1)[-1]: r["n"] for r in spark.sql("select path, count(*) as n from landed group by path").collect()}
    assert counts == {"a.tiff": 35, "b.ome.tiff": 35, "m.tif": 12}


def test_png_rows_come_back():
    import struct
    import zlib

    from tessella.sources.png import encode_png

    for channels in (1, 2, 3, 4):
        pixels = np.random.default_rng(channels).integers(0, 256, (7, 5, channels), dtype=np.uint8)
        data, at, chunks = encode_png(pixels), 8, {}
        while at < len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(name + body)
            chunks[name], at = body, at + 12 + size
        rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(7, -1)
        assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(pixels.shape) == pixels).all()
        assert struct.unpack(">II", chunks[b"IHDR"][:8]) == (5, 7)


def test_single_tiles_and_open_slides(folder):
    rows = [{"path": str(folder / name), "tile_x": x, "tile_y": 8, "tile_extent_x": 20, "tile_extent_y": 10, "level": 0} for name in ("a.tiff", "b.ome.tiff") for x in (0, 64, 410)]
    reader = slides.TileReader(rows, most=1, background=(9, 8, 7))
    assert len(reader) == 6
    for n, row in enumerate(rows):
        want = np.empty((10, 20, 3), np.uint8)
        want[:] = (9, 8, 7)
        seen = gradient(300, 420)[8:18, row["tile_x"] : row["tile_x"] + 20]
        want[: seen.shape[0], : seen.shape[1]] = seen
        assert (reader[n] == want).all() and len(reader.open) == 1
    reader.close()
    assert not reader.open


def test_tiles_of_a_slide_lie_together(spark):
    rows = [(f"s{k}", x, y) for k in range(6) for x in range(20) for y in range(20)]
    tiles = spark.createDataFrame(rows, "path string, tile_x int, tile_y int").repartition(9)
    out = slides.together(tiles, rows=100)
    blocks = {}
    for r in out.withColumn("b", F.spark_partition_id()).collect():
        blocks.setdefault(r["b"], []).append((r["path"], r["tile_y"], r["tile_x"]))
    assert out.count() == len(rows) and all(b == sorted(b) for b in blocks.values())
    assert max(len({p for p, _, _ in b}) for b in blocks.values()) <= 2


def test_small_tiles_share_blocks_and_messages_are_small(spark):
    import pickle

    tiles = spark.range(40_000).selectExpr("concat('s', id div 400) path", "id % 20 tile_x", "id div 20 % 20 tile_y", "16L tile_extent_x", "16L tile_extent_y")
    out = slides.together(tiles)
    assert out.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    blocks = out.groupBy(F.spark_partition_id()).agg(F.count_distinct("path").alias("paths")).agg(F.sum("paths")).first()[0]
    assert out.count() == 40_000 and blocks < 100 + out.rdd.getNumPartitions()
    # large tiles still have blocks of their own
    assert slides.together(tiles.withColumn("tile_extent_x", F.lit(1 << 20))).rdd.getNumPartitions() == 313
    paths = [f"file:///some/shared/folder/s_{k}_{k % 7 * 16}.png" for k in range(5000)]
    message = slides.Written(paths)
    assert len(pickle.dumps(message)) * 5 < sum(map(len, paths)) and message.paths == paths


def test_sinks_take_batches_row_by_row(tmp_path):
    import pyarrow as pa

    def batches():
        for k in range(3):
            yield pa.RecordBatch.from_pydict({"name": [f"{k}.tiff"], "shape": [[20, 30, 3]], "data": [gradient(20, 30).tobytes()]})
            assert (tmp_path / f"{k}.tiff").exists()

    message = slides.TiffWriter({"path": str(tmp_path)}).write(batches())
    assert message.paths == [str(tmp_path / f"{k}.tiff") for k in range(3)]


def test_few_slides_stay_open(folder, tmp_path):
    with slides._Open() as found:
        for k in range(slides.MOST_OPEN + 20):
            (tmp_path / f"{k}.tiff").symlink_to(folder / "a.tiff")
            assert found[str(tmp_path / f"{k}.tiff")].describe(0)[:2] == (420, 300)
        assert len(found.slides) == slides.MOST_OPEN


def test_pngs_come_back_from_folders_and_tasks_are_bounded(spark, tmp_path, monkeypatch):
    slides.register(spark)
    rows = [(f"{k % 3}/{k}.png" if k % 4 else f"{k}.png", [5 + k, 7, 3], bytes((5 + k) * 21)) for k in range(24)]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").write.format("png_tiles").mode("append").save(str(tmp_path))
    (tmp_path / "1" / "none.png").write_bytes(b"no image")
    got = {r["path"].removeprefix(f"{tmp_path}/"): (r["width"], r["height"]) for r in spark.read.format("png_tiles").load(str(tmp_path)).collect()}
    assert got == {name: (7, shape[0]) for name, shape, _ in rows}
    monkeypatch.setattr(slides, "listed", lambda *_: [f"{k}.tiff" for k in range(100_000)])
    parts = slides.SlideReader({"path": "x", "level": 0, "tile_extent": 16, "stride": 16}).partitions()
    assert len(parts) <= slides.PARTITIONS and sum(len(p.paths) for p in parts) == 100_000


def test_tasks_that_write_slides_have_few(spark, tmp_path):
    from tessella.plans import file_queries

    spark.range(6000).selectExpr("id s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    dealt = file_queries._suppliers(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count()
    most, rows = dealt.agg(F.max("count"), F.sum("count")).first()
    assert most <= file_queries.SLIDES_A_TASK * 1.05 and rows == 6000


def test_opaque_pixels(spark):
    df = spark.createDataFrame([(bytes([255, 255, 255, 0, 1, 2, 3, 255]),), (bytes([0, 0, 0, 254]),), (b"",), (None,)], "d binary")
    assert [r[0] for r in df.select(slides.opaque_pixels("d")).collect()] == [1, 0, 0, None]


def test_byte_sum(spark):
    df = spark.createDataFrame([(bytes([255] * 1000 + [7]),), (b"\0",), (b"",), (None,)], "d binary")
    assert [r[0] for r in df.select(slides.byte_sum("d")).collect()] == [255_007, 0, 0, None]
