"""Slides as rows: a Spark data source of slide metadata, pixel reads as Arrow functions, and a sink of TIFFs.

``spark.read.format("wsi_slides")`` lists files on the driver and reads their headers on the executors, a partition a group of
files. Pixels are read by column functions, which belong above all filters on metadata.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage


from tessella.sources.files import below, listed, opened, removed, written
from tessella.sources.png import HEAD as PNG_HEAD
from tessella.sources.png import encode_png, png_size
from tessella.sources.tiff import TiffFile, encode_tiff, pyramid

#: Suffixes of slide files.
EXTENSIONS = ("svs", "tif", "dcm", "ndpi", "vms", "vmu", "scn", "mrxs", "tiff", "svslide", "bif", "czi", "ome.tiff", "ome.tif")
SLIDE = "path string, extent_x bigint, extent_y bigint, tile_extent_x bigint, tile_extent_y bigint, stride_x bigint, stride_y bigint, mpp_x double, mpp_y double, level bigint, downsample double"
#: Partitions of files at most, unless ``files_per_partition`` is given: a task costs more than the heads of a few files.
PARTITIONS = 512
#: Bytes of pixels that a block of tiles may hold in any case, and slides that a task keeps open.
BLOCK_BYTES, MOST_OPEN = 16 << 20, 64
TILE = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])
OVERLAY = T.StructType([*TILE.fields, T.StructField("mask", T.BinaryType())])


class OpenSlideBackend:
    """The same few operations on formats that only the OpenSlide library reads."""

    def __init__(self, path: str):
        import openslide

        self.slide = openslide.OpenSlide(path)
        self.base = tuple(float(self.slide.properties[f"openslide.mpp-{a}"]) for a in "xy")

    def level(self, mpp: Sequence[float]) -> int:
        wanted = (mpp[0] / self.base[0] + mpp[1] / self.base[1]) / 2
        far = [abs(d - wanted) for d in self.slide.level_downsamples]
        return far.index(min(far))

    def describe(self, level: int) -> tuple[int, int, float, float, float]:
        d = float(self.slide.level_downsamples[level])
        return (*self.slide.level_dimensions[level], self.base[0] * d, self.base[1] * d, d)

    def read(self, x: int, y: int, width: int, height: int, level: int, background=255) -> np.ndarray:
        d = self.slide.level_downsamples[level]
        rgba = np.asarray(self.slide.read_region((int(x * d), int(y * d)), level, (width, height))).astype(float)
        alpha = rgba[..., 3:] / 255
        return (rgba[..., :3] * alpha + np.broadcast_to(background, (3,)) * (1 - alpha)).round().astype(np.uint8)

    def read_rgba(self, x: int, y: int, width: int, height: int, level: int) -> np.ndarray:
        """Red, green, blue and alpha of a region whose corner is given in the level's pixels."""
        d = self.slide.level_downsamples[level]
        return np.asarray(self.slide.read_region((int(x * d), int(y * d)), level, (width, height)))

    def close(self) -> None:
        self.slide.close()


class TiffBackend:
    def __init__(self, path: str):
        self.context = opened(path)
        self.tiff = TiffFile(self.context.__enter__())
        self.ome = path.lower().endswith((".ome.tif", ".ome.tiff"))

    def level(self, mpp: Sequence[float]) -> int:
        if self.ome:
            return self.tiff.closest_level(mpp)
        base = self.tiff.pages[0].resolution()
        wanted = (mpp[0] / base[0] + mpp[1] / base[1]) / 2
        far = [abs(self.tiff.pages[0].width / p.width - wanted) for p in self.tiff.pages]
        return far.index(min(far))

    def describe(self, level: int) -> tuple[int, int, float, float, float]:
        page = self.tiff.pages[level]
        return (page.width, page.height, *page.resolution(), self.tiff.pages[0].width / page.width)

    def read(self, x: int, y: int, width: int, height: int, level: int, background=255) -> np.ndarray:
        return self.tiff.pages[level].read(x, y, width, height, background)

    def read_rgba(self, x: int, y: int, width: int, height: int, level: int) -> np.ndarray:
        """Red, green, blue and alpha of a region whose corner is given in the level's pixels; outside is transparent black."""
        page = self.tiff.pages[level]
        pixels = page.read(x, y, width, height, 0)
        out = np.zeros((height, width, 4), np.uint8)
        out[..., :3] = pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., :1]
        out[max(0, -y) : max(0, page.height - y), max(0, -x) : max(0, page.width - x), 3] = 255
        return out

    def close(self) -> None:
        self.context.__exit__(None, None, None)


def open_slide(path: str):
    """TIFFs are read here; other formats need the OpenSlide library to be installed."""
    if path.lower().endswith((".tif", ".tiff")):
        return TiffBackend(path)
    return OpenSlideBackend(path.removeprefix("file://"))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SlideReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        both = lambda name: [int(v) for v in str(options[name]).split(",")] * 2
        if ("mpp" in options) == ("level" in options):
            raise ValueError("exactly one of mpp and level is needed")
        for name in ("tile_extent", "stride"):
            if name not in options:
                raise ValueError(f"{name} is needed: a number, or two separated by a comma")
        self.tile, self.stride = both("tile_extent")[:2], both("stride")[:2]
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on the path leaves files unread."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and f.attribute == ("path",):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        o = self.options
        paths = json.loads(o["paths"]) if "paths" in o else [o["path"]]
        found = listed(paths, o.get("extensions", ",".join(EXTENSIONS)).split(","), o.get("ignoreMissingFiles", "false").lower() == "true", o.get("pathGlobFilter", "*"))
        if self.only is not None:
            found = [f for f in found if f in self.only]
        if "shuffle_seed" in o:
            np.random.default_rng(int(o["shuffle_seed"])).shuffle(found)
        size = max(1, int(o.get("files_per_partition", max(16, -(-len(found) // PARTITIONS)))))
        return [Files(found[i : i + size]) for i in range(0, len(found), size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            slide = open_slide(path)
            try:
                if "level" in self.options:
                    level = int(self.options["level"])
                else:
                    mpp = [float(v) for v in str(self.options["mpp"]).split(",")] * 2
                    level = slide.level(mpp[:2])
                width, height, mpp_x, mpp_y, downsample = slide.describe(level)
            finally:
                slide.close()
            yield (path, int(width), int(height), *self.tile, *self.stride, float(mpp_x), float(mpp_y), level, float(downsample))


class SlideSource(DataSource):
    """Options: path or paths (JSON list), mpp or level, tile_extent, stride, extensions, pathGlobFilter, ignoreMissingFiles,
    files_per_partition (16, or as many as leave ``PARTITIONS`` partitions), shuffle_seed."""

    @classmethod
    def name(cls) -> str:
        return "wsi_slides"

    def schema(self) -> str:
        return SLIDE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SlideReader(self.options)


class Written(WriterCommitMessage):
    """The files of a task, packed: messages of all tasks meet on the driver."""

    def __init__(self, paths: list[str]):
        self.packed = zlib.compress(json.dumps(paths).encode())

    @property
    def paths(self) -> list[str]:
        return json.loads(zlib.decompress(self.packed))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other, so that a task holds no second copy of a batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


class TiffWriter(DataSourceArrowWriter):
    """Rows with name, shape, data (uint8, row-major) and options (JSON object, or null) become ``<path>/<name>``."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.defaults = json.loads(options.get("defaults", "{}"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = []
        for row in _records(iterator):
            o = self.defaults | (json.loads(row["options"]) if row.get("options") else {})
            pixels = np.frombuffer(row["data"], np.uint8).reshape(row["shape"])
            mpp = o.get("mpp", [1.0, 1.0])
            levels = pyramid(pixels if pixels.ndim == 3 else pixels[..., None]) if o.get("pyramid", True) else [pixels]
            path = f"{self.folder}/{row['name']}"
            written(path, encode_tiff(levels, mpp, tuple(o.get("tile", (512, 512))), o.get("compression", "deflate"), o.get("big", True)))
            done.append(path)
        return Written(done)

    def abort(self, messages: list) -> None:
        for m in messages:
            for path in m.paths if m is not None else []:
                removed(path)


class PngWriter(DataSourceArrowWriter):
    """Rows with name, shape and data (uint8, row-major) become ``<path>/<name>``."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = []
        for row in _records(iterator):
            path = f"{self.folder}/{row['name']}"
            written(path, encode_png(np.frombuffer(row["data"], np.uint8).reshape(row["shape"])))
            done.append(path)
        return Written(done)

    def abort(self, messages: list) -> None:
        for m in messages:
            for path in m.paths if m is not None else []:
                removed(path)


class PngReader(DataSourceReader):
    """The driver lists what lies directly in the folder, executors list what is below and read the heads of the files."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        folders, files = below(self.folder)
        files = [f for f in files if f.lower().endswith(".png")]
        groups = []
        for found, least in ((folders, 1), (files, 16)):
            size = max(least, -(-len(found) // PARTITIONS))
            groups += [Files(found[i : i + size]) for i in range(0, len(found), size)]
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for top in partition.paths:
            for path in listed([top], ["png"]):
                with opened(path) as file:
                    size = png_size(file.read(PNG_HEAD))
                if size is not None:
                    yield (path, *size)


class PngSink(DataSource):
    """``df.write.format("png_tiles").mode("append").save(folder)``; names may have folders. Reading gives the path, width and
    height of the PNG files in and below a folder: many files should be dealt over folders, which tasks list."""

    @classmethod
    def name(cls) -> str:
        return "png_tiles"

    def schema(self) -> str:
        return "path string, width bigint, height bigint"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PngReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return PngWriter(self.options)


class TiffSink(DataSource):
    """``df.write.format("tiff_tiles").mode("append").save(folder)``; option ``defaults`` holds options of all rows as JSON:
    mpp, tile, compression, big, pyramid."""

    @classmethod
    def name(cls) -> str:
        return "tiff_tiles"

    def schema(self) -> str:
        return "name string, shape array<int>, data binary, options string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return TiffWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats ``wsi_slides``, ``tiff_tiles`` and ``png_tiles`` known, and lets Spark pass filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideSource)
    spark.dataSource.register(TiffSink)
    spark.dataSource.register(PngSink)


def read_slides(spark: SparkSession, paths: str | Sequence[str], tile_extent: int | Sequence[int], stride: int | Sequence[int], mpp: float | Sequence[float] | None = None, level: int | None = None, **options) -> DataFrame:
    """One row a slide, at the level nearest to ``mpp`` or at ``level``; see ``SlideSource`` for the other options."""
    if (mpp is None) == (level is None):
        raise ValueError("exactly one of mpp and level is needed")
    register(spark)
    text = lambda v: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    named = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "tile_extent": text(tile_extent), "stride": text(stride)}
    named |= {"mpp": text(mpp)} if mpp is not None else {"level": str(level)}
    return spark.read.format("wsi_slides").options(**named, **{k: text(v) for k, v in options.items()}).load()


class _Open:
    """The slides that a batch reads; those last used, up to ``MOST_OPEN``, stay open."""

    def __init__(self):
        self.slides: dict[str, object] = {}

    def __getitem__(self, path: str | None):
        if path is None:
            raise ValueError("a tile has no slide path")
        slide = self.slides.pop(path, None) or open_slide(path)
        self.slides[path] = slide
        if len(self.slides) > MOST_OPEN:
            self.slides.pop(next(iter(self.slides))).close()
        return slide

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        for slide in self.slides.values():
            slide.close()


def _tiles(found: list[np.ndarray]) -> pa.Array:
    shapes = pa.array([list(t.shape) for t in found], pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([shapes, pa.array([t.tobytes() for t in found], pa.binary())], names=["shape", "data"])


def slide_tiles(*background: int):
    """A function of path, x, y, width, height and level that gives the pixels of tiles on a background of one gray or of red,
    green and blue. A batch keeps the slides last used open: rows of a slide should lie together (``together``)."""
    colour = background[0] if len(background) == 1 else background

    @F.arrow_udf(TILE)
    def read(path: pa.Array, x: pa.Array, y: pa.Array, width: pa.Array, height: pa.Array, level: pa.Array) -> pa.Array:
        with _Open() as slides:
            return _tiles([slides[p].read(*at, colour) for p, *at in zip(*(c.to_pylist() for c in (path, x, y, width, height, level)), strict=True)])

    return read


#: Pixels of tiles on a white background.
read_slide_tiles = slide_tiles(255)


@F.arrow_udf(TILE)
def read_slide_regions(path: pa.Array, x: pa.Array, y: pa.Array, width: pa.Array, height: pa.Array, level: pa.Array) -> pa.Array:
    """Red, green, blue and alpha of regions, whose corners are given in the level's pixels."""
    with _Open() as slides:
        return _tiles([slides[p].read_rgba(*at) for p, *at in zip(*(c.to_pylist() for c in (path, x, y, width, height, level)), strict=True)])


class TileReader:
    """Tiles by number, for loaders that fetch single items: rows are a list of mappings with path, tile_x, tile_y,
    tile_extent_x, tile_extent_y and level. The slides last used, up to ``most``, stay open."""

    def __init__(self, rows: Sequence, most: int = 16, background=255):
        self.rows, self.most, self.background, self.open = rows, most, background, {}

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, n: int) -> np.ndarray:
        row = self.rows[n]
        slide = self.open.pop(row["path"], None) or open_slide(row["path"])
        self.open[row["path"]] = slide
        if len(self.open) > self.most:
            self.open.pop(next(iter(self.open))).close()
        return slide.read(*(row[c] for c in ("tile_x", "tile_y", "tile_extent_x", "tile_extent_y", "level")), self.background)

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1].close()


def together(tiles: DataFrame, path: str = "path", order: Sequence[str] = ("tile_y", "tile_x"), rows: int = 128, blocks: int | None = None) -> DataFrame:
    """Tiles dealt by ranges of slide and place, so that those of a slide lie together and a large slide is split.

    ``blocks`` ranges, or as many as leave about ``rows`` tiles to each (the tiles are then counted), up to 100,000. Where the
    tiles' extents are known, a range of small tiles holds more of them, up to ``BLOCK_BYTES`` of pixels, as long as all cores
    have ranges. Ranges are of hashes of the slide: Spark draws rows for their edges and sends them to the driver, paths would
    be most of that.
    """
    n = blocks
    if n is None:
        sized = {"tile_extent_x", "tile_extent_y"} <= set(tiles.columns)
        count, size = tiles.agg(F.count("*"), F.sum(tile_bytes()) if sized else F.lit(None)).first()
        n = -(-count // rows)
        if size is not None:
            n = min(n, max(-(-size // BLOCK_BYTES), 4 * tiles.sparkSession.sparkContext.defaultParallelism))
    return tiles.repartitionByRange(min(100_000, max(1, n)), F.xxhash64(path), *order).sortWithinPartitions(path, *order)


def pixel_bytes(channels: int = 3) -> Column:
    """Size of a slide's pixels at its level, from the columns of ``read_slides``."""
    return F.col("extent_x") * F.col("extent_y") * channels


def tile_bytes(channels: int = 3) -> Column:
    """Size of the pixels of one of a slide's tiles."""
    return F.col("tile_extent_x") * F.col("tile_extent_y") * channels


def _patch(slides: _Open, path, x, y, width, height, mpp_x, mpp_y, roi) -> tuple[np.ndarray, np.ndarray]:
    """Overlay pixels under a tile's ROI, and which of them are outside it. ``roi`` is a ring in tile pixels."""
    slide = slides[path]
    level = slide.level((mpp_x, mpp_y))
    _, _, overlay_x, overlay_y, _ = slide.describe(level)
    rx, ry = mpp_x / overlay_x, mpp_y / overlay_y
    corners = np.array([(p["x"], p["y"]) for p in roi], float)
    low, high = np.rint(corners.min(axis=0)).astype(int), np.rint(corners.max(axis=0)).astype(int)
    to = lambda v, r: max(0, int(np.rint(v * r)))
    size = to(high[0] - low[0], rx), to(high[1] - low[1], ry)
    data = slide.read(to(x + low[0], rx), to(y + low[1], ry), *size, level, 0)
    ring = (corners - low) * (rx, ry)
    cx, cy = np.meshgrid(np.arange(size[0]) + 0.5, np.arange(size[1]) + 0.5)
    inside = np.zeros(cx.shape, bool)
    for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if y0 != y1:
            inside ^= (cy >= min(y0, y1)) & (cy < max(y0, y1)) & (cx < x0 + (cy - y0) * (x1 - x0) / (y1 - y0))
    return data, ~inside


@F.arrow_udf(OVERLAY)
def tile_overlay(path: pa.Array, x: pa.Array, y: pa.Array, mpp_x: pa.Array, mpp_y: pa.Array, roi: pa.Array) -> pa.Array:
    """Overlay pixels of tiles and a mask, 1 outside the ROI, both (height, width, 3)."""
    with _Open() as slides:
        found = [_patch(slides, p, a, b, None, None, c, d, r) for p, a, b, c, d, r in zip(*(v.to_pylist() for v in (path, x, y, mpp_x, mpp_y, roi)), strict=True)]
    shapes = pa.array([list(d.shape) for d, _ in found], pa.list_(pa.int32()))
    masks = [np.repeat(m[..., None], d.shape[2], axis=2).astype(np.uint8).tobytes() for d, m in found]
    return pa.StructArray.from_arrays([shapes, pa.array([d.tobytes() for d, _ in found], pa.binary()), pa.array(masks, pa.binary())], names=["shape", "data", "mask"])


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def tile_overlay_overlap(path: pa.Array, x: pa.Array, y: pa.Array, mpp_x: pa.Array, mpp_y: pa.Array, roi: pa.Array) -> pa.Array:
    """Share of each overlay value among the unmasked pixels of all channels; empty where all are masked."""
    out = []
    with _Open() as slides:
        for p, a, b, c, d, r in zip(*(v.to_pylist() for v in (path, x, y, mpp_x, mpp_y, roi)), strict=True):
            data, outside = _patch(slides, p, a, b, None, None, c, d, r)
            values, n = np.unique(data[~outside], return_counts=True)
            out.append([(str(v), k / n.sum()) for v, k in zip(values.tolist(), n.tolist(), strict=True)])
    return pa.array(out, pa.map_(pa.string(), pa.float64()))


@F.arrow_udf(T.DoubleType())
def pixel_std(tile: pa.Array) -> pa.Array:
    """Population standard deviation of all of a tile's numbers."""
    return pa.array([float(np.frombuffer(t["data"], np.uint8).std()) if t and t["data"] else None for t in tile.to_pylist()], pa.float64())


@F.arrow_udf(T.LongType())
def byte_sum(data: pa.Array) -> pa.Array:
    """Sum of all of a tile's bytes."""
    return pa.array([None if d is None else int(np.frombuffer(d, np.uint8).sum(dtype=np.int64)) for d in data.to_pylist()], pa.int64())


@F.arrow_udf(T.LongType())
def opaque_pixels(data: pa.Array) -> pa.Array:
    """How many of the red, green, blue and alpha pixels of a region are opaque."""
    return pa.array([None if d is None else int((np.frombuffer(d, np.uint8)[3::4] == 255).sum()) for d in data.to_pylist()], pa.int64())
