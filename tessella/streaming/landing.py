"""Slides that land in a folder, tiled as they come. Stateless: every file becomes its tiles once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.grid import grid_tiles
from tessella.sources.slides import SLIDE, open_slide


def landing_slides(spark: SparkSession, folder: str, tile_extent: Sequence[int], stride: Sequence[int], mpp: Sequence[float], files_per_trigger: int = 1000) -> DataFrame:
    """A stream of slide rows. Only paths travel; headers are read on the executors."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.tif*").load(folder)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SLIDE.split(", ")]
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                slide = open_slide(path.replace("file:///", "/").replace("file:/", "/"))
                level = slide.level(mpp)
                width, height, x, y, d = slide.describe(level)
                rows.append((path, width, height, *tile_extent, *stride, x, y, level, d))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=ARROW)

    return files.select("path").mapInArrow(describe, SLIDE)


ARROW = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[t]) for n, t in (f.split() for f in SLIDE.split(", "))])


def landing_tiles(slides: DataFrame, last: str = "keep") -> DataFrame:
    return grid_tiles(slides, last=last).withColumn("slide_id", F.sha2("path", 256))
