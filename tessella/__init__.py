"""Spark-first analytics for tiled gigapixel imagery: slides, tiles, annotations, overlays, tensors, masks."""

__version__ = "0.1.0"
