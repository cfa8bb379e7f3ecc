"""Row identities, path and cohort columns, run index and membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranking import global_rank

SEPARATOR = "\x1f"
HASHES = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5, "xxhash64": lambda c: F.hex(F.xxhash64(c))}


def row_hash(columns: Sequence[str | Column], algorithm: str = "sha256") -> Column:
    """Hash of the columns' texts, joined by a unit separator; a null is told from an empty text."""
    if algorithm not in HASHES:
        raise ValueError(f"algorithm must be one of {', '.join(HASHES)}")
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns]
    return HASHES[algorithm](F.concat_ws(SEPARATOR, *texts))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str, new: str) -> Column:
    """The path with ``suffix`` at its end replaced; other paths stay."""
    return F.when(path.endswith(suffix), F.concat(F.substr(path, F.lit(1), F.length(path) - len(suffix)), F.lit(new))).otherwise(path)


def patient_id(path: Column, separator: str = "_") -> Column:
    return F.split_part(basename(path), F.lit(separator), F.lit(1))


def is_ome(path: Column) -> Column:
    return F.lower(path).endswith(".ome.tiff") | F.lower(path).endswith(".ome.tif")


def run_index(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, start, stop): where the rows of each key lie once rows are sorted by key and ``order``.

    The starts are running sums of the keys' counts, so that nothing but one row a key is ever sorted.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    ranked = global_rank(counts, [key], weight="n")
    return ranked.select(key, (F.col("rank") - F.col("n")).alias("start"), F.col("rank").alias("stop"))


def members(rows: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is among ``ids``, or is not."""
    return rows.join(ids.select(key).distinct(), key, "left_semi" if inside else "left_anti")
