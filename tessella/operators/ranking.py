"""Positions in a total order of all rows, without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Texts drawn to find the edges of their buckets, and how much of each an edge holds.
SAMPLE, PREFIX = 16_384, 128


def global_rank(rows: DataFrame, order: Sequence[str | Column], weight: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds ``rank``: the running sum of ``weight`` (1 without it) over all rows in ``order``, this row included.

    Rows are dealt into ``bucket``, which must not decrease along the order; by default the range of the first order column
    among boundaries that Spark samples. Buckets are ranked apart, and a bucket starts where the sums of those before it end:
    one number a bucket is all that meets in one place.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    size = F.col(weight) if weight else F.lit(1).cast("long")
    if bucket is None:
        first = cols[0]
        sampled = rows.select(first.alias("v")).where("v is not null")
        kind = sampled.schema["v"].dataType.typeName()
        if kind in ("string", "binary"):
            # percentiles are for numbers only: edges from a bounded sample; they decide who ranks a row, not its rank
            share = SAMPLE / max(1, sampled.count())
            some = sampled.select(F.substring("v", 1, PREFIX).alias("v"))
            some = sorted(r["v"] if kind == "string" else bytes(r["v"]) for r in (some.sample(share, seed=0) if share < 1 else some).collect())
            edges = sorted({some[i * len(some) // BUCKETS] for i in range(1, BUCKETS)}) if some else []
            bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast(f"array<{kind}>"), lambda e: e < first)), F.lit(-1))
        else:
            edges = sampled.select(F.percentile_approx(F.col("v").cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).first()[0] or []
            edges = sorted(set(edges))
            bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < first.cast("double"))), F.lit(-1))
    dealt = rows.withColumn("__bucket", bucket)
    sums = dealt.groupBy("__bucket").agg(F.sum(size).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("__bucket").alias("__of"), before.alias("__start"))
    within = Window.partitionBy("__bucket").orderBy(*[c.asc_nulls_first() for c in cols]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("rank", F.sum(size).over(within)).join(F.broadcast(starts), F.col("__bucket") == F.col("__of"))
    return ranked.withColumn("rank", (F.col("rank") + F.col("__start")).cast("long")).drop("__bucket", "__of", "__start")


def hash_rank(rows: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """Adds ``rank`` in the order of md5(key:seed), ties by key."""
    hashed = rows.withColumn("__h", F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))).withColumn("__k", key)
    bucket = F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")
    return global_rank(hashed, ["__h", "__k"], bucket=bucket).drop("__h", "__k")
