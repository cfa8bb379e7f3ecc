"""Shared helpers: table access, cluster-safe materialisation, size-checked broadcast, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word of the decontamination and classifier stages: digits, ASCII letters (after lower-casing) and everything non-ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of the shingle and size stages: anything between white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, read by Spark only, so that any store it can open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over as many tasks as there are cores where it has fewer (small or few files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tessella-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local folder serves only a local session that names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{_own_folder()}").rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and outlives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/tessella-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what ``materialize`` wrote; call it once nothing that is still lazy reads it."""
    path = getattr(df, "_tessella_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is (Spark then shuffles it). ``df`` should be cheap to count."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(limit + 1)) <= limit else df.hint("shuffle_merge")


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame | None = None, sizes: tuple[DataFrame, int] | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right`` on the column ``key`` of both, with hot keys of ``left`` dealt out.

    A key is hot if it holds more than an even task's share of the rows, so there are fewer hot keys than tasks and their
    list is broadcast. Its rows go to as many tasks as it has shares, by a hash of the column ``by``; ``right``'s rows of hot
    keys are repeated for each, at most twice as many rows in all as there are tasks and hot rows of ``right``.
    ``counted``: a cheaper table with the same rows' keys, which is read twice; ``sizes``, if known: rows (key, n) of all keys
    that may be hot, and the number of all rows.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if sizes is None:
        counted = left if counted is None else counted
        sizes = counted.groupBy(key).agg(F.count("*").alias("n")), counted.count()
    known, total = sizes
    known = known.select(F.col(key).alias("__key"), F.col("n").alias("__n")).where(F.col("__n") * tasks > total)
    hot = F.broadcast(known.select("__key", F.ceil(F.col("__n") * tasks / total).cast("int").alias("__shares")))
    shares = F.coalesce("__shares", F.lit(1))
    one = left.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.pmod(F.xxhash64(by), shares).cast("int")).drop("__key", "__shares")
    two = right.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__key", "__shares")
    return one.join(two, [key, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame, tag: str = "cc", rounds: int = 60, small: int = 200_000) -> DataFrame:
    """(id, component) of every node that has an edge in ``edges`` (a, b: long); component is its smallest reachable id.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a partial aggregate and a join. Up to ``small``
    edges (they are counted) the aggregate is broadcast; beyond, a hub's rows are dealt over several tasks. Every round is
    written to the shared folder and earlier ones are removed. No edges: no rows.
    """

    def joined(rows: DataFrame, n: int, least) -> DataFrame:
        least = rows.groupBy("u").agg(least.alias("m"))
        return rows.join(F.broadcast(least), "u") if n <= small else salted_join(rows, least, "u", "v")

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0")
    mark, n = None, now.count()
    for k in range(1, rounds + 1):
        # large star: every neighbour above u joins the smallest of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = joined(both, 2 * n, F.least(F.min("v"), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, f"{tag}-{k}l")
        # small star: u and its smaller neighbours join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small_star = joined(large, n, F.min("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least).distinct()
        small_star = materialize(small_star, f"{tag}-{k}s")
        seen = small_star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(now)
        now, n = small_star, seen[0]
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def sample_labels(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample of ``labels`` (doc_id, column 0 or 1) and the weight that each class's rows then stand for.

    About ``per_class`` ids of each class are drawn by a hash of the id, so reruns agree. Null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rate = lambda k: min(1.0, per_class / max(1, counts.get(k, 0)))
    sample = known.where(place < F.when(F.col("label") == 1, rate(1)).otherwise(rate(0)))
    return sample, {k: 1 / rate(k) for k in (0, 1)}


def without(docs: DataFrame, ids: DataFrame, limit: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id), all columns kept. Rows with a null id stay.

    Up to ``limit`` ids (they are counted) are broadcast, more are joined by a shuffle.
    """
    gone = materialize(ids.where("doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct(), "ids")
    return docs.join(broadcast_if(gone, limit), F.col("doc_id") == F.col("__gone"), "left_anti")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of sorted batches by their first ``keys`` columns, a group at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        cols = [rest.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *new.tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest
