"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every source gets a target number of words. ``target / size`` of a source is the expected number of copies of each of
its documents: the whole part is allocated as certain copies, the rest is an inclusion probability. Documents are ranked
by ``odds(U) / odds(inclusion)`` with a hash for the random U (Rosen's Pareto order sampling) and taken in that order up
to the words that are missing: a sample of fixed size, in words, with unequal probabilities. The cut-off is found by
three passes of a 1024-bin histogram for all sources at once, never by sorting a source, so a source that holds a third
of all rows costs no more than its share. Where the last bin of a source holds several rows of one rank (repeated or null
ids), as many passes over a hash of their texts, and then over a number of the row, go on within it. One closing row per
source, the one whose size is nearest to what is then still missing, brings the sum near the target.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last;
an empty table gives no rows; rows of one id, or of none, are ranked by text, and equal rows by a number of their own, so
that any part of them can be taken; which of equal rows it is makes no difference to the columns returned; extra columns
are ignored or, with ``keep``, carried through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import TOKEN, broadcast_if, discard, materialize

BINS, LEVELS = 1024, 3
#: What rows are ranked by, the later ones among those that the earlier ones leave together.
RANKS = ("place", "v", "w")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Targets are ``min(cap * size, level * weight)`` with the one level that makes them sum to ``share`` of all sizes:
    what capping and resharing the excess by weight until none is above ends at. With the sources ordered by
    ``cap * size / weight``, the level is the largest of ``(total - caps before) / weights from here on``.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    wts = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(wts, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    ranked = ranked.withColumn("level", (total - before) / rest)
    ranked = ranked.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(everything)))
    return ranked.select("source", "source_size", "target")


def uniform(*cols: str, seed: int = 0):
    """A number in (0, 1) from 52 bits of md5, the same on every run and engine."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0, keep: Sequence[str] = (), source_limit: int = 100_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken and ``keep``.

    Up to ``source_limit`` sources their table is broadcast (its rows are counted), above it the joins shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("size"), uniform("doc_id", seed=seed).alias("u"),
        _unit(F.xxhash64(text)).alias("v"), F.monotonically_increasing_id().alias("rid"), *keep,
    )
    sized = materialize(sized.withColumn("w", _unit(F.xxhash64("rid"))), "mix")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = source_targets(sources, weights, share, cap).withColumn("certain", F.floor(ratio).cast("long"))
    state = state.withColumn("odd", ratio - F.col("certain"))
    state = state.select("*", (F.col("target") - F.col("certain") * F.col("source_size")).alias("need"), *[F.lit(0.0).alias(f"lo_{k}") for k in RANKS], F.lit(0).cast("long").alias("got"))
    state = materialize(state, "mix-targets")
    # Monotone in odds(U) / odds(inclusion), and in [0, 1): x / (1 + x)
    x = (F.col("u") / (1 - F.col("u"))) / (F.col("odd") / (1 - F.col("odd")))
    place = F.when(F.col("odd") > 0, x / (1 + x)).otherwise(1.0)
    joined = lambda s: sized.join(broadcast_if(s.withColumnRenamed("source", "of"), source_limit), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("place", place).where("size > 0 and odd > 0")
    last = 1.0 / BINS**LEVELS
    in_bin = lambda k, width: (F.col(k) >= F.col(f"lo_{k}")) & (F.col(k) < F.col(f"lo_{k}") + width)
    used: list[str] = []
    for rank in RANKS:
        earlier = F.lit(True)
        for k in used:
            earlier = earlier & in_bin(k, last)
        if used and not joined(state).where(earlier).groupBy("source", used[-1]).count().where("count > 1").take(1):
            break  # no tie in a source's last bin
        used.append(rank)
        for level in range(LEVELS):
            state = _narrowed(joined(state).where(earlier), state, rank, 1.0 / BINS**level)
    gap = F.col("need") - F.col("got")
    # taken: of smaller rank, or in the last bin of one rank and of smaller next rank
    below, inside = F.lit(False), F.lit(True)
    for k in used:
        below = below | (inside & (F.col(k) < F.col(f"lo_{k}")))
        inside = inside & in_bin(k, last)
    left = joined(state).where(~below)
    closing = left.groupBy("source").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "place", "doc_id", "v", "w", "rid", gap.alias("gap"))).alias("end"))
    closing = materialize(closing.where("end.off < end.gap").select(F.col("end.rid").alias("end_rid")), "mix-end")
    out = sized.join(broadcast_if(state.withColumnRenamed("source", "of"), source_limit), F.col("source").eqNullSafe(F.col("of"))).withColumn("place", place)
    out = out.join(broadcast_if(closing, source_limit), F.col("rid") == F.col("end_rid"), "left")
    more = (F.col("odd") > 0) & (below | F.col("end_rid").isNotNull())
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + more.cast("long")).otherwise(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *keep)


def _unit(number):
    """A long as a number in [0, 1)."""
    return F.pmod(number, F.lit(1 << 50)) / float(1 << 50)


def _narrowed(rows: DataFrame, state: DataFrame, rank: str, width: float) -> DataFrame:
    """``state`` with each source's bin of ``rank`` narrowed to the ``1 / BINS`` of it in which its cut-off lies."""
    lo, step = f"lo_{rank}", width / BINS
    inside = rows.where((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(lo) + width))
    bins = inside.withColumn("bin", F.least(F.floor((F.col(rank) - F.col(lo)) / step), F.lit(BINS - 1)))
    bins = bins.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("got").alias("got"))
    bins = bins.withColumn("sum", F.col("got") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    cut = bins.where(F.col("sum") >= F.col("need")).groupBy("source").agg(F.min_by(F.struct("bin", (F.col("sum") - F.col("words")).alias("got")), "bin").alias("cut"))
    cut = cut.select(F.col("source").alias("of"), "cut")
    out = state.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    out = out.withColumn(lo, F.when(F.col("cut").isNotNull(), F.col(lo) + F.col("cut.bin") * step).otherwise(F.col(lo))).withColumn("got", F.coalesce("cut.got", "got"))
    out = materialize(out.drop("cut"), "mix-cut")
    discard(state)
    return out
