"""Benchmark decontamination by winnowing. DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item, or the whole of an item that has fewer. Of the hashes of all
``gram``-word runs inside a window the smallest is its fingerprint (Schleimer et al., 2003). A document keeps every
run that is the smallest of some window of its own, so a shared window always shares its fingerprint at the same place.
Fingerprints are joined, every hit is extended to the whole window and compared word by word, and covered words counted.

Items shorter than ``span`` have windows of their own length, and documents get fingerprints for each length that occurs.

Up to ``window_limit`` distinct windows (they are counted) the benchmark is broadcast and documents are read once, with
one shuffle of the hits. Beyond it documents are numbered in a written table, fingerprints are joined by a shuffle that deals
hot ones over several tasks, and the documents that have hits are read again.

Defined cases: null or empty text has no words and is never contaminated; null or empty items have no windows; repeated
rows are judged one by one; an empty benchmark hits nothing; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, ascii_lower, discard, materialize, salted_join

SPAN, GRAM, THRESHOLD = 13, 5, 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(words: str, at: Column, n: int, gram: int) -> Column:
    """Hash of the words from ``at`` on; windows of different lengths have different hashes."""
    return F.xxhash64(F.lit(n), *[F.get(F.col(words), at + j) for j in range(min(gram, n))])


def benchmark_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(item_id, n, fp, off, wtext, wid): every window with its fingerprint and where in the window it is."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - span, F.lit(0)))
    windows = words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, F.lit(span)).alias("w"))
    k = F.least(F.size("w"), F.lit(gram))
    # the hash of a run takes as many words as the run has: null ones are skipped by the hash, as in _gram
    run = lambda i: F.xxhash64(F.size("w"), *[F.when(F.lit(j) < k, F.get(F.col("w"), i + j)) for j in range(gram)])
    windows = windows.withColumn("h", F.transform(F.sequence(F.lit(0), F.size("w") - k), run))
    wtext = F.array_join("w", " ")
    return windows.select("item_id", F.size("w").alias("n"), F.array_min("h").alias("fp"), (F.array_position("h", F.array_min("h")) - 1).cast("int").alias("off"), wtext.alias("wtext"), F.md5(wtext).alias("wid"))


def _one_length(df: DataFrame, n: int, gram: int) -> tuple[DataFrame, Column]:
    """``df`` with the runs' hashes and the kept places for windows of ``n`` words, and the column of (n, p, h)."""
    wide = n - min(gram, n) + 1  # runs in a window
    hashes, least, places = f"g{n}", f"m{n}", f"p{n}"
    last = F.size("w") - n  # of a window's start
    runs = F.sequence(F.lit(0), F.size("w") - min(gram, n))
    df = df.withColumn(hashes, F.when(last >= 0, F.transform(runs, lambda i: _gram("w", i, n, gram))))
    kept = runs
    if wide > 1:
        df = df.withColumn(least, F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(F.col(hashes), i + j) for j in range(wide)]))))
        kept = F.filter(runs, lambda p: F.get(F.col(hashes), p) == F.greatest(*[F.get(F.col(least), p - j) for j in range(wide)]))
    df = df.withColumn(places, F.when(last >= 0, kept).otherwise(F.array().cast("array<int>")))
    return df, F.transform(places, lambda p: F.struct(F.lit(n).alias("n"), p.alias("p"), F.get(F.col(hashes), p).alias("h")))


def document_fingerprints(docs: DataFrame, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """Adds ``fps``, array of (n, p, h), to (.., w): for each window length the runs that are smallest in a window."""
    df, parts = docs, []
    for n in lengths:
        df, part = _one_length(df, n, gram)
        parts.append(part)
    fps = F.concat(*parts) if parts else F.array().cast("array<struct<n:int,p:int,h:bigint>>")
    return df.withColumn("fps", fps).select(*docs.columns, "fps")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, threshold: int = THRESHOLD, window_limit: int = 200_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (sorted ids), contaminated.

    Contaminated: at least one word in ``threshold`` lies in a window of ``items`` (item_id, text).
    """
    windows = materialize(benchmark_windows(items.select("item_id", "text"), span, gram), "bench")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # span at most
    distinct = windows.select(F.col("n").alias("bn"), "fp", "off", "wtext", "wid").distinct()
    owners = windows.select(F.col("wid").alias("owned"), F.col("item_id").cast("string").alias("item")).distinct()
    small = windows.limit(window_limit + 1).count() <= window_limit
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    if not small:
        base = materialize(base, "numbered")  # read more than once, and a row must keep its number
    words = base.select("rid", "doc_id", words_of(F.col("text")).alias("w"))
    prints = document_fingerprints(words, lengths, gram)
    fits = lambda start, n: (start >= 0) & (start + n <= F.size("w")) & (F.array_join(F.slice("w", start + 1, n), " ") == F.col("wtext"))
    start = F.col("p") - F.col("off")
    place = F.struct(start.cast("int").alias("s"), F.col("n").cast("int").alias("n"))
    if small:
        # A mark in both tables brings every document through the one inner join. The outer form of explode keeps the
        # optimizer from adding a filter on the array's size, which it would push below the steps that make the array.
        mark = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("p"), F.lit(0).cast("long").alias("h"))
        rows = prints.withColumn("fps", F.concat("fps", F.array(mark))).select("rid", "doc_id", "w", F.explode_outer("fps").alias("f")).select("rid", "doc_id", "w", "f.n", "f.p", "f.h")
        marks = windows.sparkSession.range(1).select(F.lit(0).alias("bn"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("off"), F.lit(None).cast("string").alias("wtext"), F.lit(None).cast("string").alias("wid"))
        hits = rows.join(F.broadcast(distinct.unionByName(marks)), (F.col("h") == F.col("fp")) & (F.col("n") == F.col("bn")))
        hits = hits.where((F.col("p") < 0) | fits(start, F.col("n")))
        hits = hits.select("rid", "doc_id", F.size("w").alias("n_words"), F.when(F.col("wid").isNotNull(), place).alias("at"), "wid")
    else:
        # a common passage's fingerprints are dealt over several tasks
        seen = materialize(prints.select("rid", F.explode_outer("fps").alias("f")).select("rid", "f.n", "f.p", F.col("f.h").alias("fp")).where("fp is not null"), "prints")
        found = materialize(salted_join(seen, distinct.select("fp").distinct(), "fp", "rid"), "found")
        discard(seen)
        of_row = found.groupBy("rid").agg(F.collect_list(F.struct("n", "p", "fp")).alias("fs"))
        rows = words.join(of_row, "rid").select("rid", "doc_id", F.size("w").alias("n_words"), "w", F.explode("fs").alias("f"))
        rows = rows.select("rid", "doc_id", "n_words", "f.n", "f.p", "f.fp", F.greatest(F.col("f.p") - F.col("f.n") + 1, F.lit(0)).alias("from"), "w")
        rows = rows.withColumn("w", F.slice("w", F.col("from") + 1, 2 * F.col("n")))  # the words that a window may have
        hits = salted_join(rows, distinct, "fp", "rid", counted=found).where((F.col("n") == F.col("bn")) & fits(start - F.col("from"), F.col("n")))
        hits = hits.select("rid", "doc_id", "n_words", place.alias("at"), "wid")
        none = words.select("rid", "doc_id", F.size("w").alias("n_words"), *[F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("at", "wid")])
        hits = hits.unionByName(none)
    # of one document: at most a row for each of its words and window lengths
    per = hits.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("at")).alias("at"), F.collect_set("wid").alias("wids"))
    cover = F.aggregate("at", F.struct(F.lit(0).alias("e"), F.lit(0).alias("c")), lambda a, x: F.struct(F.greatest(a["e"], x["s"] + x["n"]).alias("e"), (a["c"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(a["e"], x["s"]))).alias("c")))
    per = per.select("rid", "doc_id", "n_words", cover["c"].cast("long").alias("n_hit"), "wids")
    if small:
        named = per.withColumn("wid", F.explode_outer("wids")).join(F.broadcast(owners), F.col("wid") == F.col("owned"), "left")
        out = named.groupBy("rid", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    else:
        per = materialize(per, "judged")
        named = salted_join(per.select("rid", F.explode("wids").alias("wid")), owners.withColumnRenamed("owned", "wid"), "wid", "rid")
        named = named.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
        out = per.join(named, "rid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * threshold >= F.col("n_words"))).alias("contaminated"))
