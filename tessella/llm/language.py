"""Language identification by compression: zstandard with a raw-content dictionary for each language.

The letters of a text are compressed, in blocks, with the dictionary of every learned language; the language whose
dictionary gives the fewest bytes wins. Blocks keep a long text from becoming its own dictionary. ``score`` is the
winner's share of ``2 ** (-bits / temper)``; an answer is ``rejected`` where the runner-up comes within ``margin`` of it,
or where there is no letter.

A dictionary is at most ``DICTIONARY`` bytes of letters of labelled texts. About ``SAMPLE`` distinct texts of a language are
drawn by a hash of the text, and from each a run of ``PIECE`` letters that starts anywhere in it: this sample is bounded, the
counts behind it and the prediction cover everything.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; equal sizes go to the language
with more learned documents, then the smaller name; rows are predicted one by one, repeated ones alike; without any learned
language all is ``und``; an empty table gives no rows; other columns are kept, those named like a result are replaced by it in
``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICTIONARY, BLOCK = 1 << 16, 4096
SAMPLE = 400  # distinct texts of a language, about
PIECE = 2000  # characters of a text that a dictionary may take, from a place that a hash of the text draws
TEMPER, MARGIN = 16.0, 0.004
PREDICTED = "lang_pred string, score double, rejected boolean"


def letters(text: Column) -> Column:
    """Lower-cased runs of letters, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def train_dictionaries(labelled: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> list[tuple[str, bytes]]:
    """(lang, dictionary) of ``labelled`` (text, lang), the languages with most documents first."""
    known = labelled.where("lang is not null").where(F.rlike("text", F.lit(r"\p{L}"))).select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)).alias("x"))
    # copies of a text are drawn together, so the rate is that of distinct texts
    counts = known.groupBy("lang", F.xxhash64("text")).count().groupBy("lang").agg(F.sum("count").alias("count"), F.count("*").alias("texts"))
    rates = counts.select(F.col("lang").alias("of"), "count", (F.lit(float(sample)) / F.col("texts")).alias("rate"))
    some = known.join(F.broadcast(rates), F.col("lang") == F.col("of")).where("x < rate").select("lang", "count", "x", letters(F.col("text")).alias("t"))  # languages are few
    start = F.pmod(F.xxhash64("t", F.lit(1)), F.greatest(F.length("t") - PIECE, F.lit(0)) + 1) + 1
    pieces = some.groupBy("lang").agg(F.max("count").alias("n"), F.array_sort(F.collect_set(F.struct("x", F.substr(F.col("t"), start.cast("int"), F.lit(PIECE)).alias("t")))).alias("s"))
    rows = pieces.select("lang", "n", F.substring(F.array_join(F.transform("s", lambda s: s["t"]), " "), 1, size).alias("d")).collect()
    return [(r["lang"], r["d"].encode()[-size:]) for r in sorted(rows, key=lambda r: (-r["n"], r["lang"])) if r["d"].strip()]


def _predictor(dictionaries: list[tuple[str, bytes]], temper: float, margin: float):
    import zstandard

    # matches of three bytes count: words are short, and most of a word's evidence is in its pieces
    how = zstandard.ZstdCompressionParameters(min_match=3, strategy=zstandard.STRATEGY_GREEDY, window_log=17, hash_log=16, chain_log=16, search_log=4, target_length=32, write_content_size=0, write_dict_id=0)
    coders = []
    for name, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        coders.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=how)))

    def predict(text: str) -> tuple[str, float, bool]:
        if not text or not coders:
            return "und", 0.0, True
        data = text.encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        share = 1 / sum(2.0 ** max(-1000.0, (sizes[best] - s) * 8 / temper) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        narrow = second is not None and second - sizes[best] < margin * sizes[best]
        return coders[best][0], share, narrow

    return predict


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], temper: float = TEMPER, margin: float = MARGIN) -> DataFrame:
    """``docs`` (text, ..) with its text replaced by lang_pred, score and rejected."""
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "rejected")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields), PREDICTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(dictionaries, temper, margin)
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(0)]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            columns = [*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "lang_pred", "score", "rejected"])

    return docs.select(letters(F.col("text")).alias("text"), *others).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns."""
    names = [f"__{k}" for k in range(len(docs.columns))]  # whatever a column is called, it can't clash
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text"))
    kept = identify(plain, dictionaries).where("not rejected")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
