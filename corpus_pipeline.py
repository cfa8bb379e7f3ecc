"""A training corpus from raw documents: identified language, no near copies, no benchmark text, no secrets, mixed by source.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns the mix: doc_id, source, size, source_size, target, copies and taken of every document in it.
Rows are matched by doc_id: those that repeat an id stay or go together, those with a null id are never dropped by stages that
drop by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize, table, without
from tessella.llm.decontamination import decontaminate
from tessella.llm.language import keep_identified, train_dictionaries
from tessella.llm.mixing import mix_sources
from tessella.llm.near_duplicates import near_duplicates
from tessella.llm.secrets import redact_secrets


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression identifies; dictionaries come from the labelled documents."""
    return keep_identified(docs, train_dictionaries(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return without(docs, near_duplicates(docs).where("not kept").select("doc_id"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark: one passage is enough to go, however long the document around it."""
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask."""
    return redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each."""
    return mix_sources(docs).where(F.col("copies") > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identified),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("secrets", redacted),
    ("mix", mixed),
]

#: Compression, MinHash and a trained model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
