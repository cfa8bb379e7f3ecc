"""One query per operator, over whole tables with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import spread, table
from tessella.llm.decontamination import decontaminate
from tessella.llm.language import identify, train_dictionaries
from tessella.llm.mixing import mix_sources
from tessella.llm.near_duplicates import near_duplicates
from tessella.llm.secrets import KINDS, scan_secrets, span_text
from tessella.llm import embeddings, html, quality, toxicity
from tessella.llm.urls import filter_urls


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < len(KINDS))
    return out.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), width=4)


def fold(n: int):
    """crc32 of doc_id as text, modulo ``n``; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    out = toxicity.score(docs.select("doc_id", held, "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    field = quality.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    out = quality.score(docs.select("doc_id", held, "text"), field)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    dictionaries = train_dictionaries(docs.where(fold(3) != 1))
    held = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_extract": op3_html_extract,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_source_mix": op8_source_mix,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language_id": op10_language_id,
}


def oracles() -> dict[str, str]:
    """The SQL files beside this module, by query."""
    folder = resources.files(__package__) / "sql"
    return {n: (folder / f"{n}.sql").read_text() for n in QUERIES if (folder / f"{n}.sql").is_file()}
