"""The queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, mixing, ogg, passages, secrets_scan, simhash, toxicity, warc
from .common import documents, scratch

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.archive_pages(documents(spark, sf_dir, "pages")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_passages(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(ogg.to_media(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.train(docs))
    return found.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(documents(spark, sf_dir)))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sizes = scratch(mixing.sized(docs).select("doc_id", "source", "size"), "sizes")  # texts are read once
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op3_line_dedup": lines.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op6_passages": passages.ORACLE, "op9_secrets": secrets_scan.ORACLE, "op10_mix": mixing.ORACLE}
