"""From raw documents to a training mix: language ID, line and near dedup, decontamination, source mixing.

Every stage takes the documents that its predecessor kept and returns a table
with the same columns; the last one adds the mix's columns. Rows without an id
take part like any other. Stages accept empty tables, which stay empty, null
columns, empty and very long texts, repeated rows and additional columns of any
name; rows that tie are told apart as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm import decontaminate, langid, lines, mixing, nearcopies
from meshwright.llm.common import HIGHEST, discard, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, however narrowly; what has no letter is rejected, and nothing else if no language was learned."""
    model = langid.train(docs)
    found = langid.predict(docs, model, carry=True)
    told = (F.col("lang_pred") != langid.UNDETERMINED) if model.langs else F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))
    return found.filter(told).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated long lines, ``n_chars`` being what is left; null texts become empty."""
    out = lines.dedup_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    return out.withColumn("row", F.col("row").withField("n_chars", F.length("text").cast("long"))).select(*(F.col("id").alias(c) if c == "doc_id" else F.col(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (5-word shingles, Jaccard similarity of 0.8 or more), of texts that op1_simhash links, and of chains of such pairs.

    It is the one with the smallest id, a row without id only if no row of its
    class has one; of several with that id the one whose text has the least MD5.
    Rows that share an id and no near copy all stay, and so do different texts
    without an id.
    """
    own, digest = F.coalesce(docs["doc_id"].cast("long"), F.lit(HIGHEST)), F.md5(F.coalesce(docs["text"], F.lit("")))
    keyed = docs.select(own.alias("own"), digest.alias("digest"), docs["text"].alias("text"))

    def least() -> DataFrame:
        best = nearcopies.near_copies(keyed).groupBy("root").agg(F.min(F.struct("own", "digest")).alias("best"))
        return best.select("best.own", "best.digest")

    kept = stored(spark, least, "kept")
    rows = docs.select(own.alias("own"), digest.alias("digest"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    first = F.row_number().over(Window.partitionBy("own", "digest").orderBy("own"))
    return rows.join(kept, ["own", "digest"], "left_semi").withColumn("nth", first).filter("nth = 1").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no part of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size, source_size, target, taken``.

    A column of the documents with such a name comes back as ``doc_`` and its name.
    """
    own = {c: f"doc_{c}" for c in docs.columns if c in ("size", "source_size", "target", "taken")}
    while set(own.values()) & set(docs.columns):
        own = {c: f"doc_{name}" for c, name in own.items()}
    return mixing.mix(mixing.sized(docs.withColumnsRenamed(own))).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: The stages learn models, hash with XXH64 and link transitively, which SQL can't state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written once, and what it needed on the way is dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
        if k:
            discard(before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
