"""The training-data pipeline: five operators applied to ``documents`` one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphquarry.llm import bpe, decontaminate, language, neardup, pii
from graphquarry.llm.common import kept, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors can tell; those without letters and near ties go."""
    found = language.identify(docs, language.learn(docs))
    return found.where("NOT rejected").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return neardup.deduplicate(docs, neardup.Similarity(percent=80)).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their new lengths."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of every document, and whether decoding them gives its exact bytes."""
    # encoded first, decoded in a second job: one Python step at a time halves the workers of an executor
    # in between, the digest of its bytes stands for a text, which would double what is written
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    coded = bpe.encode(docs, ids="ids").select("doc_id", "lang", "source", "n_chars", "ids", digest.alias("text_sha256"))
    both = bpe.decode(kept(coded, "pipeline-ids", "zstd"), ids="ids", data="data")
    return both.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("data", 256) == F.col("text_sha256")).alias("exact"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("personal_data", masked),
    ("tokens", tokenized),
]

#: Compression sizes and signatures have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
