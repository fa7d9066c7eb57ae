"""Corpus cleaning in stages; each stage reads what the one before it kept.

Quality rules drop documents, near-duplicates keep one document of each group, documents with
benchmark passages go, secrets are masked, and what is left is packed into token sequences.

All stages but the last return the columns they were given, whatever further ones are called. Null and
empty texts, null ids, rows that repeat an id or a whole row, and empty tables are valid input:

* ``quality_rules``: a null or empty text has no words and is rejected; each row is judged by its own text.
* ``near_dedup``: one row of each group stays, also among repeated rows and rows without an id; a text
  without words is linked with nothing and stays. Of equal texts the smallest id stays, nulls last.
* ``decontamination``: a null or empty text overlaps with nothing; rows that share an id are judged apart.
* ``secret_scans``: null and empty texts stay as they are; ``n_chars``, if there, is counted anew.
* ``packing``: a null or empty text is the example of id 1 alone; every row is an example of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, near_dup, packing, quality_rules, secrets
from fleetlens.session import ensure_checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in four fifths of its five-word shingles."""
    return near_dup.drop_near_duplicates(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    out = secrets.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", without_benchmark),
    ("secret_scans", without_secrets), ("packing", packed)]
ORACLE_SQL = None  # forest, components and packing have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
