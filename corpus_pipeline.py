"""From raw documents to packed sequences, in stages that each read what the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import table
from tagweave.llm.line_dedup import dedup_lines
from tagweave.llm.mixing import mix_single, repeat_taken
from tagweave.llm.packing import pack_documents
from tagweave.llm.quality import quality_rules
from tagweave.llm.simhash import near_duplicates, one_of_each
from tagweave.operators.lineage import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has."""
    return dedup_lines(docs.select(COLUMNS)).select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "lang",
        "source",
        F.length("kept_text").cast("long").alias("n_chars"),
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    docs = docs.select(COLUMNS)
    return one_of_each(docs, near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return repeat_taken(mix_single(docs.select(COLUMNS))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# trained scores, fingerprints and packing are beyond SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
