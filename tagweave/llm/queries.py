"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.attribution import token_counts
from tagweave.llm.common import table
from tagweave.llm.embeddings import near_vectors
from tagweave.llm.language_model import score_texts
from tagweave.llm.line_dedup import dedup_lines
from tagweave.llm.mixing import mix_single
from tagweave.llm.multiset_hash import edited_texts
from tagweave.llm.packing import pack_documents
from tagweave.llm.pii import find_personal_data
from tagweave.llm.prefix_trie import trie_nodes
from tagweave.llm.quality import quality_rules
from tagweave.llm.secrets import find_secrets
from tagweave.llm.simhash import hex_fingerprint, near_duplicates
from tagweave.llm.turn_repair import damage, repair


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_fingerprint().alias("fingerprint"), "component_id"
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).drop("text")


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_single(docs).select("doc_id", "size", "source_size", "target", "taken")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_texts(table(spark, sf_dir, "documents"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations"))


def turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_line_dedup": line_dedup,
    "op2_embeddings": embeddings,
    "op3_lm": language_model,
    "op4_pii": personal_data,
    "op5_secrets": secret_scan,
    "op6_token_counts": token_sections,
    "op7_simhash": simhash,
    "op8_quality": quality,
    "op9_mixing": mixing,
    "op10_packing": packing,
    "op11_fingerprints": fingerprints,
    "op12_prefix_trie": prefix_trie,
    "op13_turn_repair": turn_repair,
}
