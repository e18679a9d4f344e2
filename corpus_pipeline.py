"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of `documents`. Stages drop documents by doc_id: rows that share one go or stay together, and rows with a null
doc_id are never dropped. Null and empty texts go at language ID, as they have no letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, language, lines, near
from tessera.llm.queries import table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents whose language has a smaller mean probability are rejected, as are texts without letters.
LEAST_SCORE = 0.35


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in `ids`."""
    return common.without_ids(docs.select(*COLUMNS), common.cut(ids.distinct(), "dropped")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of no clear language."""
    found = language.identify(docs, language.train_on(docs, common.crc_mod("doc_id", 3) != 1))
    rejected = (F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < LEAST_SCORE)
    return without(docs, found.where(rejected).select("doc_id"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows."""
    kept = lines.dedup_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return without(docs, near.near_duplicates(docs).where(~F.col("kept")).select("doc_id"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return without(docs, decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts that remain."""
    both = bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("BPE encoding", encode),
]

#: Trained models and tokenizers have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
