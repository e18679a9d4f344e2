"""Queries of the ten operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, threshold=0.8)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_RULES, MORE_RULES, scan_secrets, spans_text

    rules = BASE_RULES + MORE_RULES
    found = scan_secrets(table(spark, sf_dir, "documents"), rules)
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    base = spans_text(F.filter("spans", lambda s: s["kind"] < len(BASE_RULES)), rules)
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("spans"), rules).alias("spans"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    both = round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.expr("n_bytes - octet_length(kept)").cast("long")
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import THRESHOLD, score_quality, train_on

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, train_on(docs, labels, crc_mod("doc_id", 5) != 0))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_overlaps

    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train_on

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train_on(docs, crc_mod("doc_id", 3) != 1))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    read = token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return read.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


#: A line's key: blanks at both ends stripped, A-Z lower-cased.
LINE_KEY = "translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS l
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)
), keyed AS (SELECT *, {LINE_KEY} AS k FROM lines),
owned AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS owner FROM keyed),
judged AS (SELECT *, length(k) >= 10 AND owner <> doc_id AS dropped FROM owned)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lines": OP2_SQL, "op6_top_k": OP6_SQL}
