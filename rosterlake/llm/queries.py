"""Driver queries of the training-data operators, and their DuckDB equivalents where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, license_scan, line_dedup, packing, pii, simhash, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For repeatable tests of the query alone; a deployment names its own in the session (pii.configured_key).
QUERY_KEY = b"rosterlake fixed key for repeatable queries"


def op1_pii(spark, sf_dir):
    out = pii.pseudonymise_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.configured_key(spark) or QUERY_KEY)
    return out.select("doc_id", F.size("pii_spans").alias("n_found"), "text", "pii_spans")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    out = toxicity.score_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "threshold", "rejected")


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"), digest=True)


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_embedding_dedup(spark, sf_dir):
    return embed_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op7_bpe(spark, sf_dir):
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True)


def op8_license_scan(spark, sf_dir):
    out = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    return out.withColumn("score", F.round("score", 6))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), digest=True)


def op10_simhash(spark, sf_dir):
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_pii, op2_exact_dedup, op3_toxicity, op4_suffix_dedup, op5_best_fit_packing, op6_embedding_dedup, op7_bpe, op8_license_scan, op9_line_dedup, op10_simhash)}

ORACLE_SQL = {"op2_exact_dedup": exact_dedup.SQL, "op6_embedding_dedup": embed_dedup.SQL, "op8_license_scan": license_scan.sql(), "op9_line_dedup": line_dedup.SQL}
