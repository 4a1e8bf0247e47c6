"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder
named in spark.checkpoint.dir and hands the reread rows to the next one. Stages before the last return the
columns of documents, and further ones if there are any, whatever their names. Rows are dropped by id and text, so
repeated and missing ids are judged one by one. Null texts count as empty, empty tables pass as empty tables, and
ties go the way that each operator states. Texts of any length are read as a whole.
"""

from __future__ import annotations

import secrets
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import common, exact_dedup, packing, pii, simhash, toxicity

#: Where the session names no key, pseudonyms are linked within one run of the application and can't be undone later.
_RANDOM_KEY = secrets.token_bytes(32)


def _one_of_each(docs: DataFrame, values: list[Column], verdicts: DataFrame, keys: list[str], row_bytes: int) -> DataFrame:
    """docs less the rows whose values (never null) are not _kept in verdicts by keys; of rows equal in kept keys one stays.

    keys: names that docs doesn't use.
    """
    columns = docs.columns
    found = common.settle(verdicts.groupBy(*keys).agg(F.min("_kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("NOT _kept OR _n > 1"))
    docs = docs.select("*", *(v.alias(k) for v, k in zip(values, keys, strict=True)))
    out = docs.join(common.broadcast_if_small(found.where("NOT _kept").select(*keys), row_bytes), keys, "left_anti")
    repeated = found.where("_kept").select(*keys)
    if repeated.isEmpty():
        return out.select(*columns)
    repeated = common.broadcast_if_small(repeated, row_bytes)
    again = out.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_row"))
    return out.join(repeated, keys, "left_anti").select(*columns).unionByName(again.select("_row.*").select(*columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects at the threshold of their language go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels).where(~F.col("rejected")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the largest doc_id stays."""
    verdicts = exact_dedup.exact_dedup(docs)
    sha = F.sha2(common.ascii_lower(common.text_or_empty("text")), 256)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keys = common.unused([*docs.columns, "kept"], "_name", "_sha")
    verdicts = verdicts.select(named.alias(keys[0]), F.col("text_sha256").alias(keys[1]), F.col("kept").alias("_kept"))
    return _one_of_each(docs, [named, sha], verdicts, keys, 160)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles (similarity 0.8 or more, candidates by SimHash) the smallest doc_id stays."""
    keys = common.unused([*docs.columns, "kept"], "_rk1", "_rk2")
    verdicts = simhash.near_duplicates(docs.select("doc_id", "text")).select(F.col("_rk1").alias(keys[0]), F.col("_rk2").alias(keys[1]), F.col("kept").alias("_kept"))
    return _one_of_each(docs, common.row_key("doc_id", "text"), verdicts, keys, 64)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated personal data become pseudonyms of the same format and length, by the key of spark.rosterlake.pii.key."""
    spans = common.unused(docs.columns, "_pii_spans")[0]
    return pii.pseudonymise_documents(docs, pii.configured_key(spark) or _RANDOM_KEY, spans_col=spans).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("pii", pseudonymise),
    ("best-fit packing", pack),
]

#: Training a classifier and tokenizing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
