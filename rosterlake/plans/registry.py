"""The registry of queries with their DuckDB SQL, and the derived inputs that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.operators import gold as G
from rosterlake.operators import resolve as R
from rosterlake.operators import silver as S
from rosterlake.operators import verify as V
from rosterlake.operators.settle import settle

from .duck import SECRET as QUERY_SECRET
from .roster import AS_OF, ROSTER

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BUILT_AT = "2024-06-30 00:00:00"


def query(sql: str | None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def secret(spark: SparkSession) -> bytes:
    """The key that the session names in spark.rosterlake.secret. Only without one the test key of the queries, which guards nothing."""
    named = spark.conf.get("spark.rosterlake.secret", None)
    return named.encode() if named else QUERY_SECRET


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROSTER.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cleanse(roster(spark, sf_dir), secret(spark), AS_OF)


def prepared(spark: SparkSession, sf_dir: str, where: str = "TRUE") -> DataFrame:
    rows = roster(spark, sf_dir).where(where).withColumn("position", 2 * F.col("k") + F.col("load_no"))
    return R.prepare(rows, "silver_record_id", secret(spark))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each SSN; without an SSN, another record of equal birth date, name sounds and ZIP asks for review."""
    rows = settle(prepared(spark, sf_dir), "prepared")
    index = R.as_index(rows)
    sure = R.match_ssn(rows, index).select("id", "golden_id")
    alike = R.match_soundex(rows.where("ssn_token IS NULL"), index).where("golden_id <> id").select("id", F.lit(True).alias("_review"))
    got = rows.select("id").join(sure, "id", "left").join(alike, "id", "left")
    verdict = F.when(F.col("golden_id").isNotNull(), "AUTO_MATCH").when(F.col("_review"), "REVIEW").otherwise("NO_MATCH")
    return got.select(F.col("id").alias("silver_record_id"), F.col("golden_id").alias("matched_golden_record_id"), verdict.alias("decision"), F.lit(BUILT_AT).cast("timestamp").alias("decided_at"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden layer, materialised as layers are."""
    return settle(G.gold_build(silver(spark, sf_dir), decisions(spark, sf_dir), AS_OF, BUILT_AT), "gold")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    last = F.when(k % 11 == 5, F.concat(F.left("last_name", F.lit(4)), F.lit("zz"))).otherwise(F.col("last_name"))
    digits = F.when(F.col("ssn").isNotNull(), F.right(N.digits(F.col("ssn")), F.lit(4)))
    return V.validate_requests(roster(spark, sf_dir).select(F.col("silver_record_id").alias("request_id"), "first_name", last.alias("last_name"), N.parse_date(F.col("dob")).alias("dob"), F.when(k % 13 == 6, "1").otherwise(F.col("zip")).alias("zip"), F.when(k % 3 == 0, F.lit(None)).when(k % 7 == 2, "12a4").otherwise(digits).alias("ssn_last4")))
