"""Cleansed member rows with quality flags, score and quarantine mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.functions import tokens as T

BLOCKING_FLAGS = ("dob_unparseable", "last_name_missing", "ssn_token_format_invalid")
TOKENIZED = ("ssn", "email", "phone", "address_line_1", "address_line_2")


def cleanse(raw: DataFrame, secret: bytes, as_of: str) -> DataFrame:
    """raw: string columns partner_id, partner_member_id, first_name .. end_date. One select, then flags.

    Columns that raw lacks come out null. Personal values leave as tokens only: <field>_token of the partner, and
    ssn_xref, which is the same for all partners.
    """
    has = set(raw.columns)
    c = lambda name: F.col(name) if name in has else F.lit(None).cast("string")
    base = raw.select(
        c("silver_record_id").alias("silver_record_id"), "partner_id", "partner_member_id",
        N.clean_name(c("first_name")).alias("first_name"), N.clean_name(c("middle_name")).alias("middle_name"),
        N.clean_name(c("last_name")).alias("last_name"), F.trim(c("suffix")).alias("suffix"),
        c("dob").alias("dob_raw"), N.parse_date(c("dob")).alias("dob"), N.gender(c("gender")).alias("gender"),
        N.ssn_last4(c("ssn")).alias("ssn_last4"), T.cross_reference(secret, "ssn", c("ssn")).alias("ssn_xref"),
        *(T.tokenize(secret, c("partner_id"), f, c(f)).alias(f"{f}_token") for f in TOKENIZED),
        F.initcap(F.trim(c("city"))).alias("city"), N.state_letters(c("state")).alias("state"), N.zip_sql(c("zip")).alias("zip"),
        F.left(N.digits(c("zip4")), F.lit(4)).alias("zip4"),
        F.upper(F.trim(c("plan_code"))).alias("plan_code"), F.trim(c("employer_name")).alias("employer_name"),
        F.try_to_date(c("start_date"), "yyyy-MM-dd").alias("effective_start_date"),
        F.try_to_date(c("end_date"), "yyyy-MM-dd").alias("effective_end_date"),
        (F.col("load_no") if "load_no" in has else F.lit(1)).alias("contract_version"), "updated_at",
    )
    return quarantine(base.withColumn("quality_flags", quality_flags(as_of)))


def quality_flags(as_of: str):
    today = F.to_date(F.lit(as_of))
    rules = {
        "dob_unparseable": F.col("dob").isNull(),
        "dob_in_future": F.col("dob") > today,
        "dob_pre_1900": F.col("dob") < F.to_date(F.lit("1900-01-01")),
        "last_name_missing": F.coalesce("last_name", F.lit("")) == "",
        "first_name_missing": F.coalesce("first_name", F.lit("")) == "",
        "zip_invalid": ~F.col("zip").rlike("^[0-9]{5}$"),
        "state_invalid": F.length("state") != 2,
        "end_before_start": F.col("effective_end_date") < F.col("effective_start_date"),
        "ssn_token_format_invalid": ~F.col("ssn_token").startswith("tok_"),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def quarantine(df: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(1) - F.lit(0.1) * F.size("quality_flags"), F.lit(0)).cast("decimal(3,2)")
    return df.withColumn("quality_score", score).withColumn("is_quarantined", F.arrays_overlap("quality_flags", F.array(*map(F.lit, BLOCKING_FLAGS))))


def incremental(bronze: DataFrame, mark: str | None, column: str = "_ingested_at") -> DataFrame:
    """Rows from the high-water mark on (a full scan without one). The mark is the largest ingest time already taken, never a build time."""
    return bronze if mark is None else bronze.where(F.col(column) >= F.lit(mark).cast("timestamp"))


#: Fields of a raw JSON payload, and the spellings of the member id in the order they are tried.
PAYLOAD = ("first_name", "last_name", "middle_name", "suffix", "dob", "gender", "ssn", "email", "phone", "address_line_1", "address_line_2", "city", "state", "zip", "zip4", "start_date", "end_date", "plan_code", "employer_name")
MEMBER_ID_SPELLINGS = ("partner_member_id", "EmployeeID", "member_id")


def json_extract(bronze: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """bronze with one string column for each payload field and the member id; the JSON is parsed once."""
    names = [*MEMBER_ID_SPELLINGS, *PAYLOAD]
    got = bronze.withColumn("_j", F.from_json(payload, ", ".join(f"`{n}` string" for n in names)))
    rest = [F.col(f"`{c}`") for c in bronze.columns if c != payload]
    return got.select(*rest, F.coalesce(*(F.col("_j")[n] for n in MEMBER_ID_SPELLINGS)).alias("partner_member_id"), *(F.col("_j")[n].alias(n) for n in PAYLOAD))
