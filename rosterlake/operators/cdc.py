"""Change envelopes to normalised events: one chain of expressions, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.functions import tokens as T

from .contracts import contract_map_entries, member_id_fallback

ENVELOPE = "op string, before map<string,string>, after map<string,string>, source struct<partner_id:string, lsn:string>, ts_ms bigint"
# Fields that leave as tokens only.
TIER_1 = ("ssn", "email", "phone", "address_line_1", "address_line_2")
#: Fields of the published event besides tokens.
PLAIN = ("first_name", "middle_name", "last_name", "suffix", "dob", "gender", "city", "state", "zip", "zip4", "effective_start_date", "effective_end_date", "plan_code", "employer_name")


def operation(op: Column) -> Column:
    """delete, upsert, or null for an operation that is none."""
    return F.when(op == "d", "delete").when(op.isin("c", "u", "r"), "upsert")


def process(envelopes: DataFrame, mapping: dict[str, str], secret: bytes, carry: tuple[str, ...] = ()) -> DataFrame:
    """Events of known operations: partner, member, operation, time, LSN, the normalised fields and tokens, problem.

    A delete is read from `before`, others from `after`. The last four digits of an SSN are kept before it becomes a
    token; values are tokenized as they come. First and last names, birth date, ZIP and state are normalised. Columns
    named in carry pass through. No row fails: problem says why one can't be used (no partner, no time, no row).
    """
    got = envelopes.withColumn("operation", operation(F.col("op"))).where("operation IS NOT NULL")
    row = F.when(F.col("operation") == "delete", F.col("before")).otherwise(F.col("after"))
    got = got.withColumn("_row", F.coalesce(row, F.create_map().cast("map<string,string>"))).withColumn("_c", contract_map_entries(F.col("_row"), mapping))
    c = lambda name: F.col("_c")[name]
    partner = F.coalesce("source.partner_id", F.lit("unknown"))
    has = lambda name: F.map_contains_key("_c", F.lit(name))
    normal = {
        "first_name": F.when(has("first_name"), N.normalize_name(c("first_name"))),
        "last_name": F.when(has("last_name"), N.normalize_name(c("last_name"))),
        "dob": F.nullif(N.normalize_dob(c("dob")), F.lit("")),
        "zip": F.nullif(N.normalize_zip(c("zip")), F.lit("")),
        "state": N.state_cdc(c("state")),
    }
    problem = F.when(F.col("source.partner_id").isNull(), "no partner").when(F.col("ts_ms").isNull(), "no time").when(row.isNull(), "no row")
    return got.select(
        *carry, partner.alias("partner_id"), member_id_fallback(c("partner_member_id"), F.col("_row")).alias("partner_member_id"), "operation",
        F.timestamp_millis("ts_ms").alias("occurred_at"), F.nullif(F.col("source.lsn"), F.lit("")).alias("source_lsn"), F.col("ts_ms"),
        *(normal.get(f, c(f)).alias(f) for f in PLAIN), N.ssn_last4(c("ssn")).alias("ssn_last4"),
        *(T.tokenize(secret, partner, f, c(f)).alias(f"{f}_token") for f in TIER_1), problem.alias("problem"),
    )


def order_of(events: DataFrame) -> list[Column]:
    """Later changes order higher: by time, then by the LSN as a number where it is one, else as text."""
    return [F.col("ts_ms"), F.expr("try_cast(source_lsn AS DECIMAL(38,0))"), F.coalesce("source_lsn", F.lit(""))]


def latest(events: DataFrame) -> DataFrame:
    """The last change of each member."""
    whole = F.struct(*events.columns)
    return events.groupBy("partner_id", "partner_member_id").agg(F.max_by(whole, F.struct(*order_of(events))).alias("_r")).select("_r.*")


def apply_deletes(state: DataFrame) -> DataFrame:
    """A deleted member keeps its row and gets the day of the deletion as the end of coverage."""
    ended = F.when(F.col("operation") == "delete", F.date_format("occurred_at", "yyyy-MM-dd")).otherwise(F.col("effective_end_date"))
    return state.withColumn("effective_end_date", ended)
