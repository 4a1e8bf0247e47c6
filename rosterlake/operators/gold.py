"""Golden records: assignment by decisions, the newest row of each, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARRIED = (
    "first_name", "middle_name", "last_name", "suffix", "dob", "gender", "city", "state", "zip", "zip4", "ssn_token", "ssn_last4", "email_token", "phone_token",
    "address_line_1_token", "address_line_2_token", "effective_start_date", "effective_end_date", "plan_code", "employer_name",
)
SETTLED = ("AUTO_MATCH", "NO_MATCH")


def is_active(end: Column, as_of: str) -> Column:
    return end.isNull() | (end >= F.to_date(F.lit(as_of)))


def assign(silver: DataFrame, decisions: DataFrame, hold_review: bool = False) -> DataFrame:
    """Eligible silver rows with golden_record_id: the matched one, else their own id.

    A record under review has no settled decision, so it becomes a golden record of its own, or is left out if hold_review.
    """
    eligible = silver.where(~F.col("is_quarantined"))
    if hold_review:
        eligible = eligible.join(decisions.where("decision = 'REVIEW'").select("silver_record_id"), "silver_record_id", "left_anti")
    settled = decisions.where(F.col("decision").isin(*SETTLED)).select("silver_record_id", "matched_golden_record_id")
    return eligible.join(settled, "silver_record_id", "left").withColumn("golden_record_id", F.coalesce("matched_golden_record_id", "silver_record_id")).drop("matched_golden_record_id")


def newest_first() -> Column:
    """Orders rows of a golden record: newest, then by record id."""
    return F.struct(-F.unix_micros("updated_at"), "silver_record_id")


def gold_build(silver: DataFrame, decisions: DataFrame, as_of: str, built_at: str, hold_review: bool = False) -> DataFrame:
    """One row per golden record: its newest silver row, all its partners and silver records, and whether it is active."""
    rows = assign(silver, decisions, hold_review)
    newest = F.min_by(F.struct(F.col("partner_id").alias("primary_partner_id"), F.col("partner_member_id").alias("primary_partner_member_id"), *CARRIED, F.col("updated_at").alias("last_source_update_at"), "quality_score"), newest_first())
    got = rows.groupBy("golden_record_id").agg(newest.alias("_r"), F.sort_array(F.collect_set("partner_id")).alias("source_partner_ids"), F.sort_array(F.collect_set("silver_record_id")).alias("source_silver_record_ids"))
    stamp = F.lit(built_at).cast("timestamp")
    return got.select("golden_record_id", "_r.*", "source_partner_ids", "source_silver_record_ids", is_active(F.col("_r.effective_end_date"), as_of).alias("is_active"), stamp.alias("created_at"), stamp.alias("updated_at"))


def sources_of(golden: DataFrame, silver: DataFrame) -> DataFrame:
    """golden_record_id with each silver row in its array of sources: the array is exploded, so the join is an equi-join."""
    return golden.select("golden_record_id", F.explode("source_silver_record_ids").alias("silver_record_id")).join(silver, "silver_record_id")


def name_refresh(golden: DataFrame, silver: DataFrame) -> DataFrame:
    """The most recent source of each golden record and the name that it gives."""
    got = sources_of(golden, silver).groupBy("golden_record_id").agg(F.min_by(F.struct(F.col("partner_id").alias("most_recent_partner"), "last_name", "first_name", "updated_at"), newest_first()).alias("_r"))
    return got.select("golden_record_id", "_r.*")


def attrition(golden: DataFrame, silver: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Active members whose partner has not sent them for over `days` days, never seen ones first."""
    seen = silver.groupBy("partner_id", "partner_member_id").agg(F.max("updated_at").alias("last_seen_at"))
    expected = golden.where("is_active").select(F.col("primary_partner_id").alias("partner_id"), F.col("primary_partner_member_id").alias("partner_member_id"))
    today = F.lit(as_of).cast("timestamp")
    missing = expected.join(seen, ["partner_id", "partner_member_id"], "left").where(F.col("last_seen_at").isNull() | (F.col("last_seen_at") < today - F.expr(f"INTERVAL '{days}' DAY")))
    out = missing.withColumn("days_since_seen", F.datediff(today, "last_seen_at"))
    return out.orderBy(F.desc_nulls_first("days_since_seen"), "partner_id", "partner_member_id")


def duplicate_signals(silver: DataFrame) -> DataFrame:
    """(signal, key, silver_records, partners, uniq_ids): one SSN under several members, or one birth date, surname sound, ZIP3 and initial."""
    member = F.concat_ws("|", "partner_id", "partner_member_id")
    newest = F.transform(F.sort_array(F.collect_list(F.struct("updated_at", "silver_record_id")), False), lambda x: x["silver_record_id"]).alias("silver_records")
    both = [newest, F.sort_array(F.collect_set("partner_id")).alias("partners"), F.count_distinct(member).alias("members"), F.count(F.lit(1)).alias("occurrences")]
    rows = silver.where(~F.col("is_quarantined"))
    hard = rows.where(F.col("ssn_xref").isNotNull()).groupBy("ssn_xref").agg(*both).where("members > 1").select(F.lit("hard_ssn_match").alias("signal"), F.col("ssn_xref").alias("key"), "silver_records", "partners", F.col("occurrences").alias("uniq_ids"))
    parts = [F.col("dob").cast("string").alias("_d"), F.soundex("last_name").alias("_sx"), F.left("zip", F.lit(3)).alias("_z"), F.upper(F.left("first_name", F.lit(1))).alias("_i")]
    soft = rows.where(F.col("dob").isNotNull()).select("*", *parts).groupBy("_d", "_sx", "_z", "_i").agg(*both).where("members > 1")
    soft = soft.select(F.lit("soft_demo_match").alias("signal"), F.concat_ws("|", "_d", "_sx", "_z", "_i").alias("key"), "silver_records", "partners", F.col("members").alias("uniq_ids"))
    return hard.unionByName(soft)


def outbox(old: DataFrame, new: DataFrame, key: str, enqueued_at: str) -> DataFrame:
    """Changes between two versions as outbox rows: upsert with the new row, delete with the old one."""
    cols = sorted(c for c in new.columns if c != key)
    pack = lambda d, name: d.select(key, F.struct(*cols).alias(name))
    both = pack(old, "_o").join(pack(new, "_n"), key, "full_outer").where(~F.col("_o").eqNullSafe(F.col("_n")))
    gone = F.col("_n").isNull()
    stamp = F.lit(enqueued_at).cast("timestamp")
    return both.select(
        F.sha2(F.concat_ws("|", key, F.when(gone, "delete").otherwise("upsert"), stamp.cast("string")), 256).alias("outbox_id"), key,
        F.when(gone, "delete").otherwise("upsert").alias("operation"), F.to_json(F.coalesce("_n", "_o")).alias("payload"),
        stamp.alias("enqueued_at"), F.lit(None).cast("timestamp").alias("delivered_at"), F.lit(0).alias("delivery_attempts"),
    )


def run_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed): records only old, only new, equal, or changed with the fields that differ."""
    pack = lambda d, name: d.select(key, F.struct(*fields).alias(name))
    both = pack(old, "_o").join(pack(new, "_n"), key, "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"_o.{f}").eqNullSafe(F.col(f"_n.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("_n").isNull(), "dropped").when(F.col("_o").isNull(), "added").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(key, change.alias("change"), F.when(change == "changed", F.array_join(differ, ",")).otherwise("").alias("changed"))


def agreement(diff: DataFrame) -> DataFrame:
    """The share of records that both runs have alike."""
    return diff.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("change") == "same").alias("agree")).withColumn("rate", F.col("agree") / F.col("records"))


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the largest by `order`: the state after last-write-wins."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def merge_upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target with changes applied by key: the latest change of a key replaces its row. order may use columns of changes only."""
    latest = keep_latest(changes, keys, order).select(*target.columns)
    return target.join(latest, keys, "left_anti").select(*target.columns).unionByName(latest)
