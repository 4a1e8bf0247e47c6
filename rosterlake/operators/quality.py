"""Declarative checks: a list of checks in, one result row per check out, and gates that read them.

All checks of a table that are plain counts share one aggregation; the others are one aggregation each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import STATES, Contract


@dataclass(frozen=True)
class Check:
    """A check of one table. value: the measure; passed: a condition on it as SQL over `value`."""

    name: str
    kind: str  # rows | missing | invalid | failed | duplicates | freshness_hours | groups
    columns: tuple[str, ...] = ()
    condition: str = ""
    passed: str = "value = 0"
    owner: str = "data-platform"
    severity: str = "error"
    where: str = "TRUE"


def _measure(check: Check, as_of: Column) -> Column | None:
    """The check as an aggregate expression, if it is one."""
    here = F.expr(check.where)
    missing = [F.col(c).isNull() for c in check.columns]
    if check.kind == "rows":
        return F.count_if(here)
    if check.kind == "missing":
        any_of = missing[0]
        for m in missing[1:]:
            any_of = any_of | m
        return F.count_if(here & any_of)
    if check.kind == "invalid":  # null is missing, not invalid
        return F.count_if(here & F.col(check.columns[0]).isNotNull() & ~F.expr(check.condition))
    if check.kind == "failed":
        return F.count_if(here & F.expr(check.condition))
    if check.kind == "freshness_hours":
        return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.max(F.when(here, F.col(check.columns[0]))))) / 3600)
    return None


def run_checks(df: DataFrame, checks: list[Check], as_of: str) -> DataFrame:
    """(name, owner, severity, value, passed), one row per check. A measure of nothing (freshness of no rows) fails."""
    now = F.lit(as_of).cast("timestamp")
    simple = [(c, m) for c in checks if (m := _measure(c, now)) is not None]
    result = lambda c, v: F.struct(F.lit(c.name).alias("name"), F.lit(c.owner).alias("owner"), F.lit(c.severity).alias("severity"), v.cast("long").alias("value"), F.lit(c.passed).alias("_rule"))
    parts = []
    if simple:
        row = df.agg(*(m.cast("long").alias(f"_{i}") for i, (_, m) in enumerate(simple)))
        parts.append(row.select(F.explode(F.array(*(result(c, F.col(f"_{i}")) for i, (c, _) in enumerate(simple)))).alias("_c")).select("_c.*"))
    for c in checks:
        if c.kind == "duplicates":  # keys that occur more than once
            n = df.where(c.where).groupBy(*c.columns).count().where("count > 1").agg(F.count(F.lit(1)).alias("v"))
        elif c.kind == "groups":  # groups whose aggregate meets the condition
            n = df.where(c.where).groupBy(*c.columns).agg(F.expr(c.condition).alias("_hit")).where("_hit").agg(F.count(F.lit(1)).alias("v"))
        else:
            continue
        parts.append(n.select(result(c, F.col("v")).alias("_c")).select("_c.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    verdict = F.lit(False)
    for rule in sorted({c.passed for c in checks}):
        verdict = F.when(F.col("_rule") == rule, F.coalesce(F.expr(rule), F.lit(False))).otherwise(verdict)
    return out.select("name", "owner", "severity", "value", verdict.alias("passed"))


_IN_STATES = "state IN ('" + "', '".join(STATES) + "')"
TOKEN_OK = "ssn_token LIKE 'tok\\\\_%'"
SILVER = [
    *(Check(f"missing_{c}", "missing", (c,)) for c in ("last_name", "first_name", "dob", "effective_start_date")),
    Check("invalid_dob", "invalid", ("dob",), "dob BETWEEN DATE '1900-01-01' AND DATE '2026-12-31'"),
    Check("invalid_state", "invalid", ("state",), _IN_STATES),
    Check("invalid_zip", "invalid", ("zip",), "zip RLIKE '^[0-9]{5}$'"),
    Check("invalid_ssn_last4", "invalid", ("ssn_last4",), "ssn_last4 RLIKE '^[0-9]{4}$'"),
    Check("duplicate_member", "duplicates", ("partner_id", "partner_member_id", "contract_version")),
    Check("end_date_after_start_date", "failed", (), "effective_end_date < effective_start_date"),
    Check("dob_not_after_eligibility_start", "failed", (), "dob > effective_start_date"),
    Check("ssn_token_format_check", "failed", (), f"ssn_token IS NOT NULL AND (NOT {TOKEN_OK} OR ssn_token RLIKE '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')", severity="critical", owner="security"),
]
BRONZE = [
    Check("freshness", "freshness_hours", ("_ingested_at",), passed="value < 30", severity="warn", owner="partner-success-mgr"),
    Check("row_count", "rows", passed="value > 0"),
]
MODEL_TESTS = [
    Check("unique_silver_record_id", "duplicates", ("silver_record_id",)),
    *(Check(f"not_null_{c}", "missing", (c,)) for c in ("silver_record_id", "partner_id", "partner_member_id")),
    *(Check(f"not_null_{c}", "missing", (c,), where="is_quarantined = false") for c in ("dob", "last_name")),
    Check("ssn_token_expression", "failed", (), f"NOT (ssn_token IS NULL OR {TOKEN_OK})"),
    Check("zip_expression", "failed", (), "NOT (zip IS NULL OR zip RLIKE '^[0-9]{5}$')"),
    Check("state_accepted_values", "failed", (), f"NOT {_IN_STATES}", where="state IS NOT NULL"),
    Check("quality_score_range", "failed", (), "NOT (quality_score >= 0 AND quality_score <= 1)"),
]
GOLD = [
    Check("missing_required", "missing", ("first_name", "last_name", "dob", "zip", "effective_start_date")),
    Check("duplicate_golden_record_id", "duplicates", ("golden_record_id",)),
    Check("one_golden_record_per_partner_member", "groups", ("primary_partner_id", "primary_partner_member_id"), "count(*) > 1"),
    Check("zero_active_members_alarm", "groups", ("primary_partner_id",), "count_if(is_active) = 0", severity="critical", owner="partner-success-mgr"),
]


def contract_checks(contract: Contract) -> list[Check]:
    """A contract's thresholds as checks of its partner's silver rows."""
    p = f"partner_id = '{contract.partner_id}'"
    size = f"value >= {contract.min_rows}" + (f" AND value <= {contract.max_rows}" if contract.max_rows is not None else "")
    return [
        *(Check(f"required_{f}", "missing", (f,), where=p) for f in contract.required_fields),
        Check("record_count", "rows", passed=size, where=p),
        Check("freshness", "freshness_hours", ("updated_at",), passed=f"value <= {contract.max_freshness_hours}", where=p, severity="warn"),
    ]


def quarantine_rate(good: DataFrame, quarantined: DataFrame, ts: str, as_of: str, days: int = 1, most_pct: float = 1.0) -> DataFrame:
    """One row: quarantined rows of the last days in per cent of landed ones (null if none landed), and whether that is allowed."""
    since = F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY")
    both = quarantined.select(ts, F.lit(True).alias("_bad")).unionByName(good.select(ts, F.lit(False).alias("_bad")))
    counts = both.agg(F.count_if(since & F.col("_bad")).alias("quarantined"), F.count_if(since & ~F.col("_bad")).alias("landed"))
    rate = F.col("quarantined") * F.lit(100.0) / F.nullif(F.col("landed"), F.lit(0))
    return counts.withColumn("pct", rate.cast("double")).withColumn("passed", F.coalesce(~(F.col("pct") > most_pct), F.lit(True)))


class GateClosed(RuntimeError):
    """A layer whose checks don't let the next one start."""


@dataclass
class Gate:
    """Blocks the next layer on failed checks of these severities, or on too large a share of failed rows or change in rows."""

    severities: tuple[str, ...] = ("error", "critical")
    most_failed_share: float = 0.05
    most_row_change: float | None = None
    failures: list[str] = field(default_factory=list)

    def read(self, results: DataFrame) -> bool:
        """results are one row per check, so they are read on the driver."""
        self.failures = [r["name"] for r in results.where(~F.col("passed") & F.col("severity").isin(*self.severities)).collect()]
        return not self.failures

    def page(self, failed_rows: int, rows: int) -> bool:
        return rows > 0 and failed_rows / rows > self.most_failed_share

    def steady(self, before: int, after: int) -> bool:
        return self.most_row_change is None or before == 0 or abs(after - before) / before < self.most_row_change

    def require(self, results: DataFrame) -> None:
        if not self.read(results):
            raise GateClosed(", ".join(sorted(self.failures)))


def scorecard(silver: DataFrame, decisions: DataFrame, incidents: DataFrame, as_of: str) -> DataFrame:
    """Per partner and week: rows, pass and resolve shares, median age in hours, open incidents, and the pass share against four weeks before.

    Medians are approximate within a ten-thousandth of the rows, so that no group is held in one place.
    """
    week = F.date_trunc("week", "updated_at").alias("week")
    settled = decisions.select("silver_record_id", F.col("decision").isin("AUTO_MATCH", "NO_MATCH").alias("_settled"))
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("updated_at")) / 3600
    rows = silver.join(settled, "silver_record_id", "left").groupBy("partner_id", week).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("is_quarantined"), 0.0).otherwise(1.0)).alias("pass_rate"),
        F.avg(F.when(F.coalesce("_settled", F.lit(False)), 1.0).otherwise(0.0)).alias("resolve_rate"), F.percentile_approx(age, 0.5, 10_000).alias("median_age_hours"),
    )
    open_ = incidents.where("closed_at IS NULL").groupBy("partner_id").agg(F.count(F.lit(1)).alias("open_incidents"))
    before = rows.select("partner_id", (F.col("week") + F.expr("INTERVAL '28' DAY")).alias("week"), F.col("pass_rate").alias("_before"))
    got = rows.join(before, ["partner_id", "week"], "left").join(open_, "partner_id", "left")
    return got.select("partner_id", "week", "n", "pass_rate", "resolve_rate", "median_age_hours", F.coalesce("open_incidents", F.lit(0)).alias("open_incidents"), (F.col("pass_rate") - F.col("_before")).alias("trend"))


def row_change(loads: DataFrame, most_pct: float = 15.0) -> DataFrame:
    """loads: partner_id, load_no, n. The change of each load against the one before it, and whether it is within the limit."""
    prior = loads.select("partner_id", (F.col("load_no") + 1).alias("load_no"), F.col("n").alias("prior"))
    got = loads.join(prior, ["partner_id", "load_no"])
    pct = F.abs(F.col("n") - F.col("prior")) * 100.0 / F.col("prior")
    return got.withColumn("change_pct", pct.cast("double")).withColumn("within", F.col("change_pct") <= most_pct)
