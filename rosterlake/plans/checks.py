"""Queries of quality: checks of the layers, thresholds, rates, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import quality as Q
from rosterlake.operators.contracts import STATES, Contract, ContractColumn

from . import duck as D
from .registry import decisions, gold, query, silver, table
from .roster import AS_OF

NOW = f"{AS_OF} 00:00:00"
_IN = "state IN (" + ", ".join(f"'{s}'" for s in STATES) + ")"
_row = lambda name, owner, severity, value, passed="v = 0", of="silver": f"SELECT '{name}' AS name, '{owner}' AS owner, '{severity}' AS severity, v AS value, coalesce({passed}, FALSE) AS passed FROM (SELECT CAST({value} AS BIGINT) AS v FROM {of}) x"
_DP, _ERR = "data-platform", "error"
_n = "count(*) FILTER (WHERE {0})".format


@query(f"{D.SILVER} " + " UNION ALL ".join([
    *(_row(f"missing_{c}", _DP, _ERR, _n(f"{c} IS NULL")) for c in ("last_name", "first_name", "dob", "effective_start_date")),
    _row("invalid_dob", _DP, _ERR, _n("dob < DATE '1900-01-01' OR dob > DATE '2026-12-31'")),
    _row("invalid_state", _DP, _ERR, _n(f"state IS NOT NULL AND NOT {_IN}")),
    _row("invalid_zip", _DP, _ERR, _n("zip IS NOT NULL AND NOT regexp_full_match(zip, '[0-9]{5}')")),
    _row("invalid_ssn_last4", _DP, _ERR, _n("ssn_last4 IS NOT NULL AND NOT regexp_full_match(ssn_last4, '[0-9]{4}')")),
    _row("duplicate_member", _DP, _ERR, "count(*)", of="(SELECT 1 FROM silver GROUP BY partner_id, partner_member_id, contract_version HAVING count(*) > 1) y"),
    _row("end_date_after_start_date", _DP, _ERR, _n("effective_end_date < effective_start_date")),
    _row("dob_not_after_eligibility_start", _DP, _ERR, _n("dob > effective_start_date")),
    _row("ssn_token_format_check", "security", "critical", "0 * count(*)"),
]))
def quality_silver(spark, sf_dir):
    """agg_missing, agg_invalid, agg_dup_count and failed_rows as one list of checks."""
    return Q.run_checks(silver(spark, sf_dir), Q.SILVER, NOW)


@query(f"{D.SILVER} " + " UNION ALL ".join([
    _row("unique_silver_record_id", _DP, _ERR, "count(*)", of="(SELECT 1 FROM silver GROUP BY silver_record_id HAVING count(*) > 1) y"),
    *(_row(f"not_null_{c}", _DP, _ERR, _n(f"{c} IS NULL")) for c in ("silver_record_id", "partner_id", "partner_member_id")),
    *(_row(f"not_null_{c}", _DP, _ERR, _n(f"{c} IS NULL AND NOT is_quarantined")) for c in ("dob", "last_name")),
    _row("ssn_token_expression", _DP, _ERR, "0 * count(*)"),
    _row("zip_expression", _DP, _ERR, _n("zip IS NOT NULL AND NOT regexp_full_match(zip, '[0-9]{5}')")),
    _row("state_accepted_values", _DP, _ERR, _n(f"state IS NOT NULL AND NOT {_IN}")),
    _row("quality_score_range", _DP, _ERR, _n("quality_score < 0 OR quality_score > 1")),
]))
def dbt_tests(spark, sf_dir):
    """The model's declared tests."""
    return Q.run_checks(silver(spark, sf_dir), Q.MODEL_TESTS, NOW)


@query(f"{D.GOLD} " + " UNION ALL ".join([
    _row("missing_required", _DP, _ERR, _n("first_name IS NULL OR last_name IS NULL OR dob IS NULL OR zip IS NULL OR effective_start_date IS NULL"), of="gold"),
    _row("duplicate_golden_record_id", _DP, _ERR, "count(*)", of="(SELECT 1 FROM gold GROUP BY golden_record_id HAVING count(*) > 1) y"),
    _row("one_golden_record_per_partner_member", _DP, _ERR, "count(*)", of="(SELECT 1 FROM gold GROUP BY primary_partner_id, primary_partner_member_id HAVING count(*) > 1) y"),
    _row("zero_active_members_alarm", "partner-success-mgr", "critical", "count(*)", of="(SELECT 1 FROM gold GROUP BY primary_partner_id HAVING count(*) FILTER (WHERE is_active) = 0) y"),
]))
def quality_gold(spark, sf_dir):
    return Q.run_checks(gold(spark, sf_dir), Q.GOLD, NOW)


@query(f"{D.SILVER} " + " UNION ALL ".join([
    _row("freshness", "partner-success-mgr", "warn", f"floor(epoch(TIMESTAMP '{NOW}' - max(updated_at)) / 3600)", "v < 30"),
    _row("row_count", _DP, _ERR, "count(*)", "v > 0"),
]))
def quality_bronze(spark, sf_dir):
    """agg_freshness and agg_row_count."""
    return Q.run_checks(silver(spark, sf_dir).withColumnRenamed("updated_at", "_ingested_at"), Q.BRONZE, NOW)


@query(f"{D.SILVER}, mine AS (SELECT * FROM silver WHERE partner_id = 'partner_1') " + " UNION ALL ".join([
    *(_row(f"required_{c}", _DP, _ERR, _n(f"{c} IS NULL"), of="mine") for c in ("partner_member_id", "first_name", "last_name", "dob", "zip")),
    _row("record_count", _DP, _ERR, "count(*)", "v >= 100 AND v <= 1000000", "mine"),
    _row("freshness", _DP, "warn", f"floor(epoch(TIMESTAMP '{NOW}' - max(updated_at)) / 3600)", "v <= 30", "mine"),
]))
def contract_thresholds(spark, sf_dir):
    contract = Contract("partner_1", [ContractColumn("a", "dob")], min_rows=100, max_rows=1_000_000)
    return Q.run_checks(silver(spark, sf_dir), Q.contract_checks(contract), NOW)


@query(f"{D.SILVER} SELECT name, passed FROM (SELECT 'silver' AS name, count(*) FILTER (WHERE is_quarantined) / count(*)::DOUBLE <= 0.05 AS passed FROM silver UNION ALL SELECT 'serving', abs(count(*) FILTER (WHERE load_no = 2) - count(*) FILTER (WHERE load_no = 1)) / count(*) FILTER (WHERE load_no = 1)::DOUBLE < 0.001 FROM silver UNION ALL SELECT 'gold', FALSE) x")
def layer_gates(spark, sf_dir):
    """Which of three layers may start: silver by its share of failed rows, gold by its checks, serving by the change in rows."""
    s = silver(spark, sf_dir)
    counts = s.agg(F.count_if("is_quarantined").alias("bad"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("contract_version") == 1).alias("before"), F.count_if(F.col("contract_version") == 2).alias("after")).first()
    gate = Q.Gate(most_row_change=0.001)
    rows = [("silver", not gate.page(counts["bad"], counts["n"])), ("gold", gate.read(Q.run_checks(gold(spark, sf_dir), Q.GOLD, NOW))), ("serving", gate.steady(counts["before"], counts["after"]))]
    return spark.createDataFrame(rows, "name string, passed boolean")


@query(f"{D.SILVER} SELECT q AS quarantined, g AS landed, q * 100.0::DOUBLE / nullif(g, 0) AS pct, coalesce(NOT (q * 100.0::DOUBLE / nullif(g, 0) > 1), TRUE) AS passed FROM (SELECT count(*) FILTER (WHERE is_quarantined AND updated_at >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY) AS q, count(*) FILTER (WHERE NOT is_quarantined AND updated_at >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY) AS g FROM silver) x")
def agg_quarantine_rate(spark, sf_dir):
    s = silver(spark, sf_dir)
    return Q.quarantine_rate(s.where("NOT is_quarantined"), s.where("is_quarantined"), "updated_at", NOW, 2)


@query(f"{D.SILVER} SELECT partner_id, count(*) AS n_rows, count(*) FILTER (WHERE is_quarantined) AS n_quarantined, count(*) FILTER (WHERE is_quarantined) / CAST(count(*) AS DOUBLE) AS rate FROM silver GROUP BY partner_id")
def agg_quarantine(spark, sf_dir):
    bad = F.count_if("is_quarantined")
    return silver(spark, sf_dir).groupBy("partner_id").agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("n_quarantined"), (bad / F.count(F.lit(1))).alias("rate"))


@query(f"{D.SILVER} SELECT partner_id, count(*) FILTER (WHERE effective_end_date IS NULL OR effective_end_date >= DATE '{AS_OF}') AS active, count(*) AS total, max(updated_at) AS last_updated FROM silver GROUP BY partner_id")
def agg_filter_counts(spark, sf_dir):
    ended = F.col("effective_end_date") < F.to_date(F.lit(AS_OF))
    return silver(spark, sf_dir).groupBy("partner_id").agg(F.count_if(~F.coalesce(ended, F.lit(False))).alias("active"), F.count(F.lit(1)).alias("total"), F.max("updated_at").alias("last_updated"))


@query(f"{D.SILVER} SELECT partner_id, partner_member_id, max(updated_at) AS last_seen FROM silver GROUP BY ALL")
def agg_last_seen(spark, sf_dir):
    return silver(spark, sf_dir).groupBy("partner_id", "partner_member_id").agg(F.max("updated_at").alias("last_seen"))


@query(f"{D.SILVER} SELECT partner_id, partner_member_id, count(*) AS n FROM silver GROUP BY ALL HAVING count(*) > 1")
def agg_dup_count(spark, sf_dir):
    """Members that both loads hold."""
    return silver(spark, sf_dir).groupBy("partner_id", "partner_member_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"{D.SILVER} SELECT partner_id FROM silver GROUP BY partner_id HAVING count(*) FILTER (WHERE effective_end_date IS NULL OR effective_end_date >= DATE '{AS_OF}') = 0")
def agg_zero_active(spark, sf_dir):
    ended = F.col("effective_end_date") < F.to_date(F.lit(AS_OF))
    return silver(spark, sf_dir).groupBy("partner_id").agg(F.bool_and(F.coalesce(ended, F.lit(False))).alias("all_ended")).where("all_ended").select("partner_id")


@query(f"{D.GOLD} SELECT primary_partner_id, primary_partner_member_id, count(*) AS ct FROM gold GROUP BY ALL HAVING count(*) > 1")
def agg_one_golden(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("primary_partner_id", "primary_partner_member_id").agg(F.count(F.lit(1)).alias("ct")).where("ct > 1")


@query(f"{D.DECISIONS} SELECT count(*) AS pending FROM decisions WHERE decision = 'REVIEW' HAVING count(*) > 5")
def agg_review_backlog(spark, sf_dir):
    """Decisions under review for over a week, reported above a limit (500 in production, 5 here)."""
    old = F.col("decided_at") < F.lit("2024-07-08").cast("timestamp") - F.expr("INTERVAL '7' DAY")
    return decisions(spark, sf_dir).where((F.col("decision") == "REVIEW") & old).agg(F.count(F.lit(1)).alias("pending")).where("pending > 5")


@query(f"{D.SILVER} SELECT silver_record_id, CASE WHEN effective_end_date < effective_start_date THEN 'end_before_start' ELSE 'dob_after_start' END AS reason FROM silver WHERE effective_end_date < effective_start_date OR dob > effective_start_date")
def failed_rows(spark, sf_dir):
    reason = F.when(F.expr("effective_end_date < effective_start_date"), "end_before_start").when(F.expr("dob > effective_start_date"), "dob_after_start").when(F.expr(f"NOT ssn_token LIKE 'tok\\\\_%' OR ssn_token RLIKE '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'"), "token_leak")
    return silver(spark, sf_dir).select("silver_record_id", reason.alias("reason")).where("reason IS NOT NULL")


@query(f"""{D.DECISIONS}, w AS (
  SELECT partner_id, date_trunc('week', updated_at)::TIMESTAMP AS week, count(*) AS n, avg(CASE WHEN is_quarantined THEN 0.0 ELSE 1.0 END) AS pass_rate, avg(CASE WHEN d.decision IN ('AUTO_MATCH', 'NO_MATCH') THEN 1.0 ELSE 0.0 END) AS resolve_rate
  FROM silver s LEFT JOIN decisions d USING (silver_record_id) GROUP BY ALL)
SELECT w.partner_id, w.week, w.n, round(w.pass_rate, 9) AS pass_rate, round(w.resolve_rate, 9) AS resolve_rate, CASE WHEN w.partner_id = 'partner_0' THEN 1 ELSE 0 END AS open_incidents, round(w.pass_rate - b.pass_rate, 9) AS trend
FROM w LEFT JOIN w b ON b.partner_id = w.partner_id AND b.week + INTERVAL 28 DAY = w.week""")
def agg_scorecard(spark, sf_dir):
    incidents = spark.createDataFrame([("partner_0", None), ("partner_1", "2024-06-01")], "partner_id string, closed_at string")
    got = Q.scorecard(silver(spark, sf_dir), decisions(spark, sf_dir), incidents, NOW)
    return got.drop("median_age_hours").withColumns({c: F.round(c, 9) for c in ("pass_rate", "resolve_rate", "trend")})


@query(f"{D.SILVER}, l AS (SELECT partner_id, load_no, count(*) AS n FROM silver GROUP BY ALL) SELECT b.partner_id, b.load_no, b.n, a.n AS prior, round(abs(b.n - a.n) * 100.0::DOUBLE / a.n, 9) AS change_pct, abs(b.n - a.n) * 100.0::DOUBLE / a.n <= 15 AS within FROM l b JOIN l a ON a.partner_id = b.partner_id AND a.load_no + 1 = b.load_no")
def agg_row_change(spark, sf_dir):
    loads = silver(spark, sf_dir).groupBy("partner_id", F.col("contract_version").alias("load_no")).agg(F.count(F.lit(1)).alias("n"))
    return Q.row_change(loads).withColumn("change_pct", F.round("change_pct", 9))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def agg_quantile(spark, sf_dir):
    """The 95th percentile by a mergeable summary; exact as long as a group is smaller than its accuracy."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", 0.95, 100_000).alias("p95"))


