"""The roster queries: field rules, silver and simple filters here; people, feeds and checks in their own modules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.operators import resolve as R

from . import checks, feeds, people  # noqa: F401  they register their queries
from . import duck as D
from .registry import ORACLE_SQL, QUERIES, query, roster, silver, table
from .roster import AS_OF, ROSTER

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- filters and single expressions that both engines read alike: one text over each engine's own silver
_D = f"DATE '{AS_OF}'"
SHARED: dict[str, str] = {
    "quarantine_filter": "SELECT silver_record_id, partner_id, quality_score FROM silver WHERE NOT is_quarantined",
    "is_active": f"SELECT silver_record_id, effective_end_date IS NULL OR effective_end_date >= {_D} AS is_active FROM silver",
    "ineligible_pred": f"SELECT silver_record_id, coalesce(effective_end_date < {_D}, FALSE) AS ineligible FROM silver",
    "lookup_key": "SELECT silver_record_id, concat_ws('#', zip, CAST(dob AS STRING), lower(trim(last_name))) AS lookup_key FROM silver",

}


def _shared(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(re.sub(r"\b(FROM|JOIN) silver\b", r"\1 {silver}", sql), silver=silver(spark, sf_dir))

    return run


for _name, _sql in SHARED.items():
    QUERIES[_name], ORACLE_SQL[_name] = _shared(_sql), f"{D.SILVER} {_sql}"

# ---- silver

_TOKENS = ", ".join(f"{sql} AS {name}" for name, sql in D.TOKENS.items())
_PLAIN = ("silver_record_id", "first_name", "middle_name", "last_name", "dob", "gender", "ssn_last4", "city", "state", "zip", "plan_code", "employer_name", "effective_start_date", "effective_end_date", "is_quarantined")


@query(f"{D.SILVER} SELECT {', '.join(_PLAIN)}, {_TOKENS}, {D.XREF} AS ssn_xref, array_to_string(quality_flags, ',') AS quality_flags, CAST(quality_score AS DOUBLE) AS quality_score FROM silver")
def silver_member(spark, sf_dir):
    """Cleansed rows with tokens, flags, score and quarantine mark."""
    return silver(spark, sf_dir).select(*_PLAIN, *D.TOKENS, "ssn_xref", F.array_join("quality_flags", ",").alias("quality_flags"), F.col("quality_score").cast("double").alias("quality_score"))


@query(f"{D.SILVER}, a AS (SELECT silver_record_id, list_filter([CASE WHEN ssn_last4 IN ('0000', '1234', '9999') THEN 'ssn_last4_suspicious' END, CASE WHEN dob > {_D} THEN 'dob_in_future' END, CASE WHEN dob < DATE '1900-01-01' THEN 'dob_pre_1900' END, CASE WHEN NOT regexp_full_match(zip, '[0-9]{{5}}') THEN 'zip_invalid' END, CASE WHEN zip = '00000' THEN 'zip_placeholder' END, CASE WHEN length(state) <> 2 THEN 'state_not_two_char' END], lambda x: x IS NOT NULL) AS f FROM silver) SELECT silver_record_id, array_to_string(f, ',') AS anomalies FROM a WHERE len(f) > 0")
def format_anomalies(spark, sf_dir):
    rules = {
        "ssn_last4_nondigits": ~F.col("ssn_last4").rlike("^[0-9]{4}$"), "ssn_last4_suspicious": F.col("ssn_last4").isin("0000", "1234", "9999"), "dob_in_future": F.col("dob") > F.to_date(F.lit(AS_OF)),
        "dob_pre_1900": F.col("dob") < F.to_date(F.lit("1900-01-01")), "zip_invalid": ~F.col("zip").rlike("^[0-9]{5}$"), "zip_placeholder": F.col("zip") == "00000", "state_not_two_char": F.length("state") != 2,
        "email_token_invalid": ~F.col("email_token").startswith("tok_"),
    }
    d = silver(spark, sf_dir).withColumn("_a", F.array_compact(F.array(*(F.when(r, F.lit(k)) for k, r in rules.items()))))
    return d.where(F.size("_a") > 0).select("silver_record_id", F.array_join("_a", ",").alias("anomalies"))


# ---- field rules

@query(f"""WITH roster AS ({ROSTER}) SELECT silver_record_id, {D.name('first_name')} AS first, {D.name('last_name')} AS last, coalesce(strftime({D.dob()}, '%Y-%m-%d'), '') AS dob, {D.zip5()} AS zip,
  lpad(left({D.DIGITS("coalesce(zip, '')")}, 5), 5, '0') AS zip_api, {D.soundex('last_name')} AS soundex, {D.soundex_us('last_name')} AS soundex_sql, upper(left(trim(state), 2)) AS state_cdc, array_to_string(list_sort({D.blocks('last_name', D.dob(), D.zip5())}), ';') AS blocks, ({D.all_blocks('last_name', D.dob(), D.zip5())})[1] AS block FROM roster""")
def normalize_fields(spark, sf_dir):
    """normalize_name, normalize_dob, normalize_zip, zip_api, soundex_py, soundex_sql, state_norm, blocking_keys, blocking_key, dedupe_codes."""
    c = F.col
    rows = roster(spark, sf_dir).select("silver_record_id", N.normalize_name(c("first_name")).alias("first"), N.normalize_name(c("last_name")).alias("last"), N.normalize_dob(c("dob")).alias("dob"), N.normalize_zip(c("zip")).alias("zip"), N.zip_api(c("zip")).alias("zip_api"), N.soundex_reset(c("last_name")).alias("soundex"), F.soundex("last_name").alias("soundex_sql"), N.state_cdc(c("state")).alias("state_cdc")).withColumn("_k", N.blocking_keys_of(c("last"), c("dob"), c("zip")))
    return rows.withColumn("blocks", F.array_join(F.array_sort("_k"), ";")).withColumn("block", F.element_at("_k", 1)).drop("_k")


@query(f"WITH roster AS ({ROSTER}) SELECT silver_record_id, 'G-' || upper(left(sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(partner_id || '|' || partner_member_id)), 4)) AS short_id, sha256('{{' || '\"partner_id\":\"' || partner_id || '\",\"partner_member_id\":\"' || partner_member_id || '\"' || coalesce(',\"gender\":\"' || gender || '\"', '') || coalesce(',\"middle_name\":\"' || middle_name || '\"', '') || '}}') AS row_hash, md5(concat_ws('-', partner_id, partner_member_id, load_no, coalesce(middle_name, '_null_'))) AS surrogate_key FROM roster")
def record_ids(spark, sf_dir):
    """short_golden_id, row_hash and surrogate_key."""
    c = F.col
    return roster(spark, sf_dir).select("silver_record_id", N.short_golden_id(c("partner_id"), c("partner_member_id")).alias("short_id"), N.row_hash(["partner_id", "partner_member_id", "gender", "middle_name"]).alias("row_hash"), N.surrogate_key(c("partner_id"), c("partner_member_id"), c("load_no"), c("middle_name")).alias("surrogate_key"))


_SSNS = "SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN '000-12-3456' WHEN 1 THEN '666-12-3456' WHEN 2 THEN '912-12-3456' WHEN 3 THEN '123-45-6789' WHEN 4 THEN '123456780' WHEN 5 THEN concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-00-1234') WHEN 6 THEN 'n/a' WHEN 7 THEN NULL ELSE concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-12-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END AS ssn FROM customer"


@query(f"WITH s AS ({_SSNS}), d AS (SELECT *, replace(ssn, '-', '') AS n FROM s) SELECT id, regexp_full_match(ssn, '[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}') AND left(n, 3) NOT IN ('000', '666') AND left(n, 1) <> '9' AND substr(n, 4, 2) <> '00' AND substr(n, 6, 4) <> '0000' AND n NOT IN ({', '.join(repr(x) for x in N.DUMMY_SSNS)}) AS valid FROM d")
def ssn_valid(spark, sf_dir):
    rows = spark.sql(_SSNS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return rows.select("id", N.ssn_valid(F.col("ssn")).alias("valid"))


_REPLIES = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('```json {\"match\": true, \"confidence\": 0.9, \"reasoning\": \"r', CAST(c_custkey AS STRING), '\"} ```') WHEN 1 THEN concat('Sure: {\"match\": false, \"reasoning\": \"', repeat('x', 600), '\"} bye') WHEN 2 THEN '{\"confidence\": 0.25}' ELSE 'no verdict' END AS reply FROM customer"


@query(f"WITH r AS ({_REPLIES}), j AS (SELECT id, CASE WHEN contains(reply, '{{') THEN regexp_extract(reply, '\\{{.*\\}}') END AS b FROM r) SELECT id, CASE WHEN b IS NOT NULL THEN coalesce(CAST(json_extract_string(b, '$.match') AS BOOLEAN), FALSE) END AS match, CASE WHEN b IS NOT NULL THEN coalesce(CAST(json_extract_string(b, '$.confidence') AS DOUBLE), 0.0) END AS confidence, CASE WHEN b IS NOT NULL THEN left(coalesce(json_extract_string(b, '$.reasoning'), ''), 500) END AS reasoning FROM j")
def parse_llm_json(spark, sf_dir):
    """An adjudicator's replies, fenced or wrapped in prose."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_REPLIES[_REPLIES.index("CASE") : _REPLIES.index(" AS reply")]).alias("reply"))
    return rows.select("id", N.parse_verdict(F.col("reply")).alias("v")).select("id", "v.match", "v.confidence", "v.reasoning")


@query(f"{D.MATCH}, t AS (SELECT DISTINCT features, lower(features) AS t FROM prep), g AS (SELECT features, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM t UNION ALL SELECT features, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM (SELECT features, list_filter(string_split(t, ' '), lambda w: w <> '') AS ws FROM t) x), v AS (SELECT features, h % 256 AS at, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM (SELECT features, ('0x' || left(sha1(g), 8))::BIGINT AS h FROM g) x GROUP BY ALL) SELECT features, CAST(sum(n * n) AS BIGINT) AS norm2, CAST(sum(v.n * v.at) AS BIGINT) AS moment FROM v GROUP BY features")
def embed_local(spark, sf_dir):
    """Gram counts of every distinct feature string: squared length and first moment (feature_string)."""
    from .registry import prepared

    got = R.embed(prepared(spark, sf_dir))
    moment = F.aggregate(F.zip_with("at", "n", lambda i, n: (i * n).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select(F.col("text").alias("features"), "norm2", moment.alias("moment"))
