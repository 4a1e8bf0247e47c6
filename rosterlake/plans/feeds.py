"""Queries of files, contracts, inference, change feeds, streams and the vault. Files are written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.operators import cdc, infer, vault
from rosterlake.operators import contracts as K
from rosterlake.operators import gold as G
from rosterlake.operators import silver as S
from rosterlake.operators.settle import scratch
from rosterlake.sources import files, sinks
from rosterlake.streaming import feeds

from . import duck as D
from .registry import BUILT_AT, gold, query, roster, secret, silver, table
from .roster import ROSTER

# ---- files

_CSV = {"silver_record_id": "EmployeeID", "first_name": "FirstName", "last_name": "LastName", "dob": "DOB", "ssn": "SSN", "email": "Email", "zip": "PostalCode", "state": "State", "start_date": "EligStartDate", "end_date": "EligEndDate", "plan_code": "PlanCode", "city": "Unmapped"}


def csv_roster(spark, sf_dir, one_file: bool = False) -> str:
    """The roster as a partner would send it."""
    path = f"{scratch(spark, 'inbox')}/acme/roster.csv"
    rows = roster(spark, sf_dir).select("k", "load_no", *(F.col(a).alias(b) for a, b in _CSV.items()))
    if one_file:
        rows = rows.orderBy("k", "load_no").coalesce(1)
    rows.drop("k", "load_no").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    return path


_SENT = f"WITH roster AS ({ROSTER}), sent AS (SELECT k, load_no, " + ", ".join(f"coalesce({a}, '') AS \"{b}\"" for a, b in _CSV.items()) + " FROM roster)"


@query(f'{_SENT} SELECT "EmployeeID", "FirstName", "LastName", "DOB", "PostalCode" FROM sent ORDER BY k, load_no LIMIT 50')
def scan_csv(spark, sf_dir):
    """The first 50 rows of a file (limit_sample)."""
    return files.load_sample(spark, csv_roster(spark, sf_dir, True)).select("EmployeeID", "FirstName", "LastName", "DOB", "PostalCode")


@query(f'{_SENT} SELECT * EXCLUDE (k, load_no) FROM sent')
def scan_full_csv(spark, sf_dir):
    return files.scan_csv(spark, csv_roster(spark, sf_dir))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def scan_json(spark, sf_dir):
    """One object whose members array holds the rows."""
    path = f"{scratch(spark, 'inbox')}/feed.json"
    rows = table(spark, sf_dir, "nation")  # 25 rows
    rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("members")).select(F.lit("1").alias("feed_version"), "members").coalesce(1).write.json(path)
    return files.scan_json(spark, path).select("n_nationkey", "n_name")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def scan_jsonl(spark, sf_dir):
    path = f"{scratch(spark, 'inbox')}/feed.jsonl"
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.json(path)
    return files.scan_jsonl(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS member, c_name AS name, c_mktsegment AS segment FROM customer")
def scan_fixed_width(spark, sf_dir):
    path = f"{scratch(spark, 'inbox')}/feed.txt"
    line = F.concat(F.rpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad("c_name", 20, " "), F.rpad("c_mktsegment", 10, " "))
    table(spark, sf_dir, "customer").select(line).write.text(path)
    return files.scan_fixed_width(spark, path, [("member", 1, 12), ("name", 13, 20), ("segment", 33, 10)])


@query("SELECT n_nationkey, n_name, CAST(DATE '2024-01-01' + n_nationkey AS DATE) AS since FROM nation")
def seed_load(spark, sf_dir):
    """A JSON array of records, read with their types."""
    path = f"{scratch(spark, 'seed')}/records.json"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("n_nationkey")).alias("since"))  # 25 rows
    rows.groupBy().agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "since"))).alias("value")).coalesce(1).write.text(path)
    return files.seed_load(spark, path, "n_nationkey int, n_name string, since date")


_NAMES = {"a.csv": True, "b.TSV": True, "c.json": True, "d.jsonl": True, "e.ndjson": True, "f.edi": False, "g.txt": False, "h.xlsx": False, "noextension": False}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r})" for n, r in _NAMES.items()) + ") x(file, sampled)")
def scan_unsupported(spark, sf_dir):
    """Which files the sample reader takes; the others are errors."""
    folder = scratch(spark, "samples")
    rows = []
    for name in _NAMES:
        try:
            if name.rsplit(".", 1)[-1].lower() in ("csv", "tsv", "json", "jsonl", "ndjson"):
                table(spark, sf_dir, "region").limit(1).select(F.lit('{"a": 1}').alias("value")).coalesce(1).write.text(f"{folder}/{name}")
            rows.append((name, files.load_sample(spark, f"{folder}/{name}").count() >= 0))
        except files.UnsupportedFormat:
            rows.append((name, False))
    return spark.createDataFrame(rows, "file string, sampled boolean")


_EDI = "CASE WHEN k % 4 = 1 THEN NULL ELSE lpad(CAST(k AS VARCHAR), 9, '1') END"


@query(f"""SELECT 'M' || k AS partner_member_id, 'PLAN' || k % 3 AS plan_code, 'First' || k AS first_name, 'Last' || k AS last_name, {_EDI} AS ssn, '555' || lpad(CAST(k AS VARCHAR), 7, '0') AS phone, k || ' Main St' AS address_line_1,
  'Atlanta' AS city, 'GA' AS state, '30303' AS zip, CAST(DATE '1950-01-01' + CAST(k % 9000 AS INT) AS VARCHAR) AS dob, CASE k % 2 WHEN 0 THEN 'M' ELSE 'F' END AS gender, CASE k % 5 WHEN 0 THEN '2026-02-01' ELSE '2026-01-01' END AS start_date, CASE k % 7 WHEN 0 THEN '2026-12-31' END AS end_date FROM (SELECT c_custkey AS k FROM customer) x""")
def scan_834(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    seg = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts), F.lit("~\n"))
    ssn = F.when(k % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("*34*"), F.lpad(s, 9, "1")))
    loop = F.concat(
        seg("\nINS*Y*18*030*20*A***FT"), seg("REF*0F*M", s), seg("REF*1L*PLAN", (k % 3).cast("string")), seg("DTP*356*D8*20260101"), seg("NM1*IL*1*Last", s, "*First", s, "***", ssn),
        seg("PER*IP**HP*555", F.lpad(s, 7, "0")), seg("N3*", s, " Main St"), seg("N4*Atlanta*GA*30303"), seg("DMG*D8*", F.date_format(F.date_add(F.to_date(F.lit("1950-01-01")), (k % 9000).cast("int")), "yyyyMMdd"), "*", F.when(k % 2 == 0, "M").otherwise("F")), seg("HD*030**HLT"),
        F.when(k % 5 == 0, "DTP*348*D8*20260201~\n").otherwise(""), F.when(k % 7 == 0, "DTP*349*D8*20261231~\n").otherwise(""),
    )
    path = f"{scratch(spark, 'inbox')}/members.834"
    table(spark, sf_dir, "customer").repartition(8, "c_custkey").select(loop).write.text(path)
    return files.scan_834(spark, path).drop("source_file", "member_no", "maintenance_type", "middle_name")


@query("""SELECT path, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'tsv' WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'jsonl' WHEN 'ndjson' THEN 'jsonl' WHEN 'edi' THEN 'x12_834' WHEN '834' THEN 'x12_834' WHEN 'txt' THEN 'fixed_width' ELSE 'other' END AS format,
  CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey WHEN c_custkey % 3 = 1 THEN 'acme' ELSE 'unknown' END AS partner
  FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'inbox/p' || c_custkey || '/f' WHEN 1 THEN 'drop/partner_acme_' || c_custkey ELSE 'x/file' END || '.' || CASE c_custkey % 8 WHEN 0 THEN 'csv' WHEN 1 THEN 'TSV' WHEN 2 THEN 'json' WHEN 3 THEN 'ndjson' WHEN 4 THEN 'edi' WHEN 5 THEN '834' WHEN 6 THEN 'txt' ELSE 'xlsx' END AS path FROM customer)""")
def file_keys(spark, sf_dir):
    """detect_format and partner_from_key."""
    k = F.col("c_custkey")
    stem = F.when(k % 3 == 0, F.concat(F.lit("inbox/p"), k, F.lit("/f"))).when(k % 3 == 1, F.concat(F.lit("drop/partner_acme_"), k)).otherwise("x/file")
    ext = F.get(F.array(*map(F.lit, ("csv", "TSV", "json", "ndjson", "edi", "834", "txt", "xlsx"))), (k % 8).cast("int"))
    df = table(spark, sf_dir, "customer").select(F.concat(stem, F.lit("."), ext).alias("path"))
    return df.select("path", N.detect_format(F.col("path")).alias("format"), N.partner_from_key(F.col("path")).alias("partner"))


@query(f"WITH roster AS ({ROSTER}) SELECT partner_id, '2024-06-30' AS dt, count(*) AS n FROM (SELECT DISTINCT partner_id, silver_record_id FROM roster) x GROUP BY partner_id")
def bronze_copy(spark, sf_dir):
    """Raw rows under partner and day, written twice: the second write replaces the first (dedupe_row_hash, iceberg_tables)."""
    path = scratch(spark, "bronze")
    rows = roster(spark, sf_dir).drop("updated_at")
    for attempt in ("a", "b"):
        sinks.bronze_copy(rows, path, F.col("partner_id"), "2024-06-30", attempt)
    got = sinks.dedupe_row_hash(spark.read.parquet(path))
    return got.groupBy("partner_id", F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH roster AS ({ROSTER}) SELECT silver_record_id FROM roster WHERE updated_at >= TIMESTAMP '2024-06-20 00:00:00'")
def incremental_filter(spark, sf_dir):
    return S.incremental(roster(spark, sf_dir), "2024-06-20 00:00:00", "updated_at").select("silver_record_id")


@query(f"WITH roster AS ({ROSTER}) SELECT silver_record_id, partner_id, partner_member_id, first_name, last_name, dob, ssn, zip, plan_code FROM roster")
def json_extract(spark, sf_dir):
    """Raw payloads in three spellings of the member id."""
    raw = roster(spark, sf_dir)
    fields = [c for c in S.PAYLOAD if c in raw.columns]
    spelt = [F.when(F.col("k") % 3 == i, F.col("partner_member_id")).alias(n) for i, n in enumerate(S.MEMBER_ID_SPELLINGS)]
    bronze = raw.select("silver_record_id", "partner_id", F.to_json(F.struct(*spelt, *fields)).alias("raw_payload"))
    return S.json_extract(bronze).select("silver_record_id", "partner_id", "partner_member_id", "first_name", "last_name", "dob", "ssn", "zip", "plan_code")


@query(f"""{D.SILVER} SELECT partner_id, partner_member_id, silver_record_id FROM (SELECT *, row_number() OVER (PARTITION BY partner_id, partner_member_id ORDER BY updated_at DESC, silver_record_id DESC) AS r FROM silver) x WHERE r = 1""")
def keyed_upsert(spark, sf_dir):
    """Two loads put into a keyed table, one after the other."""
    keyed = sinks.KeyedTable(spark, scratch(spark, "keyed"), ["partner_id", "partner_member_id"])
    s = silver(spark, sf_dir).select("partner_id", "partner_member_id", "silver_record_id", "updated_at", "contract_version")
    for load in (1, 2):
        keyed.upsert(s.where(F.col("contract_version") == load), [F.col("updated_at"), F.col("silver_record_id")])
    return keyed.read().select("partner_id", "partner_member_id", "silver_record_id")


@query(f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS up, row_number() OVER (ORDER BY c_custkey DESC) AS down FROM customer), m AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || c_custkey), c_custkey) AS r FROM d WHERE up > 50 AND down > 50)
SELECT c_custkey, 'first' AS band FROM d WHERE up <= 50 UNION ALL SELECT c_custkey, 'last' FROM d WHERE down <= 50 AND up > 50 UNION ALL SELECT c_custkey, 'random' FROM m WHERE r <= 50""")
def sample_stratified(spark, sf_dir):
    return files.sample_bands(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


# ---- contracts

CONTRACT = K.Contract("acme", [K.ContractColumn(b, K.ROSTER_COLUMNS.get(b, "ignore")) for b in _CSV.values()])


@query(f"""WITH roster AS ({ROSTER}) SELECT silver_record_id AS partner_member_id, first_name, last_name, dob, ssn, email, zip, state, start_date AS effective_start_date, end_date AS effective_end_date, plan_code FROM roster""")
def contract_map(spark, sf_dir):
    sent = roster(spark, sf_dir).select(*(F.col(a).alias(b) for a, b in _CSV.items()))
    return K.contract_map(sent, CONTRACT.mapping())


_DEMO_DOB = "CAST(try_strptime(trim({0}), ['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y', '%Y%m%d', '%d/%m/%Y']) AS DATE)".format
_REQUIRED = "nullif(trim(first_name), '') IS NOT NULL AND nullif(trim(last_name), '') IS NOT NULL AND nullif(trim(dob), '') IS NOT NULL AND nullif(trim(zip), '') IS NOT NULL"


@query(f"""WITH roster AS ({ROSTER}) SELECT 'G-' || upper(left(sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('acme|' || silver_record_id)), 4)) AS golden_record_id, silver_record_id AS partner_member_id, trim(first_name) AS first_name, trim(last_name) AS last_name,
  strftime({_DEMO_DOB('dob')}, '%Y-%m-%d') AS dob, lpad(left({D.DIGITS('zip')}, 5), 5, '0') AS zip, lpad(left({D.DIGITS('zip')}, 5), 5, '0') || '#' || strftime({_DEMO_DOB('dob')}, '%Y-%m-%d') || '#' || lower(trim(last_name)) AS lookup_key,
  coalesce(strftime({_DEMO_DOB('start_date')}, '%Y-%m-%d'), start_date, '1970-01-01') AS effective_start_date, strftime({_DEMO_DOB('end_date')}, '%Y-%m-%d') AS effective_end_date, CASE WHEN length({D.DIGITS('ssn')}) >= 4 THEN right({D.DIGITS('ssn')}, 4) END AS ssn_last4
  FROM roster WHERE {_REQUIRED} AND {_DEMO_DOB('dob')} IS NOT NULL""")
def roster_items(spark, sf_dir):
    """column_map_demo, required_fields, coerce_date_demo, zip_api, short_golden_id and lookup_key of a read file."""
    return K.roster_items(files.scan_csv(spark, csv_roster(spark, sf_dir)), F.lit("acme")).drop("partner_id", "last_name_lower")


@query(f"WITH roster AS ({ROSTER}) SELECT silver_record_id FROM roster WHERE {_REQUIRED}")
def required_fields(spark, sf_dir):
    """Also required_subset: the names present in a row against the required ones."""
    rows = roster(spark, sf_dir)
    present = F.array_compact(F.array(*(F.when(F.nullif(F.trim(f), F.lit("")).isNotNull(), F.lit(f)) for f in K.REQUIRED)))
    return K.required_fields(rows).where(K.required_subset(present)).select("silver_record_id")


@query(f"""WITH roster AS ({ROSTER}) SELECT partner_id, silver_record_id, 'dob' AS canonical_field, dob AS value FROM roster WHERE k % 5 < 3 AND dob IS NOT NULL UNION ALL SELECT partner_id, silver_record_id, 'zip', zip FROM roster WHERE zip IS NOT NULL""")
def contract_lookup(spark, sf_dir):
    """Long rows of source columns named by the contracts of all partners."""
    rows = roster(spark, sf_dir)
    long = rows.select("partner_id", "silver_record_id", F.explode(F.create_map(F.when(F.col("k") % 5 < 3, "DOB").otherwise("Junk"), F.col("dob"), F.lit("Zip"), F.col("zip"))).alias("source_column", "value")).where("value IS NOT NULL")
    partners = [f"partner_{i}" for i in (0, 1, 2, 3, 4, 9)]
    known = None
    for p in partners:
        one = K.Contract(p, [K.ContractColumn("DOB", "dob"), K.ContractColumn("Zip", "zip"), K.ContractColumn("Junk", "ignore")]).as_table(spark)
        known = one if known is None else known.unionByName(one)
    return K.contract_lookup(long, known).select("partner_id", "silver_record_id", "canonical_field", "value")


_RULES = {"first_name": ["strip_whitespace"], "email": ["lowercase", "rfc5322_validate"], "phone": ["e164_normalize"], "ssn": ["validate_ssn_format", "store_last_4_only"], "state": ["uppercase", "validate_us_state_abbrev"], "gender": ["normalize_to_M_F_X_U"], "zip": ["pad_to_5_digits"], "address_line_1": ["strip_whitespace", "usps_validate"], "dob": ["coerce_iso8601_date"]}
_SSN_OK = f"regexp_full_match(ssn, '[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}') AND left(replace(ssn, '-', ''), 3) NOT IN ('000', '666') AND NOT starts_with(ssn, '9') AND substr(replace(ssn, '-', ''), 4, 2) <> '00' AND right(ssn, 4) <> '0000' AND replace(ssn, '-', '') NOT IN ({', '.join(repr(s) for s in N.DUMMY_SSNS)})"
_STATES = ", ".join(f"'{s}'" for s in K.STATES)


@query(f"""WITH roster AS ({ROSTER}) SELECT silver_record_id, trim(first_name) AS first_name, lower(email) AS email, '+' || {D.DIGITS('phone')} AS phone, CASE WHEN {D.DIGITS('ssn')} <> '' THEN right({D.DIGITS('ssn')}, 4) END AS ssn, upper(state) AS state,
  CASE upper(gender) WHEN 'MALE' THEN 'M' WHEN 'F' THEN 'F' WHEN 'NB' THEN 'X' ELSE 'U' END AS gender, lpad({D.DIGITS('zip')}, 5, '0') AS zip, trim(address_line_1) AS address_line_1, strftime({D.dob()}, '%Y-%m-%d') AS dob,
  array_to_string(list_filter([CASE WHEN ssn <> '' AND NOT ({_SSN_OK}) THEN 'ssn:validate_ssn_format' END, CASE WHEN state <> '' AND upper(state) NOT IN ({_STATES}) THEN 'state:validate_us_state_abbrev' END, CASE WHEN dob <> '' AND {D.dob()} IS NULL THEN 'dob:coerce_iso8601_date' END], lambda x: x IS NOT NULL), ',') AS problems FROM roster""")
def cleansing_rules(spark, sf_dir):
    rows = roster(spark, sf_dir).select("silver_record_id", *_RULES)
    got = K.apply_rules(rows, _RULES)
    return got.withColumn("problems", F.array_join("problems", ","))


@query(f"""WITH roster AS ({ROSTER}) SELECT silver_record_id, array_to_string(list_filter([CASE WHEN length(trim(last_name)) NOT BETWEEN 1 AND 100 THEN 'last_name_length' END, CASE WHEN date_diff('day', {D.dob()}, DATE '2050-06-30') > 40200 AND date_sub('year', {D.dob()}, DATE '2050-06-30') > 110 THEN 'age_over_limit' END,
  CASE WHEN upper(trim(state)) NOT IN ({_STATES}) THEN 'state_unknown' END, CASE WHEN NOT ({_SSN_OK}) THEN 'ssn_invalid' END], lambda x: x IS NOT NULL), ',') AS field_flags FROM roster""")
def field_standards(spark, sf_dir):
    return K.field_flags(roster(spark, sf_dir), "2050-06-30").select("silver_record_id", F.array_join("field_flags", ",").alias("field_flags"))


_HEADS = "SELECT concat('p', CAST(c_custkey % 20 AS STRING)) AS partner_id, concat('col', CAST(c_custkey % (3 + c_custkey % 20) AS STRING)) AS col, CASE WHEN c_custkey % 20 = 7 THEN 'int' ELSE 'string' END AS type FROM customer"


@query(f"""WITH h AS (SELECT DISTINCT * FROM ({_HEADS}) x), f AS (SELECT partner_id, sha256(string_agg(col || ':' || type, '|' ORDER BY col || ':' || type)) AS schema_fingerprint FROM h GROUP BY partner_id) SELECT partner_id, schema_fingerprint, 'schema_invalid' AS quarantine_reason FROM f WHERE partner_id IN ('p7', 'p8')""")
def schema_drift(spark, sf_dir):
    """Fingerprints of every partner against a history that lacks the present one of two partners."""
    heads = spark.sql(_HEADS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer")).withColumnRenamed("col", "column").distinct()
    seen = K.fingerprints(heads)
    history = seen.withColumn("schema_fingerprint", F.when(F.col("partner_id").isin("p7", "p8"), "old").otherwise(F.col("schema_fingerprint")))
    return K.schema_drift(seen, history)


# ---- inference

SEEN_HEADERS = ("EmployeeID", "FirstName", "LastName", "DOB", "SSN", "Email", "Address1", "City", "State", "PostalCode", "EligStartDate", "EligEndDate", "PlanCode", "subscriberId", "givenName", "familyName", "dateOfBirth", "contactEmail", "addressLine1", "addressCity", "coverageStart", "coverageEnd", "productCode", "mi", "tel", "apt", "zip4", "sex", "company", "name_suffix", "termination", "col1", "Term_End", "start date")


@query("WITH h AS (SELECT unnest([" + ", ".join(f"'{h}'" for h in SEEN_HEADERS) + "]) || CASE WHEN r = 0 THEN '' ELSE '_' || r END AS header FROM range(3) t(r)) SELECT header, CASE " + " ".join(f"WHEN regexp_matches(lower(header), '{p}') THEN '{f}'" for p, f, *_ in infer.HEADERS) + " END AS canonical_field, CASE " + " ".join(f"WHEN regexp_matches(lower(header), '{p}') THEN '{t}'" for p, _, t, *_ in infer.HEADERS) + " END AS pii_tier, CASE WHEN " + " OR ".join(f"regexp_matches(lower(header), '{p}')" for p, *_ in infer.HEADERS) + " THEN CAST(0.92 AS DOUBLE) END AS confidence FROM h")
def header_classify(spark, sf_dir):
    heads = spark.createDataFrame([(h if r == 0 else f"{h}_{r}",) for h in SEEN_HEADERS for r in range(3)], "header string")
    return infer.header_classify(heads)


_VALUES = """SELECT concat('t', CAST(c_custkey % 13 AS STRING)) AS tab, concat('c', CAST(c_custkey % 7 AS STRING)) AS col, CASE c_custkey % 7
  WHEN 0 THEN concat('123-45-', CAST(1000 + c_custkey % 9000 AS STRING)) WHEN 1 THEN concat('u', CAST(c_custkey AS STRING), '@example.com') WHEN 2 THEN concat('1980-01-', CAST(10 + c_custkey % 19 AS STRING))
  WHEN 3 THEN CASE WHEN c_custkey % 26 = 3 THEN 'x' ELSE CAST(10000 + c_custkey % 89999 AS STRING) END WHEN 4 THEN concat('(555) 010-', CAST(1000 + c_custkey % 9000 AS STRING)) WHEN 5 THEN c_name ELSE '' END AS value FROM customer"""
_SNIFF = "WITH v AS (" + _VALUES + "), s AS (SELECT tab, col, count(nullif(value, '')) AS n_values, " + ", ".join(f"bool_and(regexp_matches(nullif(value, ''), '{p}')) AS f{i}" for i, (p, *_) in enumerate(infer.SHAPES)) + " FROM v GROUP BY tab, col), i AS (SELECT tab, col, n_values, CASE WHEN n_values = 0 THEN 'ignore' " + " ".join(f"WHEN f{i} THEN '{x[1]}'" for i, x in enumerate(infer.SHAPES)) + " ELSE 'ignore' END AS canonical_field, CASE WHEN n_values = 0 THEN 'TIER_4_NONE' " + " ".join(f"WHEN f{i} THEN '{x[2]}'" for i, x in enumerate(infer.SHAPES)) + " ELSE 'TIER_4_NONE' END AS pii_tier, CAST(CASE WHEN n_values = 0 THEN 0.5 " + " ".join(f"WHEN f{i} THEN {x[5]}" for i, x in enumerate(infer.SHAPES)) + " ELSE 0.4 END AS DOUBLE) AS confidence FROM s)"


def _sniffed(spark, sf_dir):
    values = spark.sql(_VALUES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return infer.sniff_values(values, ["tab", "col"])


@query(f"{_SNIFF} SELECT * FROM i")
def value_sniff(spark, sf_dir):
    return _sniffed(spark, sf_dir).drop("reasoning")


@query(f"{_SNIFF} SELECT tab, CASE WHEN count(*) FILTER (WHERE confidence < 0.7) > count(*) / 3.0 THEN 'HIGH' WHEN count(*) FILTER (WHERE pii_tier = 'TIER_1_DIRECT') >= 4 OR count(*) FILTER (WHERE confidence < 0.7) > 2 THEN 'MEDIUM' ELSE 'LOW' END AS overall_quality_risk FROM i GROUP BY tab")
def agg_risk(spark, sf_dir):
    return infer.risk(_sniffed(spark, sf_dir), ["tab"])


_INFERRED = (
    ("EmployeeID", "partner_member_id", 0.92, "TIER_4_NONE"), ("FirstName", "first_name", 0.92, "TIER_1_DIRECT"), ("LastName", "last_name", 0.92, "TIER_1_DIRECT"), ("DOB", "dob", 0.92, "TIER_1_DIRECT"), ("SSN", "ssn", 0.92, "TIER_1_DIRECT"),
    ("Email", "email", 0.92, "TIER_1_DIRECT"), ("PostalCode", "zip", 0.92, "TIER_2_QUASI"), ("State", "state", 0.92, "TIER_2_QUASI"), ("EligStartDate", "effective_start_date", 0.92, "TIER_3_SENSITIVE"), ("EligEndDate", "effective_end_date", 0.92, "TIER_3_SENSITIVE"),
    ("PlanCode", "plan_code", 0.92, "TIER_3_SENSITIVE"), ("Unmapped", "ignore", 0.4, "TIER_4_NONE"),
)


@query("SELECT source_column, canonical_field, CAST(confidence AS DOUBLE) AS confidence, pii_tier, 'MEDIUM' AS risk, 'EligStartDate' AS partition_column, TRUE AS in_yaml FROM (VALUES " + ", ".join(map(str, _INFERRED)) + ") x(source_column, canonical_field, confidence, pii_tier)")
def infer_schema(spark, sf_dir):
    """The draft contract of a landed file (infer_modes, suggest_partition, contract_yaml, limit_sniff, limit_prompt)."""
    path = csv_roster(spark, sf_dir, True)
    got = infer.infer_schema("roster.csv", files.load_sample(spark, path), BUILT_AT)
    text = got.to_yaml()
    rows = [(c.source_column, c.canonical_field, c.confidence, c.pii_tier, got.overall_quality_risk, got.suggested_partition_column, f'source_column: "{c.source_column}"' in text) for c in got.columns]
    return spark.createDataFrame(rows, "source_column string, canonical_field string, confidence double, pii_tier string, risk string, partition_column string, in_yaml boolean")


# ---- change feeds: operations from event types, rows from users

_MAPPING = {"emp": "partner_member_id", "given": "first_name", "family": "last_name", "born": "dob", "social": "ssn", "mail": "email", "post": "zip", "region": "state", "junk": "ignore"}


def envelopes(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    row = {
        "emp": F.when(e % 7 != 0, F.concat(F.lit("u"), text(u))), "member_id": F.when(e % 7 == 0, F.concat(F.lit("m"), text(u))), "given": F.when(u % 2 == 0, " Bob ").otherwise("Liz"), "family": F.when(u % 3 == 0, "SMITH Jr").otherwise("O'Brien"),
        "born": F.when(u % 5 == 0, "04/12/1962").when(u % 5 == 1, "never").otherwise("19620412"), "social": F.when(u % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("123-45-"), text(1000 + u % 9000))), "mail": F.concat(F.lit("U"), text(u), F.lit("@Example.org")),
        "post": F.when(u % 6 == 0, "x").otherwise(text(501 + u)), "region": F.when(u % 2 == 0, " california").otherwise("Texas"), "junk": F.lit("dropped"), "other": F.lit("dropped"),
    }
    whole = F.map_filter(F.create_map(*[x for k, v in row.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    op = F.create_map(*[F.lit(x) for x in ("signup", "c", "click", "u", "view", "r", "purchase", "d", "error", "?")])[F.col("event_type")]
    partner = F.when(e % 50 != 49, F.concat(F.lit("partner_"), text(u % 3)))
    return table(spark, sf_dir, "events").select(op.alias("op"), F.when(op == "d", whole).alias("before"), F.when(op != "d", whole).alias("after"), F.struct(partner.alias("partner_id"), text(e).alias("lsn")).alias("source"), F.unix_millis(F.date_trunc("minute", "ts")).alias("ts_ms"))


_PARTNER = "CASE WHEN event_id % 50 <> 49 THEN 'partner_' || user_id % 3 END"
_TOKEN = lambda f: D.token(D.SECRET, "partner_id", f"'{f}'", f)
_EVENTS = f"""WITH raw AS (
  SELECT event_id, user_id AS u, {_PARTNER} AS sent_by, coalesce({_PARTNER}, 'unknown') AS partner_id, CASE WHEN event_id % 7 <> 0 THEN 'u' || user_id ELSE 'm' || user_id END AS partner_member_id,
    CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'error' THEN NULL ELSE 'upsert' END AS operation, date_trunc('minute', ts) AS occurred_at, CAST(event_id AS VARCHAR) AS source_lsn,
    CASE WHEN user_id % 2 = 0 THEN 'robert' ELSE 'elizabeth' END AS first_name, CASE WHEN user_id % 3 = 0 THEN 'smith' ELSE 'o''brien' END AS last_name, CASE WHEN user_id % 5 = 1 THEN NULL ELSE '1962-04-12' END AS dob,
    CASE WHEN user_id % 6 <> 0 THEN lpad(left(CAST(501 + user_id AS VARCHAR), 5), 5, '0') END AS zip, CASE WHEN user_id % 2 = 0 THEN 'CA' ELSE 'TE' END AS state, CASE WHEN user_id % 4 <> 0 THEN '123-45-' || (1000 + user_id % 9000) END AS ssn, 'U' || user_id || '@Example.org' AS email FROM events
), events_out AS (
  SELECT partner_id, partner_member_id, operation, occurred_at, source_lsn, first_name, last_name, dob, zip, state, right(ssn, 4) AS ssn_last4, {_TOKEN('ssn')} AS ssn_token, {_TOKEN('email')} AS email_token, sent_by FROM raw WHERE operation IS NOT NULL
)"""
_EVENT_COLUMNS = ("partner_id", "partner_member_id", "operation", "occurred_at", "source_lsn", "first_name", "last_name", "dob", "zip", "state", "ssn_last4", "ssn_token", "email_token")


@query(f"{_EVENTS} SELECT * EXCLUDE (sent_by) FROM events_out")
def cdc_process(spark, sf_dir):
    """Envelopes to events (member_id_fallback, normalize_event, ssn_last4, state_norm, tokenize)."""
    return cdc.process(envelopes(spark, sf_dir), _MAPPING, secret(spark)).select(*_EVENT_COLUMNS)


def _landed(spark, sf_dir, copies: int = 1) -> str:
    folder = scratch(spark, "envelopes")
    rows = envelopes(spark, sf_dir)
    for _ in range(copies):
        rows.write.mode("append").json(folder)
    return folder


def _stream(spark, sf_dir, folder):
    return feeds.cdc_events(feeds.read_envelopes(spark, folder), _MAPPING, secret(spark))


@query(f"{_EVENTS} SELECT * EXCLUDE (sent_by) FROM events_out WHERE sent_by IS NOT NULL")
def stream_cdc(spark, sf_dir):
    """The same as a stream of files, usable events only (cdc_source, event_sink_avro as Parquet)."""
    out = scratch(spark, "events")
    feeds.write_events(_stream(spark, sf_dir, _landed(spark, sf_dir)), f"{out}/good", f"{out}/dead", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/good").select(*_EVENT_COLUMNS)


@query(f"{_EVENTS} SELECT partner_id, partner_member_id, source_lsn, 'no partner' AS problem FROM events_out WHERE sent_by IS NULL")
def dlq_sink(spark, sf_dir):
    """Dead letters of the stream: envelopes without a partner."""
    out = scratch(spark, "events")
    feeds.write_events(_stream(spark, sf_dir, _landed(spark, sf_dir)), f"{out}/good", f"{out}/dead", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/dead").select("partner_id", "partner_member_id", "source_lsn", "problem")


@query(f"{_EVENTS} SELECT partner_id, partner_member_id, operation, occurred_at, source_lsn FROM (SELECT *, row_number() OVER (PARTITION BY partner_id, partner_member_id ORDER BY occurred_at DESC, CAST(source_lsn AS BIGINT) DESC) AS r FROM events_out WHERE sent_by IS NOT NULL) x WHERE r = 1")
def stream_latest(spark, sf_dir):
    """The state of every member after the stream, deletes kept as such."""
    out = scratch(spark, "state")
    keyed = sinks.KeyedTable(spark, f"{out}/table", ["partner_id", "partner_member_id"])
    folder = _landed(spark, sf_dir)
    events = feeds.cdc_events(feeds.read_envelopes(spark, folder), _MAPPING, secret(spark))
    feeds.keep_latest_state(events, keyed, f"{out}/checkpoint").awaitTermination()
    return keyed.read().select("partner_id", "partner_member_id", "operation", "occurred_at", "source_lsn")


@query(f"{_EVENTS} SELECT partner_id, partner_member_id, source_lsn, operation FROM events_out")
def stream_dedupe(spark, sf_dir):
    """Every envelope landed twice, each event taken once. The window spans the feed, as its files come in no order."""
    out = scratch(spark, "deduped")
    events = feeds.without_replays(_stream(spark, sf_dir, _landed(spark, sf_dir, 2)), "40 days")
    events.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("partner_id", "partner_member_id", "source_lsn", "operation")


@query(f"{_SENT} SELECT \"EmployeeID\", coalesce(nullif(\"LastName\", ''), NULL) AS \"LastName\" FROM sent")
def stream_files(spark, sf_dir):
    """Landed CSV files as a stream (file_trigger)."""
    path, out = csv_roster(spark, sf_dir), scratch(spark, "landed")
    rows = feeds.read_landed(spark, path, ", ".join(f"`{c}` string" for c in _CSV.values()))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("EmployeeID", F.nullif("LastName", F.lit("")).alias("LastName"))


@query(f"{D.GOLD} SELECT golden_record_id, 'upsert' AS operation, 0 AS delivery_attempts FROM gold WHERE primary_partner_id <> 'partner_0'")
def outbox_sink(spark, sf_dir):
    """A first fill of the outbox from gold, of which one partner's rows have been relayed already."""
    g = gold(spark, sf_dir).select("golden_record_id", "primary_partner_id", "zip")
    box = G.outbox(g.limit(0), g, "golden_record_id", BUILT_AT)
    sent = box.where(F.get_json_object("payload", "$.primary_partner_id") == "partner_0")
    _, offsets = sinks.relay(sent, None, BUILT_AT)
    rest, _ = sinks.relay(box, offsets, BUILT_AT)
    return rest.select("golden_record_id", "operation", "delivery_attempts")


# ---- vault

_ASKED = """SELECT silver_record_id, partner_id, CASE k % 2 WHEN 0 THEN 'ssn' ELSE 'email' END AS field, CASE k % 2 WHEN 0 THEN ssn ELSE email END AS value,
  CASE k % 5 WHEN 0 THEN 'service:idv-api' WHEN 1 THEN 'human:alice' WHEN 2 THEN 'eve' WHEN 3 THEN 'human:compliance-lead' ELSE 'service:cleansing' END AS actor,
  CASE k % 4 WHEN 0 THEN 'idv_match' WHEN 1 THEN concat('support_case_', CAST(k AS STRING)) WHEN 2 THEN 'audit_2024' ELSE 'tokenize_only' END AS purpose, k % 17 = 3 AS lost, k, updated_at FROM roster"""


def _vault(spark, sf_dir):
    asked = spark.sql(_ASKED.replace("FROM roster", "FROM {roster}"), roster=roster(spark, sf_dir)).where("value IS NOT NULL")
    tokens = vault.tokenize(asked, secret(spark))
    kept = vault.vault_table(tokens)
    wanted = tokens.select("silver_record_id", F.when(F.col("lost"), F.concat(F.lit("tok_unknown"), F.col("k").cast("string"))).otherwise(F.col("token")).alias("token"), "actor", "purpose", "updated_at")
    return tokens, kept, wanted


_RULE = "CASE WHEN actor = 'service:idv-api' AND purpose = 'idv_match' THEN 0 WHEN actor = 'service:cdc-handler' AND purpose = 'tokenize_only' THEN 1 WHEN actor = 'service:cleansing' AND purpose = 'tokenize_only' THEN 2 WHEN starts_with(actor, 'human:') AND starts_with(purpose, 'support_case_') THEN 3 WHEN starts_with(actor, 'human:compliance') AND starts_with(purpose, 'audit_') THEN 4 END"
_ANSWERS = f"WITH roster AS ({ROSTER}), asked AS (SELECT * FROM ({_ASKED}) x WHERE value IS NOT NULL), answers AS (SELECT *, {_RULE} AS rule, CASE WHEN {_RULE} IS NULL THEN 'denied' WHEN lost THEN 'error' ELSE 'success' END AS result FROM asked)"


@query(f"{_ANSWERS} SELECT silver_record_id, {D.token(D.SECRET, 'partner_id', 'field', 'value')} AS token FROM asked")
def tokenize(spark, sf_dir):
    return _vault(spark, sf_dir)[0].select("silver_record_id", "token")


@query(f"{_ANSWERS} SELECT silver_record_id, rule FROM answers")
def policy_match(spark, sf_dir):
    return _vault(spark, sf_dir)[2].select("silver_record_id", vault.policy_rule(F.col("actor"), F.col("purpose")).alias("rule"))


@query(f"{_ANSWERS} SELECT silver_record_id, CASE WHEN result = 'success' THEN value END AS value, result, CASE result WHEN 'denied' THEN 'policy' WHEN 'error' THEN 'token not found' ELSE '' END AS reason FROM answers")
def detokenize(spark, sf_dir):
    _, kept, wanted = _vault(spark, sf_dir)
    return vault.detokenize(wanted, kept).select("silver_record_id", "value", "result", "reason")


_AUDIT = f"{_ANSWERS}, audit AS (SELECT updated_at AS ts, 'service:cleansing' AS actor, 'tokenize' AS action, field, 'tokenize_only' AS purpose, partner_id, 'success' AS result FROM asked UNION ALL SELECT updated_at, actor, CASE result WHEN 'denied' THEN 'denied' ELSE 'detokenize' END, CASE WHEN result = 'success' THEN field END, purpose, CASE WHEN result = 'success' THEN partner_id END, result FROM answers)"


def _audit(spark, sf_dir):
    tokens, kept, wanted = _vault(spark, sf_dir)
    return vault.audit_of_tokenize(tokens, "service:cleansing", F.col("updated_at")).unionByName(vault.audit_of_detokenize(vault.detokenize(wanted, kept), F.col("updated_at")))


@query(f"{_AUDIT} SELECT * FROM audit")
def audit(spark, sf_dir):
    return _audit(spark, sf_dir).drop("token", "reason")


@query(f"{_AUDIT} SELECT actor, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) > 20 AS alert FROM audit WHERE action = 'detokenize' GROUP BY ALL")
def agg_audit_volume(spark, sf_dir):
    return vault.audit_volume(_audit(spark, sf_dir), 20)


