"""Data contracts: mapping partner columns to canonical fields, required fields, cleansing rules, schema drift."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import normalize as N

# Canonical fields, and the column names that the plain roster loader knows.
CANONICAL = (
    "partner_member_id", "first_name", "middle_name", "last_name", "suffix", "dob", "gender", "ssn", "email", "phone", "address_line_1", "address_line_2",
    "city", "state", "zip", "zip4", "effective_start_date", "effective_end_date", "plan_code", "employer_name",
)
ROSTER_COLUMNS = {
    "EmployeeID": "partner_member_id", "FirstName": "first_name", "LastName": "last_name", "DOB": "dob", "SSN": "ssn", "Email": "email",
    "PostalCode": "zip", "State": "state", "EligStartDate": "effective_start_date", "EligEndDate": "effective_end_date", "PlanCode": "plan_code",
}
REQUIRED = ("partner_member_id", "first_name", "last_name", "dob", "zip")
MEMBER_ID_FALLBACKS = ("member_id", "emp_id")


@dataclass
class ContractColumn:
    source_column: str
    canonical_field: str
    confidence: float = 1.0
    pii_tier: str = "TIER_4_NONE"
    cleansing_rules: list[str] = field(default_factory=list)
    reasoning: str = ""


@dataclass
class Contract:
    partner_id: str
    columns: list[ContractColumn]
    version: int = 1
    source_format: str = "csv"
    required_fields: tuple[str, ...] = REQUIRED
    max_quarantine_pct: float = 1.0
    max_freshness_hours: int = 30
    max_row_count_change_pct: int = 15
    min_rows: int = 1
    max_rows: int | None = None

    def mapping(self) -> dict[str, str]:
        """Source column to canonical field; ignored columns are left out."""
        return {c.source_column: c.canonical_field for c in self.columns if c.canonical_field and c.canonical_field != "ignore"}

    def as_table(self, spark) -> DataFrame:
        """The contract as a lookup table, one row per column."""
        rows = [(self.partner_id, self.version, c.source_column, c.canonical_field, float(c.confidence), c.pii_tier, c.cleansing_rules) for c in self.columns]
        return spark.createDataFrame(rows, "partner_id string, contract_version int, source_column string, canonical_field string, confidence double, pii_tier string, cleansing_rules array<string>")


def contract_map(rows: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """rows with canonical columns only, and those of keep; unmapped ones go. Of columns mapped to one field the last wins."""
    chosen = {mapping[c]: c for c in rows.columns if c in mapping}
    return rows.select(*keep, *(F.col(f"`{src}`").alias(name) for name, src in chosen.items()))


def contract_map_entries(row: Column, mapping: dict[str, str]) -> Column:
    """The same for a map column: entries of known source columns under their canonical names; the last of one name wins."""
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    entries = F.filter(F.transform(F.map_entries(row), lambda e: F.struct(names[e["key"]].alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def contract_lookup(entries: DataFrame, contracts: DataFrame) -> DataFrame:
    """(partner_id, ..., canonical_field, value): long rows of source columns joined to the contracts of many partners.

    contracts grows with partners and columns, not with rows; the optimizer broadcasts it when its size allows.
    """
    known = contracts.where("canonical_field <> 'ignore'").select("partner_id", "source_column", "canonical_field")
    return entries.join(known, ["partner_id", "source_column"]).drop("source_column")


def member_id_fallback(canonical: Column, row: Column) -> Column:
    """The canonical id, else the raw row's member_id, else its emp_id, else ''."""
    return F.coalesce(F.nullif(canonical, F.lit("")), *(F.nullif(row[k], F.lit("")) for k in MEMBER_ID_FALLBACKS), F.lit(""))


def required_subset(present: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    """Whether an array of field names holds all required ones."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), present)) == 0


def required_fields(rows: DataFrame, fields: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows in which every required field is there and not blank."""
    return rows.where(" AND ".join(f"nullif(trim(`{f}`), '') IS NOT NULL" for f in fields))


def roster_items(rows: DataFrame, partner: Column) -> DataFrame:
    """The plain loader: known columns stripped, rows without required fields or a readable birth date dropped, keys derived."""
    has = [c for c in ROSTER_COLUMNS if c in rows.columns]
    names = {ROSTER_COLUMNS[c]: F.nullif(F.trim(F.nullif(F.col(f"`{c}`"), F.lit(""))), F.lit("")) for c in has}
    flat = rows.select(partner.alias("partner_id"), *(names.get(f, F.lit(None).cast("string")).alias(f) for f in dict.fromkeys(ROSTER_COLUMNS.values())))
    flat = required_fields(flat).withColumn("dob", N.coerce_date(F.col("dob"))).where("dob IS NOT NULL").withColumn("zip", N.zip_api(F.col("zip")))
    digits, last = N.digits(F.col("ssn")), F.lower(F.trim("last_name"))
    return flat.select(
        N.short_golden_id(F.col("partner_id"), F.col("partner_member_id")).alias("golden_record_id"), "partner_id", "partner_member_id", "first_name", "last_name",
        last.alias("last_name_lower"), "dob", "zip", F.concat_ws("#", "zip", "dob", last).alias("lookup_key"),
        F.coalesce(N.coerce_date(F.col("effective_start_date")), "effective_start_date", F.lit("1970-01-01")).alias("effective_start_date"),
        N.coerce_date(F.col("effective_end_date")).alias("effective_end_date"), F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).alias("ssn_last4"),
    )


# ---- cleansing rules: a name in a contract becomes an expression

def title_case(c: Column) -> Column:
    """Words capitalised, also after an apostrophe or hyphen and after Mc; other letters lower, marks kept."""
    flat = F.initcap(F.lower(F.trim(c)))
    for mark in ("'", "-"):
        flat = F.array_join(F.transform(F.split(flat, mark), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))), mark)
    words = F.transform(F.split(flat, " "), lambda w: F.when(w.startswith("Mc") & (F.length(w) > 3), F.concat(F.lit("Mc"), F.upper(F.substring(w, 3, 1)), F.substring(w, 4, 10_000))).otherwise(w))
    return F.array_join(words, " ")


def e164(c: Column) -> Column:
    """+ and 11 to 15 digits; ten digits are taken as North American; null if neither fits."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(c.startswith("+") & F.length(d).between(8, 15), F.concat(F.lit("+"), d)).when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d))


EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$"
# Two-letter codes of states, districts and territories.
STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV",
    "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
)

#: Rule name to (what becomes of the value, whether it is valid); tokenizing rules only mark a field, the vault does it.
RULES = {
    "strip_whitespace": (F.trim, None),
    "title_case": (title_case, None),
    "title_case_with_diacritics": (title_case, None),
    "lowercase": (F.lower, None),
    "uppercase": (F.upper, None),
    "coerce_iso8601_date": (lambda c: F.nullif(N.normalize_dob(c), F.lit("")), lambda c: N.parse_date(c).isNotNull()),
    "coerce_iso8601_date_from_MM/DD/YYYY": (lambda c: F.date_format(F.try_to_date(c, "M/d/yyyy"), "yyyy-MM-dd"), lambda c: F.try_to_date(c, "M/d/yyyy").isNotNull()),
    "allow_null": (lambda c: F.nullif(F.trim(c), F.lit("")), None),
    "pad_to_5_digits": (N.zip_sql, None),
    "validate_ssn_format": (None, N.ssn_valid),
    "store_last_4_only": (N.ssn_last4, None),
    "rfc5322_validate": (None, lambda c: c.rlike(EMAIL)),
    "e164_normalize": (e164, lambda c: e164(c).isNotNull()),
    "validate_us_state_abbrev": (None, lambda c: F.upper(F.trim(c)).isin(*STATES)),
    "normalize_to_M_F_X_U": (N.gender, None),
    # Fixed value: the contract's name of the tokenizing step, whatever vault performs it.
    "tokenize_via_skyflow": (None, None),
}
#: Checks against a postal database can't be made offline; the rule is known and passes every value.
OFFLINE = ("usps_validate",)


def apply_rules(rows: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """rows with each field passed through its rules in order, and problems: `field:rule` of those that a value fails. Unknown names are errors."""
    checks, out = [], {}
    for name, names in rules.items():
        value = F.col(f"`{name}`").cast("string")
        for rule in names:
            if rule in OFFLINE:
                continue
            if rule not in RULES:
                raise ValueError(f"unknown cleansing rule {rule!r} of field {name!r}")
            change, valid = RULES[rule]
            if valid is not None:
                checks.append(F.when(value.isNotNull() & (value != "") & ~F.coalesce(valid(value), F.lit(False)), F.lit(f"{name}:{rule}")))
            value = change(value) if change else value
        out[name] = value
    problems = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return rows.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in rows.columns), problems.alias("problems"))


def field_flags(rows: DataFrame, as_of: str, most_age: int = 110) -> DataFrame:
    """rows with field_flags: lengths out of range, an age over the limit, e-mail, phone and state that don't fit their standards."""
    c = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    dob = N.parse_date(c("dob").cast("string"))
    rules = {
        "first_name_length": ~F.length(F.trim(c("first_name"))).between(1, 100),
        "last_name_length": ~F.length(F.trim(c("last_name"))).between(1, 100),
        "age_over_limit": F.floor(F.months_between(F.to_date(F.lit(as_of)), dob) / 12) > most_age,
        "email_invalid": ~c("email").rlike(EMAIL),
        "phone_invalid": c("phone").isNotNull() & e164(c("phone")).isNull(),
        "state_unknown": ~F.upper(F.trim(c("state"))).isin(*STATES),
        "ssn_invalid": ~N.ssn_valid(c("ssn")),
    }
    return rows.withColumn("field_flags", F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()))))


# ---- schema fingerprints and drift

def fingerprint(df: DataFrame) -> str:
    """SHA-256 of the sorted column names and types."""
    import hashlib

    return hashlib.sha256("|".join(sorted(f"{n}:{t}" for n, t in df.dtypes)).encode()).hexdigest()


def fingerprints(headers: DataFrame) -> DataFrame:
    """headers: partner_id, column, type. One fingerprint per partner."""
    named = F.concat_ws(":", "column", "type")
    return headers.groupBy("partner_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(named)), "|"), 256).alias("schema_fingerprint"))


def schema_drift(seen: DataFrame, history: DataFrame) -> DataFrame:
    """Partners whose fingerprint is not in their history: alert, and land in quarantine."""
    return seen.join(history.select("partner_id", "schema_fingerprint"), ["partner_id", "schema_fingerprint"], "left_anti").withColumn("quarantine_reason", F.lit("schema_invalid"))
