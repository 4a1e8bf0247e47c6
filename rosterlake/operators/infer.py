"""Schema inference: headers and value shapes to a draft contract. Headers decide on the driver, values in one pass."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import Contract, ContractColumn

T1, T2, T3, T4 = "TIER_1_DIRECT", "TIER_2_QUASI", "TIER_3_SENSITIVE", "TIER_4_NONE"
# Header patterns in the order they are tried, with field, tier, cleansing rules and reason.
HEADERS = (
    (r"^(ssn|social|tax_id|tin)$", "ssn", T1, ("validate_ssn_format", "tokenize_via_skyflow", "store_last_4_only"), "Column header indicates SSN."),
    (r"^(dob|date_of_birth|birth_date|birthday)$", "dob", T1, ("coerce_iso8601_date",), "Column header indicates date of birth."),
    (r"^(first_?name|fname|given_?name)$", "first_name", T1, ("strip_whitespace", "title_case_with_diacritics"), "Header indicates first name."),
    (r"^(last_?name|lname|surname|family_?name)$", "last_name", T1, ("strip_whitespace", "title_case_with_diacritics"), "Header indicates last name."),
    (r"^(middle_?name|mname|middle_initial|mi)$", "middle_name", T1, ("strip_whitespace",), "Header indicates middle name."),
    (r"^(email|email_address|e_mail)$", "email", T1, ("lowercase", "rfc5322_validate", "tokenize_via_skyflow"), "Header indicates email."),
    (r"^(phone|phone_number|tel|mobile)$", "phone", T1, ("e164_normalize", "tokenize_via_skyflow"), "Header indicates phone number."),
    (r"^(addr|address|street|address_?line_?1|address1)$", "address_line_1", T1, ("usps_validate", "tokenize_via_skyflow"), "Header indicates street address."),
    (r"^(addr2|address_?line_?2|address2|apt|unit|suite)$", "address_line_2", T1, ("usps_validate",), "Header indicates address line 2."),
    (r"^city$", "city", T2, ("title_case", "usps_validate"), "Header indicates city."),
    (r"^(state|st|province)$", "state", T2, ("uppercase", "validate_us_state_abbrev"), "Header indicates state."),
    (r"^(zip|zipcode|postal_?code)$", "zip", T2, ("pad_to_5_digits",), "Header indicates ZIP."),
    (r"^(zip4|plus4|zip_plus4)$", "zip4", T2, (), "Header indicates ZIP+4."),
    (r"^(member_?id|partner_?member_?id|memberid|external_?id|emp(loyee)?_?id|subscriber_?id)$", "partner_member_id", T4, ("strip_whitespace",), "Header indicates partner-side member identifier."),
    (r"^(gender|sex)$", "gender", T2, ("normalize_to_M_F_X_U",), "Header indicates gender."),
    (r"(elig|effective|coverage)[_ ]?start|^start[_ ]?date$", "effective_start_date", T3, ("coerce_iso8601_date",), "Header indicates eligibility/coverage start."),
    (r"(elig|effective|coverage|term)[_ ]?(end|term)|^end[_ ]?date$|^termination$", "effective_end_date", T3, ("coerce_iso8601_date",), "Header indicates eligibility/coverage end."),
    (r"^(plan|plan_?code|product|product_?code)$", "plan_code", T3, ("uppercase",), "Header indicates plan/product code."),
    (r"^(employer|employer_?name|company|group)$", "employer_name", T2, ("strip_whitespace",), "Header indicates employer."),
    (r"^(suffix|name_suffix)$", "suffix", T1, (), "Header indicates name suffix."),
)
HEADER_CONFIDENCE = 0.92
# Value shapes in the order they are tried, with field, tier, rules, reason and confidence.
SHAPES = (
    (r"^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$", "ssn", T1, ("validate_ssn_format", "tokenize_via_skyflow"), "Values match SSN pattern.", 0.85),
    (r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "email", T1, ("lowercase", "tokenize_via_skyflow"), "Values look like emails.", 0.85),
    (r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$", "dob", T1, ("coerce_iso8601_date",), "Values look like dates.", 0.7),
    (r"^[0-9]{5}(-[0-9]{4})?$", "zip", T2, ("pad_to_5_digits",), "Values look like US ZIPs.", 0.8),
    (r"^[+\-.() 0-9]{7,20}$", "phone", T1, ("e164_normalize", "tokenize_via_skyflow"), "Values look like phone numbers.", 0.65),
)
EMPTY = ("ignore", T4, (), "Empty column.", 0.5)
UNKNOWN = ("ignore", T4, (), "No strong signal from header or values; flagging for human review.", 0.4)
SNIFFED_ROWS = 20


def classify_header(header: str) -> tuple[str, str, tuple[str, ...], str, float] | None:
    for pattern, *found in HEADERS:
        if re.search(pattern, header, re.IGNORECASE):
            return (*found, HEADER_CONFIDENCE)
    return None


def header_classify(headers: DataFrame, column: str = "header") -> DataFrame:
    """headers with canonical_field, pii_tier and confidence of the first pattern that fits; nulls where none does."""
    h = F.col(column)
    first = lambda i: F.coalesce(*(F.when(h.rlike("(?i)" + p), F.lit(x[i])) for p, *x in HEADERS))
    field = first(0)
    return headers.select("*", field.alias("canonical_field"), first(1).alias("pii_tier"), F.when(field.isNotNull(), HEADER_CONFIDENCE).alias("confidence"))


def sniff_values(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """values: long rows of sampled values. Per group the first shape that every non-empty value has, with its confidence."""
    v = F.nullif(F.col(value).cast("string"), F.lit(""))
    fits = [F.bool_and(v.rlike(p)).alias(f"_f{i}") for i, (p, *_) in enumerate(SHAPES)]
    got = values.groupBy(*by).agg(F.count(v).alias("n_values"), *fits)

    def pick(k: int):
        chosen = F.when(F.col("n_values") == 0, F.lit(EMPTY[k]))
        for i, (_, *x) in enumerate(SHAPES):
            chosen = chosen.when(F.col(f"_f{i}"), F.lit(x[k]))
        return chosen.otherwise(F.lit(UNKNOWN[k]))

    return got.select(*by, "n_values", pick(0).alias("canonical_field"), pick(1).alias("pii_tier"), pick(3).alias("reasoning"), pick(4).alias("confidence"))


def risk(columns: DataFrame, by: list[str]) -> DataFrame:
    """overall_quality_risk per group of inferred columns (confidence, pii_tier)."""
    low, direct, n = F.count_if(F.col("confidence") < 0.7), F.count_if(F.col("pii_tier") == T1), F.count(F.lit(1))
    level = F.when(low > n / 3, "HIGH").when((direct >= 4) | (low > 2), "MEDIUM").otherwise("LOW")
    return columns.groupBy(*by).agg(level.alias("overall_quality_risk"))


def risk_of(columns: list[ContractColumn]) -> str:
    low, direct = sum(c.confidence < 0.7 for c in columns), sum(c.pii_tier == T1 for c in columns)
    return "HIGH" if low > len(columns) / 3 else "MEDIUM" if direct >= 4 or low > 2 else "LOW"


def suggest_partition(columns: list[ContractColumn]) -> str | None:
    for wanted in ("effective_start_date", "dob"):
        for c in columns:
            if c.canonical_field == wanted:
                return c.source_column
    return None


@dataclass
class Inference:
    filename: str
    detected_format: str
    columns: list[ContractColumn]
    overall_quality_risk: str
    suggested_partition_column: str | None
    mode: str
    inferred_at: str

    def contract(self, partner_id: str) -> Contract:
        return Contract(partner_id, self.columns, source_format=self.detected_format)

    def to_yaml(self) -> str:
        """A draft contract for a human to review."""
        quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        head = {
            "partner_id": "REPLACE_ME", "contract_version": 1, "source_format": self.detected_format, "partition_column": self.suggested_partition_column or "effective_start_date",
            "overall_quality_risk": self.overall_quality_risk, "reviewed_by": "REPLACE_ME", "reviewed_at": "REPLACE_ME",
        }
        lines = [f"# DRAFT data contract, to be reviewed ({self.mode}, {self.inferred_at})", *(f"{k}: {v}" for k, v in head.items()), "columns:"]
        for c in self.columns:
            lines += [f"  - source_column: {quote(c.source_column)}", f"    canonical_field: {c.canonical_field}", f"    confidence: {c.confidence:.2f}", f"    pii_tier: {c.pii_tier}"]
            lines += ["    cleansing_rules:", *(f"      - {r}" for r in c.cleansing_rules)] if c.cleansing_rules else []
            lines.append(f"    reasoning: {quote(c.reasoning)}")
        return "\n".join(lines) + "\n"


#: A stronger classifier: takes the file name and the sampled rows, returns the columns; any failure falls through.
Classifier = Callable[[str, list[dict]], list[ContractColumn]]


def infer_schema(filename: str, sample: DataFrame, inferred_at: str, classifiers: list[Classifier] = (), rows: int = 50) -> Inference:
    """Classify the columns of a sample. classifiers are tried in order, the local one comes last. An empty sample is an error."""
    from rosterlake.sources.files import format_of

    sample = sample.limit(rows)
    first = sample.limit(SNIFFED_ROWS).select(*(F.col(f"`{c}`").cast("string").alias(c) for c in sample.columns))
    taken = [r.asDict() for r in first.collect()]  # at most SNIFFED_ROWS rows
    if not taken:
        raise ValueError("the sample holds no rows")
    columns, mode = None, "local"
    for classify in classifiers:
        try:
            columns, mode = classify(filename, taken), getattr(classify, "__name__", "remote")
            break
        except Exception:  # noqa: BLE001  a classifier that fails leaves the field to the next one
            continue
    if columns is None:
        open_ = [c for c in sample.columns if classify_header(c) is None]
        columns = []
        for c in sample.columns:
            field, tier, rules, reason, confidence = _sniff_list([r[c] for r in taken if r[c]]) if c in open_ else classify_header(c)
            columns.append(ContractColumn(c, field, confidence, tier, list(rules), reason))
    return Inference(filename, format_of(filename), columns, risk_of(columns), suggest_partition(columns), mode, inferred_at)


def _sniff_list(values: list[str]) -> tuple[str, str, tuple[str, ...], str, float]:
    if not values:
        return EMPTY
    return next((tuple(x) for p, *x in SHAPES if all(re.search(p, v) for v in values)), UNKNOWN)


def write_sidecar(spark, sample: DataFrame, path: str, inferred_at: str) -> bool:
    """Best effort: <path>.schema.yaml beside a landed file. False if anything fails; ingest never does."""
    try:
        text = infer_schema(path.rsplit("/", 1)[-1], sample.limit(10), inferred_at).to_yaml()
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path + ".schema.yaml")
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(text.encode()))
        out.close()
        return True
    except Exception:  # noqa: BLE001
        return False
