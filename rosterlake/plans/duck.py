"""DuckDB SQL of the derived inputs and field rules, written apart from the engine's own expressions."""

from __future__ import annotations

from rosterlake.functions import normalize as N
from rosterlake.functions import tokens as T

from .roster import AS_OF, ROSTER


def token(key: bytes, partner: str, field: str, value: str) -> str:
    """HMAC-SHA256 and base32 of partner|field|value; SQL expressions in, SQL expression out."""
    key = key.ljust(64, b"\0")
    pad = lambda x: f"unhex('{bytes(b ^ x for b in key).hex()}')"
    msg = f"encode(concat_ws('|', {partner}, {field}, {value}))"
    digest = f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || {msg})))"
    bits = f"rpad(array_to_string(list_transform(string_split(left({digest}, 32), ''), lambda c: right(bin(('0x' || c)::INT + 16), 4)), ''), 130, '0')"
    letters = f"list_transform(range(26), lambda i: substr('{T.ALPHABET}', 1 + list_sum(list_transform(range(5), lambda j: substr({bits}, i * 5 + j + 1, 1)::INT * (1 << (4 - j))))::INT, 1))"
    return f"CASE WHEN coalesce({value}, '') <> '' THEN 'tok_' || array_to_string({letters}, '') END"


def name(x: str) -> str:
    formal = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.NICKNAMES.items())
    drop = ", ".join(f"'{s}'" for s in ("", *N.SUFFIXES))
    words = f"string_split(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z\\-'' ]', ' ', 'g'), ' ')"
    return f"array_to_string(list_transform(list_filter({words}, lambda w: w NOT IN ({drop})), lambda w: CASE w {formal} ELSE w END), ' ')"


def _collapsed(codes: str, digits: str) -> str:
    for d in digits:
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return codes


def soundex(x: str) -> str:
    """H, W and vowels all end a run."""
    letters = f"regexp_replace(upper(coalesce({x}, '')), '[^A-Z]', '', 'g')"
    codes = _collapsed(f"translate({letters}, 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556')", "0123456")
    return f"CASE WHEN {letters} = '' THEN '' ELSE rpad(left(left({letters}, 1) || replace(substr({codes}, 2), '0', ''), 4), 4, '0') END"


def soundex_us(x: str) -> str:
    """The SQL dialect: H and W are skipped, anything that is no letter ends a run."""
    rest = f"regexp_replace(regexp_replace(upper(substr({x}, 2)), '[^A-Z]', '0', 'g'), '[HW]', '', 'g')"
    codes = _collapsed(f"translate(upper(left({x}, 1)) || {rest}, 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000077111122222222334556')", "01234567")
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN NOT regexp_matches(upper(left({x}, 1)), '^[A-Z]') THEN {x} ELSE rpad(left(upper(left({x}, 1)) || replace(substr({codes}, 2), '0', ''), 4), 4, '0') END"


DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')".format


def dob(x: str = "dob") -> str:
    return f"CAST(try_strptime(trim({x}), ['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d', '%d/%m/%Y', '%Y%m%d']) AS DATE)"


def zip5(x: str = "zip") -> str:
    return f"CASE WHEN {DIGITS(f"coalesce({x}, '')")} = '' THEN '' ELSE lpad(left({DIGITS(x)}, 5), 5, '0') END"


def blocks(last: str, dob_sql: str, zip_sql: str) -> str:
    return f"list_distinct({all_blocks(last, dob_sql, zip_sql)})"


def all_blocks(last: str, dob_sql: str, zip_sql: str) -> str:
    n = name(last)
    parts = f"CASE WHEN {n} = '' THEN [''] ELSE list_filter(list_concat([{n}], string_split({n}, '-'), string_split({n}, ' ')), lambda x: x <> '') END"
    year = f"CASE WHEN {dob_sql} IS NULL THEN '????' ELSE strftime({dob_sql}, '%Y') END"
    zip3 = f"CASE WHEN {zip_sql} = '' THEN '???' ELSE left({zip_sql}, 3) END"
    return f"list_transform({parts}, lambda x: concat({year}, '|', {soundex('x')}, '|', {zip3}))"


SECRET = b"roster queries"
_own = lambda f: token(SECRET, "partner_id", f"'{f}'", f)
SILVER = f"""
WITH roster AS ({ROSTER}), base AS (
  SELECT silver_record_id, partner_id, partner_member_id, trim(regexp_replace(first_name, '\\s+', ' ', 'g')) AS first_name, trim(regexp_replace(middle_name, '\\s+', ' ', 'g')) AS middle_name,
    trim(regexp_replace(last_name, '\\s+', ' ', 'g')) AS last_name, {dob()} AS dob,
    CASE WHEN upper(trim(gender)) IN ('M', 'MALE') THEN 'M' WHEN upper(trim(gender)) IN ('F', 'FEMALE') THEN 'F' WHEN upper(trim(gender)) IN ('X', 'NB', 'NONBINARY') THEN 'X' ELSE 'U' END AS gender,
    CASE WHEN coalesce({DIGITS('ssn')}, '') <> '' THEN right({DIGITS('ssn')}, 4) END AS ssn_last4, ssn, email, phone, address_line_1,
    CASE trim(city) WHEN 'new york' THEN 'New York' ELSE 'Los Angeles' END AS city,
    upper(left(regexp_replace(state, '[^A-Za-z]', '', 'g'), 2)) AS state, lpad({DIGITS('zip')}, 5, '0') AS zip, upper(trim(plan_code)) AS plan_code, trim(employer_name) AS employer_name,
    CAST(try_strptime(start_date, '%Y-%m-%d') AS DATE) AS effective_start_date, CAST(try_strptime(end_date, '%Y-%m-%d') AS DATE) AS effective_end_date, load_no AS contract_version, updated_at, k, p, load_no
  FROM roster
), flagged AS (
  SELECT *, list_filter([CASE WHEN dob IS NULL THEN 'dob_unparseable' END, CASE WHEN dob > DATE '{AS_OF}' THEN 'dob_in_future' END,
    CASE WHEN dob < DATE '1900-01-01' THEN 'dob_pre_1900' END, CASE WHEN last_name IS NULL OR last_name = '' THEN 'last_name_missing' END,
    CASE WHEN first_name IS NULL OR first_name = '' THEN 'first_name_missing' END, CASE WHEN zip IS NOT NULL AND NOT regexp_full_match(zip, '[0-9]{{5}}') THEN 'zip_invalid' END,
    CASE WHEN state IS NOT NULL AND length(state) <> 2 THEN 'state_invalid' END, CASE WHEN effective_end_date < effective_start_date THEN 'end_before_start' END],
    lambda f: f IS NOT NULL) AS quality_flags FROM base
), silver AS (
  SELECT *, CAST(greatest(1 - 0.1 * len(quality_flags), 0) AS DECIMAL(3,2)) AS quality_score,
    list_has_any(quality_flags, ['dob_unparseable', 'last_name_missing', 'ssn_token_format_invalid']) AS is_quarantined FROM flagged
)
"""
#: ssn_token and so on of silver, computed only where a query shows them.
TOKENS = {f"{f}_token": _own(f) for f in ("ssn", "email", "phone", "address_line_1")}
XREF = token(SECRET + b"|xref", "'*'", "'ssn'", "ssn")

# decisions: the first record of each SSN; without an SSN, another record of equal birth date, name sounds and ZIP asks for review
DECISIONS = f"""{SILVER}, prep AS (
  SELECT silver_record_id, ssn, 2 * k + load_no AS position, coalesce(strftime({dob()}, '%Y-%m-%d'), '') AS dob, {zip5()} AS zip, {soundex('first_name')} AS sxf, {soundex('last_name')} AS sxl FROM roster
), first_of AS (
  SELECT *, first_value(silver_record_id) OVER (PARTITION BY ssn ORDER BY position) AS of_ssn,
    first_value(silver_record_id) OVER (PARTITION BY dob, sxl, sxf, zip ORDER BY position) AS of_sound FROM prep
), decisions AS (
  SELECT silver_record_id, CASE WHEN ssn IS NOT NULL THEN of_ssn END AS matched_golden_record_id,
    CASE WHEN ssn IS NOT NULL THEN 'AUTO_MATCH' WHEN dob <> '' AND sxl <> '' AND sxf <> '' AND zip <> '' AND of_sound <> silver_record_id THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision FROM first_of
)"""


def gold_of(decided: str = DECISIONS, where: str = "NOT is_quarantined", out: str = "gold", suffix: str = "") -> str:
    return f"""{decided}, assigned{suffix} AS (
  SELECT s.*, coalesce(d.matched_golden_record_id, s.silver_record_id) AS golden_record_id FROM silver s LEFT JOIN (SELECT * FROM decisions WHERE decision <> 'REVIEW') d USING (silver_record_id) WHERE {where}
), {out} AS (
  SELECT * RENAME (partner_id AS primary_partner_id, partner_member_id AS primary_partner_member_id), effective_end_date IS NULL OR effective_end_date >= DATE '{AS_OF}' AS is_active FROM (
    SELECT *, row_number() OVER (PARTITION BY golden_record_id ORDER BY updated_at DESC, silver_record_id) AS rn, list_sort(array_agg(DISTINCT partner_id) OVER (PARTITION BY golden_record_id)) AS source_partner_ids,
      list_sort(array_agg(DISTINCT silver_record_id) OVER (PARTITION BY golden_record_id)) AS source_silver_record_ids FROM assigned{suffix}) x WHERE rn = 1
)"""


GOLD = gold_of()
REQUESTS = f"""requests AS (
  SELECT silver_record_id AS request_id, first_name, CASE WHEN k % 11 = 5 THEN left(last_name, 4) || 'zz' ELSE last_name END AS last_name, {dob()} AS dob, CASE WHEN k % 13 = 6 THEN '1' ELSE zip END AS zip_raw,
    CASE WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 2 THEN '12a4' ELSE right({DIGITS('ssn')}, 4) END AS ssn_last4 FROM roster
), checked AS (
  SELECT *, lpad(left({DIGITS('zip_raw')}, 5), 5, '0') AS zip, list_filter([CASE WHEN first_name IS NULL OR length(first_name) NOT BETWEEN 1 AND 100 THEN 'first_name' END,
    CASE WHEN last_name IS NULL OR length(last_name) NOT BETWEEN 1 AND 100 THEN 'last_name' END, CASE WHEN dob IS NULL THEN 'dob' END, CASE WHEN zip_raw IS NULL OR length(zip_raw) NOT BETWEEN 3 AND 10 THEN 'zip' END,
    CASE WHEN ssn_last4 IS NOT NULL AND NOT regexp_full_match(ssn_last4, '[0-9]{{4}}') THEN 'ssn_last4' END], lambda x: x IS NOT NULL) AS problems FROM requests
)"""
# step one: exact matches; step two: similar names for the requests that have none
VERIFY = f"""{GOLD}, {REQUESTS}, valid AS (SELECT * FROM checked WHERE len(problems) = 0),
exact AS (
  SELECT r.request_id, g.golden_record_id, g.primary_partner_id AS partner_id, coalesce(g.effective_end_date < DATE '{AS_OF}', FALSE) AS ended FROM valid r JOIN gold g ON r.dob = g.dob AND r.zip = g.zip AND lower(trim(r.last_name)) = lower(trim(g.last_name))
  WHERE coalesce(r.ssn_last4, '') = '' OR coalesce(g.ssn_last4, '') = '' OR r.ssn_last4 = g.ssn_last4
), near AS (
  SELECT r.request_id, g.golden_record_id, g.primary_partner_id AS partner_id FROM valid r JOIN gold g ON year(r.dob) = year(g.dob) AND left(r.zip, 3) = left(g.zip, 3) AND starts_with(lower(trim(g.last_name)), left(lower(trim(r.last_name)), 4))
), decided AS (
  SELECT request_id, (SELECT count(*) FROM exact e WHERE e.request_id = r.request_id) AS n, (SELECT count(*) FROM near e WHERE e.request_id = r.request_id) AS f FROM valid r
), answers AS (
  SELECT d.request_id, CASE WHEN n = 1 AND e.ended THEN 'INELIGIBLE' WHEN n = 1 THEN 'VERIFIED' WHEN n > 1 THEN 'AMBIGUOUS' WHEN f = 1 THEN 'NEEDS_REVIEW' ELSE 'NOT_FOUND' END AS status,
    CASE WHEN n = 1 THEN CAST(1.0 AS DOUBLE) WHEN n > 1 THEN 0.5 WHEN f = 1 THEN 0.7 ELSE 0.0 END AS score,
    CASE WHEN n = 1 THEN e.golden_record_id WHEN n = 0 AND f = 1 THEN m.golden_record_id END AS golden_record_id, CASE WHEN n = 1 THEN e.partner_id WHEN n = 0 AND f = 1 THEN m.partner_id END AS partner_id
  FROM decided d LEFT JOIN exact e ON d.n = 1 AND e.request_id = d.request_id LEFT JOIN near m ON d.n = 0 AND d.f = 1 AND m.request_id = d.request_id
)"""
# the resolver: partner_1 against all others, vectors as rows of counts
MATCH = f"""WITH roster AS ({ROSTER}), prep AS (
  SELECT silver_record_id AS id, partner_id, 2 * k + load_no AS position, ssn, coalesce(right({DIGITS('ssn')}, 4), '') AS ssn4, coalesce(strftime({dob()}, '%Y-%m-%d'), '') AS dob, {zip5()} AS zip,
    {name('first_name')} AS first, {name('last_name')} AS last, {soundex('first_name')} AS sxf, {soundex('last_name')} AS sxl, {blocks('last_name', dob(), zip5())} AS blocks,
    concat('NAME: ', {name('first_name')}, ' ', {name('middle_name')}, ' ', {name('last_name')}, ' | DOB: ', coalesce(strftime({dob()}, '%Y-%m-%d'), ''), ' | ADDR: ', lower(trim(coalesce(address_line_1, ''))), ', ', lower(trim(coalesce(city, ''))), ', ', upper(trim(coalesce(state, ''))), ' ', {zip5()}, ' | SSN4: ', coalesce(right({DIGITS('ssn')}, 4), '')) AS features
  FROM roster
), a AS (SELECT * FROM prep WHERE partner_id = 'partner_1'), b AS (SELECT * FROM prep WHERE partner_id <> 'partner_1'),
hit AS (
  SELECT a.id, '1a' AS stage, b.id AS golden_id, b.position FROM a JOIN b ON a.ssn = b.ssn WHERE a.ssn <> ''
  UNION ALL SELECT a.id, '1b', b.id, b.position FROM a JOIN b ON a.ssn4 = b.ssn4 AND a.dob = b.dob AND a.zip = b.zip WHERE a.ssn4 <> '' AND a.dob <> '' AND a.zip <> ''
  UNION ALL SELECT a.id, '1c', b.id, b.position FROM a JOIN b ON a.dob = b.dob AND a.sxl = b.sxl AND a.sxf = b.sxf AND a.zip = b.zip WHERE a.dob <> '' AND a.sxl <> '' AND a.sxf <> '' AND a.zip <> ''
), sure AS (SELECT id, stage, golden_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, position) AS rn FROM hit) x WHERE rn = 1),
open AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM sure)),
pairs AS (SELECT DISTINCT x.id, y.id AS golden_id FROM (SELECT id, unnest(blocks) AS w FROM open) x JOIN (SELECT id, unnest(blocks) AS w FROM b) y USING (w)),
texts AS (SELECT DISTINCT features, lower(features) AS t FROM prep WHERE id IN (SELECT id FROM pairs UNION SELECT golden_id FROM pairs)),
grams AS (
  SELECT features, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM texts
  UNION ALL SELECT features, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM (SELECT features, list_filter(string_split(t, ' '), lambda w: w <> '') AS ws FROM texts) x
), vec AS (SELECT features, h % 256 AS at, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM (SELECT features, ('0x' || left(sha1(g), 8))::BIGINT AS h FROM grams) x GROUP BY ALL),
norm AS (SELECT features, sum(n * n) AS n2 FROM vec GROUP BY features),
sims AS (
  SELECT p.id, p.golden_id, any_value(b.position) AS position, coalesce(sum(u.n * v.n), 0)::DOUBLE / sqrt(any_value(m1.n2)::DOUBLE * any_value(m2.n2)::DOUBLE) AS sim
  FROM pairs p JOIN open a ON a.id = p.id JOIN b ON b.id = p.golden_id JOIN norm m1 ON m1.features = a.features JOIN norm m2 ON m2.features = b.features
  JOIN vec u ON u.features = a.features LEFT JOIN vec v ON v.features = b.features AND v.at = u.at GROUP BY p.id, p.golden_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, position) AS rn, count(*) OVER (PARTITION BY id) AS considered FROM sims),
scored AS (
  SELECT r.*, least((CASE WHEN x.first = y.first THEN 0.25::DOUBLE WHEN x.sxf = y.sxf THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN x.last = y.last THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN x.dob = y.dob THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN x.zip = y.zip THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN x.ssn4 <> '' AND x.ssn4 = y.ssn4 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) + (sim - 0.85::DOUBLE) * 0.5::DOUBLE, 0.999::DOUBLE) AS raw
  FROM ranked r JOIN open x ON x.id = r.id JOIN b y ON y.id = r.golden_id WHERE rn = 1
), judged AS (SELECT *, round_even(raw, 3) AS score FROM scored),
resolved AS (
  SELECT a.id, CASE WHEN s.id IS NOT NULL THEN s.golden_id WHEN j.sim >= 0.85 AND j.raw >= 0.80 THEN j.golden_id END AS golden_id,
    CASE WHEN s.id IS NOT NULL THEN 'AUTO_MATCH' WHEN j.id IS NULL OR j.sim < 0.85 THEN 'NO_MATCH' WHEN j.score >= 0.95 THEN 'AUTO_MATCH' WHEN j.score >= 0.80 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision,
    CASE s.stage WHEN '1a' THEN 1.0::DOUBLE WHEN '1b' THEN 0.98 WHEN '1c' THEN 0.97 ELSE CASE WHEN j.id IS NULL THEN 0.0 WHEN j.sim < 0.85 THEN j.sim ELSE j.score END END AS score,
    CASE WHEN s.id IS NOT NULL THEN 'deterministic' WHEN j.id IS NULL THEN 'no_candidate' WHEN j.sim < 0.85 THEN 'embedding' ELSE 'embedding+adjudication' END AS stage,
    CASE WHEN s.id IS NOT NULL THEN (SELECT count(*) FROM b) ELSE coalesce(j.considered, 0) END AS candidates_considered
  FROM a LEFT JOIN sure s USING (id) LEFT JOIN judged j USING (id)
)"""
