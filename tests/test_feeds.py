"""Files, contracts, inference, change feeds, streams, vault and quality on small fixtures."""

import base64
import hashlib
import hmac
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.operators import cdc, infer, quality, vault
from rosterlake.operators import contracts as K
from rosterlake.sources import files, sinks
from rosterlake.streaming import feeds

KEY = b"dev-only-not-for-prod"
MAPPING = {"emp_no": "partner_member_id", "fname": "first_name", "lname": "last_name", "birth": "dob", "social": "ssn", "mail": "email", "postal": "zip", "st": "state", "noise": "ignore"}


def put(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


# ---- files

def test_csv_and_tsv(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'EmployeeID,FirstName,Zip\n1,"O""Brien, Ann",00501\n2,Hernández,\n3,Last,9\n')
    rows = files.load_sample(spark, p, 2).collect()
    assert [tuple(r) for r in rows] == [("1", 'O"Brien, Ann', "00501"), ("2", "Hernández", "")]
    t = put(tmp_path / "a.tsv", "a\tb\n1\tx y\n")
    assert [tuple(r) for r in files.load_sample(spark, t).collect()] == [("1", "x y")]


def test_json_and_lines(spark, tmp_path):
    p = put(tmp_path / "m.json", json.dumps({"feed": "1", "members": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]}, indent=1))
    assert [tuple(r) for r in files.load_sample(spark, p).collect()] == [("1", "x"), ("2", None)]
    q = put(tmp_path / "n.json", json.dumps([{"a": 1}, {"a": 2}, {"a": 3}]))
    assert files.load_sample(spark, q, 2).count() == 2
    r = put(tmp_path / "l.ndjson", '{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    assert [x.a for x in files.load_sample(spark, r, 3).collect()] == ["1", "2"]  # the first three lines, one of them blank
    assert files.load_sample(spark, r).count() == 3


def test_unsupported_suffix(spark):
    for name in ("a.xlsx", "a", "a.pdf"):
        with pytest.raises(files.UnsupportedFormat):
            files.load_sample(spark, name)
    assert [files.format_of(x) for x in ("a.CSV", "a.edi", "a.834", "a.txt", "a.bin")] == ["csv", "x12_834", "x12_834", "fixed_width", "other"]


def test_834(spark, tmp_path):
    text = """ISA*00*~GS*BE~
ST*834*0001~BGN*00*1~

INS*Y*18*030*20*A***FT~
REF*0F*NW-1~REF*1L*PLAN-A~
DTP*356*D8*20260101~NM1*IL*1*Williams*Marcus*A***34*250000000~PER*IP**HP*4045551212~N3*440 Lake Dr~N4*Atlanta*GA*30303~DMG*D8*19800614*M~HD*030**HLT~DTP*348*D8*20260201~
INS*Y*18*001~REF*0F*NW-2~NM1*IL*1*Tanaka*Yuki~DMG*D8*bad*F~
SE*99*0001~"""
    p = put(tmp_path / "x.edi", text)
    one, two = files.scan_834(spark, p).orderBy("member_no").collect()
    assert (one.partner_member_id, one.plan_code, one.first_name, one.middle_name, one.last_name, one.ssn, one.phone, one.zip, one.dob, one.start_date) == ("NW-1", "PLAN-A", "Marcus", "A", "Williams", "250000000", "4045551212", "30303", "1980-06-14", "2026-02-01")
    assert (two.partner_member_id, two.first_name, two.ssn, two.dob, two.gender, two.zip) == ("NW-2", "Yuki", None, None, "F", None)
    n = files.count_segments_834(spark, p).first()
    assert n.declared == 99 and n.segments == 18


def test_834_work_grows_with_the_file(spark, tmp_path):
    n = 12_000
    loops = "".join(f"\nINS*Y*18*021~\nREF*0F*M{i}~REF*1L*P~NM1*IL*1*COLLINS*F{i}~\n* ~~N4*Atlanta*GA*30303~DTP*356*D8*20260101~" for i in range(1, n + 1))
    p = put(tmp_path / "big.834", f"ISA*00*~{loops}SE*1*1~")
    began = time.time()
    got = files.scan_834(spark, p).select("member_no", "partner_member_id", "first_name", "zip", "start_date").collect()
    assert time.time() - began < 30  # of copies for every segment it took minutes
    assert sorted(map(tuple, got)) == [(i, f"M{i}", f"F{i}", "30303", "2026-01-01") for i in range(1, n + 1)]


def test_834_loops_go_over_blocks(spark, tmp_path):
    loops = "".join(f"INS*Y*18*021~REF*0F*M{i}~" + "HD*030**HLT~" * 40 + f"N3*{i} Main St~" for i in range(1, 41))
    p = put(tmp_path / "cut.834", f"ISA*00*~{loops}INS~ INS *x~")
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert spark.read.option("lineSep", "~").text(p).rdd.getNumPartitions() > 40  # blocks shorter than a loop
        got = files.scan_834(spark, p).select("member_no", "partner_member_id", "address_line_1").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [*((i, f"M{i}", f"{i} Main St") for i in range(1, 41)), (41, None, None)]


def test_fixed_width(spark, tmp_path):
    p = put(tmp_path / "x.txt", "001  Ann  \n002       \n")
    assert [tuple(r) for r in files.scan_fixed_width(spark, p, [("id", 1, 5), ("name", 6, 5)]).collect()] == [("001", "Ann"), ("002", None)]


def test_layers_and_keyed_table(spark, tmp_path):
    rows = spark.createDataFrame([("p", "1", "x"), ("q", "2", None)], "partner string, a string, b string")
    for attempt in ("first", "again"):
        sinks.bronze_copy(rows, f"{tmp_path}/bronze", F.col("partner"), "2024-06-30", attempt)
    got = spark.read.parquet(f"{tmp_path}/bronze")
    assert got.count() == 2 and {r._ingest_id for r in got.collect()} == {"again"} and os.path.isdir(f"{tmp_path}/bronze/partner_id=p/dt=2024-06-30")
    keyed = sinks.KeyedTable(spark, f"{tmp_path}/keyed", ["k"])
    assert keyed.read() is None
    make = lambda *r: spark.createDataFrame(r, "k string, v int")
    keyed.upsert(make(("a", 1), ("a", 3), ("b", 1)), [F.col("v")])
    seen = keyed.read()
    keyed.upsert(make(("a", 2), ("c", 9)), [F.col("v")])
    os.makedirs(f"{tmp_path}/keyed/999999999999-torn")  # a version without its marker is not read
    assert sorted(map(tuple, seen.collect())) == [("a", 3), ("b", 1)]
    assert sorted(map(tuple, keyed.read().collect())) == [("a", 2), ("b", 1), ("c", 9)]


def test_bands(spark):
    got = files.sample_bands(spark.range(500).withColumnRenamed("id", "k"), "k", 20).collect()
    assert len(got) == len({r.k for r in got}) == 60 and {r.k for r in got if r.band == "first"} == set(range(20)) and {r.k for r in got if r.band == "last"} == set(range(480, 500))
    assert files.sample_bands(spark.range(25).withColumnRenamed("id", "k"), "k", 20).count() == 25


def test_relay(spark):
    box = spark.createDataFrame([("1", "a"), ("2", "b")], "outbox_id string, payload string").withColumn("enqueued_at", F.current_timestamp())
    first, offsets = sinks.relay(box, None, "2024-01-01")
    assert first.count() == 2 and sinks.relay(box, offsets, "2024-01-02")[0].count() == 0


# ---- contracts

def test_contract_map(spark):
    d = spark.createDataFrame([("1", "A", "drop", "B")], "emp_no string, fname string, noise string, given string")
    got = K.contract_map(d, {**K.Contract("p", [K.ContractColumn(a, b) for a, b in MAPPING.items()]).mapping(), "given": "first_name"})
    assert got.columns == ["partner_member_id", "first_name"] and got.first().first_name == "B"  # the last of two columns wins


def test_roster_items(spark):
    rows = [("A-100001", "Bob", " Smith ", "04/12/1962", "123-45-6789", "92103-1", "2024-01-01", ""), ("A-100003", "No", "Zip", "1980-01-01", "", "", "", ""), ("A-100004", "Bad", "Date", "soon", "", "501", "", ""), ("A-100002", "Ed", "Li", "19620412", "12", "501", "x", "06/30/2024")]
    d = spark.createDataFrame(rows, "EmployeeID string, FirstName string, LastName string, DOB string, SSN string, PostalCode string, EligStartDate string, EligEndDate string")
    got = {r.partner_member_id: r for r in K.roster_items(d, F.lit("acme-corp")).collect()}
    assert set(got) == {"A-100001", "A-100002"}
    one, two = got["A-100001"], got["A-100002"]
    assert (one.golden_record_id, one.lookup_key, one.ssn_last4, one.effective_end_date) == ("G-58FE", "92103#1962-04-12#smith", "6789", None)
    assert (two.golden_record_id, two.zip, two.ssn_last4, two.effective_start_date, two.effective_end_date) == ("G-C929", "00501", None, "x", "2024-06-30")


def test_rules(spark):
    d = spark.createDataFrame([("  o'BRIEN-mcdonald ", "A@B.example", "(404) 555-1212", "078-05-1120", "Texas")], "name string, email string, phone string, ssn string, state string")
    got = K.apply_rules(d, {"name": ["strip_whitespace", "title_case_with_diacritics"], "email": ["lowercase", "rfc5322_validate", "tokenize_via_skyflow"], "phone": ["e164_normalize"], "ssn": ["validate_ssn_format", "store_last_4_only"], "state": ["uppercase", "validate_us_state_abbrev", "usps_validate"]}).first()
    assert (got.name, got.email, got.phone, got.ssn, got.state) == ("O'Brien-Mcdonald", "a@b.example", "+14045551212", "1120", "TEXAS")
    assert got.problems == ["ssn:validate_ssn_format", "state:validate_us_state_abbrev"]
    assert spark.range(1).select(K.title_case(F.lit("mcDONALD van HALEN josé"))).first()[0] == "McDonald Van Halen José"
    with pytest.raises(ValueError):
        K.apply_rules(d, {"name": ["no_such_rule"]})


def test_fingerprint_and_drift(spark):
    a = spark.createDataFrame([], "x string, y int")
    assert K.fingerprint(a) == K.fingerprint(a.select("y", "x")) != K.fingerprint(a.select("x"))
    seen = spark.createDataFrame([("p", "f1"), ("q", "f2")], "partner_id string, schema_fingerprint string")
    assert [r.partner_id for r in K.schema_drift(seen, seen.where("partner_id = 'p'")).collect()] == ["q"]


def test_ssn_and_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(N.ssn_valid(F.lit(s))) for s in ("250-77-8899", "250778899", "000-12-3456", "666-12-3456", "900-12-3456", "123-45-6789", "250-00-1234", "x")] == [True, True] + [False] * 6
    assert [one(N.normalize_name(F.lit(s))) for s in ("Nguyễn", "Ionuț", "ﬁona", "Ｊｏｓé", "Robert Jr.", "Æ")] == ["nguyen", "ionut", "fiona", "jose", "robert", ""]
    assert [one(N.soundex_reset(F.lit(s))) for s in ("Smith", "Smyth", "Tymczak", "9abc", "Garcia-Lopez")] == ["S530", "S530", "T522", "A120", "G624"]
    assert [one(F.soundex(F.lit(s))) for s in ("Ashcraft", "9abc")] == ["A261", "9abc"]
    assert one(N.parse_verdict(F.lit('x ```json\n{"match": true, "confidence": 0.5}\n```'))) == (True, 0.5, "") and one(N.parse_verdict(F.lit("none"))) is None


def test_every_folded_letter_of_the_basic_plane(spark):
    import unicodedata

    letters = [chr(c) for c in range(0xA1, 0x10000) if unicodedata.category(chr(c)).startswith("L") and unicodedata.decomposition(chr(c))]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", N.fold_ascii(F.col("c")).alias("f")).collect()
    assert all(r.f == unicodedata.normalize("NFKD", r.c).encode("ascii", "ignore").decode() for r in got) and len(got) > 1000


# ---- inference

EMPLOYER = ("EmployeeID", "FirstName", "LastName", "DOB", "SSN", "Email", "Address1", "City", "State", "PostalCode", "EligStartDate", "EligEndDate", "PlanCode")
PAYER = ("subscriberId", "givenName", "familyName", "dateOfBirth", "ssn", "contactEmail", "addressLine1", "addressCity", "addressState", "postalCode", "coverageStart", "coverageEnd", "productCode")


def sample(spark, names, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{n}` string" for n in names))


def test_infer_from_headers(spark):
    got = infer.infer_schema("a.csv", sample(spark, EMPLOYER, tuple("x" for _ in EMPLOYER)), "now")
    assert all(c.confidence == 0.92 for c in got.columns) and sum(c.pii_tier == infer.T1 for c in got.columns) == 6
    assert (got.overall_quality_risk, got.suggested_partition_column, got.detected_format, got.mode) == ("MEDIUM", "EligStartDate", "csv", "local")
    assert 'source_column: "DOB"' in got.to_yaml() and "partition_column: EligStartDate" in got.to_yaml() and got.contract("p").mapping()["DOB"] == "dob"


def test_infer_from_values(spark):
    row = ("S1", "Ann", "Li", "1980-01-02", "123-45-6789", "a@b.example", "1 Main", "Austin", "TX", "78701", "2024-01-01", "", "P")
    by = {c.source_column: c for c in infer.infer_schema("m.json", sample(spark, PAYER, row), "now").columns}
    assert (by["dateOfBirth"].canonical_field, by["dateOfBirth"].confidence, by["contactEmail"].canonical_field, by["contactEmail"].confidence) == ("dob", 0.7, "email", 0.85)
    assert (by["addressCity"].canonical_field, by["addressCity"].confidence) == ("ignore", 0.4)
    opaque = infer.infer_schema("x.csv", sample(spark, ("col1", "col2", "col3"), ("1980-01-02", "a@b.example", "78701"), ("1/2/80", "c@d.example", "78701-1234")), "now")
    assert [c.canonical_field for c in opaque.columns] == ["dob", "email", "zip"]
    assert infer.infer_schema("x.csv", sample(spark, ("foo",), ("bar",), ("baz",)), "now").overall_quality_risk == "HIGH"


def test_inference_modes(spark, tmp_path):
    d = sample(spark, ("foo",), ("bar",))

    def broken(name, rows):
        raise OSError("no network")

    def remote(name, rows):
        return [K.ContractColumn("foo", "plan_code", 0.99)]

    assert infer.infer_schema("x.csv", d, "now", [broken, remote]).mode == "remote" and infer.infer_schema("x.csv", d, "now", [broken]).mode == "local"
    with pytest.raises(ValueError):
        infer.infer_schema("x.csv", d.limit(0), "now")
    assert infer.write_sidecar(spark, d, f"{tmp_path}/x.csv", "now") and "source_column" in open(f"{tmp_path}/x.csv.schema.yaml").read()
    assert not infer.write_sidecar(spark, d.limit(0), f"{tmp_path}/y.csv", "now")


# ---- change feeds

def envelope(op, row, partner="acme", lsn="7", ts=1_700_000_000_000, side=None):
    side = side or ("before" if op == "d" else "after")
    return (op, row if side == "before" else None, row if side == "after" else None, (partner, lsn), ts)


ROW = {"emp_no": "E1", "fname": " bob ", "lname": "SMITH", "birth": "04/12/1962", "social": "123-45-6789", "mail": "Bob@Example.org", "postal": "9210", "st": "california", "unknown": "x", "noise": "y"}


def events(spark, *rows):
    return cdc.process(spark.createDataFrame(list(rows), cdc.ENVELOPE), MAPPING, KEY)


def test_cdc_create(spark):
    (e,) = events(spark, envelope("c", ROW)).collect()
    token = base64.b32encode(hmac.new(KEY, b"acme|ssn|123-45-6789", hashlib.sha256).digest()[:16]).decode().rstrip("=").lower()
    assert (e.partner_id, e.partner_member_id, e.operation, e.first_name, e.last_name, e.dob, e.zip, e.state, e.ssn_last4) == ("acme", "E1", "upsert", "robert", "smith", "1962-04-12", "09210", "CA", "6789")
    assert e.ssn_token == f"tok_{token}" == "tok_tflvnicmf32i5cqdqp2hnbydme" and e.email_token.startswith("tok_")
    assert not {"ssn", "email", "unknown", "noise"} & set(e.asDict()) and e.problem is None and not any("123-45-6789" in str(v) for v in e)


def test_cdc_delete_unknown_and_bad(spark):
    got = events(spark, envelope("d", ROW), envelope("?", ROW), envelope("u", {"member_id": "M2", "birth": "never"}), envelope("r", {"emp_id": "E3"}, partner=None), envelope("c", None, lsn=None)).collect()
    assert [(e.operation, e.partner_member_id, e.problem) for e in got] == [("delete", "E1", None), ("upsert", "M2", None), ("upsert", "E3", "no partner"), ("upsert", "", "no row")]
    assert got[1].dob is None and got[1].ssn_token is None and got[2].partner_id == "unknown" and got[3].source_lsn is None


def test_latest_and_deletes(spark):
    d = events(spark, envelope("c", ROW, lsn="9", ts=1000), envelope("u", {**ROW, "lname": "Jones"}, lsn="10", ts=1000), envelope("c", {**ROW, "emp_no": "E2"}, ts=5), envelope("d", {**ROW, "emp_no": "E2"}, ts=1_700_000_000_000))
    got = {r.partner_member_id: r for r in cdc.apply_deletes(cdc.latest(d)).collect()}
    assert got["E1"].last_name == "jones"  # LSNs order as numbers
    assert (got["E2"].operation, got["E2"].effective_end_date) == ("delete", "2023-11-14")


def test_stream_state_survives_a_replay(spark, tmp_path):
    folder = f"{tmp_path}/in"
    write = lambda *rows: spark.createDataFrame(list(rows), cdc.ENVELOPE).coalesce(1).write.mode("append").json(folder)
    table = sinks.KeyedTable(spark, f"{tmp_path}/state", ["partner_id", "partner_member_id"])
    run = lambda ck: feeds.keep_latest_state(feeds.cdc_events(feeds.read_envelopes(spark, folder), MAPPING, KEY), table, f"{tmp_path}/{ck}").awaitTermination()
    write(envelope("c", ROW, ts=1), envelope("u", {**ROW, "lname": "Jones"}, ts=2), envelope("c", {**ROW, "emp_no": "E2"}, ts=1, partner=None))
    run("ck")
    write(envelope("d", ROW, ts=3))
    run("ck")
    first = sorted(map(str, table.read().collect()))
    assert len(first) == 1 and "delete" in first[0]
    run("another")  # the whole feed once more
    assert sorted(map(str, table.read().collect())) == first


# ---- vault

def test_vault(spark):
    req = spark.createDataFrame([("acme", "ssn", "123-45-6789"), ("acme", "ssn", "123-45-6789"), ("blue", "ssn", "123-45-6789"), ("acme", "email", "a@b.example")], "partner_id string, field string, value string")
    toks = vault.tokenize(req, KEY)
    a, b, c, e = [r.token for r in toks.collect()]
    assert a == b == "tok_tflvnicmf32i5cqdqp2hnbydme" and c == "tok_lciojrjkircqjr5adusggpieqi" and vault.vault_table(toks).count() == 3
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate([(a, "service:idv-api", "idv_match", False), (a, "human:alice", "support_case_12345", True), (e, "human:alice", "support_case_1", False), (e, "human:alice", "support_case_1", True), (a, "eve", "random_browse", True), ("tok_x", "service:idv-api", "idv_match", True)])], "no int, token string, actor string, purpose string, ok boolean")
    loose = vault.detokenize(asked, vault.vault_table(toks)).orderBy("no").collect()
    assert [(r.result, r.value, r.reason) for r in loose] == [("success", "123-45-6789", ""), ("success", "123-45-6789", ""), ("success", "a@b.example", ""), ("success", "a@b.example", ""), ("denied", None, "policy"), ("error", None, "token not found")]
    strict = vault.detokenize(asked, vault.vault_table(toks), strict=True, approved="ok").orderBy("no").collect()
    assert [r.result for r in strict] == ["success", "denied", "denied", "success", "denied", "error"]
    trail = vault.audit_of_detokenize(vault.detokenize(asked, vault.vault_table(toks)), F.lit("2024-01-01").cast("timestamp"))
    assert [(r.field, r.partner_id) for r in trail.collect() if r.action == "denied"] == [(None, None)]
    assert {(r.actor, r.calls, r.alert) for r in vault.audit_volume(trail, 2).collect()} == {("service:idv-api", 2, False), ("human:alice", 3, True)}

    def broken(_):
        raise OSError("sink is down")

    assert not vault.swallow(broken, trail) and vault.swallow(lambda d: d.count(), trail)


# ---- quality

def test_checks_and_gates(spark):
    d = spark.createDataFrame([("a", "1", 5), ("a", None, 7), ("b", "x", None)], "k string, v string, n int")
    checks = [quality.Check("m", "missing", ("v",)), quality.Check("i", "invalid", ("v",), "v RLIKE '^[0-9]$'"), quality.Check("d", "duplicates", ("k",)), quality.Check("r", "rows", passed="value > 0"), quality.Check("g", "groups", ("k",), "count(n) = 0", severity="critical"), quality.Check("f", "failed", (), "n > 6", severity="warn")]
    got = {r["name"]: (r.value, r.passed) for r in quality.run_checks(d, checks, "2024-01-01").collect()}
    assert got == {"m": (1, False), "i": (1, False), "d": (1, False), "r": (3, True), "g": (1, False), "f": (1, False)}
    gate = quality.Gate()
    with pytest.raises(quality.GateClosed, match="d, g, i, m"):
        gate.require(quality.run_checks(d, checks, "2024-01-01"))
    assert gate.read(quality.run_checks(d, checks[5:], "2024-01-01"))  # a warning closes nothing
    empty = {r["name"]: r.passed for r in quality.run_checks(d.limit(0), [*checks, quality.Check("t", "freshness_hours", ("t",), passed="value < 30")][:0] or checks, "2024-01-01").collect()}
    assert empty["r"] is False and empty["m"]
    assert quality.Gate(most_row_change=0.001).steady(1000, 1000) and not quality.Gate(most_row_change=0.001).steady(1000, 1001)


def test_freshness_of_nothing_fails(spark):
    d = spark.createDataFrame([], "t timestamp")
    (r,) = quality.run_checks(d, [quality.Check("t", "freshness_hours", ("t",), passed="value < 30")], "2024-01-01").collect()
    assert r.value is None and not r.passed
