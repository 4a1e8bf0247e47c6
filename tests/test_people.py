"""Matching, verification and golden records on small hand-made people."""

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import gold as G
from rosterlake.operators import govern, knn
from rosterlake.operators import resolve as R
from rosterlake.operators import silver as S
from rosterlake.operators import verify as V

KEY = b"test"
FIELDS = "id string, ssn string, first_name string, last_name string, dob string, zip string, position long"


def people(spark, rows):
    return R.prepare(spark.createDataFrame(rows, FIELDS), "id", KEY)


def decide(spark, incoming, index, **options):
    got = R.resolve(people(spark, [(*r, 0) for r in incoming]), R.as_index(people(spark, [(*r, i) for i, r in enumerate(index)])), **options)
    return {r.id: r for r in got.collect()}


INDEX = [("G-A", "123-45-6789", "Robert", "Smith", "1962-04-12", "92103"), ("G-B", None, "Lin", "Chen", "1978-11-03", "10001"), ("G-C", "222-33-4444", "Maria", "Garcia", "1985-09-30", "78701")]


def test_exact_stages(spark):
    got = decide(spark, [("ssn", "123-45-6789", "X", "Y", "2000-01-01", "1"), ("ssn4", "999-99-6789", "Bob", "Smith", "04/12/1962", "92103-1234"), ("sound", None, "Lyn", "Chan", "1978-11-03", "10001"), ("none", None, "Zed", "Abernathy", "1950-01-01", "30301")], INDEX)
    row = lambda k: (got[k].golden_id, got[k].decision, got[k].score, got[k].stage, got[k].candidates_considered)
    assert row("ssn") == ("G-A", "AUTO_MATCH", 1.0, "deterministic", 3)
    assert row("ssn4") == ("G-A", "AUTO_MATCH", 0.98, "deterministic", 3)
    assert row("sound") == ("G-B", "AUTO_MATCH", 0.97, "deterministic", 3)
    assert row("none") == (None, "NO_MATCH", 0.0, "no_candidate", 0) and "blocking key" in got["none"].reasoning


def test_soundex_stage_hears_the_raw_names(spark):
    # Bob sounds like B100, the formal Robert like R163: the stage must not meet them
    got = decide(spark, [("bob", None, "Bob", "Smith", "1962-04-12", "92103")], [("G", None, "Robert", "Smith", "1962-04-12", "92103")])["bob"]
    assert got.stage != "deterministic"


def test_near_records_are_judged(spark):
    index = [("G", "111-22-3333", "Katherine", "Oldenburg", "1962-04-12", "92103")]
    got = decide(spark, [("near", None, "Kate", "Oldenburg", "1962-04-12", "92104"), ("far", None, "Zoltan", "Oldenburg", "1962-09-30", "92177")], index, least=0.6)
    assert (got["near"].stage, got["near"].candidates_considered) == ("embedding+adjudication", 1)
    assert got["near"].reasoning == "first name matches after normalization; last name matches; DOB matches exactly"
    low = decide(spark, [("far", None, "Zoltan", "Oldenburg", "1962-09-30", "92177")], index, least=0.99)["far"]
    assert low.stage == "embedding" and 0 < low.score < 0.99 and low.golden_id is None and low.decision == "NO_MATCH"


def test_an_adjudicator_can_be_plugged_in_and_falls_back(spark):
    index = [("G", None, "Katherine", "Oldenburg", "1962-04-12", "92103")]
    near = [("near", None, "Kate", "Oldenburg", "1962-04-12", "92104")]
    sure = decide(spark, near, index, least=0.6, adjudicator=lambda p: p.select("id", "golden_id", F.lit(0.99).alias("raw"), F.lit("outside").alias("reasoning")))["near"]
    assert (sure.decision, sure.golden_id, sure.reasoning) == ("AUTO_MATCH", "G", "outside")
    silent = decide(spark, near, index, least=0.6, adjudicator=lambda p: p.select("id", "golden_id", F.lit(None).cast("double").alias("raw"), F.lit("").alias("reasoning")))["near"]
    assert silent.reasoning.startswith("first name matches")


def test_adjudication_weights(spark):
    def score(a, b, sim):
        row = spark.range(1).select(R.adjudicate({k: F.lit(v) for k, v in a.items()}, {k: F.lit(v) for k, v in b.items()}, F.lit(sim)).alias("x"))
        return row.first().x

    full = {"first": "robert", "last": "smith", "dob": "1962-04-12", "zip": "92103", "ssn4": "6789", "sx_first": "R163"}
    assert score(full, full, 0.85) == 0.999
    assert abs(score(full, {**full, "ssn4": ""}, 0.85) - 0.85) < 1e-12
    blank = {**full, "ssn4": ""}
    assert abs(score(blank, blank, 0.85) - 0.85) < 1e-12  # blank digits are no agreement
    assert abs(score(full, {**full, "first": "rupert"}, 0.85) - 0.85) < 1e-12
    assert [spark.range(1).select(R.classify(F.lit(x))).first()[0] for x in (0.95, 0.949, 0.8, 0.799)] == ["AUTO_MATCH", "REVIEW", "REVIEW", "NO_MATCH"]


def test_known_cosine(spark):
    """A fixed pair of feature strings: two Marias with other names around them."""
    texts = ["NAME: maria  garcia lopez | DOB: 1985-09-30 | ADDR: , austin, TX 78701 | SSN4: 1234", "NAME: maria  garcia | DOB: 1985-09-30 | ADDR: , austin, TX 78704 | SSN4: 1234"]
    import hashlib
    import math

    def vector(t):
        t, out = t.lower(), [0] * 256
        words = t.split()
        for g in [t[i : i + 3] for i in range(len(t) - 2)] + [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]:
            h = int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "big")
            out[h % 256] += 1 if h >> 31 else -1
        return out

    a, b = map(vector, texts)
    want = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    made = {r.text: r for r in R.embed(spark.createDataFrame([(t,) for t in texts], "features string")).collect()}
    assert made[texts[0]].dense == a and made[texts[1]].dense == b
    inc = spark.createDataFrame([("i", texts[0])], "id string, features string")
    gold = spark.createDataFrame([("g", 0, texts[1])], "golden_id string, position long, features string")
    assert abs(R.similarities(spark.createDataFrame([("i", "g")], "id string, golden_id string"), inc, gold).first().sim - want) < 1e-12


def test_block_join_plans_no_nested_loop(spark):
    a = people(spark, [("x", None, "A", "Garcia-Lopez", "1985-09-30", "78701", 0)])
    b = R.as_index(people(spark, [("y", None, "A", "Garcia", "1985-01-01", "78704", 0)]))
    pairs = R.block_pairs(a, b)
    assert pairs.collect() == [("x", "y")] and "NestedLoop" not in pairs._jdf.queryExecution().toString()
    blank = people(spark, [("x", None, "A", "", "", "", 0), ("z", None, "A", "Li", "1990-01-01", "", 0)])
    assert {(r.block, r.n) for r in R.blank_blocks(blank).collect()} == {("????||???", 1), ("1990|L000|???", 1)}
    assert all(not r.blocks for r in R.without_blank_blocks(blank).collect())


SEED = [("G-0001", "acme", "Robert", "Smith", "1962-04-12", "92103", "6789", None), ("G-0005", "acme", "Ethan", "O'Brien", "1990-02-02", "60601", "1111", "2024-06-30"), ("G-0009", "blue", "Ann", "Martinez", "1980-05-05", "30303", None, None), ("G-0010", "blue", "Ann", "Martin", "1980-07-07", "30309", None, None)]


def golden(spark, more=()):
    d = spark.createDataFrame([*SEED, *more], "golden_record_id string, primary_partner_id string, first_name string, last_name string, dob string, zip string, ssn_last4 string, effective_end_date string")
    return d.withColumn("dob", F.to_date("dob"))


def ask(spark, rows, more=()):
    d = spark.createDataFrame(rows, "request_id string, first_name string, last_name string, dob string, zip string, ssn_last4 string").withColumn("dob", F.to_date("dob"))
    checked = V.validate_requests(d)
    return {r.request_id: (r.status, r.score, r.golden_record_id) for r in V.verify(checked.where(F.size("problems") == 0), golden(spark, more), "2026-01-01").collect()}


def test_verify(spark):
    got = ask(spark, [
        ("ok", "Robert", "Smith", "1962-04-12", "92103", "6789"), ("nick", "Bobby", " SMITH", "1962-04-12", "92103-0001", None), ("other", "Robert", "Smith", "1962-04-12", "92103", "0000"),
        ("ended", "Ethan", "O'Brien", "1990-02-02", "60601", None), ("one", "Ann", "Marti", "1980-01-01", "30301", None), ("none", "No", "Body", "1970-01-01", "00000", None), ("smi", "R", "Smi", "1962-01-01", "92199", None),
    ])
    assert got["ok"] == ("VERIFIED", 1.0, "G-0001") == got["nick"] and got["other"] == ("NEEDS_REVIEW", 0.7, "G-0001")
    assert got["ended"] == ("INELIGIBLE", 1.0, "G-0005")
    assert got["one"] == ("NOT_FOUND", 0.0, None)  # two similar records are no answer
    assert got["none"] == ("NOT_FOUND", 0.0, None) and got["smi"] == ("NEEDS_REVIEW", 0.7, "G-0001")


def test_one_active_match_beside_another_persons_ended_record(spark):
    ended = ("G-0100", "blue", "Rob", "Smith", "1962-04-12", "92103", "0000", "2020-01-01")
    assert ask(spark, [("ok", "Robert", "Smith", "1962-04-12", "92103", "6789")], [ended])["ok"] == ("VERIFIED", 1.0, "G-0001")
    assert ask(spark, [("many", "Robert", "Smith", "1962-04-12", "92103", None)], [ended])["many"][0] == "AMBIGUOUS"


def test_request_validation(spark):
    d = spark.createDataFrame([("a", "", "x", "1", "12a4"), ("b", "A", "y" * 101, "123456789012", None), ("c", "A", "B", "501", "1234")], "request_id string, first_name string, last_name string, zip string, ssn_last4 string").withColumn("dob", F.to_date(F.lit("2000-01-01")))
    got = {r.request_id: (r.zip, r.problems) for r in V.validate_requests(d).collect()}
    assert got["a"][1] == ["first_name", "zip", "ssn_last4"] and got["b"][1] == ["last_name", "zip"] and got["c"] == ("00501", [])


def test_gold(spark):
    raw = spark.createDataFrame([
        ("s1", "acme", "m1", "Ann", "Old", "1980-01-01", "2024-01-01 00:00:00"), ("s2", "blue", "m9", "Ann", "New", "1980-01-01", "2024-05-01 00:00:00"), ("s3", "acme", "m3", "Bo", "Li", "1990-01-01", "2024-05-01 00:00:00"),
        ("s4", "acme", "m4", "Cy", "", "1990-01-01", "2024-05-01 00:00:00"), ("s5", "blue", "m5", "Di", "Ray", "1991-01-01", "2024-05-01 00:00:00"),
    ], "silver_record_id string, partner_id string, partner_member_id string, first_name string, last_name string, dob string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    silver = S.cleanse(raw, KEY, "2024-06-30")
    decisions = spark.createDataFrame([("s1", "g1", "AUTO_MATCH"), ("s2", "g1", "AUTO_MATCH"), ("s3", "g1", "REVIEW"), ("s5", None, "NO_MATCH")], "silver_record_id string, matched_golden_record_id string, decision string")
    made = {r.golden_record_id: r for r in G.gold_build(silver, decisions, "2024-06-30", "2024-07-01").collect()}
    assert set(made) == {"g1", "s3", "s5"} and made["g1"].last_name == "New" and made["g1"].source_partner_ids == ["acme", "blue"] and made["g1"].source_silver_record_ids == ["s1", "s2"]
    assert len(G.gold_build(silver, decisions, "2024-06-30", "2024-07-01").columns) == 30
    assert {r.golden_record_id for r in G.gold_build(silver, decisions, "2024-06-30", "2024-07-01", hold_review=True).collect()} == {"g1", "s5"}
    g = G.gold_build(silver, decisions, "2024-06-30", "2024-07-01")
    assert {r.last_name for r in G.name_refresh(g, silver).collect()} == {"New", "Li", "Ray"}
    late = G.attrition(g, silver.where("silver_record_id <> 's5'"), "2024-06-30").collect()
    assert [r.days_since_seen for r in late] == [None, 60, 60]  # never seen comes first


def test_outbox_and_merge(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4)], "k string, v int")
    got = {r.k: (r.operation, r.payload) for r in G.outbox(old, new, "k", "2024-01-01").collect()}
    assert got == {"b": ("upsert", '{"v":3}'), "c": ("delete", "{}"), "d": ("upsert", '{"v":4}')}
    changes = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("e", 7, 1)], "k string, v int, at int")
    once = G.merge_upsert(old, changes, ["k"], [F.col("at")])
    again = G.merge_upsert(once, changes, ["k"], [F.col("at")])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, again.collect()), key=str) == sorted([("a", 6), ("b", 2), ("c", None), ("e", 7)], key=str)


def test_masks_and_row_access(spark):
    d = spark.createDataFrame([("g", "p1", "tok_a", "tok_b", "tok_c")], "golden_record_id string, primary_partner_id string, ssn_token string, phone_token string, address_line_1_token string").withColumn("dob", F.to_date(F.lit("1980-05-06")))
    grants = spark.createDataFrame([("ann", "p1", "2030-01-01"), ("bob", "p1", "2020-01-01"), ("cy", "p2", "2030-01-01")], "engineer string, partner_id string, granted_until string").withColumn("granted_until", F.col("granted_until").cast("timestamp"))
    seen = lambda user, role: govern.read_as(d, grants, user, role, "2024-01-01").collect()
    (row,) = seen("ann", "ENGINEER")
    assert (str(row.dob), row.ssn_token, row.phone_token, row.address_line_1_token) == ("1980-01-01", None, None, "tok_c")
    assert not seen("bob", "ENGINEER") and not seen("cy", "ENGINEER")
    (row,) = seen("nobody", "COMPLIANCE_ROLE")
    assert (str(row.dob), row.ssn_token) == ("1980-05-06", "tok_a")
    assert not seen("nobody", "PII_ELEVATED")


@pytest.mark.parametrize("least", [1, 1 << 24])
def test_nearest_neighbours_in_passes(spark, monkeypatch, least):
    import numpy as np

    monkeypatch.setattr(knn, "PASS_BYTES", least)
    x = np.random.default_rng(0).normal(size=(60, 5))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in knn.nearest(d, d.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for i in sorted(range(60), key=lambda i: (-round(float(u[q] @ u[i]), 9), i)) if i != q][:3] for q in (0, 20, 40)}
    assert got == want
