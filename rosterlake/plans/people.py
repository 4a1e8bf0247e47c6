"""Queries of matching, verification and golden records."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import gold as G
from rosterlake.operators import govern, knn
from rosterlake.operators import resolve as R
from rosterlake.operators import verify as V
from rosterlake.operators.settle import settle

from . import duck as D
from .registry import BUILT_AT, decisions, gold, prepared, query, requests, silver, table
from .roster import AS_OF


def sides(spark, sf_dir):
    """Records of partner_1 and the index of all others."""
    return settle(prepared(spark, sf_dir, "partner_id = 'partner_1'")), R.as_index(settle(prepared(spark, sf_dir, "partner_id <> 'partner_1'")))


def _stage(n: str) -> str:
    return f"{D.MATCH} SELECT id, golden_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS r FROM hit WHERE stage = '{n}') x WHERE r = 1"


@query(_stage("1a"))
def match_ssn(spark, sf_dir):
    return R.match_ssn(*sides(spark, sf_dir)).drop("stage")


@query(_stage("1b"))
def match_ssn4_dob_zip(spark, sf_dir):
    return R.match_ssn4_dob_zip(*sides(spark, sf_dir)).drop("stage")


@query(_stage("1c"))
def match_soundex(spark, sf_dir):
    return R.match_soundex(*sides(spark, sf_dir)).drop("stage")


def _open(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return settle(a.join(R.deterministic(a, b), "id", "left_anti")), b


@query(f"{D.MATCH} SELECT id, golden_id FROM pairs")
def block_join(spark, sf_dir):
    """Pairs of records without an exact match that share a blocking key (also key_intersect)."""
    return R.block_pairs(*_open(spark, sf_dir))


@query(f"{D.MATCH} SELECT id, golden_id, round(sim, 9) AS sim, rn AS rank FROM ranked WHERE rn <= 10 AND sim >= 0.85")
def knn_topk(spark, sf_dir):
    """Local embeddings, cosine and the best ten candidates (embed_local, cosine, win_topk, sort_candidates, topk_embed)."""
    a, b = _open(spark, sf_dir)
    got = R.knn_topk(R.similarities(R.block_pairs(a, b), a, b))
    return got.select("id", "golden_id", F.round("sim", 9).alias("sim"), "rank")


@query(f"{D.MATCH} SELECT id, golden_id, round(raw, 9) AS raw, score FROM judged WHERE sim >= 0.85")
def adjudicate_local(spark, sf_dir):
    a, b = _open(spark, sf_dir)
    best = R.knn_topk(R.similarities(R.block_pairs(a, b), a, b)).where("rank = 1")
    pairs = best.join(a.select("id", *R.FIELDS), "id").join(b.select("golden_id", *(F.col(f).alias(f"g_{f}") for f in R.FIELDS)), "golden_id")
    return R.adjudicate_local(pairs).select("id", "golden_id", F.round("raw", 9).alias("raw"), F.bround("raw", 3).alias("score"))


@query(f"{D.MATCH} SELECT id, golden_id, decision, round(score, 9) AS score, stage, candidates_considered FROM resolved")
def resolve(spark, sf_dir):
    """The whole cascade: partner_1 against the records of all other partners."""
    return R.resolve(*sides(spark, sf_dir)).drop("reasoning").withColumn("score", F.round("score", 9))


@query(f"""{D.MATCH} SELECT block, count(*) AS n FROM (SELECT unnest(blocks) AS block FROM prep) x WHERE starts_with(block, '????|') OR ends_with(block, '|???') OR contains(block, '||') GROUP BY block""")
def blank_blocks(spark, sf_dir):
    return R.blank_blocks(prepared(spark, sf_dir))


@query("SELECT q.vec_id AS query_id, x.vec_id, rn AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS vid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(list_transform(q.embedding, lambda v: v::DOUBLE), list_transform(e.embedding, lambda v: v::DOUBLE)), 9) DESC, e.vec_id) AS rn FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) s JOIN embeddings q ON q.vec_id = s.qid JOIN embeddings x ON x.vec_id = s.vid WHERE rn <= 10")
def knn_index(spark, sf_dir):
    """The ten nearest of all vectors for every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return knn.nearest(rows, rows.where("vec_id % 20 = 0"), 10).select("query_id", "vec_id", "rank")


@query(f"{D.GOLD}, names AS (SELECT golden_record_id, lower(last_name) AS n FROM gold WHERE length(last_name) >= 1), wanted AS (SELECT DISTINCT lower(last_name) AS q FROM {'{r}'}), g AS (SELECT DISTINCT n, unnest(list_distinct(list_transform(range(1, length(n) + 2), lambda i: substr('  ' || n || ' ', i, 3)))) AS t FROM (SELECT DISTINCT n FROM names) d), w AS (SELECT DISTINCT q, unnest(list_distinct(list_transform(range(1, length(q) + 2), lambda i: substr('  ' || q || ' ', i, 3)))) AS t FROM wanted WHERE length(q) >= 1), c AS (SELECT q, n, count(*) AS n_both FROM w JOIN g USING (t) GROUP BY q, n), cg AS (SELECT n, count(*) AS ng FROM g GROUP BY n), cw AS (SELECT q, count(*) AS nw FROM w GROUP BY q) SELECT q AS query, n AS name, round(n_both::DOUBLE / (ng + nw - n_both), 9) AS similarity FROM c JOIN cg USING (n) JOIN cw USING (q) WHERE n_both::DOUBLE / (ng + nw - n_both) >= 0.3".replace("{r}", "(SELECT CASE WHEN k % 11 = 5 THEN left(last_name, 4) || 'zz' ELSE last_name END AS last_name FROM roster) y"))
def trigram_lookup(spark, sf_dir):
    """Distinct requested names against distinct golden names by shared trigrams."""
    wanted = requests(spark, sf_dir).select(F.lower("last_name").alias("query")).where("length(query) >= 1").distinct()
    names = gold(spark, sf_dir).select(F.lower("last_name").alias("name")).where("length(name) >= 1").distinct()
    return V.trigram_matches(wanted, names, 0.3).withColumn("similarity", F.round("similarity", 9))


# ---- verification

@query(f"{D.VERIFY} SELECT request_id, zip, array_to_string(problems, ',') AS problems FROM checked")
def request_validation(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", "zip", F.array_join("problems", ",").alias("problems"))


def valid(spark, sf_dir):
    return settle(requests(spark, sf_dir).where(F.size("problems") == 0))


@query(f"{D.VERIFY} SELECT request_id, golden_record_id, partner_id FROM exact")
def idv_lookup(spark, sf_dir):
    return V.lookup(valid(spark, sf_dir), gold(spark, sf_dir)).select("request_id", "golden_record_id", "partner_id")


@query(f"{D.VERIFY} SELECT request_id, golden_record_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY golden_record_id) AS rn FROM near) x WHERE rn <= 10")
def idv_fuzzy(spark, sf_dir):
    return V.fuzzy_top(valid(spark, sf_dir), gold(spark, sf_dir)).select("request_id", "golden_record_id", "rank")


@query(f"{D.VERIFY} SELECT * FROM answers")
def verify(spark, sf_dir):
    return V.verify(valid(spark, sf_dir), gold(spark, sf_dir), AS_OF).drop("decision_basis")


@query(f"{D.VERIFY} SELECT count(*) AS requests_total, count(*) FILTER (WHERE status = 'VERIFIED') AS verified, count(*) FILTER (WHERE status = 'NOT_FOUND') AS not_found, count(*) FILTER (WHERE status IN ('AMBIGUOUS', 'NEEDS_REVIEW')) AS ambiguous, count(*) FILTER (WHERE status = 'INELIGIBLE') AS ineligible FROM answers")
def agg_metrics(spark, sf_dir):
    return V.metrics(V.verify(valid(spark, sf_dir), gold(spark, sf_dir), AS_OF))


# ---- golden records

@query(f"{D.DECISIONS} SELECT silver_record_id, matched_golden_record_id, decision FROM decisions")
def er_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).drop("decided_at")


@query(f"{D.DECISIONS} SELECT silver_record_id, matched_golden_record_id FROM decisions WHERE decision IN ('AUTO_MATCH', 'NO_MATCH')")
def decision_filter(spark, sf_dir):
    return decisions(spark, sf_dir).where(F.col("decision").isin(*G.SETTLED)).select("silver_record_id", "matched_golden_record_id")


@query(f"{D.GOLD} SELECT silver_record_id, golden_record_id FROM assigned")
def join_decisions(spark, sf_dir):
    return G.assign(silver(spark, sf_dir), decisions(spark, sf_dir)).select("silver_record_id", "golden_record_id")


_SHOWN = "golden_record_id, primary_partner_id, primary_partner_member_id, first_name, middle_name, last_name, dob, gender, city, state, zip, ssn_last4, effective_start_date, effective_end_date, plan_code, employer_name, is_active"


@query(f"{D.GOLD} SELECT {_SHOWN}, array_to_string(source_partner_ids, ',') AS source_partner_ids, array_to_string(source_silver_record_ids, ',') AS source_silver_record_ids, updated_at AS last_source_update_at, CAST(quality_score AS DOUBLE) AS quality_score, TIMESTAMP '{BUILT_AT}' AS created_at FROM gold")
def gold_build(spark, sf_dir):
    """All that a golden record carries but for tokens (win_latest, win_distinct_arrays, decision_filter, join_decisions)."""
    d = gold(spark, sf_dir)
    return d.select(*_SHOWN.split(", "), F.array_join("source_partner_ids", ",").alias("source_partner_ids"), F.array_join("source_silver_record_ids", ",").alias("source_silver_record_ids"), "last_source_update_at", F.col("quality_score").cast("double").alias("quality_score"), "created_at")


@query(f"{D.GOLD} SELECT golden_record_id, partner_id, silver_record_id FROM (SELECT golden_record_id, unnest(source_silver_record_ids) AS id FROM gold) g JOIN silver s ON s.silver_record_id = g.id")
def join_any_array(spark, sf_dir):
    return G.sources_of(gold(spark, sf_dir), silver(spark, sf_dir)).select("golden_record_id", "partner_id", "silver_record_id")


@query(f"{D.GOLD} SELECT golden_record_id, partner_id AS most_recent_partner, last_name, first_name, updated_at FROM (SELECT g.golden_record_id, s.*, row_number() OVER (PARTITION BY g.golden_record_id ORDER BY s.updated_at DESC, s.silver_record_id) AS r FROM gold g JOIN silver s ON list_contains(g.source_silver_record_ids, s.silver_record_id)) x WHERE r = 1")
def win_refresh(spark, sf_dir):
    return G.name_refresh(gold(spark, sf_dir), silver(spark, sf_dir))


_ATTRITION = f"{D.GOLD}, seen AS (SELECT partner_id, partner_member_id, max(updated_at) AS last_seen_at FROM silver GROUP BY ALL) SELECT partner_id, partner_member_id, last_seen_at, date_diff('day', CAST(last_seen_at AS DATE), DATE '{AS_OF}') AS days_since_seen FROM (SELECT primary_partner_id AS partner_id, primary_partner_member_id AS partner_member_id FROM gold WHERE is_active) e LEFT JOIN seen USING (partner_id, partner_member_id) WHERE last_seen_at IS NULL OR last_seen_at < TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 7 DAY"


@query(_ATTRITION)
def join_attrition(spark, sf_dir):
    """Active members that their partner has stopped sending, longest first (sort_attrition, datediff)."""
    return G.attrition(gold(spark, sf_dir), silver(spark, sf_dir), AS_OF)


_DUPES = f"""{D.SILVER}, eligible AS (SELECT *, {D.XREF} AS ssn_xref, {D.soundex_us('last_name')} AS sx FROM silver WHERE NOT is_quarantined),
signals AS (
  SELECT 'hard_ssn_match' AS signal, ssn_xref AS key, list(silver_record_id ORDER BY updated_at DESC, silver_record_id DESC) AS silver_records, list_sort(list(DISTINCT partner_id)) AS partners, count(*) AS uniq_ids
  FROM eligible WHERE ssn_xref IS NOT NULL GROUP BY ssn_xref HAVING count(DISTINCT partner_id || '|' || partner_member_id) > 1
  UNION ALL SELECT 'soft_demo_match', concat_ws('|', CAST(dob AS VARCHAR), sx, left(zip, 3), upper(left(first_name, 1))), list(silver_record_id ORDER BY updated_at DESC, silver_record_id DESC), list_sort(list(DISTINCT partner_id)), count(DISTINCT partner_id || '|' || partner_member_id)
  FROM eligible WHERE dob IS NOT NULL GROUP BY dob, sx, left(zip, 3), upper(left(first_name, 1)) HAVING count(DISTINCT partner_id || '|' || partner_member_id) > 1
) SELECT signal, key, array_to_string(silver_records, ',') AS silver_records, array_to_string(partners, ',') AS partners, uniq_ids FROM signals"""


def _signals(spark, sf_dir):
    got = G.duplicate_signals(silver(spark, sf_dir))
    return got.select("signal", "key", F.array_join("silver_records", ",").alias("silver_records"), F.array_join("partners", ",").alias("partners"), "uniq_ids")


@query(_DUPES)
def union_signals(spark, sf_dir):
    """Hard and soft duplicates in one table (agg_hard_dupes, agg_soft_dupes, soundex_sql, key_concat, sort_agg)."""
    return _signals(spark, sf_dir)


@query(_DUPES + " WHERE signal = 'hard_ssn_match'")
def agg_hard_dupes(spark, sf_dir):
    return _signals(spark, sf_dir).where("signal = 'hard_ssn_match'")


@query(_DUPES + " WHERE signal = 'soft_demo_match'")
def agg_soft_dupes(spark, sf_dir):
    return _signals(spark, sf_dir).where("signal = 'soft_demo_match'")


_LOAD1 = D.gold_of(D.GOLD, "NOT is_quarantined AND load_no = 1", "old", "1")


@query(f"{_LOAD1} SELECT coalesce(o.golden_record_id, n.golden_record_id) AS golden_record_id, CASE WHEN n.golden_record_id IS NULL THEN 'delete' ELSE 'upsert' END AS operation FROM old o FULL JOIN gold n ON o.golden_record_id = n.golden_record_id WHERE o.golden_record_id IS NULL OR n.golden_record_id IS NULL OR (o.last_name, o.zip, o.updated_at, o.is_active) IS DISTINCT FROM (n.last_name, n.zip, n.updated_at, n.is_active)")
def outbox_diff(spark, sf_dir):
    """The change of gold from the first load to both, as outbox rows of the fields that are served."""
    s, d = silver(spark, sf_dir), decisions(spark, sf_dir)
    served = ("golden_record_id", "last_name", "zip", "last_source_update_at", "is_active")
    old = G.gold_build(s.where("contract_version = 1"), d, AS_OF, BUILT_AT).select(*served)
    return G.outbox(old, gold(spark, sf_dir).select(*served), "golden_record_id", BUILT_AT).select("golden_record_id", "operation")


_RUNS = f"{D.SILVER}, o AS (SELECT * FROM silver WHERE load_no = 1), n AS (SELECT * FROM silver WHERE load_no = 2), joined AS (SELECT coalesce(o.partner_member_id, n.partner_member_id) AS partner_member_id, o.k AS ok, n.k AS nk, [CASE WHEN o.last_name IS DISTINCT FROM n.last_name THEN 'last_name' END, CASE WHEN o.zip IS DISTINCT FROM n.zip THEN 'zip' END, CASE WHEN o.state IS DISTINCT FROM n.state THEN 'state' END] AS f FROM o FULL JOIN n ON o.partner_member_id = n.partner_member_id), diff AS (SELECT partner_member_id, CASE WHEN nk IS NULL THEN 'dropped' WHEN ok IS NULL THEN 'added' WHEN len(list_filter(f, lambda x: x IS NOT NULL)) > 0 THEN 'changed' ELSE 'same' END AS change, CASE WHEN nk IS NULL OR ok IS NULL THEN '' ELSE array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') END AS changed FROM joined)"


def _diff(spark, sf_dir):
    s = silver(spark, sf_dir)
    return G.run_diff(s.where("contract_version = 1"), s.where("contract_version = 2"), "partner_member_id", ["last_name", "zip", "state"])


@query(f"{_RUNS} SELECT * FROM diff")
def prior_run_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"{_RUNS} SELECT count(*) AS records, count(*) FILTER (WHERE change = 'same') AS agree, count(*) FILTER (WHERE change = 'same') / count(*)::DOUBLE AS rate FROM diff")
def run_agreement(spark, sf_dir):
    return G.agreement(_diff(spark, sf_dir))


@query(f"{D.SILVER} SELECT partner_id, partner_member_id, silver_record_id, contract_version FROM (SELECT *, row_number() OVER (PARTITION BY partner_id, partner_member_id ORDER BY load_no DESC) AS r FROM silver) x WHERE r = 1")
def merge_upsert(spark, sf_dir):
    """The first load with the second merged into it by member."""
    cols = ("partner_id", "partner_member_id", "silver_record_id", "contract_version")
    s = silver(spark, sf_dir).select(*cols)
    return G.merge_upsert(s.where("contract_version = 1"), s.where("contract_version = 2"), ["partner_id", "partner_member_id"], [F.col("contract_version")])


@query(f"{D.SILVER} SELECT silver_record_id, partner_id, partner_member_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY partner_id, partner_member_id ORDER BY updated_at DESC, silver_record_id) AS r FROM silver) x WHERE r = 1")
def win_latest(spark, sf_dir):
    rows = silver(spark, sf_dir).select("silver_record_id", "partner_id", "partner_member_id", "updated_at")
    got = rows.groupBy("partner_id", "partner_member_id").agg(F.min_by(F.struct("silver_record_id", "updated_at"), G.newest_first()).alias("_r"))
    return got.select("_r.silver_record_id", "partner_id", "partner_member_id", "_r.updated_at")


# ---- governance

GRANTS = "SELECT concat('e', CAST(n_nationkey % 4 AS STRING)) AS engineer, concat('partner_', CAST(n_nationkey % 6 AS STRING)) AS partner_id, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE TIMESTAMP '2020-01-01 00:00:00' END AS granted_until FROM nation"


def grants(spark, sf_dir):
    return spark.sql(GRANTS.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))


_GRANTED = f"{D.GOLD}, grants AS ({GRANTS}) SELECT golden_record_id, primary_partner_id FROM gold WHERE primary_partner_id IN (SELECT partner_id FROM grants WHERE engineer = 'e2' AND granted_until > TIMESTAMP '{BUILT_AT}')"


@query(_GRANTED)
def row_access(spark, sf_dir):
    """Golden records of the partners that an engineer holds unexpired grants for (semi_grants)."""
    return govern.row_access(gold(spark, sf_dir), grants(spark, sf_dir), "e2", "ENGINEER", BUILT_AT).select("golden_record_id", "primary_partner_id")


@query(f"{D.GOLD} SELECT golden_record_id, 'ENGINEER' AS role, make_date(year(dob), 1, 1) AS dob, CAST(NULL AS VARCHAR) AS ssn_token, CAST(NULL AS VARCHAR) AS phone_token, address_line_1_token FROM (SELECT *, {D.TOKENS['address_line_1_token']} AS address_line_1_token FROM (SELECT *, primary_partner_id AS partner_id FROM gold) x) y UNION ALL SELECT golden_record_id, 'PII_ELEVATED', dob, {D.TOKENS['ssn_token']}, {D.TOKENS['phone_token']}, {D.TOKENS['address_line_1_token']} FROM (SELECT *, primary_partner_id AS partner_id FROM gold) x")
def mask_by_role(spark, sf_dir):
    """The same rows as two roles read them (mask_dob, mask_token)."""
    g, out = gold(spark, sf_dir), None
    for role in ("ENGINEER", "PII_ELEVATED"):
        seen = govern.mask_tokens(govern.mask_dob(g, role), role).select("golden_record_id", F.lit(role).alias("role"), "dob", "ssn_token", "phone_token", "address_line_1_token")
        out = seen if out is None else out.unionByName(seen)
    return out


@query(f"{D.SILVER} SELECT gender, left(zip, 3) AS zip3, count(*) AS n, count(*) >= 5 AS releasable FROM silver GROUP BY ALL")
def k_anonymity(spark, sf_dir):
    return govern.k_anonymous(silver(spark, sf_dir), {"gender": F.col("gender"), "zip3": F.left("zip", F.lit(3))}, 5)


@query(f"{D.SILVER} SELECT silver_record_id FROM silver WHERE silver_record_id NOT IN (SELECT silver_record_id FROM silver WHERE effective_end_date < DATE '2017-06-30')")
def retention_delete(spark, sf_dir):
    return govern.retention(silver(spark, sf_dir), "silver_record_id", "effective_end_date", "2017-06-30").select("silver_record_id")


