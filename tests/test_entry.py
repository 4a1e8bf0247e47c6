import __spark_entry__ as entry

EXPECTED = (
    "scan_csv scan_json scan_jsonl scan_full_csv scan_834 scan_fixed_width file_keys bronze_copy keyed_upsert stream_files stream_cdc dlq_sink outbox_sink contract_map roster_items required_fields json_extract "
    "incremental_filter quarantine_filter decision_filter idv_lookup idv_fuzzy lookup_key ineligible_pred is_active row_access mask_by_role join_decisions join_any_array join_attrition match_ssn match_ssn4_dob_zip match_soundex "
    "block_join knn_topk knn_index contract_lookup trigram_lookup prior_run_diff agg_hard_dupes agg_soft_dupes agg_last_seen agg_filter_counts agg_quarantine_rate agg_dup_count agg_review_backlog agg_one_golden agg_zero_active "
    "agg_risk agg_metrics failed_rows dbt_tests contract_thresholds layer_gates agg_quantile agg_scorecard agg_row_change agg_audit_volume win_latest win_refresh sample_stratified union_signals normalize_fields record_ids "
    "ssn_valid parse_llm_json embed_local tokenize detokenize policy_match audit cdc_process header_classify value_sniff adjudicate_local resolve cleansing_rules field_standards schema_drift silver_member format_anomalies "
    "infer_schema seed_load scan_unsupported merge_upsert gold_build verify request_validation outbox_diff retention_delete k_anonymity stream_latest stream_dedupe"
)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 6
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and not set(EXPECTED.split()) - set(found)
    assert not {n for n in found if n not in sql and not n.startswith("op") and n != "pipeline"}
    assert all(s.strip().upper().startswith(("WITH", "SELECT")) for s in sql.values())
