"""Registered queries against their SQL checks (one of each family; ``check.py`` runs all)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SAMPLE = """s2_load_csv s4_read_interactions s10_scan_metric_logs p1_clean p8_duplicate_columns p12_orient_edges f3_case_sensitive_keywords f4_valid_dates
j3_semi_joins a1_edge_rollup a1_edge_rounds o4_top_per_group x4_top_overlap c2_safe_casts c11_time_encoding g3_tripartite_edges g9_degree_statistics
g12_connectivity g18_assortativity g19_power_law g21_health_findings w3_dense_ranks w5_inter_event_times w8_timestamp_checks a16_node_activity r6_ranked_output r9_parameter_sweep
r10_monte_carlo t2_position_split t4_inductive_split w6_recent_neighbors t11_attention_pooling a8_company_features n3_plausible_negatives n5_top_k_hard_negatives
m2_feature_vector m8_quality_per_batch m11_multi_positive_metrics m12_precision_at_k a12_error_table m16_delta_report l5_hybrid_loss a18_run_comparison
st2_node_state st6_pending_messages st9_order_monitor""".split()


def test_registry():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert set(SAMPLE) <= set(q)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, sf, name):
    text, ok = compare(spark, connect(sf), name, queries()[name], oracle_sql().get(name), sf)
    assert ok, text


def test_entry(spark):
    assert entry(spark).count() == 40
