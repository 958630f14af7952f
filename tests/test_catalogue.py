"""The catalogue, and a sample of it against SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    families = {name.rstrip("0123456789").split("_")[0].rstrip("0123456789") for name in entry.queries()}
    assert {"src", "snk", "chk", "qua", "enr", "ent", "vec", "emb", "txt", "hyb", "evl", "grf", "ops", "str"} <= families


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "chk1_fixed_windows", "chk5_sections", "qua3_assessment", "enr3_keywords", "ent1_offsets", "vec1_top_k_cosine", "vec6_sparse_cosine", "txt2_phrase",
    "txt6_term_coverage", "hyb1_weighted_sum", "hyb6_dedup", "hyb16_cache_lookup", "evl7_all_metrics", "evl9_ab_test", "grf4_merged_nodes", "grf15_passages",
    "ops8_lineage_chain", "ops15_score_history", "snk6_routing", "src5_json_key_types", "str3_health_trends", "str7_heartbeat_sessions",
])
def test_matches_sql(spark, name):
    ok, message, _ = compare(spark, entry.queries()[name], entry.oracle_sql()[name], "sf0.001")
    assert ok, message
