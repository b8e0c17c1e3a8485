"""Registered queries against their check SQL on the smallest tables."""

import pytest

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "src3_type_from_path src10_file_type_expansion ext2_string_kind ext15_payload_records ext21_env_category ext24_path_category "
    "prd1_string_external_ip prd5_kv_path prd13_exports_count prd19_gates prd23_location prd30_rule_explain join3_literal_then_regex "
    "join8_offset_section join9_file_alignment join14_typosquat agg8_atomic_scan agg6_composite_levels agg10_import_findings "
    "agg15_directory_rollup agg18_findings_graph agg24_diff_counts agg36_container_tree met1_text_lines met10_string_metrics "
    "win1_near_lines win4_findings_cap win9_running_budget man1_script_findings cat2_same_pattern cat39_dangling_references "
    "scan_report str1_continuous_scan"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    _, rows, state = compare(spark, con, name, SF)
    assert state == "ok" or (state == "EMPTY" and rows == 0), state


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
