"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.plans.tables import GIVEN

FOLDER = "/root/testdata/sf0.001"
# one query per module and kind; the whole registry is compared at a larger scale by the driver
SAMPLE = [
    "top_hotspots", "change_coupling_pairs", "containment_ratio", "accretion_ratchet", "glob_path_join", "mdlink_resolution_join",
    "age_markers", "scan_sensitive_content", "instruction_score", "scan_mutation_reports", "run_certification", "keyhole_summary",
    "weak_components", "communities_of_groups", "stream_first_flagged", "sink_actions_contract", "colocated_test_join", "import_edge_build",
    "strong_components", "dependency_levels", "hot_file_groups", "overlapping_grouping_pairs", "stream_late_rows", "sink_run_log", "hidden_coupling", "quality_gate", "co_commit_semi_join", "redact",
    "grouping_disagreement", "hotspot_transitions", "directory_rollup", "authorship_class", "nearest_ancestor_join", "needs_attention",
]


def same(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_contract_is_consistent(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 250
    assert contract.entry(spark).columns[:2] == ["repo", "path"]


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_equals_duckdb(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted([same(v) for v in r] for r in df.select(*columns).collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    assert ours == sorted([same(r[i]) for i in order] for r in cursor.fetchall())
