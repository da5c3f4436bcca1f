"""Registered queries against their SQL oracle on the smallest tables (all of them with PLANLOOM_ALL=1)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from planloom.plans import load_all

SF = "/root/testdata/sf0.001"
QUICK = ["within_distance", "intersecting_pairs", "on_layer_pairs", "contains_polygon", "line_symbol_edges", "nearest_symbol",
         "upsert_elements", "soft_delete", "apply_corrections", "in_domain", "file_context", "token_budget", "vector_topk",
         "vector_join", "nms_distance", "fuse_circles", "clean", "components", "branch_edges", "validate", "parse_annotations",
         "classify_documents", "standards_lookup", "junction_types", "usage_counts"]
REG = load_all()


def test_names_and_coverage():
    assert set(REG.ORACLES) <= set(REG.QUERIES)
    assert not [n for n in REG.QUERIES if n.startswith("op") or "pipeline" in n]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(REG.ORACLES) if os.environ.get("PLANLOOM_ALL") else QUICK)
def test_query_matches_oracle(spark, name):
    import check
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    err, _ = check.compare(name, REG.QUERIES[name](spark, SF), con, REG.ORACLES[name])
    assert err is None, err
