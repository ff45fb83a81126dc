"""Registered queries against their DuckDB oracles, one of each kind."""

import pytest

from compare import compare, connect
from slickwatch.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
QUICK = [
    "ais_quality_flags", "ais_anomalies", "dedup_first", "vessel_tracks", "vessel_state", "triage_tier", "rank_candidates",
    "select_hypotheses", "asof_forcing_nearest", "forcing_bilinear", "coverage_check", "horizon_matrix", "source_envelope",
    "arrival_metrics", "dark_seed", "component_stats", "pixel_polygon_overlap", "category_fp_report", "train_val_split", "src_ais_csv",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", QUICK)
def test_matches_oracle(spark, con, key):
    assert compare(spark, con, key, FOLDER) == ""


def test_every_inventory_key_is_registered():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 145
