"""Registered queries against their SQL twins on the smallest tables.

A cross-section by default; ORACLE=all runs every one (about ten minutes).
"""

import os

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SOME = ("p5_keep_last", "s4_series_sdmx", "q1_coverage", "d8_centered_dev", "z4_drivers", "z10_composite", "r1_peer_standing", "b11_comparison", "n5_components", "a5_spearman", "x5_scenarios", "t6_report", "scale_z")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    problem, _ = difference(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "period", "risk_score", "risk_band", "sector_score"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
