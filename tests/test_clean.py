import pytest
from conftest import rows

from panelscore.model import Indicator, Model
from panelscore.operators import clean

MODEL = Model(
    indicators=(Indicator("CPI", "P", 0.6, 1, low=-20, high=100), Indicator("GDP", "P", 0.4, -1)),
    pillar_weights={"P": 1.0},
)


def raw(spark, data, schema="entity string, indicator string, period string, value string, seq long"):
    return spark.createDataFrame(data, schema)


def test_ids_merge_and_the_last_arrival_is_flagged(spark):
    df = raw(spark, [("usa", "CPI", "2024", "2", 1), (" USA ", "CPI ", "2024.0", "200", 2)])
    assert rows(clean.clean_long(df, MODEL)) == [("USA", "CPI", 2024, 200.0, "unknown", "out_of_range")]


def test_bad_numbers_become_missing_and_rows_without_period_go(spark):
    df = raw(spark, [("a", "CPI", "2024", "x", 1), ("a", "CPI", "soon", "1", 2), ("a", "GDP", "2024", "NaN", 3), (None, "GDP", "2024", "1", 4)])
    out = rows(clean.clean_long(df, MODEL), "entity", "indicator", "value", "flag")
    assert out == [("A", "CPI", None, "missing"), ("A", "GDP", None, "missing")]


def test_unknown_indicators_have_no_bounds(spark):
    df = raw(spark, [("a", "XYZ", "2024", "1e9", 1)])
    assert rows(clean.clean_long(df, MODEL), "flag") == [("ok",)]


def test_period_policy(spark):
    df = raw(spark, [("a", "CPI", "2023", "1", 1), ("a", "CPI", "2024", "2", 2)])
    assert rows(clean.clean_long(df, MODEL, [2024]), "period") == [(2024,)]
    with pytest.raises(ValueError):
        clean.keep_periods(df, [])
    with pytest.raises(ValueError):
        clean.check_period_range(2023, 2024, allowed=2024)
    assert clean.check_period_range(2024, 2024, allowed=2024) == (2024, 2024)


def test_wide_and_back(spark):
    df = raw(spark, [("a", "CPI", "2023", "1", 1), ("a", "GDP", "2023", "2", 2), ("b", "CPI", "2023", "?", 3), ("b", "GDP", "2024", "4", 4)])
    wide = clean.clean_to_wide(df, MODEL)
    # B has no value at all in 2023, so that row vanishes.
    assert rows(wide, "entity", "period", "CPI", "GDP") == [("A", 2023, 1.0, 2.0), ("B", 2024, None, 4.0)]
    assert clean.to_long(wide, MODEL.codes).count() == 4


def test_a_wide_frame_is_rejected(spark):
    with pytest.raises(ValueError):
        clean.normalize(spark.createDataFrame([("a", 2024, 1.0)], "entity string, period int, CPI double"))


def test_derived_rows_win(spark):
    base = spark.createDataFrame([("A", "G", 1, 1.0, "s", None), ("A", "H", 1, None, "s", "ok")], "entity string, indicator string, period int, value double, source string, flag string")
    derived = spark.createDataFrame([("A", "G", 1, 9.0, "d", "ok")], base.schema)
    assert rows(clean.finalize(base, derived)) == [("A", "G", 1, 9.0, "d", "ok")]
