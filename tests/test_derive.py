import pytest
from conftest import rows

from panelscore.operators import clean, derive
from panelscore.operators.derive import Derivation

LONG = "entity string, indicator string, period int, value double"


def series(spark, values, entity="A", code="X", start=2000):
    return spark.createDataFrame([(entity, code, start + n, v) for n, v in enumerate(values)], LONG)


def by_period(df):
    return {r["period"]: r["value"] for r in df.collect()}


def test_yoy_is_ten_percent(spark):
    out = by_period(derive.derive(series(spark, [100.0, 110.0, 121.0, 133.1]), [Derivation("Y", "X", "yoy")]))
    assert out == {2000: None, 2001: 10.0, 2002: 10.0, 2003: 10.0}


def test_yoy_of_a_global_series_reaches_every_entity(spark):
    annual = spark.createDataFrame([(2004, 100.0), (2005, 110.0), (2006, 121.0)], "period int, value double")
    entities = spark.createDataFrame([("A",), ("B",)], "entity string")
    out = clean.fan_out(derive.global_yoy(annual), entities)
    assert [(e, p, round(v, 9)) for e, p, v in rows(out, "entity", "period", "value")] == [
        ("A", 2005, 10.0), ("A", 2006, 10.0), ("B", 2005, 10.0), ("B", 2006, 10.0)
    ]


def test_trailing_gap_needs_two_rows(spark):
    out = by_period(derive.derive(series(spark, [1.0, 2.0, 6.0, 7.0]), [Derivation("Y", "X", "trailing_gap")]))
    assert out == {2000: None, 2001: 0.5, 2002: 3.0, 2003: 2.0}


def test_three_row_change_skips_no_gap(spark):
    out = by_period(derive.derive(series(spark, [1.0, 2.0, 4.0, 8.0]), [Derivation("Y", "X", "lag3")]))
    assert out == {2000: None, 2001: None, 2002: None, 2003: 7.0}


def test_constant_level_has_no_deviation(spark):
    out = by_period(derive.derive(series(spark, [2.0] * 11), [Derivation("Y", "X", "centered")]))
    assert set(out.values()) == {0.0} and len(out) == 11


def test_ratio_needs_a_positive_denominator(spark):
    df = series(spark, [6.0, 5.0, 4.0]).union(series(spark, [3.0, 0.0], code="D"))
    out = derive.derive(df, [Derivation("R", "X", "ratio", other="D")])
    assert rows(out, "period", "value") == [(2000, 2.0)]


def test_only_one_entity_and_basis_points(spark):
    df = series(spark, [1.0, 1.25]).union(series(spark, [1.0, 2.0], entity="B"))
    out = derive.derive(df, [Derivation("Y", "X", "diff_bps", only_entity="a")])
    assert rows(out, "entity", "period", "value") == [("A", 2000, None), ("A", 2001, 25.0)]


@pytest.mark.parametrize("rule", ["yoy", "diff_bps", "trailing_gap", "lag3", "centered"])
def test_wide_rules_equal_long_rules_with_gaps(spark, rule):
    values = [3.0, None, 4.0, 5.5, None, None, 7.0, 6.0, 8.0, None, 2.0]
    wide = spark.createDataFrame([("A", 2000 + n, v, 1.0) for n, v in enumerate(values)], "entity string, period int, X double, Z double")
    rule = Derivation("Y", "X", rule, digits=None)
    long = clean.to_long(wide, ["X"]).where("value IS NOT NULL")
    expected = {p: v for p, v in by_period(derive.derive(long, [rule])).items() if v is not None}
    got = {r["period"]: r["Y"] for r in derive.derive_columns(wide, [rule]).collect() if r["Y"] is not None}
    assert got == pytest.approx(expected)


def test_last_quarter_stands_for_the_year(spark):
    df = spark.createDataFrame([("A", 2005, 1, 1.0), ("A", 2005, 4, 5.43216), ("A", 2006, 2, 9.0), ("A", 2006, 3, 7.25)], "entity string, period int, quarter int, v double")
    assert rows(derive.year_end(df, ["entity", "period"], "quarter", "v")) == [("A", 2005, 5.4322), ("A", 2006, 7.25)]


def test_latest_deviation_label(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("A", 2, -1.0), ("A", 3, None), ("B", 1, 0.0)], "entity string, period int, d double")
    assert rows(derive.latest_deviation(df, "d"), "entity", "latest", "label") == [
        ("A", -1.0, "STRONGER than its 5-year trend"), ("B", 0.0, "AT its 5-year trend")
    ]
