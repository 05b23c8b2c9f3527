from conftest import rows

from panelscore.model import Episode
from panelscore.operators import backtest as bt

TUR = Episode("TUR", "Episode A", 2016, 2018)
BRA = Episode("bra", "Episode B", 2014, 2016)
SCHEMA = "entity string, period int, risk_score double"


def scores(spark, **series):
    data = [(e.upper(), p, v) for e, points in series.items() for p, v in points.items()]
    return spark.createDataFrame(data, SCHEMA)


def one(df):
    return df.collect()[0].asDict()


def test_early_warning_two_years_before(spark):
    r = one(bt.replay(scores(spark, tur={2016: 40.0, 2017: 50.0, 2018: 62.0}), [TUR]))
    assert (r["verdict"], r["lead_time"], r["delta"], r["peak_delta"], r["peak_period"]) == ("flagged", 2, 22.0, 22.0, 2018)


def test_peak_may_follow_the_event(spark):
    ep = [Episode("BRA", "B", 2013, 2016)]
    r = one(bt.replay(scores(spark, bra={2013: 40.0, 2016: 42.0, 2017: 45.0}), ep))
    assert (r["verdict"], r["lead_time"], r["peak_period"], r["delta"]) == ("flagged", 3, 2017, 2.0)


def test_verdict_rounds_but_lead_time_does_not(spark):
    r = one(bt.replay(scores(spark, tur={2016: 40.0, 2018: 42.96}), [TUR]))
    assert (r["verdict"], r["lead_time"]) == ("flagged", None)


def test_ties_take_the_earliest_peak(spark):
    r = one(bt.replay(scores(spark, tur={2016: 40.0, 2018: 50.0, 2019: 50.0}), [TUR]))
    assert r["peak_period"] == 2018


def test_missing_baseline_is_inconclusive(spark):
    r = one(bt.replay(scores(spark, tur={2018: 62.0}), [TUR]))
    assert (r["verdict"], r["event_score"], r["peak_score"], r["delta"]) == ("inconclusive", None, None, None)


def test_drift_is_the_share_of_others_that_rose(spark):
    df = scores(spark, tur={2016: 40.0, 2018: 60.0}, a={2016: 10.0, 2018: 20.0}, b={2016: 10.0, 2018: 10.0}, c={2018: 3.0})
    assert rows(bt.peer_drift(df, [TUR]), "peer_drift", "compared") == [(0.5, 2)]


def test_confusion_metrics(spark):
    df = scores(
        spark,
        tur={2016: 40.0, 2018: 60.0},
        bra={2014: 40.0, 2016: 40.5},
        usa={p: 30.0 for p in range(2014, 2019)},
    )
    results = bt.run_backtest(df, [TUR, BRA])
    tally = bt.ordinary_windows(df, [TUR, BRA])
    m = one(bt.metrics(results, tally))
    assert (m["true_positives"], m["false_negatives"], m["recall"], m["false_negative_rate"]) == (1, 1, 0.5, 0.5)
    assert (m["false_positives"], m["true_negatives"], m["precision"], m["false_positive_rate"]) == (0, 5, 1.0, 0.0)
    assert one(bt.summary(results))["detection_rate"] == 0.5


def test_ordinary_windows(spark):
    step = scores(spark, a={p: 40.0 if p <= 2017 else 60.0 for p in range(2013, 2021)})
    assert one(bt.false_alarm_rate(bt.ordinary_windows(step)))["false_alarm_rate"] == 0.125
    flat = scores(spark, a={p: 40.0 for p in range(2013, 2021)})
    assert one(bt.false_alarm_rate(bt.ordinary_windows(flat)))["false_alarm_rate"] == 0.0
    assert bt.ordinary_windows(flat.where("false")).count() == 0


def test_no_ordinary_window_leaves_rates_null(spark):
    df = scores(spark, tur={2016: 40.0, 2018: 60.0})
    tally = bt.ordinary_windows(df, [TUR])
    m = one(bt.metrics(bt.run_backtest(df, [TUR]), tally))
    assert (m["false_positives"], m["precision"], m["warning_frequency"], m["recall"]) == (None, None, None, 1.0)


def test_overrides():
    (e,) = bt.with_overrides([TUR], window=3, threshold=7)
    assert (e.window, e.threshold, e.entity) == (3, 7.0, "TUR")
