"""Episodes as a table against the list form, and interval joins against all pairs."""

import random

import pytest
from conftest import rows

from panelscore.model import Episode
from panelscore.operators import backtest, episodes

SPEC = "episode int, entity string, label string, baseline int, event int, window int, threshold double"


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(8)
    out = [(f"e{e}", p, None if rng.random() < 0.1 else rng.choice([10.0, 12.0, 15.0, rng.random() * 40])) for e in range(12) for p in range(1990, 2015) if rng.random() < 0.9]
    return spark.createDataFrame(out, "entity string, period int, risk_score double")


def listed(seed, n=80):
    rng = random.Random(seed)
    return [Episode(f"E{rng.randrange(13)}", f"L{k}", b := rng.randrange(1988, 2016), b + rng.randrange(-1, 6), rng.randrange(4), rng.choice([0.0, 3.0, 8.5])) for k in range(n)]


def framed(spark, eps):
    return spark.createDataFrame([(n, e.entity.lower(), e.label, e.baseline, e.event, e.window, e.threshold) for n, e in enumerate(eps)], SPEC)


@pytest.mark.parametrize("width", [1, 3, 50])
def test_same_as_the_list(spark, scores, width):
    eps = listed(width)
    table = framed(spark, eps)
    found = episodes.replay(scores, table, width)
    columns = ("episode", "entity", "baseline_score", "event_score", "peak_score", "peak_period", "delta", "peak_delta", "verdict", "lead_time")
    assert rows(found, *columns) == rows(backtest.replay(scores, eps), *columns)
    drift = ("episode", "risen", "compared", "peer_drift")
    assert rows(episodes.peer_drift(scores, found, width), *drift) == rows(backtest.peer_drift(scores, eps), *drift)
    for few in (eps, eps[:5], []):
        held = framed(spark, few) if few else table.limit(0)
        assert rows(episodes.ordinary_windows(scores, held, 2, 4.0)) == rows(backtest.ordinary_windows(scores, few, 2, 4.0))


def test_one_entity_with_very_many_episodes(spark, scores):
    """A hot entity: bins keep what meets in proportion to windows, not to episodes times periods."""
    eps = [Episode("E1", f"L{k}", 1990 + k % 20, 1991 + k % 20, k % 3, 3.0) for k in range(3000)]
    found = episodes.replay(scores, framed(spark, eps))
    few = {(e.baseline, e.event, e.window): e for e in eps}
    wanted = {(r.baseline, r.event, r.window): (r.verdict, r.peak_delta, r.lead_time) for r in backtest.replay(scores, list(few.values())).collect()}
    got = found.collect()
    assert len(got) == 3000 and all((r.verdict, r.peak_delta, r.lead_time) == wanted[r.baseline, r.event, r.window] for r in got)


def test_defaults_and_nulls(spark, scores):
    table = spark.createDataFrame([(1, "e1", 1995, 1996), (2, None, 1995, 1996), (3, "e2", None, 1996), (4, "e2", 1995, None), (5, "nobody", 1995, 1996)], "episode int, entity string, baseline int, event int")
    got = {r.episode: r for r in episodes.replay(scores, table).collect()}
    assert (got[1].window, got[1].threshold) == (backtest.DEFAULT_WINDOW, backtest.DEFAULT_THRESHOLD)
    assert all(got[k].verdict == "inconclusive" and got[k].peak_delta is None for k in (2, 3, 4, 5))


def test_interval_join(spark):
    rng = random.Random(1)
    spans = [(k, rng.choice("ab"), a := rng.randrange(-20, 20), a + rng.randrange(-2, 9)) for k in range(60)]
    points = [(k, rng.choice("ab"), rng.randrange(-25, 25)) for k in range(80)]
    left = spark.createDataFrame(spans, "s int, g string, low int, high int")
    right = spark.createDataFrame(points, "p int, g string, period int")
    for width in (1, 7):
        got = {(r.s, r.p) for r in episodes.interval_join(left, right, "low", "high", ("g",), width).collect()}
        assert got == {(s, p) for s, g, low, high in spans for p, h, t in points if g == h and low <= t <= high}
