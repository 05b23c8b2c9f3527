"""Appended periods scored from the state against scoring the whole panel."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscore.model import Indicator, Model, ScoringParams
from panelscore.operators import history, score
from panelscore.sources import versions

MODEL = Model(
    indicators=(Indicator("A", "One", 0.4, 1), Indicator("B", "One", 0.3, -1), Indicator("C", "Two", 0.3, 1)),
    pillar_weights={"One": 0.6, "Two": 0.4},
    params=ScoringParams(min_history_obs=3),
)
COLUMNS = ("entity", "period", "data_completeness", "risk_score", "trend_1y_delta", "trend_2y_delta", "trend_direction", "risk_band", "pillar_one_score")


@pytest.fixture(scope="module")
def panel(spark):
    """Gaps, late entrants, missing values, a constant series, large values with a small spread."""
    rng, out = random.Random(4), []
    for e in range(9):
        for p in range(2000 if e < 6 else 2004, 2013):
            if rng.random() < 0.15:
                continue
            a = 5.0 if e == 0 else rng.gauss(0, 1)
            b = None if rng.random() < 0.3 or e == 1 else 1e7 + rng.random()
            out.append((f"e{e}", None if e == 8 else f"G{e % 2}", p, a, b, None if p < 2003 else rng.random() * 100))
    return spark.createDataFrame(out, "entity string, peer_group string, period int, A double, B double, C double")


def near(found, wanted):
    found, wanted = (rows(df, *COLUMNS) for df in (found, wanted))
    assert len(found) == len(wanted)
    for x, y in zip(found, wanted):
        assert all(u == v or (isinstance(u, float) and u == pytest.approx(v, abs=2e-6)) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("cuts", [[2013], [*range(2001, 2014)], [2004, 2005, 2009, 2009, 2013]])
def test_by_parts_is_the_whole(panel, cuts):
    state, parts, low = None, [], 0
    for cut in cuts:
        part, state = history.append(panel.where(f"period >= {low} AND period < {cut}"), state, MODEL)
        parts.append(part)
        low = cut
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    near(found, score.score_panel(panel, MODEL))
    last = {r.entity: r for r in state.collect()}
    held = {r[0]: r for r in panel.groupBy(F.upper("entity")).agg(F.count("B"), F.avg("B"), F.max("period")).collect()}
    for e, r in last.items():
        assert (r.sn1, r.last_period) == (held[e][1], held[e][3]) and r.sm1 == (held[e][2] if held[e][2] is None else pytest.approx(held[e][2]))
        assert len(r.recent) <= 2


def test_table_moves_on_and_repeats_are_harmless(spark, panel, tmp_path):
    path = str(tmp_path)
    first = history.advance(spark, path, panel.where("period < 2006"), MODEL)
    again = history.advance(spark, path, panel.where("period < 2006"), MODEL)
    assert again.count() == 0 and versions.current(spark, path).number == 1
    rest = history.advance(spark, path, panel, MODEL)
    near(first.unionByName(rest), score.score_panel(panel, MODEL))
    assert versions.current(spark, path).facts == {"high": 2012}


def test_rows_of_the_past_are_refused(panel):
    _, state = history.append(panel.where("period < 2006"), None, MODEL)
    with pytest.raises(Exception, match="before the state"):
        history.append(panel.where("period = 2003"), state, MODEL)[0].collect()
