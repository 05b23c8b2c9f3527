import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscore.defaults import DEFAULT_DERIVATIONS, DEFAULT_MODEL
from panelscore.functions.scalar import band
from panelscore.model import Indicator, Model, ScoringParams, model_from_mapping
from panelscore.operators import quality
from panelscore.operators import score as s
from panelscore.sources.synthetic import synthetic_panel

SMALL = Model(
    indicators=(Indicator("A", "One", 0.6, 1), Indicator("B", "One", 0.4, -1), Indicator("C", "Two", 0.5, 1), Indicator("D", "Two", 0.0, 1)),
    pillar_weights={"One": 0.7, "Two": 0.3},
    sectors={"S1": ("One",), "S2": ("Two",)},
    sector_weights={"S1": 0.5, "S2": 0.5},
    params=ScoringParams(min_history_obs=3, sector_composite_weight=0.25),
)
SCHEMA = "entity string, peer_group string, period int, A double, B double, C double, D double"


def small_data():
    rng = np.random.default_rng(7)
    out = []
    for e in range(9):
        group = None if e >= 7 else f"G{e % 2}"
        for p in range(8):
            v = [float(x) for x in rng.normal(size=4)]
            holes = rng.random(4) < 0.2
            out.append((f"E{e}", group, 2000 + p, *[None if h else x for h, x in zip(holes, v)]))
    return out


def brute(data, model):
    """Plain-Python scores by the definitions."""
    p = model.params
    cells = {(r[0], r[2]): dict(zip("ABCD", r[3:])) for r in data}
    group = {r[0]: r[1] or "__all__" for r in data}

    def z(values, v, least):
        if len(values) < least:
            return None
        sd = np.std(values)
        if sd == 0:
            return 0.0
        return None if v is None else (v - np.mean(values)) / sd

    result = {}
    for (e, t), row in cells.items():
        combined = {}
        for code, v in row.items():
            own = [cells[e, u][code] for u in range(2000, t + 1) if (e, u) in cells and cells[e, u][code] is not None]
            peers = [cells[x, t][code] for x in group if group[x] == group[e] and (x, t) in cells and cells[x, t][code] is not None]
            sides = [(z(own, v, p.min_history_obs), p.history_z_weight), (z(peers, v, p.min_peer_obs), p.peer_z_weight)]
            sides = [(a, w) for a, w in sides if a is not None]
            combined[code] = sum(a * w for a, w in sides) / sum(w for _, w in sides) if sides else 0.0
        pillars = {}
        for name in model.pillar_weights:
            members = [i for i in model.indicators if i.pillar == name]
            weight = sum(i.weight for i in members if row[i.code] is not None)
            if weight > 0:
                signal = sum(combined[i.code] * i.direction * i.weight for i in members) / weight
                pillars[name] = min(100.0, max(0.0, 50 + 18 * signal))

        def mean(parts):
            return sum(v * w for v, w in parts) / sum(w for _, w in parts) if parts else None

        pillar_view = mean([(pillars[k], w) for k, w in model.pillar_weights.items() if k in pillars])
        sectors = {k: mean([(pillars[m], model.pillar_weights[m]) for m in ms if m in pillars]) for k, ms in model.sectors.items()}
        sector_view = mean([(v, model.sector_weights[k]) for k, v in sectors.items() if v is not None])
        beta = p.sector_composite_weight
        result[e, t] = None if pillar_view is None else (1 - beta) * pillar_view + beta * sector_view
    return result


def test_scores_follow_the_definitions(spark):
    data = small_data()
    expected = brute(data, SMALL)
    got = {(r["entity"], r["period"]): r["risk_score"] for r in s.score_panel(spark.createDataFrame(data, SCHEMA), SMALL).collect()}
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert (got[key] is None) == (value is None), key
        assert value is None or math.isclose(got[key], value, rel_tol=1e-9), key


def test_later_rows_never_change_earlier_scores(spark):
    data = small_data()
    early = [r for r in data if r[2] < 2005]
    shock = [(r[0], r[1], r[2], *[1e6] * 4) if r[2] >= 2005 else r for r in data]
    before = rows(s.score_panel(spark.createDataFrame(early, SCHEMA), SMALL), "entity", "period", F.round("risk_score", 9))
    after = s.score_panel(spark.createDataFrame(shock, SCHEMA), SMALL).where("period < 2005")
    assert rows(after, "entity", "period", F.round("risk_score", 9)) == before


def test_partitioning_does_not_matter(spark):
    data = small_data()
    one = rows(s.score_panel(spark.createDataFrame(data, SCHEMA).coalesce(1), SMALL), "entity", "period", F.round("risk_score", 9))
    many = rows(s.score_panel(spark.createDataFrame(data[::-1], SCHEMA).repartition(7), SMALL), "entity", "period", F.round("risk_score", 9))
    assert one == many


def test_completeness_counts_absent_columns(spark):
    df = spark.createDataFrame([("E", None, 2000, 1.0, 1.0, None, 1.0)], SCHEMA).drop("C")
    assert rows(s.score_panel(df, SMALL), "data_completeness") == [(1.0 / 1.5,)]


def test_contribution_rises_with_risk_inside_a_group(spark):
    df = spark.createDataFrame([(f"E{n}", "G", 2000, float(n), 0.0, 0.0, 0.0) for n in range(4)], SCHEMA)
    out = s.drivers(s.z_frame(df, SMALL), SMALL).where("indicator = 'A'").orderBy("entity").collect()
    values = [r["weighted_contribution"] for r in out]
    assert values == sorted(values) and values[0] < 0 < values[-1]


def test_composite_lies_between_pillar_and_sector_view(spark):
    z = s.z_frame(synthetic_panel(spark, 6, 2010, 2016), DEFAULT_MODEL)
    pillar_only = s.scores_from_z(z, DEFAULT_MODEL.with_weights(sector_composite_weight=0.0)).withColumnRenamed("risk_score", "lo")
    sector_only = s.scores_from_z(z, DEFAULT_MODEL.with_weights(sector_composite_weight=1.0)).withColumnRenamed("risk_score", "hi")
    mid = s.scores_from_z(z, DEFAULT_MODEL)
    keys = ["entity", "period"]
    joined = mid.join(pillar_only.select(*keys, "lo"), keys).join(sector_only.select(*keys, "hi"), keys)
    assert joined.where("risk_score < least(lo, hi) - 1e-9 OR risk_score > greatest(lo, hi) + 1e-9").count() == 0
    assert mid.where("data_completeness = 1").count() > 0


def test_synthetic_panel_matches_its_derivations(spark):
    panel = synthetic_panel(spark, 5, 2000, 2012)
    assert rows(quality.derivation_drift(panel, DEFAULT_DERIVATIONS), "drifted") == [(False,)] * 4
    bent = panel.withColumn("OUTPUT_GAP_PROXY_PCT", F.when(F.col("period") == 2005, 9.0).otherwise(F.col("OUTPUT_GAP_PROXY_PCT")))
    assert rows(quality.derivation_drift(bent, DEFAULT_DERIVATIONS).where("drifted"), "indicator") == [("OUTPUT_GAP_PROXY_PCT",)]


def test_trend_reading(spark):
    df = spark.createDataFrame([("E", p, v) for p, v in enumerate([50.0, 51.5, 54.0, 50.0])], "entity string, period int, risk_score double")
    assert [r["trend_direction"] for r in s.trend_columns(df, SMALL).orderBy("period").collect()] == [None, "Stable", "Deteriorating", "Improving"]


def test_bands(spark):
    df = spark.createDataFrame([(None,), (0.0,), (20.0,), (59.99,), (60.0,), (80.0,)], "x double")
    assert [r[0] for r in df.select(band(F.col("x"))).collect()] == [None, "Low", "Moderate", "Elevated", "High", "Severe"]


def test_bad_models_are_refused():
    with pytest.raises(ValueError):
        Model(indicators=(), pillar_weights={"A": 0.5})
    with pytest.raises(ValueError):
        Model(indicators=(), pillar_weights={"A": 1.0}, sectors={"S": ("B",)}, sector_weights={"S": 1.0})
    with pytest.raises(ValueError):
        SMALL.with_weights({"One": 0.9, "Two": 0.3})


def test_model_from_a_configuration():
    model = model_from_mapping(
        {
            "scoring": {"min_history_obs": 4, "sector_composite_weight": 0.3},
            "pillar_weights": {"P": 1.0},
            "indicators": [{"code": "X", "pillar": "P", "weight": 0.2, "risk_direction": -1, "min": 0, "max": 5}],
        }
    )
    assert model.params.min_history_obs == 4 and model.indicators[0].high == 5.0 and model.total_weight == 0.2


def test_no_indicator_is_an_error(spark):
    with pytest.raises(ValueError):
        s.z_frame(spark.createDataFrame([("E", 1)], "entity string, period int"), SMALL)
