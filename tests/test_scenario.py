import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_score import SCHEMA, SMALL, brute, small_data

from panelscore.defaults import DEFAULT_MODEL, DEFAULT_PRESETS, preset
from panelscore.model import Indicator, Model, Preset
from panelscore.operators import scenario
from panelscore.operators import score as scoring
from panelscore.sources.synthetic import synthetic_panel

SHOCKS = (Preset("one", "One", "A", 1.5, ("B", "C", "missing")), Preset("two", "Two", "D", -2.0, ("A",)))


def test_closed_form_equals_scoring_the_changed_panel_again(spark):
    data = small_data()
    panel = spark.createDataFrame(data, SCHEMA)
    base = brute(data, SMALL)
    got = {(r["preset"], r["entity"], r["period"]): r for r in scenario.shock_scores(panel, SMALL, SHOCKS).collect()}
    deltas = {(r["preset"], r["target"]): r["slope"] for r in scenario.regressions(panel, SHOCKS).collect()}
    assert len(got) == 2 * len(data)
    for shock in SHOCKS:
        for row in data[::7]:
            changed = list(row)
            for target in shock.targets:
                if target in "ABCD" and row[3 + "ABCD".index(target)] is not None:
                    changed[3 + "ABCD".index(target)] += deltas[shock.key, target] * shock.amount
            expected = brute([tuple(changed) if r == row else r for r in data], SMALL)[row[0], row[2]]
            r = got[shock.key, row[0], row[2]]
            if base[row[0], row[2]] is None:
                assert r["baseline_score"] is None and r["scenario_band"] == "Unavailable" and r["status"] != "ok"
                continue
            assert math.isclose(r["baseline_score"], base[row[0], row[2]], rel_tol=1e-9)
            assert math.isclose(r["scenario_score"], expected, rel_tol=1e-9), (shock.key, row)


def test_constant_driver_gives_no_estimate(spark):
    panel = spark.createDataFrame(small_data(), SCHEMA).withColumn("D", F.lit(1.0))
    (r,) = scenario.regressions(panel, SHOCKS[1:]).collect()
    assert (r["slope"], r["r_squared"], r["information"], r["driver_min"]) == (None, None, "INSUFFICIENT DATA", 1.0)
    moved = scenario.shock_scores(panel, SMALL, SHOCKS[1:]).where("delta <> 0 OR NOT out_of_sample")
    assert moved.where("baseline_score IS NOT NULL").count() == 0


def test_five_observations_are_needed(spark):
    panel = spark.createDataFrame([(f"E{n}", None, 2000, float(n), 2.0 * n, 0.0, 0.0) for n in range(4)], SCHEMA)
    (r, _) = scenario.regressions(panel, SHOCKS[:1]).collect()
    assert (r["slope"], r["n_obs"], r["driver_min"]) == (None, 4, None)


def test_exact_line(spark):
    panel = spark.createDataFrame([(f"E{n}", None, 2000, float(n), 2.0 * n, 1.0, 0.0) for n in range(9)], SCHEMA)
    b, c = scenario.regressions(panel, SHOCKS[:1]).orderBy("target").collect()
    assert b["slope"] == pytest.approx(2.0) and b["r_squared"] == pytest.approx(1.0)
    # A constant target has a slope of 0 and no r-squared.
    assert c["slope"] == pytest.approx(0.0) and c["r_squared"] is None


def test_named_presets_on_the_default_model(spark):
    assert len(DEFAULT_PRESETS) == 5
    with pytest.raises(ValueError):
        preset("meteor")
    panel = synthetic_panel(spark, 10, 2005, 2014)
    far = replace(preset("fx_devaluation"), amount=200.0)
    (r,) = scenario.run_shock(panel, DEFAULT_MODEL, far, "e0000003", 2012).collect()
    assert r["status"] == "ok" and r["estimation_window"] == "2005–2014" and r["out_of_sample"]
    assert r["narrative"].startswith("FX shock (20% devaluation) shock: a 200 pp change in the currency-depreciation")
    assert r["narrative"].endswith("is an extrapolation.")
    with pytest.raises(ValueError):
        scenario.run_shock(panel, DEFAULT_MODEL, preset("fx_devaluation"), "nobody", 2012)
    absent = scenario.shock_scores(panel.drop("BIS_CREDIT_GAP"), DEFAULT_MODEL, [preset("banking_stress")])
    assert {(r["status"], r["scenario_score"], r["information"]) for r in absent.collect()} == {("driver not in the panel", None, scenario.NONE)}
    with pytest.raises(ValueError):
        scenario.run_shock(panel.drop("BIS_CREDIT_GAP"), DEFAULT_MODEL, preset("banking_stress"), "e0000003", 2012)


def test_a_constant_target_does_not_move(spark):
    model = Model((Indicator("A", "P", 0.5), Indicator("B", "P", 0.5)), {"P": 1.0})
    shock = Preset("s", "S", "D", 3.0, ("A", "B"))
    cells = [(f"e{n}", "G", 2000 + p, 0.1, 0.1 * n + 0.7, float((n * 7 + p * 3) % 11)) for n in range(4) for p in range(12)]
    panel = spark.createDataFrame(cells, "entity string, peer_group string, period int, A double, B double, D double")
    out = scenario.shock_scores(panel, model, [replace(shock, targets=("A",))]).collect()
    assert len(out) == 48 and all(r["scenario_score"] == r["baseline_score"] for r in out)
    # B is constant for each entity: no spread in its history, moved or not up to rounding.
    z = scoring.z_frame(panel, model)
    assert {r[0] for r in z.where("zt0 IS NOT NULL").select("zt0").distinct().collect()} == {0.0}
    assert {r[0] for r in z.where("zt1 IS NOT NULL").select("zt1").distinct().collect()} == {0.0}
