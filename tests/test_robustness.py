"""Dirty inputs, empty inputs, reloads, and values far from the usual range."""

import os
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscore.defaults import DEFAULT_MODEL, preset
from panelscore.functions.ranks import rank_table
from panelscore.model import Episode, Indicator, Model, Preset, episodes_from_mapping
from panelscore.operators import clean, derive, network, quality, scenario
from panelscore.operators import score as scoring
from panelscore.plans import pipeline
from panelscore.session import pin, release, scratch, unpin
from panelscore.sources import cachelog, files
from panelscore.sources.synthetic import synthetic_panel

LONG = "entity string, indicator string, period int, value double, source string, flag string"
TINY = Model((Indicator("A", "P", 0.5), Indicator("B", "P", 0.5)), {"P": 1.0})


@pytest.mark.parametrize("values", [[0.001 * n for n in range(400)], [1e9 * (n % 37) - 5e9 for n in range(400)], [7.0] * 400, [1e-7 * n for n in range(50)] + [1e12]])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks_of_any_range(spark, values, keys):
    df = spark.createDataFrame([("g" if n % 3 else None, float(v)) for n, v in enumerate(values)] + [("g", None)], "k string, x double")
    got = {tuple(r) for r in rank_table(df, keys, "x").select(*keys, "x", "n_less", "n_equal", "n_total").collect()}
    expected = set()
    for k in ({"g", None} if keys else {0}):
        own = [v for n, v in enumerate(values) if not keys or ("g" if n % 3 else None) == k]
        expected |= {((k,) if keys else ()) + (v, sum(w < v for w in own), own.count(v), len(own)) for v in own}
    assert got == expected


def test_last_arrival_without_an_order(spark):
    data = [("E", "A", 1, 2.0, "s", None), ("E", "A", 1, 5.0, "s", None), ("E", "B", 1, 1.0, "s", 3), ("E", "B", 1, 9.0, "s", None)]
    df = spark.createDataFrame(data, "entity string, indicator string, period int, value double, source string, seq bigint")
    assert rows(clean.keep_last(df), "indicator", "value") == [("A", 5.0), ("B", 1.0)]
    log = spark.createDataFrame([("k", "s", None, 1), ("k", "s", "2020-01-01", 2), ("k", "s", "2020-01-01", 4)], "cache_key string, source string, t string, body int")
    log = log.withColumn("retrieved_at", F.col("t").cast("timestamp")).drop("t")
    assert rows(cachelog.newest_per_key(log), "body") == [(4,)]
    stats = cachelog.statistics(log.unionByName(log.withColumn("source", F.lit(None).cast("string"))))
    assert rows(stats, "source", "is_total", "entries") == [("s", False, 3), (None, False, 3), (None, True, 6)]


def test_year_on_year_steps_over_nulls(spark):
    df = spark.createDataFrame([("E", "X", 2000 + n, v, "s", "ok") for n, v in enumerate([100.0, None, 121.0])], LONG)
    rule = derive.Derivation("Y", "X", "yoy")
    assert rows(derive.derive(df, [rule]), "period", "value") == [(2000, None), (2002, 21.0)]
    assert derive.derive(df, []).count() == 0 and derive.derive(df, []).columns == derive.derive(df, [rule]).columns


def test_peer_groups_whatever_the_case(spark):
    cells = [(e, p, float(n + p), 1.0) for n, e in enumerate(["e0", "E1", "e2"]) for p in range(6)]
    panel = spark.createDataFrame(cells, "entity string, period int, A double, B double")
    peers = spark.createDataFrame([("E0", "G"), ("e1", "G"), ("E1", "G")], "entity string, peer_group string")
    z = scoring.z_frame(panel, TINY, peers)
    assert rows(z.select("entity", "peer_group").distinct()) == [("E0", "G"), ("E1", "G"), ("E2", None)]
    twice = peers.union(spark.createDataFrame([("e0", "H")], peers.schema))
    with pytest.raises(Exception, match="more than one peer group"):
        scoring.prepare(panel, TINY, twice).collect()
    entities = spark.createDataFrame([("e0",)], "entity string")
    long = spark.createDataFrame([("E0", "A", 1, 1.0, "s", "ok")], LONG)
    assert rows(quality.coverage(long, entities, ["A"], [1]), "entity", "observed") == [("E0", 1)]
    checked = quality.episode_checks(panel, [Episode("E2", "known", 1, 2)], entities)
    assert checked.count() == 0


def test_checks_without_rules_and_networks_without_a_limit(spark):
    panel = synthetic_panel(spark, 3, 2000, 2006)
    assert quality.derivation_drift(panel, []).count() == 0
    assert quality.report(panel, DEFAULT_MODEL, [], []).collect()[0]["derivations"]
    vectors = network.delta_vectors(panel.select("entity", "period", F.lit(1.0).alias("risk_score")))
    with pytest.raises(ValueError):
        network.correlations(vectors, threshold=0.0)


def observations(panel):
    codes = [c for c in panel.columns if c not in ("entity", "peer_group", "period")]
    return clean.to_long(panel, codes).withColumn("source", F.lit("made up")).withColumn("seq", F.lit(0).cast("bigint"))


def test_batch_run_with_defaults_then_with_fewer_periods(spark, tmp_path):
    raw = observations(synthetic_panel(spark, 4, 2018, 2023))
    out = pipeline.run(raw, DEFAULT_MODEL, str(tmp_path / "run"))
    assert out.read(spark, "scores").count() == 24
    assert {r["status"] for r in spark.read.json(out.path("changes")).collect()} == {"ok"}
    out = pipeline.run(raw, DEFAULT_MODEL, str(tmp_path / "run"), periods=[2022, 2023])
    for table in ("observations", "panel", "scores", "drivers", "reports"):
        assert {r[0] for r in out.read(spark, table).select("period").distinct().collect()} == {2022, 2023}
    meta = spark.read.json(out.path("run_metadata")).collect()[0]
    assert meta["entity_count"] == 4 and meta["observations_missing"] == 0
    assert {r["status"] for r in spark.read.json(out.path("changes")).collect()} == {"ok", "missing", "drifted"}
    assert rows(out.read(spark, "entity_coverage"), "coverage_pct") == [(100.0,)] * 4


def test_batch_run_with_scenarios_names_and_expected_entities(spark, tmp_path):
    panel = synthetic_panel(spark, 4, 2012, 2019).drop("BIS_CREDIT_GAP")
    names = spark.createDataFrame([(f"E000000{n}", f"Land {n}") for n in range(4)], "entity string, name string")
    expected = names.select("entity").union(spark.createDataFrame([("E9",)], "entity string"))
    shocks = [preset("growth_slowdown"), preset("banking_stress")]
    out = pipeline.run(
        observations(panel), DEFAULT_MODEL, str(tmp_path / "run"), presets=shocks, episodes=[Episode("E0000001", "one", 2014, 2016)],
        generated_at="now", entities=expected, names=names, sources={"made up": "made up", "other": "other"},
    )
    status = out.read(spark, "scenarios").groupBy("preset", "status").count()
    assert rows(status, "preset", "status") == [("banking_stress", "driver not in the panel"), ("growth_slowdown", "ok")]
    text = out.read(spark, "reports").where("entity = 'E0000002' and period = 2015").collect()[0]["report"]
    assert text.startswith("**Land 2 — Risk Score") and "**Scenario:**" in text and "- made up" in text
    assert rows(out.read(spark, "entity_coverage").where("observed = 0"), "entity") == [("E9",)]
    assert spark.read.json(out.path("provenance")).collect()[0]["other_ok"] is False
    assert spark.read.json(out.path("backtest")).count() == 1
    assert out.read(spark, "trajectories").count() == 4


def test_channels_keep_the_order_of_the_preset(spark):
    cells = [(f"E{n}", 2000 + p, float(n + p), float(n * p % 5), float(p)) for n in range(4) for p in range(8)]
    panel = spark.createDataFrame(cells, "entity string, period int, A double, B double, D double")
    moves = scenario.target_deltas(panel, [Preset("s", "S", "D", 1.0, ("B", "none", "A"))])
    assert rows(moves.select("position", "target").distinct()) == [(0, "B"), (1, "A")]


def test_reload_and_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("E", p, 1.0) for p in range(5)], "entity string, period int, value double")
    files.write_table(df, path)
    files.write_table(df.where("period < 3"), path)
    assert rows(spark.read.parquet(path), "period") == [(0,), (1,), (2,)]
    files.write_table(df.where("period = 1").withColumn("value", F.lit(2.0)), path, replace=[1, 2])
    assert rows(spark.read.parquet(path), "period", "value") == [(0, 1.0), (1, 2.0)]


def test_pinned_tables_end_with_their_run(spark):
    outside = pin(spark.range(3))
    with scratch(spark) as folder:
        inside = pin(spark.range(5))
        assert inside.pinned_at.startswith(folder) and inside.count() == 5
    assert not os.path.exists(inside.pinned_at.removeprefix("file:")) and outside.count() == 3
    unpin(outside)
    release(spark)
    assert not os.path.exists(outside.pinned_at.removeprefix("file:"))


def test_configurations():
    found = episodes_from_mapping({"detection_window_years": 2, "pass_threshold_points": "4", "episodes": [{"iso3": "abc", "baseline_year": "1", "event_year": 3, "window_years": 0}, {"iso3": "D", "baseline_year": 1, "event_year": 2, "label": "x"}, {"label": "no id"}]})
    assert found == [Episode("ABC", "abc", 1, 3, 0, 4.0), Episode("D", "x", 1, 2, 2, 4.0)]
    assert len(episodes_from_mapping({})) == 4
    for broken in ({"pillar_weights": {"P": 1.5, "Q": -0.5}}, {"sectors": {"S": ("P",), "T": ("P",)}, "sector_weights": {"S": 0.5, "T": 0.5}}, {"sectors": {"S": ()}, "sector_weights": {"S": 1.0}}):
        with pytest.raises(ValueError):
            replace(TINY, **broken)
