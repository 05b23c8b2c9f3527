import json

from conftest import rows
from pyspark.sql import functions as F

from panelscore.defaults import DEFAULT_DERIVATIONS, DEFAULT_MODEL, preset
from panelscore.model import Episode
from panelscore.operators import clean, explain, quality, rank, scenario
from panelscore.operators import score as scoring
from panelscore.plans import pipeline
from panelscore.sources.synthetic import synthetic_panel

STAMP = "2024-01-01 00:00:00"


def test_phrases(spark):
    df = spark.createDataFrame([("NY.GDP.MKTP.KD.ZG", 0.1), ("NY.GDP.MKTP.KD.ZG", -0.1), ("DT.DOD.DSTC.CD", 1.0)], "i string, c double")
    out = [r[0] for r in df.selectExpr(explain.driver_phrase(DEFAULT_MODEL, "i", "c")).collect()]
    assert out == ["Weakening growth", "Resilient growth", "Short-term external debt"]


def test_trend_phrases(spark):
    df = spark.createDataFrame([("A", 1, 50.0), ("A", 2, 51.0), ("A", 3, 55.0), ("A", 5, 60.0), ("A", 6, 40.5)], "entity string, period int, risk_score double")
    assert [r["trend_phrase"] for r in explain.with_trend(df).orderBy("period").collect()] == [
        None, "broadly unchanged from 50 a year earlier", "up from 51 a year earlier (+4.0 pts)", None, "down from 60 a year earlier (-19.5 pts)"
    ]


def test_confidence(spark):
    df = spark.createDataFrame([(0.96,), (0.8,), (0.5,)], "data_completeness double")
    plain = [r[0] for r in df.selectExpr(explain.confidence_level()).collect()]
    lowered = [r[0] for r in df.selectExpr(explain.confidence_level("'LOW INFORMATION'")).collect()]
    assert (plain, lowered) == (["HIGH", "MODERATE", "LOW"], ["MODERATE", "LOW", "LOW"])


def test_reports_are_complete_and_repeatable(spark):
    panel = synthetic_panel(spark, 6, 2008, 2014)
    shock = preset("growth_slowdown")

    def texts():
        scores = explain.story_scores(scoring.z_frame(panel, DEFAULT_MODEL), DEFAULT_MODEL)
        shocked = scenario.shock_scores(panel, DEFAULT_MODEL, [shock])
        channels = scenario.target_deltas(panel, [shock])
        return rows(explain.reports(scores, DEFAULT_MODEL, STAMP, None, ["World Bank"], shocked, channels, shock))

    first = texts()
    assert first == texts() and len(first) == 42
    for _, _, text in first:
        for part in ("Risk Score:", "**Main drivers:**", "**Scenario:**", "**Impact:**", "**Analyst view:**", "**Limitations:**", "- World Bank", STAMP):
            assert part in text
        assert text.count("\n- ") >= 3 and "If NY.GDP.MKTP.KD.ZG moves by -2 from current levels" in text


def test_dossier_is_one_nested_row(spark):
    panel = synthetic_panel(spark, 4, 2008, 2012)
    scores = explain.story_scores(scoring.z_frame(panel, DEFAULT_MODEL), DEFAULT_MODEL)
    shocked = scenario.shock_scores(panel, DEFAULT_MODEL, [preset("rate_hike")])
    out = explain.dossiers(scores, DEFAULT_MODEL, shocked)
    assert out.count() == 20
    row = json.loads(out.where("entity = 'E0000001' AND period = 2012").toJSON().first())
    assert len(row["pillars"]) == 5 and len(row["top_drivers"]) == 6 and "trajectory" not in row
    assert row["pillars"] == sorted(row["pillars"], key=lambda p: -p["score"])
    assert row["peer_standing"]["n"] == 1 and row["scenarios"][0]["preset"] == "rate_hike"


def test_the_batch_run_writes_every_table_and_can_be_repeated(spark, tmp_path):
    panel = synthetic_panel(spark, 6, 2008, 2014)
    codes = [c for c in panel.columns if c not in ("entity", "peer_group", "period")]
    raw = clean.to_long(panel, codes).withColumn("source", F.lit("made up")).withColumn("seq", F.lit(0).cast("bigint"))
    peers = panel.select("entity", "peer_group").distinct()
    prints = []
    for _ in range(2):
        out = pipeline.run(
            raw, DEFAULT_MODEL, str(tmp_path / "run"), DEFAULT_DERIVATIONS, peers, [preset("fx_devaluation")],
            [Episode("E0000001", "one", 2010, 2012)], generated_at=STAMP,
        )
        prints.append(pipeline.fingerprints(out, spark).collect())
    assert out.read(spark, "scores").count() == 42 and out.read(spark, "reports").count() == 42
    assert out.read(spark, "scenarios").count() == 42 and out.read(spark, "drivers").count() == 42 * len(DEFAULT_MODEL.codes)
    assert rows(out.read(spark, "episodes"), "entity", "baseline") == [("E0000001", 2010)]
    coverage = spark.read.json(out.path("coverage")).collect()[0]
    assert coverage["entities"] == 6 and coverage["derivations"] and coverage["indicator_columns"]
    old, new = (spark.createDataFrame(p) for p in prints)
    assert quality.overall_status(quality.compare_fingerprints(old, new)).collect()[0]["drifted"] == 0


def test_complete_slices_carry_the_trajectory(spark, tmp_path):
    panel = synthetic_panel(spark, 5, 2008, 2013)
    scores = explain.story_scores(scoring.z_frame(panel, DEFAULT_MODEL), DEFAULT_MODEL)
    explain.dossiers(scores, DEFAULT_MODEL).write.parquet(str(tmp_path / "d"))
    rank.trajectories(scores).write.parquet(str(tmp_path / "t"))
    d, t = spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "t"))
    expected = {}
    for r in sorted(d.collect(), key=lambda r: r["period"]):
        expected.setdefault(r["entity"], []).append((r["period"], r["risk_score"]))
    shown = {r["entity"]: r for r in explain.complete(d, t).collect()}
    assert set(shown) == set(expected)
    for e, r in shown.items():
        assert [tuple(x) for x in r["trajectory"]] == expected[e] and (r["period"], r["risk_score"]) == expected[e][-1]
    wanted = spark.createDataFrame([("e0000001", 2009), ("E0000001", 2009), ("E0000002", 2013), ("E0000002", 1900), ("none", 2010), (None, None)], "entity string, period int")
    some = explain.complete(d, t.where("entity <> 'E0000002'"), wanted).collect()
    assert sorted((r["entity"], r["period"], r["trajectory"] is None) for r in some) == [("E0000001", 2009, False), ("E0000002", 2013, True)]
    one = explain.lookup(d, t, "e0000001", 2009)
    assert one.collect() == [r for r in some if r["entity"] == "E0000001"]
    assert explain.lookup(d, t, "E0000001").first() == shown["E0000001"] and explain.lookup(d, t, "nobody").count() == 0
    assert explain.complete(d.limit(0), t).count() == 0
