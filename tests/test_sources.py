import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscore.model import Episode, Indicator, Model
from panelscore.operators import benchmark, quality
from panelscore.sources import cachelog, files, payloads


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "payload string")


def test_records_keep_readable_rows_only(spark):
    good = json.dumps([{"page": 1}, [
        {"countryiso3code": "ind", "date": "2022", "value": 3.4, "country": {"id": "IN"}},
        {"countryiso3code": "", "country": {"id": "us"}, "date": "2022", "value": 0.7},
        {"countryiso3code": "BRA", "date": "2022Q1", "value": 1.0},
        {"countryiso3code": "ZAF", "date": "2022", "value": None},
    ]])
    df = texts(spark, good, "[]", '[{"message": "x"}]', '[{"page": 1}, null]', "not json")
    assert rows(payloads.records_to_long(df), "entity", "period", "value") == [("IND", 2022, 3.4), ("US", 2022, 0.7)]
    single = spark.createDataFrame([(good, "zaf")], "payload string, asked string")
    assert payloads.records_to_long(single, stamp="asked").where("entity = 'ZAF'").count() == 3


def test_dated_lines_to_a_yearly_mean(spark):
    df = spark.createDataFrame([("x", v) for v in ("2020-01-01,1", "2020-06-01,3", "2020-13-01,9", "2021-01-01,.", "1999-01-01,5", "junk")], "s string, line string")
    assert rows(payloads.lines_to_annual(df, ["s"], 2000, 2030)) == [("x", 2020, 2.0)]


def test_csv_without_the_series_is_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("observation_date,DFF\n2020-01-01,1.0\n2020-02-01,2.0\n")
    assert rows(payloads.read_annual_csv(spark, str(tmp_path), "DFF", 2000, 2030)) == [(2020, 1.5)]
    assert payloads.read_annual_csv(spark, str(tmp_path), "OTHER", 2000, 2030).count() == 0


def quarterly(labels, values, wrap=True):
    body = {
        "dataSets": [{"series": {"0:0": {"observations": {str(n): [v] for n, v in enumerate(values)}}}}],
        "structure": {"dimensions": {"observation": [{"id": "TIME_PERIOD", "values": [{"id": x} for x in labels]}]}},
    }
    return json.dumps({"meta": {}, "data": body} if wrap else body)


def test_quarterly_payload(spark):
    labels = ["2005-Q1", "2005-Q4", "2006-Q1", "2006-Q2", "2006-Q3", "2006-Q4"]
    values = [1.0, 5.43216, 2.0, 3.0, 4.0, 7.25]
    for wrap in (True, False):
        out = payloads.quarterly_to_annual(texts(spark, quarterly(labels, values, wrap), "{}", "garbage"))
        assert rows(out) == [(2005, 5.4322), (2006, 7.25)]


def test_series_payload_maps_codes(spark):
    body = {
        "dataSets": [{"series": {"0:0": {"observations": {"0": [1.0], "1": [None]}}, "0:1": {"observations": {"1": [2.5], "9": [7.0]}}, "0:2": {"observations": {"0": [3.0]}}}}],
        "structure": {"dimensions": {
            "series": [{"id": "FREQ", "values": [{"id": "A"}]}, {"id": "REF_AREA", "values": [{"id": "TR"}, {"id": "XYZ"}, {"id": "FR"}]}],
            "observation": [{"id": "TIME_PERIOD", "values": [{"id": "2020"}, {"id": "2021-Q1"}]}],
        }},
    }
    aliases = spark.createDataFrame([("TR", "TUR"), ("FR", "FRA")], "code string, entity string")
    wanted = spark.createDataFrame([("TUR",), ("XYZ",)], "entity string")
    out = payloads.series_to_long(texts(spark, json.dumps(body)), wanted, aliases)
    assert rows(out, "entity", "period", "value") == [("TUR", 2020, 1.0), ("XYZ", 2021, 2.5)]


def test_cache_log(spark):
    log = spark.createDataFrame(
        [("k", "s", 1, 200, "2024-01-01 00:00:00"), ("k", "s", 2, 200, "2024-01-01 02:00:00"), ("m", "t", 3, 503, "2024-01-01 03:00:00")],
        "cache_key string, source string, body int, status_code int, at string",
    ).select("cache_key", "source", "body", "status_code", F.col("at").cast("timestamp").alias("retrieved_at"))
    now = F.lit("2024-01-01 08:00:00").cast("timestamp")
    assert rows(cachelog.lookup(log, now), "body", "freshness_seconds") == [(2, 21600), (3, 18000)]
    assert rows(cachelog.lookup(log, now, ttl=20000), "body") == [(3,)]
    assert rows(cachelog.last_known_good(log, now, ttl=20000), "body", "stale") == [(2, True), (3, False)]
    assert rows(cachelog.freshness(log, now), "source", "state") == [("s", "LIVE"), ("t", "UNAVAILABLE")]
    assert rows(cachelog.statistics(log), "source", "entries") == [("s", 2), ("t", 1), (None, 3)]


def test_wide_csv_and_idempotent_load(spark, tmp_path):
    source = tmp_path / "wide.csv"
    source.write_text("iso,year,CPI\n tur,2020,1.5\nusa,2021,NaN\n")
    df = files.read_wide_csv(spark, str(source), ["CPI", "GDP"], "iso", "year")
    assert rows(df) == [("TUR", 2020, 1.5), ("USA", 2021, None)]
    with pytest.raises(ValueError):
        files.read_wide_csv(spark, str(source), ["CPI"], "entity", "year")
    target = str(tmp_path / "out")
    for _ in range(2):
        files.write_table(df, target)
    files.write_table(df.where("period = 2021").withColumn("CPI", F.lit(9.0)), target, replace=[2021])
    assert rows(spark.read.parquet(target), "entity", "CPI", "period") == [("TUR", 1.5, 2020), ("USA", 9.0, 2021)]


def test_ratings(spark):
    df = spark.createDataFrame(
        [("a", "S&P", "AAA"), ("a", "Moody's", "Aaa"), ("b", "S&P", "D"), ("b", "Fitch", "ZZ+"), ("c", "Fitch", "ZZ+"), ("d", "Moody's", "Ba1"), ("d", "S&P", "BB")],
        "entity string, agency string, letter string",
    )
    assert rows(benchmark.reference(df)) == [("A", 1.0, 0.0), ("B", 21.0, 100.0), ("D", 11.5, 52.5)]


def test_spearman_guards(spark):
    def rho(*pairs):
        return benchmark.spearman(spark.createDataFrame(pairs, "x double, y double"), "x", "y").collect()[0]["spearman"]

    assert rho((1.0, 10.0), (2.0, 20.0), (3.0, 90.0)) == 1.0
    assert rho((1.0, 10.0)) is None and rho((1.0, 5.0), (2.0, 5.0)) is None


MODEL = Model((Indicator("X", "P", 0.6), Indicator("Y", "P", 0.4)), {"P": 1.0})


def test_thin_newest_period_is_skipped(spark):
    data = [(f"E{e}", i, p, 1.0) for e in range(6) for p in (2023, 2024) for i in "XY"] + [(f"E{e}", i, 2025, 1.0) for e in range(2) for i in "XY"]
    panel = spark.createDataFrame(data, "entity string, indicator string, period int, value double")
    assert quality.latest_covered_period(panel, MODEL).collect()[0]["period"] == 2024
    assert rows(quality.missing_indicators(panel.where("indicator = 'X'"), MODEL), "indicator") == [("Y",)]


def test_structure_and_episode_checks(spark):
    model = Model((Indicator("X", "P", 0.6),), {"P": 0.5, "Q": 0.5})
    assert rows(quality.empty_pillars(spark, model)) == [("pillar_coverage", "Q")]
    panel = spark.createDataFrame([("A", 2000), ("A", 2010)], "entity string, period int")
    eps = [Episode("A", "fine", 2000, 2005), Episode("A", "late", 2005, 2020), Episode("Z", "who", 2001, 2002)]
    assert rows(quality.episode_checks(panel, eps), "label", "problem") == [("late", "event outside panel"), ("who", "unknown entity")]


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "d int, v string")
    old = quality.fingerprint(a, "t", F.col("d"))
    new = quality.fingerprint(a.where("d <> 3").replace("y", "w").repartition(3), "t", F.col("d"))
    compared = quality.compare_fingerprints(old, new)
    assert rows(compared, "partition", "status") == [("1", "ok"), ("2", "drifted"), ("3", "missing")]
    assert quality.overall_status(compared).collect()[0]["overall"] == "drifted"
