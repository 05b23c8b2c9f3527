import statistics

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from panelscore.functions.ranks import global_index, median_table, rank_table
from panelscore.operators import explain, rank

SCHEMA = "entity string, period int, peer_group string, risk_score double, risk_band string, data_completeness double"


def scores(spark, data):
    full = [(e, p, g, s, None, 1.0) for e, p, g, s in data]
    from panelscore.functions.scalar import band

    return spark.createDataFrame(full, SCHEMA).withColumn("risk_band", band(F.col("risk_score")))


def test_peer_standing_of_the_worked_example(spark):
    df = scores(spark, [("BRA", 1, "em", 50.0), ("A", 1, "em", 30.0), ("B", 1, "em", 55.0), ("C", 1, "em", 60.0), ("USA", 1, None, 52.0)])
    got = {r["entity"]: r for r in rank.peer_standing(df).collect()}
    bra, usa = got["BRA"], got["USA"]
    assert (bra["rank"], bra["n"], bra["percentile"], bra["riskier_share"], bra["group_name"]) == (3, 3, 33, 67, "em")
    # Without a group the whole panel counts.
    assert (usa["rank"], usa["n"], usa["percentile"], usa["group_name"]) == (3, 4, 50, "panel")


def test_a_single_member_has_no_peers(spark):
    df = scores(spark, [("A", 1, "g", 50.0), ("B", 1, "h", 40.0)])
    assert rows(rank.peer_standing(df), "entity", "rank", "n", "percentile") == [("A", None, 0, None), ("B", None, 0, None)]


def test_rank_table_with_many_ties(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.round(rng.uniform(0, 100, 400), 1)] + [50.0] * 200
    df = spark.createDataFrame([("g", v) for v in values], "k string, x double")
    got = {r["x"]: (r["n_less"], r["n_equal"], r["n_total"]) for r in rank_table(df, ["k"], "x").collect()}
    assert got == {v: (sum(w < v for w in values), values.count(v), len(values)) for v in set(values)}
    for part in (values, values[:-1]):
        table = rank_table(df.limit(0).union(spark.createDataFrame([("g", v) for v in part], df.schema)), ["k"], "x")
        assert median_table(table, ["k"], "x").collect()[0]["median"] == statistics.median(part)


def test_median_of_the_others(spark):
    rng = np.random.default_rng(2)
    for size in (2, 3, 4, 7, 8):
        values = [float(v) for v in rng.integers(0, 5, size)]
        df = scores(spark, [(f"E{n}", 1, "g", v) for n, v in enumerate(values)])
        got = {r["entity"]: r["peer_median"] for r in explain.peer_medians(df).collect()}
        assert got == {f"E{n}": statistics.median(values[:n] + values[n + 1 :]) for n in range(size)}


def test_global_index(spark):
    df = spark.createDataFrame([(f"k{n:03d}",) for n in range(97)], "k string").repartition(5)
    assert rows(global_index(df, ["k"]), "k", "index") == [(f"k{n:03d}", n) for n in range(97)]


def test_watch_uses_the_two_newest_panel_periods(spark):
    df = scores(spark, [("A", 1, "g", 50.0), ("A", 3, "g", 65.0), ("B", 1, "g", 50.0), ("B", 2, "g", 40.0), ("B", 3, "g", 30.0), ("C", 2, "g", 10.0), ("C", 3, "g", 25.0)])
    # A has no score in the prior period 2.
    assert rows(rank.deterioration_watch(df), "side", "entity", "delta") == [("falling", "B", -10.0), ("rising", "C", 15.0)]
    assert rows(rank.band_transitions(df)) == [("C", "Low", "Moderate")]


def test_calendar_change_needs_the_year_before(spark):
    df = scores(spark, [("A", 2000, "g", 50.0), ("A", 2002, "g", 60.0), ("A", 2003, "g", 61.0)])
    assert rows(rank.calendar_change(df), "period", "change") == [(2000, None), (2002, None), (2003, 1.0)]
    assert rows(rank.worst_rises(df)) == [("A", 2003, 1.0)]


def test_map_layer_labels_gaps(spark):
    df = scores(spark, [("A", 2000, "g", 70.0), ("B", 2001, "g", 10.0)])
    assert rows(rank.map_layer(df, [2000, 2001]), "entity", "period", "label", "highlight") == [
        ("A", 2000, "High", True), ("A", 2001, "No data", False), ("B", 2000, "No data", False), ("B", 2001, "Low", False)
    ]
