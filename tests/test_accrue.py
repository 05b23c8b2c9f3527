"""Summaries of loads, merged, against everything at once."""

import random

import pytest
from conftest import rows

from panelscore.operators import accrue, quality

CODES = ["A", "B", "C"]


def panel(spark, seed, n=400):
    rng = random.Random(seed)
    out = [(f"e{rng.randrange(9)}", rng.choice("ABCX"), None if rng.random() < 0.05 else 1990 + rng.randrange(30)) for _ in range(n)]
    return spark.createDataFrame(out, "entity string, indicator string, period int")


def test_merged_coverage(spark):
    loads = [panel(spark, k) for k in range(3)]
    bits = accrue.coverage_bits(loads[0], CODES, 1990)
    for load in loads[1:]:
        bits = accrue.merge_bits(bits, accrue.coverage_bits(load, CODES, 1990))
    whole = loads[0].unionByName(loads[1]).unionByName(loads[2])
    entities = spark.createDataFrame([("e1",), ("E1",), ("e5",), ("absent",)], "entity string")
    columns = ("entity", "expected", "observed", "coverage_pct")
    for asked, periods in ((CODES, range(1990, 2020)), (["B"], [1995, 1996, 2050]), (["A", "C"], range(1980, 1999))):
        got = accrue.coverage(bits, entities, CODES, list(periods), 1990, asked)
        assert rows(got, *columns) == rows(quality.coverage(whole, entities, asked, list(periods)), *columns)


def test_many_cells_need_several_bitmaps(spark):
    far = spark.createDataFrame([("a", "A", p) for p in (0, 40_000, 40_000, 90_000)], "entity string, indicator string, period int")
    bits = accrue.coverage_bits(far, CODES, 0)
    assert bits.count() == 3
    got = accrue.coverage(bits, far.select("entity"), CODES, [0, 40_000, 90_000, 90_001], 0).first()
    assert (got.observed, got.expected) == (3, 12)


def test_periods_before_the_base_are_refused(spark):
    with pytest.raises(Exception, match="before 2000"):
        accrue.coverage_bits(panel(spark, 1), CODES, 2000).collect()


def test_merged_sketches(spark):
    rng = random.Random(2)
    data = [(k % 3, None if k % 50 == 0 else float("nan") if k % 51 == 0 else rng.choice([1.0, rng.gauss(0, 1)])) for k in range(30_000)]
    parts = [spark.createDataFrame(data[k::4], "g int, v double") for k in range(4)]
    merged = accrue.quantile_sketches(parts[0], ["g"], "v")
    for part in parts[1:]:
        merged = accrue.merge_sketches(merged, accrue.quantile_sketches(part, ["g"], "v"), ["g"])
    for r in accrue.quantiles(merged, ["g"], {"low": 0.1, "mid": 0.5, "high": 0.99}).collect():
        own = sorted(v for g, v in data if g == r.g and v is not None and v == v)
        assert r.n == len(own)
        for name, share in (("low", 0.1), ("mid", 0.5), ("high", 0.99)):
            below, upto = (sum(v < r[name] for v in own) / len(own), sum(v <= r[name] for v in own) / len(own))
            assert below - 3 * accrue.rank_error() <= share <= upto + 3 * accrue.rank_error()
