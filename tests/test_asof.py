"""As-of joins against looking at every row."""

import datetime
import random

import pytest
from conftest import rows

from panelscore.operators import asof


def plain(left, right, order):
    out = []
    for key, at, tag in left:
        best = [r for r in right if key is not None and at is not None and r[0] == key and r[1] is not None and r[1] <= at]
        best = max(best, key=lambda r: (r[1], order(r)), default=None)
        out.append((key, at, tag, *(best[1:] if best else (None, None, None))))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def tables(seed, instant):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "a", "b", "c", "d", None])
    at = lambda: None if rng.random() < 0.05 else instant(rng.randrange(60))
    right = [(key(), at(), rng.randrange(5), float(k)) for k in range(150)]
    left = [(key(), at(), k // 2) for k in range(150)]
    return left + left[:9], right


INSTANTS = {
    "int": int,
    "date": lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k),
    "timestamp": lambda k: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=k * 1000),
    "timestamp_ntz": lambda k: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=k * 1000),
}


@pytest.mark.parametrize("stretch", [10**6, 20, 1])
@pytest.mark.parametrize("kind", INSTANTS)
def test_against_all_rows(spark, kind, stretch):
    left, right = tables(stretch, INSTANTS[kind])
    a = spark.createDataFrame(left, f"k string, at {kind}, tag int")
    b = spark.createDataFrame(right, f"k string, at {kind}, p int, v double")
    got = asof.asof_join(a, b, ["k"], "at", ["p"], rows_per_stretch=stretch)
    assert got.columns == ["k", "at", "tag", asof.MATCHED, "p", "v"]
    assert rows(got) == plain(left, right, lambda r: (r[2], r[3]))


def test_empty_sides_and_clashes(spark):
    left, right = tables(3, int)
    a = spark.createDataFrame(left, "k string, at int, tag int")
    b = spark.createDataFrame(right, "k string, at int, p int, v double")
    assert asof.asof_join(a.limit(0), b, ["k"], "at").collect() == []
    assert rows(asof.asof_join(a, b.limit(0), ["k"], "at")) == plain(left, [], None)
    with pytest.raises(ValueError, match="tag"):
        asof.asof_join(a, b.withColumnRenamed("p", "tag"), ["k"], "at")
    with pytest.raises(TypeError):
        asof.asof_join(a.withColumn("at", a.at.cast("double")), b, ["k"], "at")


def test_scores_known_then(spark):
    vintages = spark.createDataFrame(
        [("A", 2001, 10, 1.0), ("A", 2001, 30, 2.0), ("A", 2002, 20, 5.0), ("B", 2001, 5, 9.0)], "entity string, period int, known_at int, risk_score double"
    )
    asked = spark.createDataFrame([("a", 9, 2001), ("a", 10, 2001), ("a", 25, 2001), ("a", 31, 2001), ("b", 99, 2002)], "entity string, asked_at int, period int")
    assert rows(asof.known_scores(vintages, asked), "asked_at", "risk_score") == [(10, 1.0), (25, 1.0), (31, 2.0), (9, None), (99, None)]
    newest = asof.known_scores(vintages, asked.drop("period"), by_period=False)
    assert rows(newest, "asked_at", "period", "risk_score") == [(10, 2001, 1.0), (25, 2002, 5.0), (31, 2001, 2.0), (9, None, None), (99, 2001, 9.0)]
