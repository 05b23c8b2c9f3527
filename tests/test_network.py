import itertools
import math

import numpy as np
import pytest
from conftest import rows

from panelscore.operators import network as net

SCHEMA = "entity string, period int, risk_score double"


def table(spark, series):
    return spark.createDataFrame([(e, p, v) for e, points in series.items() for p, v in points.items()], SCHEMA)


def test_together_apart_and_constant(spark):
    zigzag = [50.0, 55.0, 50.0, 55.0, 50.0, 55.0, 50.0]
    series = {
        "A": {2000 + n: v for n, v in enumerate(zigzag)},
        "B": {2000 + n: v + 3 for n, v in enumerate(zigzag)},
        "C": {2000 + n: 40 + 1.1 * n for n in range(7)},
    }
    found, kept, members = net.network(table(spark, series))
    assert rows(kept) == [("A", "B", 1.0, 6)]
    assert rows(members, "entity", "cluster", "degree", "integration") == [("A", 0, 1, 1.0), ("B", 0, 1, 1.0), ("C", 1, 0, None)]
    s = net.summary(found, kept).collect()[0]
    assert (s["entities"], s["pairs_considered"], s["mean_abs_correlation"], s["positive_edge_share"]) == (3, 3, 1.0, 1.0)


def test_short_overlap_has_no_edge(spark):
    series = {"X": {2000: 1.0, 2001: 3.0, 2002: 2.0}, "Y": {2000: 2.0, 2001: 4.0, 2002: 3.0}}
    found, kept, members = net.network(table(spark, series))
    assert kept.count() == 0 and rows(members, "entity", "cluster") == [("X", 0), ("Y", 1)]


def test_adjacent_means_present_in_the_panel(spark):
    df = table(spark, {"A": {2000: 1.0, 2003: 5.0, 2004: 6.0}, "B": {2000: 1.0, 2004: 9.0}})
    assert rows(net.score_deltas(df), "entity", "period", "delta") == [("A", 2003, 4.0), ("A", 2004, 1.0)]


@pytest.mark.parametrize("block_rows", [4, 7, 100])
def test_blocks_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    series = {f"E{n:02d}": {p: float(v) for p, v in enumerate(rng.normal(50, 5, 12)) if rng.random() > 0.15} for n in range(23)}
    deltas = {e: {p: pts[p] - pts[p - 1] for p in pts if p - 1 in pts} for e, pts in series.items()}
    expected, sums = {}, dict.fromkeys(series, (0.0, 0))
    for a, b in itertools.combinations(sorted(series), 2):
        both = sorted(set(deltas[a]) & set(deltas[b]))
        if len(both) < 4:
            continue
        r = np.corrcoef([deltas[a][p] for p in both], [deltas[b][p] for p in both])[0, 1]
        for e in (a, b):
            sums[e] = (sums[e][0] + abs(r), sums[e][1] + 1)
        if abs(r) >= 0.5:
            expected[a, b] = (r, len(both))
    vectors = net.delta_vectors(table(spark, series))
    found = net.correlations(vectors, block_rows=block_rows).cache()
    got = {(r["a"], r["b"]): (r["correlation"], r["pairs"]) for r in net.pair_table(found).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k][0], expected[k][0], abs_tol=1e-9) and got[k][1] == expected[k][1] for k in got)
    nodes = {r["entity"]: r["integration"] for r in net.nodes(found, net.edges(found)).collect()}
    assert nodes == pytest.approx({e: (round(s / n, 4) if n else None) for e, (s, n) in sums.items()})
    found.unpersist()


VECTORS = "entity string, steps array<int>, deltas array<double>"


def gapped(spark, count, width=12, seed=8):
    """Vectors of changes, every third with gaps, one constant, one empty, one null; and the correlations one by one."""
    rng = np.random.default_rng(seed)
    some = {f"E{n:03d}": {p: float(v) for p, v in enumerate(rng.normal(size=width), 1) if n % 3 or rng.random() > 0.2} for n in range(count)}
    some |= {"flat": dict.fromkeys(range(1, width + 1), 2.5), "none": {}}
    expected = {}
    for a, b in itertools.combinations(sorted(some.keys() - {"flat", "none"}), 2):
        both = sorted(some[a].keys() & some[b].keys())
        if len(both) >= 4:
            expected[a, b] = (np.corrcoef([some[a][p] for p in both], [some[b][p] for p in both])[0, 1], len(both))
    return spark.createDataFrame([*[(e, list(v), list(v.values())) for e, v in some.items()], ("null", None, None)], VECTORS), expected


def equal(found, expected, threshold):
    got = {(r["a"], r["b"]): (r["correlation"], r["pairs"]) for r in net.pair_table(found).collect()}
    wanted = {k: v for k, v in expected.items() if abs(v[0]) >= threshold}
    assert got.keys() == wanted.keys()
    assert all(math.isclose(got[k][0], wanted[k][0], abs_tol=1e-9) and got[k][1] == wanted[k][1] for k in got)


@pytest.mark.parametrize("tile_rows", [1, 3, 256])
def test_tiles_equal_brute_force(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(net, "TILE_ROWS", tile_rows)
    vectors, expected = gapped(spark, 31)
    found = net.correlations(vectors, block_rows=20).cache()
    equal(found, expected, 0.5)
    sums = dict.fromkeys(r["entity"] for r in vectors.collect())
    for e in sums:
        of = [abs(r) for ends, (r, _) in expected.items() if e in ends]
        sums[e] = round(sum(of) / len(of), 4) if of else None
    assert {r["entity"]: r["integration"] for r in net.nodes(found, net.edges(found)).collect()} == pytest.approx(sums, abs=1e-4)
    found.unpersist()


def test_copies_of_a_row_do_not_grow_with_the_entities(spark):
    vectors, expected = gapped(spark, 200)
    found = net.correlations(vectors, block_rows=2).cache()
    equal(found, expected, 0.5)
    # One node row from every group that an entity went to.
    assert max(r["count"] for r in found.where("kind = 'node'").groupBy("a").count().collect()) <= net.BLOCKS
    found.unpersist()


def test_a_block_stays_within_a_task(spark, monkeypatch):
    vectors, _ = gapped(spark, 4)
    assert [net.rows_per_block(vectors, n, 64) for n in (7, 2048, 3200, 32 * 10**5)] == [64, 64, 100, 10**5]
    monkeypatch.setattr(net, "BLOCK_CELLS", 12 * 80)
    assert [net.rows_per_block(vectors, n, 64) for n in (7, 3200, 10**6)] == [64, 80, 80]


def test_components_of_chain_star_and_ring(spark):
    chain = [(f"c{n:02d}", f"c{n + 1:02d}") for n in range(20)]
    star = [("hub", f"s{n}") for n in range(9)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r1", "r3")]
    edges = spark.createDataFrame(chain + star + ring, "a string, b string")
    labels = {r["node"]: r["label"] for r in net.components(edges).collect()}
    assert {labels[f"c{n:02d}"] for n in range(21)} == {"c00"}
    assert {labels[f"s{n}"] for n in range(9)} == {labels["hub"]} == {"hub"}
    assert {labels[x] for x in ("r1", "r2", "r3")} == {"r1"}


def test_edge_limit_keeps_the_strongest(spark):
    found = spark.createDataFrame(
        [("pair", "A", "B", 0.9, 5), ("pair", "A", "C", -0.95, 5), ("pair", "B", "C", 0.9, 5)],
        "kind string, a string, b string, correlation double, pairs bigint",
    )
    assert rows(net.edges(found, 2), "a", "b") == [("A", "B"), ("A", "C")]
    assert net.edges(found, None).count() == 3
