"""Pruned edges against all pairs, with and without common factors and gaps."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from panelscore.operators import network, pruned

SCHEMA = "entity string, steps array<int>, deltas array<double>"


def edges(df):
    return {(a, b): (round(r, 9), n) for a, b, r, n in rows(df, "a", "b", "correlation", "pairs")}


def vectors(spark, values, gaps=0.0, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for k, v in enumerate(values):
        at = [s for s in range(len(v)) if rng.random() >= (gaps if k % 3 == 0 else 0)]
        order = rng.permutation(len(at)).tolist()
        out.append((f"E{k:03d}", [at[i] + 1 for i in order], [float(v[at[i]]) for i in order]))
    return spark.createDataFrame([*out, ("none", None, None), ("one", [3], [1.0])], SCHEMA)


def factors(groups, each, width, noise, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, width))
    sign = rng.choice([-1, 1], size=(groups * each, 1))
    return sign * np.repeat(base, each, 0) + noise * rng.normal(size=(groups * each, width))


@pytest.mark.parametrize("gaps", [0.0, 0.2])
@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_same_edges_as_all_pairs(spark, gaps, threshold):
    values = np.concatenate([factors(6, 12, 20, 0.4), np.full((2, 20), 7.0), 1e8 + np.zeros((1, 20)) + np.eye(20)[:1]])
    table = vectors(spark, values, gaps)
    wanted = edges(network.pair_table(network.correlations(table, threshold=threshold, block_rows=16)))
    found, report = pruned.edges(table, threshold=threshold, block_rows=16)
    assert edges(found) == wanted and wanted
    r = report.first()
    assert r.compared <= r.block_pairs and r.with_gaps >= 1


def test_common_factors_let_most_block_pairs_be_skipped(spark):
    table = vectors(spark, factors(12, 40, 30, 0.1))
    found, report = pruned.edges(table, threshold=0.9, block_rows=20)
    assert len(edges(found)) == 12 * 40 * 39 // 2
    assert report.first().skipped_share > 0.7


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_copies_of_a_row_do_not_grow_with_the_blocks(spark, monkeypatch, gaps):
    table = vectors(spark, np.random.default_rng(2).normal(size=(300, 12)), gaps)
    wanted = edges(network.pair_table(network.correlations(table, threshold=0.6)))
    assert edges(pruned.edges(table, threshold=0.6, block_rows=2)[0]) == wanted and wanted

    def counting(*_, **__):
        def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist([{"kind": "pair", "a": "", "b": "", "correlation": 0.0, "pairs": sum(b.num_rows for b in batches), "abs_sum": 0.0, "peers": 0}])

        return kernel

    monkeypatch.setattr(network, "block_kernel", counting)
    sent = pruned.edges(table, threshold=0.6, block_rows=2)[0].agg({"pairs": "sum"}).first()[0]
    # Bands of either kind end with a smaller one.
    assert sent <= (network.BLOCKS + 2) * 302


def test_blocks_of_equal_angles_are_cut(spark):
    placed = spark.range(400).selectExpr("concat('E', id) AS entity", "0 AS pivot", "array(IF(id < 300, 0.5D, id / 1000D)) AS angles")
    sizes = [r["count"] for r in pruned._blocks(placed, 10).groupBy("block").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 40


def test_bands_follow_the_stretches(spark):
    blocks = [("10:0:0", 4), ("2:10:0", 5), ("2:9:1", 3), ("2:9:0", 4), ("gaps:1", 4), ("gaps:0", 4), ("gaps:10", 1)]
    found = pruned._bands(spark.createDataFrame(blocks, "block string, rows bigint"), 8)
    assert [tuple(r) for r in found.orderBy("part").select("block", "band", "bound").collect()] == [
        ("2:9:0", 1, True), ("2:9:1", 1, True), ("2:10:0", 1, True), ("10:0:0", 2, True), ("gaps:0", 3, False), ("gaps:1", 3, False), ("gaps:10", 4, False),
    ]


def test_little_to_compare(spark):
    table = vectors(spark, factors(1, 2, 3, 0.1))
    assert pruned.edges(table, min_pairs=4)[0].collect() == []
    assert pruned.edges(table.limit(0))[0].collect() == []
    with pytest.raises(ValueError):
        pruned.edges(table, threshold=0.0)
