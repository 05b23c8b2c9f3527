"""Hash trees: the same nodes from any order and in parts, and the drifted keys against a plain comparison."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscore.operators import hashtree

SCHEMA = "k long, day string, v double, note string"


def table(seed=1, n=2000):
    rng = random.Random(seed)
    return [(k if k % 50 else None, f"d{rng.randrange(5)}" if k % 31 else None, rng.choice([None, rng.random()]), "x") for k in range(n)]


def plain(old, new):
    held = [{}, {}]
    for side, data in zip(held, (old, new)):
        for r in data:
            side.setdefault((r[1] or "null", r[0]), []).append(r)
    out = set()
    for key in held[0].keys() | held[1].keys():
        a, b = (sorted(side.get(key, []), key=str) for side in held)
        if a != b:
            out.add((*key, "missing" if not b else "new" if not a else "changed"))
    return out


def located(spark, old, new, depth=2):
    frames = [spark.createDataFrame(x, SCHEMA) for x in (old, new)]
    trees = [hashtree.tree(hashtree.leaves(f, ["k"], F.col("day"), 8, depth), 8, depth) for f in frames]
    found = hashtree.differences(*trees, 8, depth)
    return found, {tuple(r) for r in hashtree.drifted_rows(*frames, found, ["k"], F.col("day"), 8, depth).select("partition", "k", "status").collect()}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_drifted_keys(spark, depth):
    old = table()
    new = [r if k % 211 else (r[0], r[1], -1.0, r[3]) for k, r in enumerate(old) if k % 307] + [(10**6 + k, "d9", 1.0, "y") for k in range(3)] + [old[5]]
    random.Random(2).shuffle(new)
    assert located(spark, old, new, depth)[1] == plain(old, new) != set()


def test_equal_tables_in_any_order_and_in_parts(spark):
    data = table()
    found, drifted = located(spark, data, data[::-1])
    assert found.collect() == [] and drifted == set()
    whole, one, two = (hashtree.leaves(spark.createDataFrame(x, SCHEMA), ["k"], F.col("day")) for x in (data, data[::3], [r for k, r in enumerate(data) if k % 3]))
    assert rows(hashtree.merge_leaves(one, two), "partition", "branch", "rows", "hash") == rows(whole, "partition", "branch", "rows", "hash")
    assert hashtree.tree(whole).where("level = 0").select("rows").collect() == [(2000,)]


def test_one_changed_row_is_one_path(spark):
    old = table()
    new = [*old[:77], (*old[77][:2], 5.0, "z"), *old[78:]]
    found, drifted = located(spark, old, new)
    assert [r.level for r in found.orderBy("level").collect()] == [0, 1, 2, 3]
    assert drifted == {(old[77][1] or "null", old[77][0], "changed")}
    leaf = found.where("level = 3").first()
    assert leaf.old_rows == leaf.new_rows < 60


def test_empty_tables(spark):
    assert located(spark, [], [])[1] == set()
    assert located(spark, [], [(1, "a", 1.0, "x")])[1] == {("a", 1, "new")}
