"""Fingerprints that locate a difference (Q10): table, partition, branches of the key's hash, row.

A node is a count and a sum of row hashes, so a tree is built in one aggregation, merged by adding, and does not depend on
the order of rows. Two trees are compared from the top; each step looks below nodes that differ only, and at the end only
the rows of differing leaves are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscore.functions.scalar import col
from panelscore.session import pin

#: Children of a node, and levels of branches below a partition.
FANOUT, DEPTH = 64, 2
NODE = ("level", "partition", "branch")


def _leaf(keys: Sequence[str], fanout: int, depth: int) -> Column:
    return F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(1)), F.lit(fanout**depth))


def _content(df: DataFrame) -> Column:
    return F.xxhash64(*[col(c) for c in sorted(df.columns)]).cast("decimal(20,0)")


def _part(partition: Column | None) -> Column:
    return F.coalesce((F.lit("all") if partition is None else partition).cast("string"), F.lit("null"))


def leaves(df: DataFrame, keys: Sequence[str], partition: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(partition, branch, rows, hash): the tree's lowest level, combined before the shuffle; add leaves to merge loads."""
    picked = df.select(_part(partition).alias("partition"), _leaf(keys, fanout, depth).alias("branch"), _content(df).alias("h"))
    return picked.groupBy("partition", "branch").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("hash"))


def merge_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """The leaves of two loads of a table taken together, without its rows."""
    both = one.unionByName(other).groupBy("partition", "branch")
    return both.agg(F.sum("rows").alias("rows"), F.sum("hash").cast("decimal(38,0)").alias("hash"))


def tree(leaf_table: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(level, partition, branch, rows, hash): level 0 is the table, 1 a partition, then branches down to the leaves."""
    shifts = [F.struct(F.lit(depth + 1 - k).alias("level"), (F.col("branch") / F.lit(fanout**k)).cast("long").alias("branch")) for k in range(depth)]
    paths = F.array(
        F.struct(F.lit(0).alias("level"), F.lit("").alias("partition"), F.lit(0).cast("long").alias("branch")),
        F.struct(F.lit(1).alias("level"), F.col("partition"), F.lit(0).cast("long").alias("branch")),
        *[F.struct(s["level"].alias("level"), F.col("partition"), s["branch"].alias("branch")) for s in shifts],
    )
    unfolded = leaf_table.select(F.explode(paths).alias("node"), "rows", "hash").select("node.*", "rows", "hash")
    return unfolded.groupBy(*NODE).agg(F.sum("rows").alias("rows"), F.sum("hash").cast("decimal(38,0)").alias("hash"))


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    left = old.select(*NODE, F.col("rows").alias("old_rows"), F.col("hash").alias("_old"))
    right = new.select(*NODE, F.col("rows").alias("new_rows"), F.col("hash").alias("_new"))
    same = F.col("_old").eqNullSafe(F.col("_new")) & F.col("old_rows").eqNullSafe(F.col("new_rows"))
    return left.join(right, list(NODE), "full").where(~same).select(*NODE, "old_rows", "new_rows")


def differences(old: DataFrame, new: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(level, partition, branch, old_rows, new_rows): all nodes that differ, found from the top.

    Trees stored by level are read by level; below a partition only the children of nodes that differ are compared.
    """
    found = _differing(old.where("level = 0"), new.where("level = 0"))
    out = last = pin(found)
    for level in range(1, depth + 2):
        if last.isEmpty():
            return out
        sides = []
        for side in (old, new):
            nodes = side.where(F.col("level") == level)
            if level > 1:
                parents = last.select("partition", F.col("branch").alias("_parent"))
                above = (F.col("branch") / F.lit(fanout)).cast("long") if level > 2 else F.lit(0).cast("long")
                nodes = nodes.withColumn("_parent", above).join(parents, ["partition", "_parent"], "left_semi").drop("_parent")
            sides.append(nodes)
        last = pin(_differing(*sides))
        out = out.unionByName(last)
    return out


def drifted_rows(
    old: DataFrame,
    new: DataFrame,
    found: DataFrame,
    keys: Sequence[str],
    partition: Column | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """(partition, keys, status): keys whose rows are ``missing``, ``new`` or ``changed`` between two frames of equal columns.

    Only rows under a differing leaf are grouped and joined; rows that share a key are taken together. Where the partition is a
    column of a partitioned table, the join on it prunes the files of all other partitions.
    """
    leaf_nodes = found.where(F.col("level") == depth + 1).select("partition", "branch")

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*[col(k) for k in keys], _part(partition).alias("partition"), _leaf(keys, fanout, depth).alias("branch"), _content(df).alias("h"))
        near = rows.join(leaf_nodes, ["partition", "branch"], "left_semi")
        return near.groupBy("partition", *keys).agg(F.count(F.lit(1)).alias(f"_n{name}"), F.sum("h").alias(f"_h{name}"))

    a, b = side(old, "a").alias("a"), side(new, "b").alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("partition", *keys)]
    joined = a.join(b, on, "full").where(~(F.col("_ha").eqNullSafe(F.col("_hb")) & F.col("_na").eqNullSafe(F.col("_nb"))))
    status = F.when(F.col("_nb").isNull(), "missing").when(F.col("_na").isNull(), "new").otherwise("changed")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in ("partition", *keys)], status.alias("status"))
