"""Ranks, medians and positions that never bring one large group into one task.

A rank window over a period (or over nothing at all) would sort every entity of that period in a
single task. Here ties are collapsed by a partially aggregated ``groupBy``, the distinct values are
range-partitioned, and only two small windows remain: one over the values of a chunk and one over the
chunks of a group, which are at most as many as shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscore.session import pin


def rank_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): how many rows are smaller, equal, and in the group.

    The distinct values are dealt out in order of (keys, value), so neither a large group nor a narrow or wide range of
    values decides who gets how much. Counts run inside each chunk of a group, and the sums of the chunks before it are
    added: one row per group and chunk. The chunked table is pinned, since the chunk borders must not move between its uses.
    """
    keys = list(keys)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    chunked = pin(distinct.repartitionByRange(*keys, value).withColumn("_chunk", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum("n_equal").alias("_n"))
    totals = totals.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_chunk").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"),
        F.sum("_n").over(group).alias("n_total"),
    )
    same = F.col("_chunk") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    counted = chunked.withColumn("_ahead", F.coalesce(F.sum("n_equal").over(within), F.lit(0)))
    return counted.join(totals, same).select(*keys, value, (F.col("_below") + F.col("_ahead")).alias("n_less"), "n_equal", "n_total")


def order_statistic(position: Column, value: str) -> Column:
    """Aggregate over a ``rank_table`` group: the value at 1-based ``position``."""
    here = (F.col("n_less") < position) & (position <= F.col("n_less") + F.col("n_equal"))
    return F.max(F.when(here, F.col(value)))


def median_table(table: DataFrame, keys: Sequence[str], value: str, alias: str = "median") -> DataFrame:
    """Exact median per group from a ``rank_table``."""
    low = F.floor((F.col("n_total") + 1) / 2)
    high = F.ceil((F.col("n_total") + 1) / 2)
    out = table.groupBy(*keys) if keys else table.groupBy()
    return out.agg(
        ((order_statistic(low, value) + order_statistic(high, value)) / 2.0).alias(alias),
        F.max("n_total").alias("n_total"),
    )


def global_index(df: DataFrame, order: Sequence[str], alias: str = "index") -> DataFrame:
    """0-based position in a total order, without a single-task window.

    Range-partitioned sort, pinned, then the sizes of the sorted chunks (one row per partition)
    give every chunk its offset.
    """
    ordered = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = ordered.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    # One row per shuffle partition: bounded by the cluster's own setting, not by the data.
    return (
        ordered.join(F.broadcast(offsets), "_chunk")
        .withColumn(alias, F.col("_offset") + F.col("_row"))
        .drop("_chunk", "_row", "_offset")
    )
