"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscore.session import pin, unpin


#: Links from which on the sums are written before they are joined.
SPLIT_LINKS = 1_000_000


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 50, split_links: int = SPLIT_LINKS) -> DataFrame:
    """(node, label): the smallest node of its component, for every node of (a, b); loops and repeats are harmless.

    Each round lets nodes point to the smallest node they see and writes the result as a table, so the lineage stays short.
    Links are at most as many as given, neighbours are never gathered: a hub only takes part in sums and joins. With many
    links the sums are written before they are joined: each join then has an exchange on either side, where a hub can be
    split. With few that would only cost more jobs.
    """
    edges = pin(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _measure(edges)
    for _ in range(rounds):
        written: list[DataFrame] = [edges]

        def held(df: DataFrame, many: bool = state[0] > split_links, written: list = written) -> DataFrame:
            if many:
                written.append(df := pin(df))
            return df

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = held(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # Large star: greater neighbours of a node go to the least that it sees.
        large = held(edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # Small star: a node and its smaller neighbours go to the least of them.
        low = held(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = pin(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        for table in written:
            unpin(table)
        before, state = state, _measure(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
    raise RuntimeError("the components did not settle")
