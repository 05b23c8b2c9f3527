"""Deterministic panels for tests and scale runs, generated by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.defaults import DEFAULT_DERIVATIONS, DEFAULT_MODEL
from panelscore.model import Model
from panelscore.operators.derive import Derivation, derive_columns
from panelscore.schema import ENTITY, PEER_GROUP, PERIOD


def synthetic_panel(
    spark: SparkSession,
    entities: int = 23,
    start: int = 1990,
    end: int = 2025,
    groups: int = 2,
    partitions: int | None = None,
    model: Model = DEFAULT_MODEL,
    rules: Sequence[Derivation] = DEFAULT_DERIVATIONS,
    seed: int = 11,
) -> DataFrame:
    """Wide panel of ``entities`` x (start..end) with the series of ``model`` and whatever ``rules`` need and derive.

    Every base series is a level of its entity plus a yearly move, both read off a hash of seed, series, entity and year, so
    a cell is the same whatever else is generated. All values are positive.
    """
    derived = {r.code for r in rules}
    base = sorted(({*model.codes} | {r.base for r in rules} | {r.other for r in rules if r.other}) - derived)
    ids = spark.range(int(entities)) if partitions is None else spark.range(0, int(entities), 1, partitions)
    grid = ids.select("id", F.explode(F.sequence(F.lit(int(start)), F.lit(int(end)))).alias(PERIOD))

    def draw(code: str, *parts: str):
        """A number from 0 to 1."""
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(code), *parts), F.lit(10_007)) / 10_006.0

    series = [F.round(10.0 + 80.0 * draw(c, "id") + 9.0 * draw(c, "id", PERIOD), 3).alias(c) for c in base]
    panel = grid.select(
        F.format_string("E%07d", F.col("id")).alias(ENTITY),
        F.concat(F.lit("G"), (F.col("id") % groups).cast("string")).alias(PEER_GROUP),
        F.col(PERIOD).cast("int").alias(PERIOD),
        *series,
    )
    return derive_columns(panel, rules)
