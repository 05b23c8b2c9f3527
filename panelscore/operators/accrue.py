"""Summaries that loads add to: coverage as bitmaps (Q1, Q12) and quantile sketches per period.

A load is summarised in one aggregation; summaries of loads are merged without their rows. Cells that come twice count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscore.functions.scalar import nan_to_null
from panelscore.model import local_table
from panelscore.schema import ENTITY, INDICATOR, PERIOD

#: Items a quantile sketch keeps in its largest level, about.
SKETCH_K = 800


def _cell(indicators: Sequence[str], base: int, indicator: Column, period: Column) -> Column:
    """1, 2, ... period by period; the number of a cell stays as it is when later periods arrive."""
    place = F.array_position(F.array(*[F.lit(i) for i in indicators]), indicator)
    early = F.raise_error(F.concat(F.lit(f"a period before {int(base)}: "), period.cast("string"))).cast("long")
    return F.when(period < base, early).otherwise((period.cast("long") - base) * len(indicators) + place)


def coverage_bits(panel: DataFrame, indicators: Sequence[str], base: int) -> DataFrame:
    """(entity, bucket, bits): which (indicator, period) cells an entity has, 32,768 cells to a bitmap.

    ``indicators`` and ``base``, the first period of all, must be the same for all loads. Other indicators are left out, null
    periods as well; a period before the base is an error.
    """
    asked = panel.where(F.col(INDICATOR).isin(list(indicators)) & F.col(PERIOD).isNotNull() & F.col(ENTITY).isNotNull())
    cells = asked.select(F.upper(ENTITY).alias(ENTITY), _cell(indicators, base, F.col(INDICATOR), F.col(PERIOD)).alias("cell"))
    bucket = F.bitmap_bucket_number("cell").alias("bucket")
    return cells.groupBy(ENTITY, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def merge_bits(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy(ENTITY, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def coverage(bits: DataFrame, entities: DataFrame, indicators: Sequence[str], periods: Sequence[int], base: int, asked: Sequence[str] | None = None) -> DataFrame:
    """Q1 from bitmaps: (entity, expected, observed, coverage_pct) of the ``asked`` indicators (all) over ``periods``."""
    asked = list(indicators if asked is None else asked)
    expected = max(1, len(asked) * len(set(periods)))
    wanted = local_table(bits.sparkSession, [(i, int(p)) for i in asked for p in sorted(set(periods)) if p >= base], f"{INDICATOR} string, {PERIOD} int")
    mask = coverage_bits(wanted.withColumn(ENTITY, F.lit("mask")), indicators, base).select("bucket", F.col("bits").alias("mask"))
    both = bits.join(mask, "bucket").select(ENTITY, "bucket", F.explode(F.array("bits", "mask")).alias("bits"))
    seen = both.groupBy(ENTITY, "bucket").agg(F.bitmap_and_agg("bits").alias("bits")).groupBy(ENTITY).agg(F.sum(F.bitmap_count("bits")).alias("_n"))
    observed = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    return entities.select(F.upper(ENTITY).alias(ENTITY)).distinct().join(seen, ENTITY, "left").select(
        ENTITY, F.lit(expected).cast("bigint").alias("expected"), observed.alias("observed"), (observed * 100.0 / expected).alias("coverage_pct")
    )


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, sketch): a mergeable sketch of the values of each group; nulls and NaN are left out."""
    known = df.select(*keys, nan_to_null(F.col(value)).cast("double").alias("_v")).where("_v IS NOT NULL")
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(int(k))).alias("sketch"))


def merge_sketches(one: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return one.unionByName(other).groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """(keys, n, one column per name in ``shares``): values at about these shares of each group."""
    return sketches.select(
        *keys,
        F.kll_sketch_get_n_double("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias(name) for name, s in shares.items()],
    )


def rank_error(k: int = SKETCH_K) -> float:
    """By how much the rank of a quantile is off at most, as a share of its group, in 99 of 100 cases (the sketch's own law)."""
    return 2.296 / k**0.9723
