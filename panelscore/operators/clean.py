"""Cleaning and reshaping of panels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscore.functions.scalar import col, nan_to_null
from panelscore.model import Model, indicator_table
from panelscore.schema import ENTITY, FLAG, INDICATOR, LONG_COLUMNS, PERIOD, SEQ, SOURCE, VALUE, require


def normalize(df: DataFrame) -> DataFrame:
    """Trim and upper-case ids, coerce numbers, fill absent columns. Bad text becomes null."""
    require(df, ENTITY, INDICATOR, PERIOD, VALUE)
    period = F.col(PERIOD).cast("string")
    return df.select(
        F.upper(F.trim(F.col(ENTITY).cast("string"))).alias(ENTITY),
        F.trim(F.col(INDICATOR).cast("string")).alias(INDICATOR),
        # A year that arrives as "2024.0" is still 2024.
        period.try_cast("double").try_cast("int").alias(PERIOD),
        nan_to_null(F.col(VALUE).try_cast("double")).alias(VALUE),
        (F.col(SOURCE) if SOURCE in df.columns else F.lit("unknown")).alias(SOURCE),
        (F.col(FLAG) if FLAG in df.columns else F.lit("ok")).alias(FLAG),
        (F.col(SEQ) if SEQ in df.columns else F.lit(0).cast("bigint")).alias(SEQ),
    )


def quality_flag(value: Column, low: Column, high: Column) -> Column:
    return (
        F.when(value.isNull(), "missing")
        .when(value < low, "out_of_range")
        .when(value > high, "out_of_range")
        .otherwise("ok")
    )


def flag_quality(df: DataFrame, model: Model) -> DataFrame:
    """Overwrite the flag from the indicator bounds. Values are kept, never dropped."""
    bounds = indicator_table(df.sparkSession, model).select(INDICATOR, "low", "high")
    flag = quality_flag(F.col(VALUE), F.col("low"), F.col("high"))
    return df.join(bounds, INDICATOR, "left").withColumn(FLAG, flag).drop("low", "high")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """P3."""
    return df.dropna(subset=[ENTITY, INDICATOR, PERIOD])


def keep_periods(df: DataFrame, periods: Iterable[int] | None) -> DataFrame:
    """The period policy is a parameter; ``None`` keeps the whole history."""
    if periods is None:
        return df
    wanted = sorted({int(p) for p in periods})
    if not wanted:
        raise ValueError("at least one period must be requested")
    return df.where(F.col(PERIOD).isin(wanted))


def check_period_range(start: int, end: int, allowed: int | None = None) -> tuple[int, int]:
    """P4, request side: order and, when a single period is allowed, exactly that one."""
    start, end = int(start), int(end)
    if start > end:
        raise ValueError(f"start {start} lies after end {end}")
    if allowed is not None and (start, end) != (allowed, allowed):
        raise ValueError(f"only period {allowed} may be requested, got {start}-{end}")
    return start, end


def keep_last(df: DataFrame, keys: Sequence[str] = (ENTITY, INDICATOR, PERIOD), order: str | Column = SEQ) -> DataFrame:
    """P5: the last arrival per key.

    ``max_by`` is combined before the shuffle, so a key with a third of all rows leaves every task as one row; a
    ``row_number`` window would sort all of them in a single task. Its struct buffer makes Spark sort each task's rows by key
    on both sides of the shuffle. Rows without a position come first; equal positions fall to the greatest value and source.
    """
    rest = [c for c in df.columns if c not in keys]
    position = F.col(order) if isinstance(order, str) else order
    position = F.struct(position.isNotNull(), position, *[col(c) for c in (VALUE, SOURCE) if c in rest])
    last = F.max_by(F.struct(*[col(c) for c in rest]), position).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*[col(c) for c in df.columns])


def clean_long(df: DataFrame, model: Model, periods: Iterable[int] | None = None) -> DataFrame:
    """P1-P5 in the order of the canonical cleaning boundary."""
    rows = keep_periods(drop_incomplete(normalize(df)), periods)
    # Flags depend on the surviving row only, so the bounds join runs after the duplicates are gone.
    return flag_quality(keep_last(rows), model).select(*LONG_COLUMNS)


def finalize(base: DataFrame, derived: DataFrame) -> DataFrame:
    """Base plus derived rows; nulls go, a derived row replaces a base row of the same key."""
    ranked = base.withColumn("_rank", F.lit(0)).unionByName(
        derived.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    if SEQ not in ranked.columns:
        ranked = ranked.withColumn(SEQ, F.lit(0).cast("bigint"))
    ranked = (
        ranked.withColumn(VALUE, nan_to_null(F.col(VALUE)))
        .dropna(subset=[PERIOD, VALUE])
        .withColumn(FLAG, F.coalesce(FLAG, F.lit("ok")))
    )
    order = F.struct("_rank", F.coalesce(SEQ, F.lit(0).cast("bigint")))
    return keep_last(ranked, order=order).select(*LONG_COLUMNS)


def to_wide(df: DataFrame, codes: Sequence[str], keys: Sequence[str] = (ENTITY, PERIOD)) -> DataFrame:
    """One column per listed code from a panel with unique keys.

    The list is part of the plan, so no extra job looks for distinct values; one partially
    aggregated ``groupBy``. Keys whose values are all null vanish.
    """
    present = df.where(F.col(VALUE).isNotNull() & F.col(INDICATOR).isin(list(codes)))
    cells = [F.max(F.when(F.col(INDICATOR) == c, F.col(VALUE))).alias(c) for c in codes]
    return present.groupBy(*keys).agg(*cells)


def to_long(df: DataFrame, codes: Sequence[str], keys: Sequence[str] = (ENTITY, PERIOD)) -> DataFrame:
    """One row per cell, nulls included; a narrow step."""
    return df.unpivot(list(keys), [col(c) for c in codes], INDICATOR, VALUE)


def clean_to_wide(df: DataFrame, model: Model, periods: Iterable[int] | None = None) -> DataFrame:
    return to_wide(clean_long(df, model, periods), model.codes)


def slice_rows(df: DataFrame, entity: str | None = None, period: int | None = None) -> DataFrame:
    """Predicates on stored columns; they reach the scan."""
    if entity is not None:
        df = df.where(F.col(ENTITY) == str(entity).upper())
    return df if period is None else df.where(F.col(PERIOD) == int(period))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct entities or periods in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def between_periods(df: DataFrame, start: int, end: int) -> DataFrame:
    """P10: inclusive. Apply after a time window, never before it."""
    return df.where(F.col(PERIOD).between(int(start), int(end)))


def fan_out(series: DataFrame, entities: DataFrame) -> DataFrame:
    """A series without entity (one row per period) given to every entity.

    The series is collapsed to one array first (one entry per period, bounded by the calendar)
    and attached to the entities as the single row it is; the rows then unfold in place.
    """
    others = [c for c in series.columns if c != ENTITY]
    packed = series.agg(F.array_sort(F.collect_list(F.struct(PERIOD, *[c for c in others if c != PERIOD]))).alias("_s"))
    attached = entities.select(ENTITY).distinct().crossJoin(packed)
    return attached.select(ENTITY, F.explode("_s").alias("_r")).select(ENTITY, "_r.*")
