"""Time-series derivations.

Every rule is row-based: it looks at the observed rows of a series in period order and does not
fill gaps. All rules of a panel share one window over (entity, indicator); a series has at most one
row per period, so a window partition is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscore.functions.scalar import col, half_even, pct_change
from panelscore.schema import ENTITY, FLAG, INDICATOR, LONG_COLUMNS, PERIOD, SOURCE, VALUE

def series():
    return Window.partitionBy(ENTITY, INDICATOR).orderBy(PERIOD)


@dataclass(frozen=True)
class Derivation:
    """``rule`` applied to ``base`` gives ``code``; ``other`` is the denominator of a ratio."""

    code: str
    base: str
    rule: str
    other: str | None = None
    source: str = "derived"
    digits: int | None = 3
    only_entity: str | None = None


def yoy(value: Column) -> Column:
    """% change against the previous row with a value."""
    return pct_change(value, F.last(value, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1)))


def diff_bps(value: Column) -> Column:
    """D3: first difference in hundredths."""
    return (value - F.lag(value, 1).over(series())) * 100.0


def trailing_gap(value: Column) -> Column:
    """Deviation from the mean of the last three rows including this one, two at least."""
    last3 = series().rowsBetween(-2, 0)
    return F.when(F.count(value).over(last3) >= 2, value - F.avg(value).over(last3))


def lag3(value: Column) -> Column:
    """Change over three rows."""
    return value - F.lag(value, 3).over(series())


def centered_deviation(value: Column) -> Column:
    """% deviation from the centred five-row mean, three observations at least, mean > 0."""
    around = series().rowsBetween(-2, 2)
    trend = F.when(F.count(value).over(around) >= 3, F.avg(value).over(around))
    return F.when(trend > 0, pct_change(value, trend))


# D2 is the plain level under another name.
RULES = {
    "level": lambda value: value,
    "yoy": yoy,
    "diff_bps": diff_bps,
    "trailing_gap": trailing_gap,
    "lag3": lag3,
    "centered": centered_deviation,
}
# Rules that emit no row where the result is undefined.
SPARSE = {"centered", "ratio"}


def derive(panel: DataFrame, rules: Sequence[Derivation]) -> DataFrame:
    """All derived rows of a long panel with unique keys, in one pass over the series.

    Window rules share one exchange and sort; every base row then unfolds into the derived rows
    it feeds. Ratios (D7) pair two series by a partially aggregated ``groupBy`` instead of a
    self-join.
    """
    windowed = [r for r in rules if r.rule != "ratio"]
    ratios = [r for r in rules if r.rule == "ratio"]
    parts = []
    if windowed:
        used = sorted({r.rule for r in windowed})
        rows = panel.where(F.col(INDICATOR).isin(sorted({r.base for r in windowed})))
        rows = rows.select(ENTITY, INDICATOR, PERIOD, VALUE)
        rows = rows.select("*", *[RULES[u](F.col(VALUE)).alias(f"_{u}") for u in used])
        emitted = F.filter(
            F.array(*[_emit(r) for r in windowed]),
            lambda x: x.isNotNull(),
        )
        parts.append(
            rows.select(ENTITY, PERIOD, F.explode(emitted).alias("_d")).select(
                ENTITY, F.col("_d.code").alias(INDICATOR), PERIOD, F.col("_d.value").alias(VALUE), F.col("_d.source")
            )
        )
    if ratios:
        needed = sorted({r.base for r in ratios} | {r.other for r in ratios})
        cells = [F.max(F.when(F.col(INDICATOR) == c, F.col(VALUE))).alias(f"_v{n}") for n, c in enumerate(needed)]
        pairs = panel.where(F.col(INDICATOR).isin(needed)).groupBy(ENTITY, PERIOD).agg(*cells)
        at = {c: F.col(f"_v{n}") for n, c in enumerate(needed)}
        emitted = F.filter(
            F.array(
                *[
                    F.when(
                        at[r.base].isNotNull() & (at[r.other] > 0),
                        F.struct(
                            F.lit(r.code).alias("code"),
                            half_even(at[r.base] / at[r.other], r.digits).alias("value"),
                            F.lit(r.source).alias("source"),
                        ),
                    )
                    for r in ratios
                ]
            ),
            lambda x: x.isNotNull(),
        )
        parts.append(
            pairs.select(ENTITY, PERIOD, F.explode(emitted).alias("_d")).select(
                ENTITY, F.col("_d.code").alias(INDICATOR), PERIOD, F.col("_d.value").alias(VALUE), F.col("_d.source")
            )
        )
    if not parts:
        return panel.where(F.lit(False)).select(ENTITY, INDICATOR, PERIOD, F.lit(None).cast("double").alias(VALUE), F.lit("").alias(SOURCE), F.lit("ok").alias(FLAG)).select(*LONG_COLUMNS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn(FLAG, F.lit("ok")).withColumnRenamed("source", SOURCE).select(*LONG_COLUMNS)


def _emit(rule: Derivation) -> Column:
    value = half_even(F.col(f"_{rule.rule}"), rule.digits)
    when = F.col(INDICATOR) == rule.base
    if rule.only_entity is not None:
        when = when & (F.col(ENTITY) == rule.only_entity.upper())
    if rule.rule in SPARSE:
        when = when & value.isNotNull()
    if rule.rule == "yoy":
        # A row without a value is no observation.
        when = when & F.col(VALUE).isNotNull()
    return F.when(
        when, F.struct(F.lit(rule.code).alias("code"), value.alias("value"), F.lit(rule.source).alias("source"))
    )


def derive_columns(wide: DataFrame, rules: Sequence[Derivation]) -> DataFrame:
    """The same rules on a wide panel, as columns.

    Every series steps over its own gaps (``lag`` and ``lead`` ignoring nulls), so nothing is
    reshaped: all series share one exchange by entity and one sort. Ratios are row expressions.
    A defined derived cell wins over an existing one; an undefined one leaves it (P6).
    """
    over = "OVER (PARTITION BY entity ORDER BY period)"
    steps: dict[str, dict[int, Column]] = {}
    needs = {"yoy": (-1,), "diff_bps": (-1,), "trailing_gap": (-2, -1), "lag3": (-3,), "centered": (-2, -1, 1, 2)}
    for rule in rules:
        for step in needs.get(rule.rule, ()):
            function = "lag" if step < 0 else "lead"
            at = F.expr(f"{function}(`{rule.base}`, {abs(step)}) IGNORE NULLS {over}")
            steps.setdefault(rule.base, {})[step] = at.alias(f"_{rule.base}_{step}")
    staged = wide.select("*", *[c for found in steps.values() for c in found.values()])

    def moved(rule: Derivation, step: int) -> Column:
        return F.col(f"`_{rule.base}_{step}`")

    def mean(columns: Sequence[Column], least: int) -> Column:
        total, n = F.lit(0.0), F.lit(0)
        for c in columns:
            total, n = total + F.coalesce(c, F.lit(0.0)), n + F.when(c.isNotNull(), 1).otherwise(0)
        return F.when(n >= least, total / n)

    def result(rule: Derivation) -> Column:
        v = col(rule.base)
        if rule.rule == "ratio":
            return F.try_divide(v, F.when(col(rule.other) > 0, col(rule.other)))
        if rule.rule == "level":
            return v
        if rule.rule == "yoy":
            return pct_change(v, moved(rule, -1))
        if rule.rule == "diff_bps":
            return (v - moved(rule, -1)) * 100.0
        if rule.rule == "lag3":
            return v - moved(rule, -3)
        if rule.rule == "trailing_gap":
            return v - mean([moved(rule, -2), moved(rule, -1), v], 2)
        trend = mean([moved(rule, s) for s in (-2, -1)] + [v] + [moved(rule, s) for s in (1, 2)], 3)
        return F.when(v.isNotNull() & (trend > 0), pct_change(v, trend))

    derived = {}
    for rule in rules:
        value = half_even(result(rule), rule.digits)
        if rule.only_entity is not None:
            value = F.when(F.col(ENTITY) == rule.only_entity.upper(), value)
        derived[rule.code] = F.coalesce(value, col(rule.code)) if rule.code in wide.columns else value
    kept = [col(c) for c in wide.columns if c not in derived]
    return staged.select(*kept, *[e.alias(c) for c, e in derived.items()])


def year_end(df: DataFrame, keys: Sequence[str], sub_period: str, value: str, digits: int | None = 4) -> DataFrame:
    """The last sub-period present represents the year; combined before the shuffle."""
    return df.groupBy(*keys).agg(half_even(F.max_by(value, sub_period), digits).alias(VALUE))


def annual_mean(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Mean per calendar year of dated observations."""
    return df.groupBy(*keys, F.year(day).cast("int").alias(PERIOD)).agg(F.avg(value).alias(VALUE))


def global_yoy(annual: DataFrame) -> DataFrame:
    """Yoy of one series without entity (one row per year, bounded by the calendar)."""
    over = Window.partitionBy(F.lit(0)).orderBy(PERIOD)
    levels = annual.where(F.col(VALUE).isNotNull())
    change = pct_change(F.col(VALUE), F.lag(VALUE, 1).over(over))
    return levels.select(PERIOD, change.alias(VALUE)).where(F.col(VALUE).isNotNull())


def latest_deviation(df: DataFrame, value: str) -> DataFrame:
    """Newest non-null deviation per entity and its reading."""
    known = df.where(F.col(value).isNotNull()).groupBy(ENTITY)
    latest = F.col("latest")
    label = (
        F.when(latest > 0, "WEAKER than its 5-year trend")
        .when(latest < 0, "STRONGER than its 5-year trend")
        .otherwise("AT its 5-year trend")
    )
    return known.agg(F.max_by(value, PERIOD).alias("latest"), F.max(PERIOD).alias(PERIOD)).withColumn("label", label)
