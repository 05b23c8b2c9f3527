"""Point-in-time reads: what was known of an entity at an instant (P9, T8, S12 over score vintages)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscore.schema import ENTITY, PERIOD, require
from panelscore.session import pin

#: Instants of all keys that a stretch of time holds, about; a key's window sorts those of one stretch.
ROWS_PER_STRETCH = 2_000_000
MATCHED = "matched_at"


def _ticks(df: DataFrame, time: str) -> Column:
    """Instants as whole numbers in their own order."""
    kind = dict(df.dtypes)[time]
    if kind == "date":
        return F.unix_date(time).cast("long")
    if kind == "timestamp":
        return F.unix_micros(time)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()))
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return F.col(time).cast("long")
    raise TypeError(f"{time} is {kind}; an instant is a date, a timestamp or a whole number")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    time: str,
    order: Sequence[str] = (),
    rows_per_stretch: int = ROWS_PER_STRETCH,
) -> DataFrame:
    """Every row of ``left`` with the newest row of ``right`` of equal ``on`` and no later ``time``, nulls where there is none.

    Of right rows at the same instant the greatest by ``order`` counts, then by its other columns. The right instant comes as
    ``matched_at``. Null keys and instants match nothing; rows of ``left`` may repeat.

    Both sides collapse to distinct instants, are put in one order, and the last right row is carried on. Time is cut into
    stretches, so an entity with a third of all rows is sorted in many tasks; a second, small pass over one row per key and
    stretch carries rows into the stretches that follow.
    """
    rest = [c for c in right.columns if c not in (*on, time)]
    if clash := sorted(set(rest) & set(left.columns)):
        raise ValueError(f"both sides have {clash}")
    known = lambda df: df.dropna(subset=[*on, time])
    packed = F.struct(F.col(time).alias(MATCHED), *rest)
    best = known(right).groupBy(*on, time).agg(F.max_by(packed, F.struct(*order, *rest) if rest else F.lit(0)).alias("_r"))
    best = best.select(*on, _ticks(best, time).alias("_t"), "_r")
    asked = known(left).select(*on, time).distinct()
    asked = asked.select(*on, time, _ticks(asked, time).alias("_t"))
    both = best.withColumn("_asks", F.lit(False)).unionByName(asked.drop(time).withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    both = pin(both)
    n, low, high = both.agg(F.count(F.lit(1)), F.min("_t"), F.max("_t")).first()
    parts = max(1, -(-n // int(rows_per_stretch)))
    width = max(1, -(-(high - low + 1) // parts)) if n else 1
    stretched = both.withColumn("_s", F.floor((F.col("_t") - F.lit(low or 0)) / F.lit(width)).cast("long"))
    # A right row at the same instant counts, so it stands first.
    within = Window.partitionBy(*on, "_s").orderBy("_t", "_asks")
    found = stretched.withColumn("_in", F.last("_r", ignorenulls=True).over(within)).where("_asks").select(*on, "_t", "_s", "_in")
    if parts > 1:
        ends = stretched.groupBy(*on, "_s").agg(F.max_by("_r", F.when(~F.col("_asks"), F.col("_t"))).alias("_end"))
        before = Window.partitionBy(*on).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*on, "_s", F.last("_end", ignorenulls=True).over(before).alias("_before"))
        found = found.join(carried, [*on, "_s"], "left").withColumn("_in", F.coalesce("_in", "_before"))
    answers = found.select(*on, "_t", "_in")
    placed = left.withColumn("_t", _ticks(left, time)).join(answers, [*on, "_t"], "left")
    return placed.select(*[F.col(c) for c in left.columns], *[F.col(f"_in.{c}").alias(c) for c in (MATCHED, *rest)])


def known_scores(vintages: DataFrame, questions: DataFrame, by_period: bool = True) -> DataFrame:
    """The score known at ``asked_at``: of the period asked for, or without ``by_period`` of the newest period known.

    ``vintages`` has entity, period, known_at, risk_score and more; a row replaces older ones of its entity and period.
    """
    require(vintages, ENTITY, PERIOD, "known_at", "risk_score")
    table = vintages.withColumn(ENTITY, F.upper(ENTITY)).withColumnRenamed("known_at", "asked_at")
    asked = questions.withColumn(ENTITY, F.upper(ENTITY))
    if by_period:
        return asof_join(asked, table, [ENTITY, PERIOD], "asked_at")
    return asof_join(asked, table, [ENTITY], "asked_at", [PERIOD])
