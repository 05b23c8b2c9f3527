"""Episode replay with the episodes as a table (B1-B5, B8): any number of them, on any entities.

Windows meet scores by bins of periods: an episode is listed in every bin that its window touches, a score in its own, and an
exact condition follows the equi-join. So an entity with a great many episodes or periods never meets all its rows with all
its episodes. Episodes that share a window share the work of the peer drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscore.operators import backtest
from panelscore.operators.backtest import DEFAULT_THRESHOLD, DEFAULT_WINDOW, SCORE
from panelscore.schema import ENTITY, PERIOD, require
from panelscore.session import pin

#: Periods in a bin: about the length of a usual window.
BIN = 8
COLUMNS = ("episode", ENTITY, "baseline", "event", "window", "threshold")


def episode_rows(episodes: DataFrame) -> DataFrame:
    """The columns of an episode with their defaults; a negative window holds no period."""
    require(episodes, "episode", ENTITY, "baseline", "event")
    window = F.col("window") if "window" in episodes.columns else F.lit(None)
    threshold = F.col("threshold") if "threshold" in episodes.columns else F.lit(None)
    return episodes.select(
        "episode",
        F.upper(ENTITY).alias(ENTITY),
        F.col("baseline").cast("int").alias("baseline"),
        F.col("event").cast("int").alias("event"),
        F.coalesce(window.cast("int"), F.lit(DEFAULT_WINDOW)).alias("window"),
        F.coalesce(threshold.cast("double"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
    )


def _known(scores: DataFrame) -> DataFrame:
    return scores.where(F.col(SCORE).isNotNull()).select(F.upper(ENTITY).alias(ENTITY), PERIOD, SCORE)


def _bin(period: Column, width: int) -> Column:
    return F.floor(period / F.lit(width)).cast("int")


def interval_join(spans: DataFrame, rows: DataFrame, low: str, high: str, on: tuple[str, ...] = (), width: int = BIN) -> DataFrame:
    """Rows whose period lies in [low, high] of a span with equal ``on``; a span with low > high or a null end meets none."""
    some = spans.where(F.col(low) <= F.col(high))
    listed = some.withColumn("_bin", F.explode(F.sequence(_bin(F.col(low), width), _bin(F.col(high), width))))
    placed = rows.withColumn("_bin", _bin(F.col(PERIOD), width))
    met = listed.join(placed, ["_bin", *on])
    return met.where(F.col(PERIOD).between(F.col(low), F.col(high))).drop("_bin")


def _at(episodes: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    scores = known.select(ENTITY, F.col(PERIOD).alias(column), F.col(SCORE).alias(name))
    return episodes.join(scores, [ENTITY, column], "left")


def replay(scores: DataFrame, episodes: DataFrame, width: int = BIN) -> DataFrame:
    """B1-B4 for every row of ``episodes`` (episode, entity, baseline, event[, window, threshold]); ``episode`` is a key.

    Scores at baseline and event, the peak in [event, event + window] (on ties the earliest period), verdict, deltas rounded to
    one decimal and lead time; an episode that cannot be judged is inconclusive and has no scores.
    """
    known = _known(scores)
    table = episode_rows(episodes)
    judged = _at(_at(table, known, "baseline", "baseline_score"), known, "event", "event_score")
    spans = table.select("episode", ENTITY, "event", (F.col("event") + F.col("window")).alias("_until"))
    peaks = interval_join(spans, known, "event", "_until", (ENTITY,), width).groupBy("episode")
    peaks = peaks.agg(F.max(F.struct(F.col(SCORE).alias("s"), (-F.col(PERIOD)).alias("n"))).alias("_peak"))
    # Read twice, by the lead time and at the end.
    judged = pin(judged.join(peaks, "episode", "left").select("*", F.col("_peak.s").alias("peak_score"), (-F.col("_peak.n")).alias("peak_period")).drop("_peak"))
    usable = F.col("baseline_score").isNotNull() & F.col("peak_score").isNotNull()
    rise = F.bround(F.col("peak_score") - F.col("baseline_score"), 1)
    flagged = usable & (rise >= F.col("threshold"))
    early = interval_join(judged.where(flagged).select("episode", ENTITY, "baseline", "event", "peak_score", "threshold"), known, "baseline", "event", (ENTITY,), width)
    first = early.where(F.col("peak_score") - F.col(SCORE) >= F.col("threshold")).groupBy("episode").agg(F.min(PERIOD).alias("_first"))
    verdict = F.when(~usable, "inconclusive").when(flagged, "flagged").otherwise("missed")
    return judged.join(first, "episode", "left").select(
        *COLUMNS,
        *[F.when(usable, F.col(c)).alias(c) for c in ("baseline_score", "event_score", "peak_score", "peak_period")],
        F.when(usable, F.bround(F.col("event_score") - F.col("baseline_score"), 1)).alias("delta"),
        F.when(usable, rise).alias("peak_delta"),
        verdict.alias("verdict"),
        (F.col("event") - F.col("_first")).alias("lead_time"),
    )


def peer_drift(scores: DataFrame, replayed: DataFrame, width: int = BIN) -> DataFrame:
    """B5 for a result of ``replay``: (episode, risen, compared, peer_drift), where another entity can be compared.

    The rises of all entities are counted once for each distinct window and threshold; an episode then takes its own entity,
    which its row describes, out of the counts. Work grows with entities times distinct windows, not episodes.
    """
    known = _known(scores)
    windows = pin(replayed.select("baseline", "event", "window").distinct())
    spans = windows.select("event", "window", (F.col("event") + F.col("window")).alias("_until")).distinct()
    peaks = interval_join(spans, known, "event", "_until", (), width).groupBy(ENTITY, "event", "window").agg(F.max(SCORE).alias("_peak"))
    bases = windows.join(known.select(ENTITY, F.col(PERIOD).alias("baseline"), F.col(SCORE).alias("_base")), "baseline")
    rises = bases.join(peaks, [ENTITY, "event", "window"]).select("baseline", "event", "window", (F.col("_peak") - F.col("_base")).alias("_rise"))
    asked = replayed.select("baseline", "event", "window", "threshold").distinct()
    # Equal rises collapse before thresholds meet them.
    rises = rises.groupBy("baseline", "event", "window", "_rise").agg(F.count(F.lit(1)).alias("_n"))
    counted = rises.join(asked, ["baseline", "event", "window"]).groupBy("baseline", "event", "window", "threshold").agg(
        F.sum(F.when(F.col("_rise") >= F.col("threshold"), F.col("_n")).otherwise(0)).alias("_risen"), F.sum("_n").alias("_compared")
    )
    own = F.col("verdict") != "inconclusive"
    own_rose = own & (F.col("peak_score") - F.col("baseline_score") >= F.col("threshold"))
    joined = replayed.join(counted, ["baseline", "event", "window", "threshold"]).select(
        "episode", (F.col("_risen") - own_rose.cast("long")).alias("risen"), (F.col("_compared") - own.cast("long")).alias("compared")
    )
    return joined.where("compared > 0").select("*", F.bround(F.col("risen") / F.col("compared"), 3).alias("peer_drift"))


def ordinary_windows(scores: DataFrame, episodes: DataFrame, window: int = DEFAULT_WINDOW, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """B8 with the exclusions from a table: baselines, and window periods to either side of an event, of the same entity."""
    table = episode_rows(episodes)
    around = F.when(F.col("window") >= 0, F.sequence(F.col("event") - F.col("window"), F.col("event") + F.col("window")))
    spans = F.concat(F.array("baseline"), F.coalesce(around, F.expr("CAST(array() AS array<int>)")))
    excluded = table.select(ENTITY, F.explode(spans).alias(PERIOD)).where(F.col(PERIOD).isNotNull()).distinct()
    return backtest.tally_windows(backtest.window_rises(scores, window).join(excluded, [ENTITY, PERIOD], "left_anti"), threshold)
