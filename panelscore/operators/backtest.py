"""Episode replay.

``by`` adds key columns (such as a weighting scheme) that every step carries along. Episodes come
from configuration: a driver-side list whose length decides about the broadcast. All joins are
equi-joins on entity or period.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscore.model import Episode, Model, episode_table, local_table
from panelscore.operators import score as scoring
from panelscore.schema import ENTITY, PERIOD
from panelscore.session import pin

SCORE = "risk_score"
DEFAULT_WINDOW, DEFAULT_THRESHOLD = 1, 3.0


def with_overrides(
    episodes: Sequence[Episode], window: int | None = None, threshold: float | None = None
) -> list[Episode]:
    """A call may override window and threshold of every episode."""
    return [
        replace(
            e,
            window=e.window if window is None else int(window),
            threshold=e.threshold if threshold is None else float(threshold),
        )
        for e in episodes
    ]


def _known(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.where(F.col(SCORE).isNotNull()).select(*by, F.upper(ENTITY).alias(ENTITY), PERIOD, SCORE)


def _all_episodes(scores: DataFrame, episodes: Sequence[Episode], by: Sequence[str]) -> DataFrame:
    """The result frame: every episode, once per value of ``by`` (a handful of schemes)."""
    table = episode_table(scores.sparkSession, episodes)
    if not by:
        return table
    # Few values of ``by`` (schemes), few episodes: the episodes unfold in each row instead of being joined to it.
    listed = table.agg(F.collect_list(F.struct(*table.columns)).alias("_all"))
    return scores.select(*by).distinct().crossJoin(listed).select(*by, F.explode("_all").alias("_e")).select(*by, "_e.*")


def replay(scores: DataFrame, episodes: Sequence[Episode], by: Sequence[str] = ()) -> DataFrame:
    """Baseline and event score, peak in the window, verdict, deltas and lead time.

    One equi-join of the few entities concerned, one small array per episode (its own window of
    periods), everything else is a row expression over that array.
    """
    table = episode_table(scores.sparkSession, episodes)
    span = F.col(PERIOD).between(F.least("baseline", "event"), F.col("event") + F.col("window"))
    near = _known(scores, by).join(table.select("episode", ENTITY, "baseline", "event", "window"), ENTITY)
    near = near.where(span | (F.col(PERIOD) == F.col("baseline")))
    packed = near.groupBy(*by, "episode").agg(F.array_sort(F.collect_list(F.struct(PERIOD, SCORE))).alias("_t"))
    out = _all_episodes(scores, episodes, by).join(packed, [*by, "episode"], "left")
    at = "get(filter(_t, x -> x.period = {0}), 0).risk_score"
    out = out.selectExpr(
        "*",
        f"{at.format('baseline')} AS baseline_score",
        f"{at.format('event')} AS event_score",
        # Largest score, on ties the earliest period.
        "array_max(transform(filter(_t, x -> x.period BETWEEN event AND event + window), "
        "x -> named_struct('s', x.risk_score, 'n', -x.period))) AS _peak",
    )
    out = out.selectExpr("*", "_peak.s AS peak_score", "-_peak.n AS peak_period")
    usable = F.col("baseline_score").isNotNull() & F.col("peak_score").isNotNull()
    # An episode that cannot be judged reports no scores at all.
    out = out.select(
        "*",
        usable.alias("_usable"),
        F.when(usable, F.bround(F.col("peak_score") - F.col("baseline_score"), 1)).alias("peak_delta"),
        F.when(usable, F.bround(F.col("event_score") - F.col("baseline_score"), 1)).alias("delta"),
    )
    verdict = (
        F.when(~F.col("_usable"), "inconclusive")
        .when(F.col("peak_delta") >= F.col("threshold"), "flagged")
        .otherwise("missed")
    )
    # The verdict reads the rounded rise, the lead time the exact one.
    first = F.expr(
        "array_min(transform(filter(_t, x -> x.period BETWEEN baseline AND event AND peak_score - x.risk_score >= threshold), "
        "x -> x.period))"
    )
    out = out.withColumn("verdict", verdict)
    return out.select(
        *by,
        "episode",
        ENTITY,
        "label",
        "baseline",
        "event",
        "window",
        "threshold",
        *[F.when(F.col("_usable"), F.col(c)).alias(c) for c in ("baseline_score", "event_score", "peak_score", "peak_period")],
        "delta",
        "peak_delta",
        "verdict",
        F.when(F.col("verdict") == "flagged", F.col("event") - first).alias("lead_time"),
    )


def peer_drift(scores: DataFrame, episodes: Sequence[Episode], by: Sequence[str] = ()) -> DataFrame:
    """Share of the other entities that rose as much over the same window.

    Every episode names its few periods, so scores meet episodes by equality on the period. The
    rise of an entity is two partially aggregated maxima.
    """
    roles = [
        (n, e.entity.upper(), role, p, float(e.threshold))
        for n, e in enumerate(episodes)
        for role, periods in (("base", [e.baseline]), ("peak", range(e.event, e.event + e.window + 1)))
        for p in periods
    ]
    wanted = local_table(
        scores.sparkSession, roles, "episode int, own string, role string, period int, threshold double"
    )
    met = _known(scores, by).join(wanted, PERIOD).where(F.col(ENTITY) != F.col("own"))
    rises = met.groupBy(*by, "episode", ENTITY, "threshold").agg(
        F.max(F.when(F.col("role") == "base", F.col(SCORE))).alias("_base"),
        F.max(F.when(F.col("role") == "peak", F.col(SCORE))).alias("_peak"),
    )
    comparable = rises.where(F.col("_base").isNotNull() & F.col("_peak").isNotNull())
    rose = F.col("_peak") - F.col("_base") >= F.col("threshold")
    return comparable.groupBy(*by, "episode").agg(
        F.count_if(rose).alias("risen"),
        F.count(F.lit(1)).alias("compared"),
        F.bround(F.count_if(rose) / F.count(F.lit(1)), 3).alias("peer_drift"),
    )


def dominant_component(
    replayed: DataFrame, components: DataFrame, name: str, value: str, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Component with the largest rise from baseline to peak period, the first listed on ties."""
    judged = replayed.where(F.col("verdict") != "inconclusive").select(*by, "episode", ENTITY, "baseline", "peak_period")
    near = components.select(*by, F.upper(ENTITY).alias(ENTITY), PERIOD, name, value).join(
        # One row per episode and scheme.
        judged,
        [*by, ENTITY],
    )
    near = near.where((F.col(PERIOD) == F.col("baseline")) | (F.col(PERIOD) == F.col("peak_period")))
    both = near.groupBy(*by, "episode", name).agg(
        F.max(F.when(F.col(PERIOD) == F.col("peak_period"), F.col(value))).alias("_peak"),
        F.max(F.when(F.col(PERIOD) == F.col("baseline"), F.col(value))).alias("_base"),
    )
    rise = F.col("_peak") - F.col("_base")
    position = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name))
    return both.where(rise.isNotNull()).groupBy(*by, "episode").agg(F.max_by(name, F.struct(rise, -position)).alias(f"dominant_{name}"))


def run_backtest(
    scores: DataFrame, episodes: Sequence[Episode], model: Model | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Full episode result. ``scores`` should be a table; with a model it needs the pillar columns."""
    result = replay(scores, episodes, by)
    drift = peer_drift(scores, episodes, by).select(*by, "episode", "peer_drift")
    joined = result.join(drift, [*by, "episode"], "left")
    if model is not None:
        pillars = scoring.pillar_scores(scores, model, keep=[*by, ENTITY, PERIOD])
        found = dominant_component(result, pillars, "pillar", "pillar_score", model.active_pillars, by)
        joined = joined.join(found, [*by, "episode"], "left")
        if model.sectors:
            sectors = scoring.sector_scores(scores, model, keep=[*by, ENTITY, PERIOD])
            found = dominant_component(result, sectors, "sector", "sector_score", list(model.sectors), by)
            joined = joined.join(found, [*by, "episode"], "left")
    judged = F.col("verdict") != "inconclusive"
    return joined.withColumn("peer_drift", F.when(judged, F.col("peer_drift")))


def summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, detection rate, median rise, most systemic episode. One row per ``by``, of a few episodes."""
    flagged, missed = F.count_if(F.col("verdict") == "flagged"), F.count_if(F.col("verdict") == "missed")
    drift = F.col("peer_drift").isNotNull()
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes_total"),
        flagged.alias("flagged"),
        missed.alias("missed"),
        F.count_if(F.col("verdict") == "inconclusive").alias("inconclusive"),
        F.bround(F.try_divide(flagged, flagged + missed), 3).alias("detection_rate"),
        F.bround(F.median("peak_delta"), 1).alias("median_peak_delta"),
        F.max_by("label", F.when(drift, F.struct(F.col("peer_drift"), -F.col("episode")))).alias("systemic_episode"),
        F.max("peer_drift").alias("highest_peer_drift"),
    )


def _excluded(episodes: Sequence[Episode]) -> list[tuple]:
    spans = {
        (e.entity.upper(), p)
        for e in episodes
        for p in (e.baseline, *range(e.event - e.window, e.event + e.window + 1))
    }
    return sorted(spans)


def ordinary_windows(
    scores: DataFrame,
    episodes: Sequence[Episode] = (),
    window: int = DEFAULT_WINDOW,
    threshold: float = DEFAULT_THRESHOLD,
    by: Sequence[str] = (),
) -> DataFrame:
    """Alarmed and quiet windows outside the known episodes, one row per ``by``; no row when none.

    The look-ahead is one range frame per entity; the exclusion is an anti-join with a short list.
    """
    rises = window_rises(scores, window, by)
    if episodes:
        known = local_table(scores.sparkSession, _excluded(episodes), "entity string, period int")
        rises = rises.join(known, [ENTITY, PERIOD], "left_anti")
    return tally_windows(rises, threshold, by)


def window_rises(scores: DataFrame, window: int, by: Sequence[str] = ()) -> DataFrame:
    """The rise from every scored row to the peak of its window."""
    ahead = Window.partitionBy(*by, ENTITY).orderBy(PERIOD).rangeBetween(0, int(window))
    return _known(scores, by).select(*by, ENTITY, PERIOD, (F.max(SCORE).over(ahead) - F.col(SCORE)).alias("_rise"))


def tally_windows(rises: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    alarmed = F.count_if(F.col("_rise") >= float(threshold))
    out = rises.groupBy(*by).agg(alarmed.alias("alarmed"), (F.count(F.lit(1)) - alarmed).alias("quiet"))
    return out.where(F.col("alarmed") + F.col("quiet") > 0)


def false_alarm_rate(tally: DataFrame) -> DataFrame:
    """B9."""
    rate = F.bround(F.try_divide(F.col("alarmed"), F.col("alarmed") + F.col("quiet")), 3)
    return tally.withColumn("false_alarm_rate", rate)


def metrics(results: DataFrame, tally: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion metrics. Without ordinary windows false positives and what needs them are null."""
    counts = results.groupBy(*by).agg(
        F.count_if(F.col("verdict") == "flagged").alias("true_positives"),
        F.count_if(F.col("verdict") == "missed").alias("false_negatives"),
        F.bround(F.median("lead_time"), 1).alias("median_lead_time"),
    )
    negatives = tally.select(*by, F.col("alarmed").alias("false_positives"), F.col("quiet").alias("true_negatives"))
    # One row per value of ``by`` on both sides; without ``by`` one row, and none of ordinary windows if there are none.
    joined = counts.join(negatives, list(by) if by else F.lit(True), "left")
    tp, fn, fp, tn = (F.col(c) for c in ("true_positives", "false_negatives", "false_positives", "true_negatives"))

    def rate(part: Column, whole: Column) -> Column:
        return F.bround(F.try_divide(part, F.when(whole > 0, whole)), 3)

    return joined.select(
        *by,
        tp,
        fn,
        fp,
        tn,
        rate(tp, tp + fp).alias("precision"),
        rate(tp, tp + fn).alias("recall"),
        rate(fp, fp + tn).alias("false_positive_rate"),
        rate(fn, tp + fn).alias("false_negative_rate"),
        rate(tp + fp, tp + fn + fp + tn).alias("warning_frequency"),
        rate(tp, tp + fn).alias("detection_rate"),
        "median_lead_time",
    )


def compare_weightings(z: DataFrame, model: Model, episodes: Sequence[Episode]) -> DataFrame:
    """Configured against equal weights over the same episodes; one scoring pass feeds both."""
    scores = pin(scoring.scheme_scores(z, model))
    by = ["scheme"]
    results = run_backtest(scores, episodes, None, by)
    tally = ordinary_windows(scores, episodes, by=by)
    joined = summary(results, by).join(metrics(results, tally, by).drop("detection_rate"), by)
    return joined
