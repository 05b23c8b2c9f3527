"""Ranking, peers and monitoring.

Input is a score table: entity, period, peer_group, risk_score, risk_band (and data_completeness).
Ranks and medians go through ``functions.ranks``, so a period or peer group of any size is spread
over the cluster. "Previous" comes in two kinds here: the row before (``previous_row``) and the
calendar predecessor p-1 (``calendar_change``); they share one window by entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscore.functions.ranks import median_table, rank_table
from panelscore.functions.scalar import band_order, col
from panelscore.operators import score as scoring
from panelscore.schema import ENTITY, PEER_GROUP, PERIOD

SCORE = "risk_score"


def scored(scores: DataFrame) -> DataFrame:
    return scores.where(F.col(SCORE).isNotNull())


def peer_standing(scores: DataFrame) -> DataFrame:
    """Percentile, share of riskier peers, rank and number of peers (without the entity itself).

    Entities of a group compare within it, the others with the whole panel of that period.
    """
    known = scored(scores).select(ENTITY, PERIOD, PEER_GROUP, SCORE)
    grouped = known.where(F.col(PEER_GROUP).isNotNull())
    single = known.where(F.col(PEER_GROUP).isNull())
    within = grouped.join(rank_table(grouped, [PERIOD, PEER_GROUP], SCORE), [PERIOD, PEER_GROUP, SCORE])
    overall = single.join(rank_table(known, [PERIOD], SCORE), [PERIOD, SCORE])
    n = F.col("n_total") - 1
    at_most = F.col("n_less") + F.col("n_equal") - 1
    riskier = F.col("n_total") - F.col("n_less") - F.col("n_equal")
    some = n > 0

    def share(part: Column) -> Column:
        # Exact halves go to the even neighbour.
        return F.when(some, F.bround(part * 100.0 / n, 0).cast("int"))

    return within.unionByName(overall).select(
        ENTITY,
        PERIOD,
        share(at_most).alias("percentile"),
        share(riskier).alias("riskier_share"),
        F.when(some, riskier + 1).alias("rank"),
        F.when(some, n).otherwise(F.lit(0).cast("bigint")).alias("n"),
        F.coalesce(PEER_GROUP, F.lit("panel")).alias("group_name"),
    )


def panel_rank(scores: DataFrame) -> DataFrame:
    """R2: rank from the riskiest, median and size per period."""
    known = scored(scores).select(ENTITY, PERIOD, SCORE)
    table = rank_table(known, [PERIOD], SCORE)
    medians = median_table(table, [PERIOD], SCORE).select(PERIOD, "median")
    ranked = known.join(table, [PERIOD, SCORE]).join(medians, PERIOD)
    rank = (F.col("n_total") - F.col("n_less") - F.col("n_equal") + 1).alias("rank")
    return ranked.select(ENTITY, PERIOD, SCORE, rank, "median", F.col("n_total").alias("size"))


def top_of_period(scores: DataFrame, k: int = 7, ascending: bool = False) -> DataFrame:
    """The k first of every period; the limit applies before the shuffle (window group limit)."""
    order = F.col(SCORE).asc() if ascending else F.col(SCORE).desc()
    w = Window.partitionBy(PERIOD).orderBy(order, ENTITY)
    return scored(scores).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def newest_periods(scores: DataFrame) -> DataFrame:
    """One row: the two newest scored periods of the panel. Distinct periods are bounded by the calendar."""
    periods = scored(scores).select(PERIOD).distinct()
    ordered = F.sort_array(F.collect_list(PERIOD), asc=False)
    return periods.agg(ordered.alias("_p")).select(F.get("_p", 0).alias("latest"), F.get("_p", 1).alias("prior"))


def previous_row(scores: DataFrame) -> DataFrame:
    """Score, band and period of the scored row before."""
    w = Window.partitionBy(ENTITY).orderBy(PERIOD)
    return scored(scores).select(
        "*",
        F.lag(SCORE, 1).over(w).alias("_score"),
        F.lag("risk_band", 1).over(w).alias("_band"),
        F.lag(PERIOD, 1).over(w).alias("_period"),
    )


def latest_moves(scores: DataFrame) -> DataFrame:
    """R4 base: entities scored in both of the two newest panel periods, with their move."""
    moved = previous_row(scores)
    # One row joined by equality on the period.
    newest = F.broadcast(newest_periods(scores))
    return moved.join(newest, (F.col(PERIOD) == F.col("latest")) & (F.col("_period") == F.col("prior"))).select(
        ENTITY,
        "prior",
        "latest",
        (F.col(SCORE) - F.col("_score")).alias("delta"),
        F.col("_band").alias("prior_band"),
        F.col("risk_band").alias("latest_band"),
    )


def deterioration_watch(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k largest rises and falls between the two newest periods."""
    moves = latest_moves(scores)
    side = F.when(F.col("delta") > 0, "rising").when(F.col("delta") < 0, "falling")
    w = Window.partitionBy("side").orderBy(F.abs("delta").desc(), ENTITY)
    ranked = moves.withColumn("side", side).where(F.col("side").isNotNull())
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select(
        "side", "position", ENTITY, "prior", "latest", "delta"
    )


def band_transitions(scores: DataFrame) -> DataFrame:
    """Entities whose band worsened between the two newest periods."""
    worse = band_order(F.col("latest_band")) > band_order(F.col("prior_band"))
    return latest_moves(scores).where(worse).select(ENTITY, "prior_band", "latest_band")


def calendar_change(scores: DataFrame) -> DataFrame:
    """Every scored slice with its change against p-1, null when p-1 has no score."""
    before = F.when(F.col("_period") == F.col(PERIOD) - 1, F.col("_score"))
    return previous_row(scores).withColumn("previous_score", before).withColumn(
        "change", F.col(SCORE) - F.col("previous_score")
    ).drop("_score", "_band", "_period")


def movement(scores: DataFrame) -> DataFrame:
    """The change with its reading."""
    c = F.col("change")
    reading = F.when(c > 0, "positive").when(c < 0, "negative").otherwise("neutral")
    return calendar_change(scores).select(ENTITY, PERIOD, SCORE, "change", reading.alias("movement"))


def panel_kpis(scores: DataFrame) -> DataFrame:
    """One row per period."""
    changed = calendar_change(scores)
    rise = F.min_by(ENTITY, F.when(F.col("change").isNotNull(), F.struct(-F.col("change"), F.col(ENTITY))))
    fall = F.min_by(ENTITY, F.when(F.col("change").isNotNull(), F.struct(F.col("change"), F.col(ENTITY))))
    facts = changed.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("covered"),
        F.count_if(band_order(F.col("risk_band")) >= 2).alias("elevated_plus"),
        rise.alias("fastest_riser"),
        fall.alias("most_improving"),
    )
    known = scored(scores)
    score_median = median_table(rank_table(known, [PERIOD], SCORE), [PERIOD], SCORE, "median_score").drop("n_total")
    share_median = median_table(
        rank_table(known, [PERIOD], "data_completeness"), [PERIOD], "data_completeness", "median_completeness"
    ).drop("n_total")
    return facts.join(score_median, PERIOD, "left").join(share_median, PERIOD, "left")


def rankings(scores: DataFrame, k: int = 5) -> DataFrame:
    """Highest, fastest up and fastest down per period, k each."""
    changed = calendar_change(scores).select(ENTITY, PERIOD, SCORE, "change")
    entries = F.array(
        F.struct(F.lit("highest").alias("ranking"), (-F.col(SCORE)).alias("order")),
        F.when(F.col("change").isNotNull(), F.struct(F.lit("rising").alias("ranking"), (-F.col("change")).alias("order"))),
        F.when(F.col("change").isNotNull(), F.struct(F.lit("falling").alias("ranking"), F.col("change").alias("order"))),
    )
    listed = changed.select("*", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_e")).select(
        "_e.ranking", "_e.order", ENTITY, PERIOD, SCORE, "change"
    )
    w = Window.partitionBy(PERIOD, "ranking").orderBy("order", ENTITY)
    return listed.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("order")


def riskiest(scores: DataFrame, names: DataFrame, period: int | None = None, k: int = 5) -> DataFrame:
    """The k riskiest of one period (the newest by default) with names.

    The limit runs before the names are joined, so only k rows move.
    """
    known = scored(scores)
    if period is None:
        newest = F.broadcast(scores.agg(F.max(PERIOD).alias(PERIOD)))
        known = known.join(newest, PERIOD)
    else:
        known = known.where(F.col(PERIOD) == int(period))
    top = known.orderBy(F.col(SCORE).desc(), ENTITY).limit(k).select(ENTITY, PERIOD, SCORE, "risk_band")
    return names.join(F.broadcast(top), ENTITY)


def worst_rises(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k largest rises against p-1 over the whole panel."""
    changed = calendar_change(scores).where(F.col("change").isNotNull())
    return changed.select(ENTITY, PERIOD, F.col("change").alias("score_delta")).orderBy(
        F.col("score_delta").desc(), ENTITY, PERIOD
    ).limit(k)


def top_driver_categories(z: DataFrame, model) -> DataFrame:
    """How often each category is the largest driver, per period. The winner is found in the row."""
    first = scoring.top_driver(z, model, [i.category for i in model.indicators])
    return z.groupBy(PERIOD, F.expr(first).alias("category")).agg(F.count(F.lit(1)).alias("times_top_driver"))


def score_matrix(scores: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Entity x period matrix of scores, one column per listed period."""
    cells = [F.max(F.when(F.col(PERIOD) == p, F.col(SCORE))).alias(str(p)) for p in periods]
    return scored(scores).groupBy(ENTITY).agg(*cells)


def scored_periods(scores: DataFrame) -> list[int]:
    """The periods that have a score; as many as the calendar has."""
    return sorted(r[0] for r in scored(scores).select(PERIOD).distinct().collect())


def map_layer(scores: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Every entity in every period (those with a score, unless listed), "No data" where there is no score, and the highlight."""
    from panelscore.functions.scalar import band

    periods = scored_periods(scores) if periods is None else list(periods)
    matrix = score_matrix(scores, periods)
    grid = F.array(*[F.struct(F.lit(int(p)).alias(PERIOD), col(str(p)).alias(SCORE)) for p in periods])
    cells = grid if periods else F.expr(f"CAST(array() AS ARRAY<STRUCT<{PERIOD}: INT, {SCORE}: DOUBLE>>)")
    rows = matrix.select(ENTITY, F.explode(cells).alias("_c")).select(ENTITY, "_c.*")
    label = F.coalesce(band(F.col(SCORE)), F.lit("No data"))
    return rows.withColumn("label", label).withColumn("highlight", F.col("label").isin("High", "Severe"))


def trajectories(scores: DataFrame) -> DataFrame:
    """Ordered (period, score) list per entity; bounded by the calendar."""
    points = F.array_sort(F.collect_list(F.struct(PERIOD, SCORE)))
    return scored(scores).groupBy(ENTITY).agg(points.alias("trajectory"))


def adequacy(panel: DataFrame, ratio: str, floor: float = 1.0) -> DataFrame:
    """A coverage ratio against its floor."""
    return panel.where(col(ratio).isNotNull()).select(
        ENTITY, PERIOD, col(ratio).alias("ratio"), (col(ratio) < floor).alias("below_floor")
    )


def twin_deficit(panel: DataFrame, first: str, second: str) -> DataFrame:
    """Two balances and whether both are negative."""
    both = F.coalesce((col(first) < 0) & (col(second) < 0), F.lit(False))
    return panel.where(col(first).isNotNull() | col(second).isNotNull()).select(
        ENTITY, PERIOD, col(first).alias("first"), col(second).alias("second"), both.alias("twin_deficit")
    )
