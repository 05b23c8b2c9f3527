"""Ranking and monitoring of nation x year scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.operators import rank
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import nation_scores, nation_z, tidy
from panelscore.session import pin

M = b.NATION_MODEL


def table(spark, sf):
    """Scores as the written table they are in production."""
    return pin(
        nation_scores(spark, sf).select("entity", "period", "peer_group", "risk_score", "risk_band", "data_completeness")
    )


def r1(spark, sf):
    return rank.peer_standing(table(spark, sf))


def r2(spark, sf):
    return tidy(rank.panel_rank(table(spark, sf)))


def r3(spark, sf):
    return tidy(rank.top_of_period(table(spark, sf), 7).select("entity", "period", "risk_score", "position"))


def r4(spark, sf):
    return tidy(rank.deterioration_watch(table(spark, sf)))


def r5(spark, sf):
    return rank.band_transitions(table(spark, sf))


def r6(spark, sf):
    return tidy(
        rank.calendar_change(table(spark, sf)).select("entity", "period", "risk_score", "previous_score", "change")
    )


def r7(spark, sf):
    return tidy(rank.panel_kpis(table(spark, sf)))


def r8(spark, sf):
    return tidy(rank.rankings(table(spark, sf)))


def r9(spark, sf):
    names = b.nation_dimension(spark, sf).select("entity", "region")
    return tidy(rank.riskiest(table(spark, sf), names))


def r10(spark, sf):
    return tidy(rank.worst_rises(table(spark, sf)))


def r11(spark, sf):
    return rank.top_driver_categories(nation_z(spark, sf), M)


def r12(spark, sf):
    """The matrix over all scored years, one row per cell so that any number of years compares."""
    scores = table(spark, sf)
    years = rank.scored_periods(scores)
    cells = rank.score_matrix(scores, years).unpivot("entity", [str(y) for y in years], "period", "risk_score")
    return tidy(cells.withColumn("period", F.col("period").cast("int")))


def r13(spark, sf):
    return tidy(rank.map_layer(table(spark, sf)))


def r14(spark, sf):
    t = rank.trajectories(table(spark, sf))
    text = F.concat_ws(";", F.transform("trajectory", lambda x: F.format_string("%d:%.4f", x["period"], x["risk_score"])))
    return t.select("entity", text.alias("trajectory"))


def r15(spark, sf):
    return tidy(rank.movement(table(spark, sf)))


def r16(spark, sf):
    panel = b.nation_year(spark, sf)
    ratio = rank.adequacy(panel, "LINES_PER_ORDER", 4.0)
    twins = rank.twin_deficit(panel, "ORDER_COUNT_GAP", "RETURN_SHARE_3Y")
    return tidy(ratio.join(twins, ["entity", "period"], "full"))


QUERIES = {
    "r1_peer_standing": r1,
    "r2_panel_rank": r2,
    "r3_peer_list": r3,
    "r4_watch": r4,
    "r5_transitions": r5,
    "r6_change": r6,
    "r7_kpis": r7,
    "r8_rankings": r8,
    "r9_top_n": r9,
    "r10_yoy_worst": r10,
    "r11_driver_category": r11,
    "r12_matrix": r12,
    "r13_map_layer": r13,
    "r14_trajectory": r14,
    "r15_movement": r15,
    "r16_flags": r16,
}

GRID = """(SELECT DISTINCT entity FROM scores WHERE risk_score IS NOT NULL)
        CROSS JOIN (SELECT DISTINCT period FROM scores WHERE risk_score IS NOT NULL) LEFT JOIN scores USING (entity, period)"""
CHANGE = f"""{o.SC}, ch AS (
  SELECT c.*, p.risk_score AS previous_score, c.risk_score - p.risk_score AS change
  FROM scores c LEFT JOIN scores p ON p.entity = c.entity AND p.period = c.period - 1 WHERE c.risk_score IS NOT NULL)"""
MOVES = f"""{o.SC}, yrs AS (
  SELECT max(period) AS latest, max(period) FILTER (period < top) AS prior
  FROM scores, (SELECT max(period) AS top FROM scores WHERE risk_score IS NOT NULL) WHERE risk_score IS NOT NULL),
mv AS (
  SELECT a.entity, prior, latest, a.risk_score - p.risk_score AS delta, p.risk_band AS prior_band, a.risk_band AS latest_band
  FROM yrs JOIN scores a ON a.period = latest JOIN scores p ON p.period = prior AND p.entity = a.entity
  WHERE a.risk_score IS NOT NULL AND p.risk_score IS NOT NULL)"""
ORDER = "CASE {0} WHEN 'Low' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Elevated' THEN 2 WHEN 'High' THEN 3 WHEN 'Severe' THEN 4 ELSE -1 END"

ORACLE = {
    "r1_peer_standing": f"""{o.SC}, pairs AS (
          SELECT a.entity, a.period, a.peer_group, count(x.entity) AS n, count(*) FILTER (x.risk_score <= a.risk_score) AS le,
                 count(*) FILTER (x.risk_score > a.risk_score) AS gt
          FROM scores a LEFT JOIN scores x ON x.period = a.period AND x.entity <> a.entity AND x.risk_score IS NOT NULL
            AND (a.peer_group IS NULL OR x.peer_group = a.peer_group)
          WHERE a.risk_score IS NOT NULL GROUP BY 1, 2, 3)
        SELECT entity, period, CASE WHEN n > 0 THEN round_even(le * 100.0 / n, 0)::INT END AS percentile,
          CASE WHEN n > 0 THEN round_even(gt * 100.0 / n, 0)::INT END AS riskier_share,
          CASE WHEN n > 0 THEN gt + 1 END AS rank, n, coalesce(peer_group, 'panel') AS group_name FROM pairs""",
    "r2_panel_rank": f"""{o.SC} SELECT entity, period, {o.r6('risk_score', 'med AS median')}, rank, size FROM (
          SELECT entity, period, risk_score, rank() OVER (PARTITION BY period ORDER BY risk_score DESC) AS rank,
                 median(risk_score) OVER (PARTITION BY period) AS med, count(*) OVER (PARTITION BY period) AS size
          FROM scores WHERE risk_score IS NOT NULL)""",
    "r3_peer_list": f"""{o.SC} SELECT entity, period, {o.r6('risk_score')}, position::INT AS position FROM (
          SELECT *, row_number() OVER (PARTITION BY period ORDER BY risk_score DESC, entity) AS position
          FROM scores WHERE risk_score IS NOT NULL) WHERE position <= 7""",
    "r4_watch": f"""{MOVES} SELECT side, position::INT AS position, entity, prior, latest, {o.r6('delta')} FROM (
          SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(delta) DESC, entity) AS position FROM (
            SELECT *, CASE WHEN delta > 0 THEN 'rising' WHEN delta < 0 THEN 'falling' END AS side FROM mv) WHERE side IS NOT NULL)
        WHERE position <= 5""",
    "r5_transitions": f"""{MOVES} SELECT entity, prior_band, latest_band FROM mv
        WHERE {ORDER.format('latest_band')} > {ORDER.format('prior_band')}""",
    "r6_change": f"{CHANGE} SELECT entity, period, {o.r6('risk_score', 'previous_score', 'change')} FROM ch",
    "r7_kpis": f"""{CHANGE} SELECT period, count(*) AS covered,
          count(*) FILTER ({ORDER.format('risk_band')} >= 2) AS elevated_plus,
          first(entity ORDER BY change DESC NULLS LAST, entity) FILTER (change IS NOT NULL) AS fastest_riser,
          first(entity ORDER BY change NULLS LAST, entity) FILTER (change IS NOT NULL) AS most_improving,
          {o.r6('median(risk_score) AS median_score', 'median(data_completeness)::DOUBLE AS median_completeness')}
        FROM ch GROUP BY period""",
    "r8_rankings": f"""{CHANGE}, ls AS (
          SELECT 'highest' AS ranking, -risk_score AS ord, * FROM ch
          UNION ALL SELECT 'rising', -change, * FROM ch WHERE change IS NOT NULL
          UNION ALL SELECT 'falling', change, * FROM ch WHERE change IS NOT NULL)
        SELECT ranking, entity, period, position::INT AS position, {o.r6('risk_score', 'change')} FROM (
          SELECT *, row_number() OVER (PARTITION BY period, ranking ORDER BY ord, entity) AS position FROM ls) WHERE position <= 5""",
    "r9_top_n": f"""{o.SC} SELECT s.entity, d.region, s.period, {o.r6('risk_score')}, risk_band
        FROM (SELECT * FROM scores WHERE risk_score IS NOT NULL AND period = (SELECT max(period) FROM scores)
              ORDER BY risk_score DESC, entity LIMIT 5) s JOIN dim d USING (entity)""",
    "r10_yoy_worst": f"""{CHANGE} SELECT entity, period, {o.r6('change AS score_delta')} FROM (
          SELECT * FROM ch WHERE change IS NOT NULL ORDER BY change DESC, entity, period LIMIT 5)""",
    "r11_driver_category": f"""{o.Z} SELECT period, category, count(*) AS times_top_driver FROM (
          SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY round(abs(weighted_contribution), 12) DESC, indicator) AS pos FROM drv)
        WHERE pos = 1 GROUP BY 1, 2""",
    "r12_matrix": f"""{o.SC} SELECT entity, period, {o.r6('risk_score')} FROM {GRID}""",
    "r13_map_layer": f"""{o.SC} SELECT entity, period, {o.r6('risk_score')}, coalesce(risk_band, 'No data') AS label,
          coalesce(risk_band IN ('High', 'Severe'), false) AS highlight
        FROM {GRID}""",
    "r14_trajectory": f"""{o.SC} SELECT entity, string_agg(printf('%d:%.4f', period, risk_score), ';' ORDER BY period) AS trajectory
        FROM scores WHERE risk_score IS NOT NULL GROUP BY 1""",
    "r15_movement": f"""{CHANGE} SELECT entity, period, {o.r6('risk_score', 'change')},
          CASE WHEN change > 0 THEN 'positive' WHEN change < 0 THEN 'negative' ELSE 'neutral' END AS movement FROM ch""",
    "r16_flags": f"""{o.PANEL} SELECT entity, period, {o.r6('LINES_PER_ORDER AS ratio', 'ORDER_COUNT_GAP AS first', 'RETURN_SHARE_3Y AS second')},
          LINES_PER_ORDER < 4 AS below_floor,
          CASE WHEN ORDER_COUNT_GAP IS NOT NULL OR RETURN_SHARE_3Y IS NOT NULL
               THEN coalesce(ORDER_COUNT_GAP < 0 AND RETURN_SHARE_3Y < 0, false) END AS twin_deficit
        FROM panel WHERE LINES_PER_ORDER IS NOT NULL OR ORDER_COUNT_GAP IS NOT NULL OR RETURN_SHARE_3Y IS NOT NULL""",
}
