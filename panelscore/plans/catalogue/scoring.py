"""Scoring on nation x year."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.model import pillar_column, sector_column
from panelscore.operators import score
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import nation_scores, nation_z, tidy

M = b.NATION_MODEL


def z1(spark, sf):
    return tidy(score.drivers(nation_z(spark, sf), M).select("entity", "period", "indicator", "raw_value", "z_time"))


def z2(spark, sf):
    return tidy(score.drivers(nation_z(spark, sf), M).select("entity", "period", "indicator", "z_peer"))


def z3(spark, sf):
    return tidy(score.drivers(nation_z(spark, sf), M).select("entity", "period", "indicator", "z_combined"))


def z4(spark, sf):
    return tidy(score.drivers(nation_z(spark, sf), M))


def z5(spark, sf):
    return tidy(nation_scores(spark, sf).select("entity", "period", "data_completeness"))


def z6(spark, sf):
    return tidy(score.pillar_scores(nation_scores(spark, sf), M))


def z8(spark, sf):
    return tidy(score.sector_scores(nation_scores(spark, sf), M))


def z10(spark, sf):
    return tidy(nation_scores(spark, sf).select("entity", "period", "risk_score", "risk_band", "sector_score"))


def z11(spark, sf):
    return tidy(nation_scores(spark, sf).select("entity", "period", "trend_1y_delta", "trend_2y_delta", "trend_direction"))


PILLARS = [pillar_column(p) for p in M.active_pillars]
SECTORS = [sector_column(s) for s in M.sectors]


def z13(spark, sf):
    return tidy(nation_scores(spark, sf).select("entity", "period", "risk_score", *PILLARS, *SECTORS))


def z14(spark, sf):
    return tidy(score.scheme_scores(nation_z(spark, sf), M).select("scheme", "entity", "period", "risk_score", "risk_band"))


def z15(spark, sf):
    top = score.top_drivers(nation_z(spark, sf), M, 6)
    return tidy(top.select("entity", "period", "position", "indicator", "label", "weighted_contribution"))


def z16(spark, sf):
    return tidy(score.signed_drivers(nation_z(spark, sf), M, up=3, down=2))


def z17(spark, sf):
    listed = score.pillar_list(nation_scores(spark, sf), M)
    return listed.select("entity", "period", F.concat_ws(",", F.transform("pillars", lambda p: p["pillar"])).alias("pillars"))


QUERIES = {
    "z1_expanding_z": z1,
    "z2_peer_z": z2,
    "z3_blend": z3,
    "z4_drivers": z4,
    "z5_completeness": z5,
    "z6_pillar": z6,
    "z8_sector": z8,
    "z10_composite": z10,
    "z11_trend": z11,
    "z13_wide": z13,
    "z14_schemes": z14,
    "z15_top_drivers": z15,
    "z16_split": z16,
    "z17_pillar_order": z17,
}

EQUAL = M.equal_weights().pillar_weights
WIDE = ", ".join(
    [f"max(pillar_score) FILTER (pillar = '{p}') AS {pillar_column(p)}" for p in M.active_pillars]
)
WIDE_S = ", ".join([f"max(sector_score) FILTER (sector = '{s}') AS {sector_column(s)}" for s in M.sectors])

ORACLE = {
    "z1_expanding_z": f"{o.Z} SELECT entity, period, indicator, {o.r6('v AS raw_value', 'z_time')} FROM drv",
    "z2_peer_z": f"{o.Z} SELECT entity, period, indicator, {o.r6('z_peer')} FROM drv",
    "z3_blend": f"{o.Z} SELECT entity, period, indicator, {o.r6('z_combined')} FROM drv",
    "z4_drivers": f"""{o.Z} SELECT entity, period, indicator, category, pillar, label, unit, {o.r6(
        'v AS raw_value', 'risk_direction::DOUBLE AS risk_direction', 'weight::DOUBLE AS weight', 'z_time', 'z_peer', 'z_combined', 'z_risk', 'weighted_contribution')} FROM drv""",
    "z5_completeness": f"{o.SC} SELECT entity, period, {o.r6('data_completeness::DOUBLE AS data_completeness')} FROM scores",
    "z6_pillar": f"""{o.SC} SELECT entity, period, pillar, {o.r6('pillar_score', 'pillar_weight::DOUBLE AS pillar_weight')},
        {o.band('pillar_score')} AS pillar_band FROM pil""",
    "z8_sector": f"""{o.SC} SELECT entity, period, sector, {o.r6('sector_score', 'sector_weight::DOUBLE AS sector_weight')},
        {o.band('sector_score')} AS sector_band FROM sec JOIN sw USING (sector)""",
    "z10_composite": f"{o.SC} SELECT entity, period, {o.r6('risk_score', 'sector_score')}, risk_band FROM scores",
    "z11_trend": f"{o.SC} SELECT entity, period, {o.r6('trend_1y_delta', 'trend_2y_delta')}, trend_direction FROM scores",
    "z13_wide": f"""{o.SC} SELECT entity, period, {o.r6('risk_score', *PILLARS, *SECTORS)} FROM scores
        LEFT JOIN (SELECT entity, period, {WIDE} FROM pil GROUP BY 1, 2) USING (entity, period)
        LEFT JOIN (SELECT entity, period, {WIDE_S} FROM sec GROUP BY 1, 2) USING (entity, period)""",
    "z14_schemes": f"""{o.SC}, {o.values('eq', 'pillar, w', list(EQUAL.items()))},
        both_schemes AS (
          SELECT 'weighted' AS scheme, entity, period, risk_score FROM scores
          UNION ALL SELECT 'equal_weight', entity, period, sum(pillar_score * w) / sum(w) FROM pil JOIN eq USING (pillar) GROUP BY 2, 3)
        SELECT scheme, entity, period, {o.r6('risk_score')}, {o.band('risk_score')} AS risk_band FROM both_schemes""",
    "z15_top_drivers": f"""{o.Z} SELECT entity, period, position::INT AS position, indicator, label, {o.r6('weighted_contribution')} FROM (
          SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY round(abs(weighted_contribution), 12) DESC, indicator) AS position FROM drv)
        WHERE position <= 6""",
    "z16_split": f"""{o.Z}, m AS (
          SELECT *, max(abs(weighted_contribution)) OVER (PARTITION BY entity, period) AS top,
                 CASE WHEN weighted_contribution > 0 THEN 'up' WHEN weighted_contribution < 0 THEN 'down' END AS side FROM drv),
        r AS (SELECT *, row_number() OVER (PARTITION BY entity, period, side ORDER BY round(abs(weighted_contribution), 12) DESC, indicator) AS position
              FROM m WHERE side IS NOT NULL)
        SELECT entity, period, side, position::INT AS position, indicator, label, {o.r6('weighted_contribution', 'abs(weighted_contribution) / greatest(top, 1e-11) AS bar_share')}
        FROM r WHERE position <= CASE side WHEN 'up' THEN 3 ELSE 2 END""",
    "z17_pillar_order": f"""{o.SC} SELECT entity, period, coalesce(pillars, '') AS pillars FROM scores LEFT JOIN (
          SELECT entity, period, string_agg(pillar, ',' ORDER BY round(pillar_score, 9) DESC, pillar DESC) AS pillars FROM pil GROUP BY 1, 2)
        USING (entity, period)""",
}
