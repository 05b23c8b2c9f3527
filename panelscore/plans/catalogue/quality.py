"""Data quality checks on nation x year."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelscore.model import Indicator, local_table
from panelscore.operators import clean, quality
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy

M = b.NATION_MODEL
WIDER = replace(
    M, indicators=(*M.indicators, Indicator("SHIPPING_DELAY", "Service", 0.04), Indicator("CLAIMS", "Quality", 0.02))
)


def long_panel(spark, sf):
    return clean.to_long(b.nation_year(spark, sf), M.codes)


def q2(spark, sf):
    return tidy(quality.missing_indicators(long_panel(spark, sf), WIDER))


def q4(spark, sf):
    return quality.latest_covered_period(long_panel(spark, sf), M, min_coverage=0.8, min_entities=10)


def tampered(spark, sf):
    """With the line count, which is no indicator but the base of the ratio."""
    panel = b.nation_year(spark, sf, ("LINE_COUNT",))
    value = F.when(F.col("period") == 1998, F.col("RETURN_SHARE_3Y") + 1.0).otherwise(F.col("RETURN_SHARE_3Y"))
    return panel.withColumn("RETURN_SHARE_3Y", value)


RULES = b.NATION_DERIVED


def q5(spark, sf):
    return tidy(quality.derivation_drift(tampered(spark, sf), RULES))


def q6(spark, sf):
    return quality.episode_checks(b.nation_year(spark, sf), b.NATION_EPISODES)


def q7(spark, sf):
    return quality.report(tampered(spark, sf), M, RULES, b.NATION_EPISODES)


def q8(spark, sf):
    flagged = clean.flag_quality(b.nation_long(spark, sf).drop("flag"), M)
    row = quality.provenance(flagged, 25, M, 2000, {"orders": "Orders", "lineitem": "lineitem", "rates": "rates feed"})
    return tidy(row.withColumn("notes", F.concat_ws(" | ", "notes")))


def q9(spark, sf):
    return quality.run_metadata(b.nation_long(spark, sf), 25, M)


BROKEN = replace(
    M,
    indicators=tuple(i for i in M.indicators if i.pillar != "Service"),
    sectors=dict(M.sectors),
)


def q3(spark, sf):
    """A model without any indicator of one pillar, held against the pillars that the panel delivers."""
    problems = quality.empty_pillars(spark, BROKEN)
    of = local_table(spark, [(i.code, i.pillar) for i in M.indicators], "indicator string, pillar string")
    seen = long_panel(spark, sf).where("value is not null").join(of, "indicator").groupBy("pillar").agg(F.count(F.lit(1)).alias("cells"))
    return problems.join(seen, "pillar", "left").select("check", "pillar", "cells")


QUERIES = {
    "q2_missing": q2,
    "q3_structure": q3,
    "q4_latest_period": q4,
    "q5_drift": q5,
    "q6_episodes": q6,
    "q7_report": q7,
    "q8_provenance": q8,
    "q9_run_metadata": q9,
}

EPISODES = o.values(
    "ep",
    "episode, entity, label, baseline, event, win, threshold",
    [(n, e.entity, e.label, e.baseline, e.event, e.window, float(e.threshold)) for n, e in enumerate(b.NATION_EPISODES)],
)
BOUNDS = o.values("bounds", "indicator, low, high", [(i.code, i.low, i.high) for i in M.indicators])

DRIFT = f"""{o.PANEL}, p2 AS (SELECT * REPLACE (CASE WHEN period = 1998 THEN RETURN_SHARE_3Y + 1.0 ELSE RETURN_SHARE_3Y END AS RETURN_SHARE_3Y) FROM panel),
        act AS ({" UNION ALL ".join(f"SELECT entity, period, '{r.code}' AS indicator, {r.code} AS actual FROM p2" for r in RULES)}),
        rows_ AS (
          SELECT w.entity, w.period, CASE w.indicator WHEN 'AVG_ORDER_VALUE' THEN 'ORDER_VALUE_YOY' WHEN 'ORDER_COUNT' THEN 'ORDER_COUNT_GAP'
                   WHEN 'RETURN_SHARE' THEN 'RETURN_SHARE_3Y' ELSE 'DISCOUNT_TREND_DEV' END AS indicator FROM w
          WHERE w.indicator IN ('AVG_ORDER_VALUE', 'ORDER_COUNT', 'RETURN_SHARE') OR (w.indicator = 'AVG_DISCOUNT' AND n5 >= 3 AND mean5 > 0)
          UNION ALL SELECT entity, period, indicator FROM derived WHERE indicator = 'LINES_PER_ORDER'),
        cmp AS (SELECT r.indicator, abs(d.value - a.actual) AS gap FROM rows_ r JOIN act a USING (entity, period, indicator)
                LEFT JOIN derived d USING (entity, period, indicator)),
        drift AS (SELECT indicator, max(gap) AS max_drift, count(*) AS rows, coalesce(max(gap) > 1e-6, false) AS drifted FROM cmp GROUP BY 1)"""

ORACLE = {
    "q2_missing": f"""{o.PANEL}, {o.values('wider', 'indicator, pillar, weight', [(i.code, i.pillar, float(i.weight)) for i in WIDER.weighted])}
        SELECT indicator, pillar, {o.r6('weight::DOUBLE AS weight')} FROM wider
        WHERE indicator NOT IN (SELECT indicator FROM full_long WHERE value IS NOT NULL)""",
    "q3_structure": f"""{o.PANEL}, left_ AS (SELECT DISTINCT pillar FROM ind WHERE weight > 0 AND pillar <> 'Service'),
        p AS (SELECT 'pillar_coverage' AS "check", pillar FROM pw WHERE pillar_weight > 0 AND pillar NOT IN (SELECT pillar FROM left_)
          UNION ALL SELECT 'sector_partition', pillar FROM pw WHERE sector IS NOT NULL AND pillar NOT IN (SELECT pillar FROM left_))
        SELECT "check", pillar, (SELECT count(*) FROM full_long JOIN ind USING (indicator) WHERE ind.pillar = p.pillar) AS cells FROM p""",
    "q4_latest_period": f"""{o.PANEL}, sh AS (
          SELECT entity, period, sum(weight) / {M.total_weight} AS share FROM full_long JOIN ind USING (indicator) WHERE weight > 0 GROUP BY 1, 2),
        g AS (SELECT period, count(*) AS entities FROM sh WHERE share >= 0.8 - 1e-9 GROUP BY 1)
        SELECT period, entities FROM g WHERE entities >= 10 ORDER BY period DESC LIMIT 1""",
    "q5_drift": f"{DRIFT} SELECT indicator, {o.r6('max_drift')}, rows, drifted FROM drift",
    "q6_episodes": f"""{o.PANEL}, {EPISODES}, span AS (SELECT min(period) AS low, max(period) AS high FROM panel),
        c AS (SELECT ep.*, CASE WHEN entity NOT IN (SELECT entity FROM panel) THEN 'unknown entity'
            WHEN NOT baseline BETWEEN low AND high AND NOT event BETWEEN low AND high THEN 'baseline and event outside panel'
            WHEN NOT baseline BETWEEN low AND high THEN 'baseline outside panel'
            WHEN NOT event BETWEEN low AND high THEN 'event outside panel' END AS problem FROM ep, span)
        SELECT episode, entity, label, baseline, event, problem FROM c WHERE problem IS NOT NULL""",
    "q7_report": f"""{DRIFT}, {EPISODES}, names AS (SELECT DISTINCT indicator FROM full_long),
        f AS (SELECT
          (SELECT min(period) FROM panel) AS period_min, (SELECT max(period) FROM panel) AS period_max, (SELECT count(DISTINCT entity) FROM panel) AS entities,
          (SELECT coalesce(bool_and(NOT drifted), true) FROM drift) AS derivations,
          (SELECT count(*) = 0 FROM ep WHERE entity NOT IN (SELECT entity FROM panel) OR baseline NOT BETWEEN (SELECT min(period) FROM panel) AND (SELECT max(period) FROM panel)
             OR event NOT BETWEEN (SELECT min(period) FROM panel) AND (SELECT max(period) FROM panel)) AS episode_windows_in_range,
          (SELECT count(*) FROM ind WHERE weight > 0) AS indicators_total,
          (SELECT count(*) FROM ind WHERE weight > 0 AND indicator IN (SELECT indicator FROM names)) AS indicators_covered,
          (SELECT count(*) = 0 FROM pw WHERE pillar_weight > 0 AND (sector IS NULL OR pillar NOT IN (SELECT pillar FROM ind WHERE weight > 0))) AS pillar_coverage)
        SELECT *, indicators_total = indicators_covered AS indicator_columns,
          CASE WHEN indicators_total = indicators_covered AND pillar_coverage AND derivations THEN 'ok' ELSE 'issues' END AS status FROM f""",
    "q8_provenance": f"""{o.LONG}, {BOUNDS}, f AS (
          SELECT obs.*, CASE WHEN value < low OR value > high THEN 1 ELSE 0 END AS bad,
                 obs.indicator IN ('AVG_DISCOUNT', 'AVG_TAX', 'RETURN_SHARE', 'LINE_COUNT') AS from_lines
          FROM obs LEFT JOIN bounds USING (indicator)),
        a AS (SELECT count(*) FILTER (period = 2000) AS received, sum(bad)::BIGINT AS out_of_range,
                     bool_or(NOT from_lines) AS orders_ok, bool_or(from_lines) AS lineitem_ok FROM f)
        SELECT 2000 AS period, {25 * len(M.indicators)}::BIGINT AS expected, received,
          {o.r6(f'round_even(received * 100.0 / {25 * len(M.indicators)}, 1)::DOUBLE AS coverage_pct')}, out_of_range, orders_ok, lineitem_ok,
          false AS rates_ok, concat_ws(' | ', CASE WHEN out_of_range > 0 THEN out_of_range || ' observation(s) fell outside configured bounds' END,
            CASE WHEN NOT orders_ok THEN 'Orders delivered nothing' END, CASE WHEN NOT lineitem_ok THEN 'lineitem delivered nothing' END,
            'rates feed delivered nothing') AS notes FROM a""",
    "q9_run_metadata": f"""{o.LONG}, {o.values('codes', 'indicator', [(c,) for c in M.codes])}
        SELECT count(DISTINCT entity) AS entity_count, count(DISTINCT indicator) FILTER (indicator IN (SELECT indicator FROM codes)) AS indicator_count,
          count(*) AS observations_received, greatest(0, {25 * len(M.codes)} - count(*)) AS observations_missing FROM obs""",
}
