"""Shocks on the nation panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.model import Preset
from panelscore.operators import scenario
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy

M, PRESETS = b.NATION_MODEL, b.NATION_PRESETS


def panel(spark, sf):
    return b.nation_year(spark, sf).withColumn("FLAT", F.lit(0.0))


def x1(spark, sf):
    return tidy(scenario.regressions(panel(spark, sf), PRESETS), 9)


def x3(spark, sf):
    return tidy(scenario.target_deltas(panel(spark, sf), PRESETS).drop("position"))


def x5(spark, sf):
    out = scenario.shock_scores(panel(spark, sf), M, PRESETS)
    return tidy(out.drop("peer_group"))


def x7(spark, sf):
    """Status of every shock, with a preset whose driver nobody delivers, on a panel of which a year has no score."""
    p = panel(spark, sf)
    blank = [F.when(F.col("period") != 1996, F.col(c)).alias(c) for c in M.codes]
    out = scenario.shock_scores(p.select("entity", "peer_group", "period", *blank), M, (b.NATION_PRESETS[0], MISSING))
    return tidy(out.select("entity", "period", "preset", "status", "shocked_driver_value"))


def x8(spark, sf):
    out = scenario.narrative(scenario.shock_scores(panel(spark, sf), M, PRESETS), PRESETS)
    return out.select("entity", "period", "preset", "narrative")


MISSING = Preset("absent_driver", "Absent driver", "NOT_DELIVERED", 1.0, ("RETURN_SHARE",))
QUERIES = {"x1_ols": x1, "x3_deltas": x3, "x5_scenarios": x5, "x7_status": x7, "x8_narrative": x8}

TARGETS = [(p, target) for p in PRESETS for target in p.targets if target in M.codes]
PAIRS = f"""{o.PANEL}, xp AS (SELECT *, 0.0::DOUBLE AS FLAT FROM panel),
pairs AS ({" UNION ALL ".join(
    f"SELECT '{p.key}' AS preset, '{p.driver}' AS driver, '{t}' AS target, {p.amount!r}::DOUBLE AS amount, entity, period, {p.driver} AS x, {t} AS y FROM xp" for p, t in TARGETS)}),
reg AS (
  SELECT preset, driver, target, max(amount) AS amount,
         CASE WHEN count(x) FILTER (y IS NOT NULL) >= 5 AND stddev_pop(x) FILTER (y IS NOT NULL) > 0 THEN regr_slope(y, x) END AS slope,
         CASE WHEN count(x) FILTER (y IS NOT NULL) >= 5 AND stddev_pop(x) FILTER (y IS NOT NULL) > 0
               AND stddev_pop(y) FILTER (x IS NOT NULL) > 0 THEN regr_r2(y, x) END AS r_squared,
         count(x) FILTER (y IS NOT NULL) AS n_obs,
         CASE WHEN count(x) FILTER (y IS NOT NULL) >= 5 THEN min(x) FILTER (y IS NOT NULL) END AS driver_min,
         CASE WHEN count(x) FILTER (y IS NOT NULL) >= 5 THEN max(x) FILTER (y IS NOT NULL) END AS driver_max
  FROM pairs GROUP BY 1, 2, 3),
inf AS (
  SELECT preset, CASE WHEN count(slope) = 0 THEN 'INSUFFICIENT DATA'
      WHEN min(n_obs) FILTER (slope IS NOT NULL) >= 80 AND median(r_squared) FILTER (slope IS NOT NULL) >= 0.35 THEN 'HIGH INFORMATION'
      WHEN min(n_obs) FILTER (slope IS NOT NULL) >= 30 AND median(r_squared) FILTER (slope IS NOT NULL) >= 0.10 THEN 'MODERATE INFORMATION'
      ELSE 'LOW INFORMATION' END AS information FROM reg GROUP BY 1)"""
DRIVERS = " UNION ALL ".join(
    f"SELECT '{p.key}' AS preset, {p.amount!r}::DOUBLE AS amount, entity, period, {p.driver} AS x, (SELECT min({p.driver}) FROM xp) AS low, (SELECT max({p.driver}) FROM xp) AS high FROM xp"
    for p in PRESETS
)
# Brute force: for every (preset, cell) the history and the peer group are rebuilt with that cell replaced.
SHOCK = f"""{PAIRS},
{o.zscores().lstrip()}, {o.rollup().lstrip()}, {o.SCORES.lstrip()},
dv AS ({DRIVERS}),
tg AS (SELECT r.preset, r.target AS indicator, c.entity, c.period, c.grp, c.v, c.v + coalesce(r.slope * r.amount, 0) AS x
       FROM reg r JOIN cells c ON c.indicator = r.target),
th AS (
  SELECT preset, indicator, entity, period, count(w) AS hn, avg(w) AS hm, stddev_pop(w) AS hs FROM (
    SELECT t.preset, t.indicator, t.entity, t.period, CASE WHEN c.period = t.period THEN t.x ELSE c.v END AS w
    FROM tg t JOIN cells c ON c.indicator = t.indicator AND c.entity = t.entity AND c.period <= t.period) GROUP BY ALL),
tp AS (
  SELECT preset, indicator, entity, period, count(w) AS pn, avg(w) AS pm, stddev_pop(w) AS ps FROM (
    SELECT t.preset, t.indicator, t.entity, t.period, CASE WHEN c.entity = t.entity THEN t.x ELSE c.v END AS w
    FROM tg t JOIN cells c ON c.indicator = t.indicator AND c.period = t.period AND c.grp = t.grp) GROUP BY ALL),
tz AS (
  SELECT t.*, {o.ZSCORE.format(n="hn", m=o.P.min_history_obs, s="hs", v="x", mean="hm")} AS z_time,
         {o.ZSCORE.format(n="pn", m=o.P.min_peer_obs, s="ps", v="x", mean="pm")} AS z_peer
  FROM tg t JOIN th USING (preset, indicator, entity, period) JOIN tp USING (preset, indicator, entity, period)),
tc AS (
  SELECT *, coalesce((coalesce(z_time, 0) * {o.P.history_z_weight} + coalesce(z_peer, 0) * {o.P.peer_z_weight})
    / nullif((z_time IS NOT NULL)::INT * {o.P.history_z_weight} + (z_peer IS NOT NULL)::INT * {o.P.peer_z_weight}, 0), 0) AS z_combined FROM tz),
drv_x AS (
  SELECT pr.preset, d.entity, d.period, d.pillar, d.v, d.weight,
         coalesce(tc.z_combined, d.z_combined) * d.risk_direction * d.weight AS weighted_contribution
  FROM drv d CROSS JOIN (SELECT DISTINCT preset FROM dv) pr
  LEFT JOIN tc ON tc.preset = pr.preset AND tc.indicator = d.indicator AND tc.entity = d.entity AND tc.period = d.period),
{o.rollup('_x', 'preset').lstrip()},
res AS (
  SELECT dv.entity, dv.period, dv.preset, b.risk_score AS baseline_score, b.risk_band AS baseline_band, s.risk_score AS scenario_score,
         coalesce({o.band('s.risk_score')}, 'Unavailable') AS scenario_band, s.risk_score - b.risk_score AS delta,
         dv.x AS baseline_driver_value, dv.x + dv.amount AS shocked_driver_value, information,
         coalesce(dv.x + dv.amount < dv.low OR dv.x + dv.amount > dv.high, false) AS out_of_sample,
         (SELECT min(period) || '–' || max(period) FROM xp) AS estimation_window
  FROM dv JOIN scores b USING (entity, period) JOIN sc_x s USING (preset, entity, period) JOIN inf USING (preset))"""
NAMES = o.values(
    "nm", "preset, head", [(p.key, f"{p.name} shock: a {abs(p.amount):g} {p.unit} change in the {p.driver_label} ({p.driver}) moves ") for p in PRESETS]
)

ORACLE = {
    "x1_ols": f"""{PAIRS} SELECT preset, driver, target, {o.r6('slope', 'r_squared', 'driver_min', 'driver_max', digits=9)}, n_obs, information
        FROM reg JOIN inf USING (preset)""",
    "x3_deltas": f"""{PAIRS} SELECT preset, target, entity, period, {o.r6('y AS baseline_value', '(slope * r.amount) AS estimated_delta', 'r_squared',
        'x AS baseline_driver_value', '(x + r.amount) AS shocked_driver_value')}, n_obs FROM pairs p JOIN reg r USING (preset, target)""",
    "x5_scenarios": f"""{SHOCK} SELECT entity, period, preset, {o.r6('baseline_score', 'scenario_score', 'delta', 'baseline_driver_value', 'shocked_driver_value')},
        baseline_band, scenario_band, information, out_of_sample, estimation_window,
        CASE WHEN baseline_score IS NULL THEN 'no baseline score' ELSE 'ok' END AS status FROM res""",
    "x7_status": f"""{o.SC}, st7 AS (
          SELECT entity, period, '{PRESETS[0].key}' AS preset, CASE WHEN s.period = 1996 OR risk_score IS NULL THEN 'no baseline score' ELSE 'ok' END AS status,
            CASE WHEN s.period <> 1996 THEN p.{PRESETS[0].driver} + {PRESETS[0].amount} END AS shocked FROM scores s JOIN panel p USING (entity, period)
          UNION ALL SELECT entity, period, '{MISSING.key}', 'driver not in the panel', NULL FROM scores)
        SELECT entity, period, preset, status, {o.r6('shocked AS shocked_driver_value')} FROM st7""",
    "x8_narrative": f"""{SHOCK}, {NAMES} SELECT entity, period, preset, CASE WHEN baseline_score IS NOT NULL THEN
          head || entity || '''s risk score from ' || printf('%.1f', baseline_score) || ' (' || baseline_band || ') to ' || printf('%.1f', scenario_score)
          || ' (' || scenario_band || ') — a ' || printf('%.1f', abs(delta)) || '-point move indicating '
          || CASE WHEN delta > 1e-9 THEN 'elevated risk' WHEN delta < -1e-9 THEN 'moderated risk' ELSE 'unchanged risk' END
          || '. Estimation: pooled-panel bivariate OLS on the ' || estimation_window || ' sample; ' || lower(information) || '.'
          || CASE WHEN out_of_sample THEN {o.lit(scenario.EXTRAPOLATION)} ELSE '' END END AS narrative FROM res JOIN nm USING (preset)""",
}
