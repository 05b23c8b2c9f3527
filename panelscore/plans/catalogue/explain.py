"""Explanations of nation x year scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.functions import text as t
from panelscore.operators import explain, rank, scenario
from panelscore.operators import score as scoring
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue import scenario as sc
from panelscore.plans.catalogue.common import nation_scores, nation_z, tidy
from panelscore.plans.catalogue.ranking import table
from panelscore.session import pin

M = b.NATION_MODEL
STAMP = "2024-01-31 06:00:00"
PRESET = b.NATION_PRESETS[0]


def t1(spark, sf):
    top = scoring.top_drivers(nation_z(spark, sf), M, 3)
    return top.selectExpr(
        "entity", "period", "position", "indicator", f"{explain.driver_phrase(M, 'indicator', 'weighted_contribution')} AS phrase"
    )


def t2(spark, sf):
    return explain.with_trend(table(spark, sf)).select("entity", "period", "trend_phrase")


def t3(spark, sf):
    return tidy(explain.with_peers(table(spark, sf)).select("entity", "period", "peer_median", "peer_phrase"))


def t4(spark, sf):
    return nation_scores(spark, sf).selectExpr(
        "entity", "period", f"{explain.confidence_level()} AS level", f"{explain.confidence_level(t.text('LOW INFORMATION'))} AS with_scenario"
    )


def t5(spark, sf):
    return nation_scores(spark, sf).selectExpr("entity", "period", f"{explain.limitations()} AS limitations")


def t6(spark, sf):
    """Reports with a scenario block for every nation and year."""
    panel = sc.panel(spark, sf)
    scores = explain.story_scores(scoring.z_frame(panel, M), M)
    found = pin(scenario.estimates(panel, [PRESET]))
    shocked = scenario.shock_scores(panel, M, [PRESET], found=found)
    channels = scenario.target_deltas(panel, [PRESET], found)
    names = b.nation_dimension(spark, sf).select("entity", F.concat(F.initcap("entity"), F.lit(" of "), "region").alias("name"))
    return explain.reports(scores, M, STAMP, names, ["orders", "lineitem"], shocked, channels, PRESET)


def t7(spark, sf):
    scores = explain.story_scores(nation_z(spark, sf), M, 6)
    d = explain.dossiers(scores, M)
    return tidy(
        d.selectExpr(
            "entity", "period", "risk_score", "risk_band", "trend.direction", "trend.delta_1", "trend.delta_2",
            "concat_ws(',', transform(pillars, p -> concat(p.pillar, ':', p.band))) AS pillars",
            "concat_ws(',', transform(top_drivers, x -> x.indicator)) AS drivers",
            "peer_standing.percentile", "peer_standing.rank", "peer_standing.n", "peer_standing.group_name",
        )
    )


def t7_nested(spark, sf):
    panel = sc.panel(spark, sf)
    scores = explain.story_scores(scoring.z_frame(panel, M), M, 6)
    nested = explain.dossiers(scores, M, scenario.shock_scores(panel, M, b.NATION_PRESETS))
    flat = nested.selectExpr("entity", "period", "size(pillars) AS pillars", "size(top_drivers) AS drivers", "inline(scenarios)")
    return tidy(flat.selectExpr("entity", "period", "preset", "scenario_band", "scenario_score", "delta", "information", "out_of_sample", "CAST(pillars AS BIGINT) AS pillars", "CAST(drivers AS BIGINT) AS drivers"))


def t7_complete(spark, sf):
    scores = explain.story_scores(nation_z(spark, sf), M, 6)
    shown = explain.complete(explain.dossiers(scores, M), rank.trajectories(scores))
    points = "concat_ws(';', transform(trajectory, x -> format_string('%d:%.4f', x.period, x.risk_score))) AS trajectory"
    return tidy(shown.selectExpr("entity", "period", "risk_score", "risk_band", "trend.direction", "peer_standing.n", points))


def t8(spark, sf):
    return tidy(explain.history(nation_scores(spark, sf)))


QUERIES = {
    "t1_phrases": t1,
    "t2_trend_text": t2,
    "t3_peer_text": t3,
    "t4_confidence": t4,
    "t5_limitations": t5,
    "t6_report": t6,
    "t7_dossier": t7,
    "t7_dossier_nested": t7_nested,
    "t7_complete": t7_complete,
    "t8_history": t8,
}

PHRASES = o.values(
    "ph", "indicator, worse, better", [(i.code, i.worse_phrase or i.name, i.better_phrase or i.name) for i in M.indicators]
)
ORDER = "CASE target " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(PRESET.targets)) + " END"
WHOLE = "printf('%.0f', {0})"
TOP = f"""{PHRASES},
rkd AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY round(abs(weighted_contribution), 12) DESC, indicator) AS position FROM drv),
top AS (SELECT entity, period, position, indicator, CASE WHEN weighted_contribution > 0 THEN worse ELSE better END AS phrase
        FROM rkd JOIN ph USING (indicator) WHERE position <= 3)"""
TREND = """tr AS (
  SELECT c.entity, c.period, c.risk_score - p.risk_score AS d, p.risk_score AS b
  FROM scores c LEFT JOIN scores p ON p.entity = c.entity AND p.period = c.period - 1),
trp AS (SELECT entity, period, CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 1.5 THEN 'broadly unchanged from ' || printf('%.0f', b) || ' a year earlier'
  ELSE CASE WHEN d > 0 THEN 'up' ELSE 'down' END || ' from ' || printf('%.0f', b) || ' a year earlier (' || CASE WHEN d > 0 THEN '+' ELSE '' END || printf('%.1f', d) || ' pts)' END AS trend_phrase FROM tr)"""
PEER = """pm_ AS (
  SELECT a.entity, a.period, any_value(a.risk_score) AS s, median(x.risk_score) AS m FROM scores a
  LEFT JOIN scores x ON x.period = a.period AND x.peer_group = a.peer_group AND x.entity <> a.entity WHERE a.risk_score IS NOT NULL GROUP BY 1, 2),
prp AS (SELECT entity, period, m AS peer_median, CASE WHEN m IS NULL THEN NULL WHEN abs(s - m) < 2 THEN 'roughly in line with its peer group'
  ELSE CASE WHEN s > m THEN 'above' ELSE 'below' END || ' its peer-group median (' || printf('%.0f', m) || ')' END AS peer_phrase FROM pm_)"""
LEVEL = "CASE WHEN data_completeness >= 0.95 THEN 'HIGH' WHEN data_completeness >= 0.7 THEN 'MODERATE' ELSE 'LOW' END"
CAUTION = "'- ' || printf(" + o.lit(explain.CAUTION.replace("%s", "%.0f")) + ", data_completeness * 100)"
FIXED = ", ".join(o.lit(f"- {n}") for n in explain.LIMITATIONS)
LIMITS = f"concat_ws(chr(10), CASE WHEN data_completeness < 0.7 THEN {CAUTION} END, {FIXED})"

REPORT = f"""{sc.SHOCK}, {TOP}, {TREND}, {PEER},
blt AS (SELECT entity, period, string_agg('- ' || phrase, chr(10) ORDER BY position) AS bullets,
              first(phrase ORDER BY position) AS lead FROM top GROUP BY 1, 2),
chn AS (
  SELECT p.entity, p.period, string_agg('Channel: ' || target || ' estimated to move by ' ||
      CASE WHEN slope * r.amount < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(slope * r.amount)) || ' (' ||
      CASE WHEN r_squared < 0.1 THEN 'low-information' ELSE 'moderate-information' END || ', pooled-panel R²=' || printf('%.2f', r_squared) ||
      ', n=' || n_obs || ').', ' ' ORDER BY {ORDER}) AS channels
  FROM pairs p JOIN reg r USING (preset, target) WHERE preset = '{PRESET.key}' GROUP BY 1, 2),
one AS (
  SELECT s.*, r.scenario_score, r.scenario_band, r.delta, r.information, r.out_of_sample, bullets, lead, channels, trend_phrase, peer_phrase,
         upper(s.entity[1]) || lower(s.entity[2:]) || ' of ' || d.region AS name
  FROM scores s JOIN (SELECT * FROM res WHERE preset = '{PRESET.key}') r USING (entity, period)
  JOIN blt USING (entity, period) LEFT JOIN chn USING (entity, period) LEFT JOIN trp USING (entity, period)
  LEFT JOIN prp USING (entity, period) JOIN dim d ON d.entity = s.entity)"""
WEAK = "information IN ('LOW INFORMATION', 'INSUFFICIENT DATA')"
FULL_TEXT = f"""concat_ws(chr(10), '**' || name || ' — Risk Score: ' || printf('%.0f', risk_score) || '/100 (' || risk_band || ')**', '',
  '**Main drivers:**', bullets, '', '**Scenario:**',
  '"If {PRESET.driver} moves by ' || CASE WHEN {PRESET.amount} >= 0 THEN '+' ELSE '' END || printf('%.0f', {PRESET.amount}) || ' from current levels..."', '',
  '**Impact:**', CASE WHEN delta IS NULL THEN {o.lit(explain.NO_ESTIMATE)} ELSE
    'Under this historical-sensitivity stress test, the model estimates a ' || CASE WHEN delta > 0 THEN 'deterioration' ELSE 'improvement' END
    || ' in the composite risk score of ' || printf('%.1f', abs(delta)) || ' points (' || printf('%.0f', risk_score) || ' -> ' || printf('%.0f', scenario_score) || '), '
    || CASE WHEN scenario_band <> risk_band THEN 'moving the country into the ' || scenario_band || ' band' ELSE 'staying within the ' || scenario_band || ' band' END
    || '. ' || channels END, '',
  '**Analyst view:**', concat_ws(' ', name || '''s composite score of ' || printf('%.0f', risk_score) || ' places it in the ' || lower(risk_band) || ' risk band.',
    'That score is ' || trend_phrase || '.', 'It sits ' || peer_phrase || '.', 'The single largest swing factor this period is ' || lower(lead) || '.',
    {o.lit(explain.LEVER % PRESET.driver.replace('_', ' ').lower())}, {o.lit(explain.POSITIONING)}), '',
  '**Limitations:**', {LIMITS}, '', '**Confidence:**',
  concat_ws(chr(10), 'Confidence: ' || CASE WHEN {WEAK} AND data_completeness >= 0.95 THEN 'MODERATE' WHEN {WEAK} THEN 'LOW' ELSE {LEVEL} END
      || ' — a data-quality flag, not a statistical confidence interval.',
    '- Data: ' || CASE WHEN data_completeness >= 0.95 THEN 'High coverage' WHEN data_completeness >= 0.7 THEN 'Moderate coverage' ELSE 'Partial coverage' END
      || ' for this country-year (' || printf('%.0f', data_completeness * 100) || '% of indicator weight populated).',
    '- Scenario estimate: ' || information || '.', CASE WHEN {WEAK} AND data_completeness >= 0.7 THEN '- The scenario impact should be read with extra caution.' END,
    CASE WHEN out_of_sample THEN '- The scenario shock exceeds the observed driver range (extrapolation).' END), '',
  '**Sources:**', '- orders', '- lineitem', '', 'Generated: {STAMP}')"""

ORACLE = {
    "t1_phrases": f"{o.Z}, {TOP} SELECT entity, period, position::INT AS position, indicator, phrase FROM top",
    "t2_trend_text": f"{o.SC}, {TREND} SELECT entity, period, trend_phrase FROM trp",
    "t3_peer_text": f"{o.SC}, {PEER} SELECT entity, period, {o.r6('peer_median')}, peer_phrase FROM prp RIGHT JOIN (SELECT entity, period FROM scores) USING (entity, period)",
    "t4_confidence": f"""{o.SC} SELECT entity, period, {LEVEL} AS level,
        CASE WHEN data_completeness >= 0.95 THEN 'MODERATE' ELSE 'LOW' END AS with_scenario FROM scores""",
    "t5_limitations": f"{o.SC} SELECT entity, period, {LIMITS} AS limitations FROM scores",
    "t6_report": f"""{REPORT} SELECT entity, period,
        CASE WHEN risk_score IS NULL THEN 'No sufficient data to score ' || name || ' for ' || period || '.' ELSE {FULL_TEXT} END AS report FROM one""",
    "t7_dossier": f"""{o.SC}, pl AS (SELECT entity, period, string_agg(pillar || ':' || {o.band('pillar_score')}, ',' ORDER BY round(pillar_score, 9) DESC, pillar DESC) AS pillars FROM pil GROUP BY 1, 2),
        td AS (SELECT entity, period, string_agg(indicator, ',' ORDER BY round(abs(weighted_contribution), 12) DESC, indicator) AS drivers FROM (
          SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY round(abs(weighted_contribution), 12) DESC, indicator) AS pos FROM drv) WHERE pos <= 6 GROUP BY 1, 2),
        st AS (SELECT a.entity, a.period, count(x.entity) AS n, count(*) FILTER (x.risk_score <= a.risk_score) AS le, count(*) FILTER (x.risk_score > a.risk_score) AS gt
          FROM scores a LEFT JOIN scores x ON x.period = a.period AND x.entity <> a.entity AND x.risk_score IS NOT NULL
            AND (a.peer_group IS NULL OR x.peer_group = a.peer_group) WHERE a.risk_score IS NOT NULL GROUP BY 1, 2)
        SELECT entity, period, {o.r6('risk_score')}, risk_band, trend_direction AS direction, {o.r6('trend_1y_delta AS delta_1', 'trend_2y_delta AS delta_2')}, pillars, drivers,
          CASE WHEN n > 0 THEN round_even(le * 100.0 / n, 0)::INT END AS percentile, CASE WHEN n > 0 THEN gt + 1 END AS rank, n,
          coalesce(peer_group, 'panel') AS group_name
        FROM scores JOIN pl USING (entity, period) JOIN td USING (entity, period) JOIN st USING (entity, period)""",
    "t7_dossier_nested": f"""{sc.SHOCK} SELECT entity, period, preset, scenario_band, {o.r6('scenario_score', 'delta')}, information, out_of_sample,
          (SELECT count(*) FROM pil p WHERE p.entity = res.entity AND p.period = res.period) AS pillars, (SELECT least(6, count(*)) FROM ind) AS drivers
        FROM res WHERE baseline_score IS NOT NULL""",
    "t7_complete": f"""{o.SC}, lt AS (SELECT entity, max(period) AS period, string_agg(printf('%d:%.4f', period, risk_score), ';' ORDER BY period) AS trajectory
          FROM scores WHERE risk_score IS NOT NULL GROUP BY 1)
        SELECT entity, period, {o.r6('risk_score')}, risk_band, trend_direction AS direction, trajectory,
          (SELECT count(*) FROM scores x WHERE x.period = a.period AND x.entity <> a.entity AND x.risk_score IS NOT NULL
             AND (a.peer_group IS NULL OR x.peer_group = a.peer_group)) AS n
        FROM scores a JOIN lt USING (entity, period)""",
    "t8_history": f"""{o.SC} SELECT entity, period, {o.r6('risk_score', 'data_completeness::DOUBLE AS data_completeness', 'trend_1y_delta')}, risk_band, trend_direction
        FROM scores WHERE risk_score IS NOT NULL""",
}
