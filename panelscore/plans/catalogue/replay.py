"""Episode replay on nation x year scores."""

from __future__ import annotations

from panelscore.model import pillar_column, sector_column
from panelscore.operators import backtest
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import nation_scores, nation_z, tidy
from panelscore.plans.catalogue.quality import EPISODES
from panelscore.session import pin

M, EP = b.NATION_MODEL, b.NATION_EPISODES
COMPONENTS = [pillar_column(p) for p in M.active_pillars] + [sector_column(s) for s in M.sectors]


def table(spark, sf):
    return pin(nation_scores(spark, sf).select("entity", "period", "risk_score", "risk_band", *COMPONENTS))


def b3(spark, sf):
    out = backtest.replay(table(spark, sf), EP)
    return tidy(out.drop("label", "window", "lead_time"))


def b4(spark, sf):
    return backtest.replay(table(spark, sf), EP).select("episode", "entity", "verdict", "lead_time")


def b5(spark, sf):
    return tidy(backtest.peer_drift(table(spark, sf), EP))


def b6(spark, sf):
    out = backtest.run_backtest(table(spark, sf), EP, M)
    return out.select("episode", "entity", "verdict", "dominant_pillar", "dominant_sector")


def b7(spark, sf):
    return tidy(backtest.summary(backtest.run_backtest(table(spark, sf), EP)))


def b8(spark, sf):
    return backtest.ordinary_windows(table(spark, sf), EP)


def b9(spark, sf):
    scores = table(spark, sf)
    return tidy(backtest.false_alarm_rate(backtest.ordinary_windows(scores, window=2, threshold=4.0)))


def b10(spark, sf):
    scores = table(spark, sf)
    return tidy(backtest.metrics(backtest.replay(scores, EP), backtest.ordinary_windows(scores, EP)))


def b11(spark, sf):
    return tidy(backtest.compare_weightings(nation_z(spark, sf), M, EP))


def b12(spark, sf):
    changed = backtest.with_overrides(EP, window=2, threshold=1.5)
    out = backtest.replay(table(spark, sf), changed)
    return tidy(out.select("episode", "window", "threshold", "peak_score", "peak_period", "peak_delta", "verdict", "lead_time"))


QUERIES = {
    "b3_replay": b3,
    "b4_lead_time": b4,
    "b5_drift": b5,
    "b6_dominant": b6,
    "b7_summary": b7,
    "b8_ordinary_windows": b8,
    "b9_false_alarm": b9,
    "b10_metrics": b10,
    "b11_comparison": b11,
    "b12_overrides": b12,
}


def replayed(scores: str, ep: str = "ep", suffix: str = "", part: str = "") -> str:
    """CTEs of a replay: rp (results) and dr (drift), with an optional scheme column."""
    on = "s.entity = e.entity" + (" AND s.scheme = e.scheme" if part else "")
    frame = f"(SELECT sch.scheme, ep.* FROM ep CROSS JOIN (SELECT DISTINCT scheme FROM {scores}) sch)" if part else ep
    keys = "scheme, episode" if part else "episode"
    same = "x.scheme = e.scheme AND " if part else ""
    return f"""
epx{suffix} AS (SELECT * FROM {frame}),
pk{suffix} AS (
  SELECT e.*, b.risk_score AS base, v.risk_score AS ev,
         (SELECT max(s.risk_score) FROM {scores} s WHERE {on} AND s.period BETWEEN e.event AND e.event + e.win) AS peak
  FROM epx{suffix} e
  LEFT JOIN {scores} b ON {on.replace('s.', 'b.')} AND b.period = e.baseline
  LEFT JOIN {scores} v ON {on.replace('s.', 'v.')} AND v.period = e.event),
rp{suffix} AS (
  SELECT e.*, base IS NOT NULL AND peak IS NOT NULL AS usable,
    CASE WHEN base IS NULL OR peak IS NULL THEN 'inconclusive' WHEN round_even(peak - base, 1) >= threshold THEN 'flagged' ELSE 'missed' END AS verdict,
    (SELECT min(s.period) FROM {scores} s WHERE {on} AND s.period BETWEEN e.event AND e.event + e.win AND s.risk_score = peak) AS peak_period,
    (SELECT e.event - min(s.period) FROM {scores} s WHERE {on} AND s.period BETWEEN e.baseline AND e.event AND peak - s.risk_score >= threshold) AS lead
  FROM pk{suffix} e),
ot{suffix} AS (
  SELECT {", ".join("e." + k for k in keys.split(", "))}, x.entity, max(e.threshold) AS threshold,
         max(x.risk_score) FILTER (x.period = e.baseline) AS base,
         max(x.risk_score) FILTER (x.period BETWEEN e.event AND e.event + e.win) AS peak
  FROM epx{suffix} e JOIN {scores} x ON {same}x.entity <> e.entity GROUP BY ALL),
dr{suffix} AS (
  SELECT {keys}, count(*) FILTER (peak - base >= threshold) AS risen, count(*) AS compared,
         round_even(count(*) FILTER (peak - base >= threshold) / count(*), 3)::DOUBLE AS peer_drift
  FROM ot{suffix} WHERE base IS NOT NULL AND peak IS NOT NULL GROUP BY ALL)"""


def ordinary(scores: str, win: int, threshold: float, exclude: bool, part: str = "") -> str:
    key = "scheme, " if part else ""
    gate = (
        "AND NOT EXISTS (SELECT 1 FROM ep x WHERE x.entity = a.entity AND (a.period = x.baseline OR a.period BETWEEN x.event - x.win AND x.event + x.win))"
        if exclude
        else ""
    )
    same = "AND y.scheme = a.scheme" if part else ""
    return f"""
tally AS (
  SELECT {key}count(*) FILTER (rise >= {threshold}) AS alarmed, count(*) FILTER (rise < {threshold}) AS quiet FROM (
    SELECT {'a.scheme, ' if part else ''}a.entity, a.period, max(y.risk_score) - max(a.risk_score) AS rise
    FROM {scores} a JOIN {scores} y ON y.entity = a.entity {same} AND y.period BETWEEN a.period AND a.period + {win}
    WHERE a.risk_score IS NOT NULL {gate} GROUP BY ALL) {'GROUP BY scheme' if part else ''})"""


R = f"{o.SC}, {EPISODES}, {replayed('scores')}"
D1 = "{0}::DOUBLE AS {1}"


def delta(a: str, name: str) -> str:
    return o.r6(f"(CASE WHEN usable THEN round_even({a} - base, 1)::DOUBLE END) AS {name}")


def rate(a: str, whole: str, name: str) -> str:
    return o.r6(f"(round_even(({a}) / nullif({whole}, 0), 3)::DOUBLE) AS {name}")


SUMMARY = f"""count(*) AS episodes_total, count(*) FILTER (verdict = 'flagged') AS flagged, count(*) FILTER (verdict = 'missed') AS missed,
  count(*) FILTER (verdict = 'inconclusive') AS inconclusive,
  {rate("count(*) FILTER (verdict = 'flagged')", "count(*) FILTER (verdict <> 'inconclusive')", 'detection_rate')},
  {o.r6("(round_even(median(CASE WHEN usable THEN round_even(peak - base, 1) END), 1)::DOUBLE) AS median_peak_delta")},
  first(label ORDER BY d.peer_drift DESC, episode) FILTER (usable AND d.peer_drift IS NOT NULL) AS systemic_episode,
  {o.r6("(max(d.peer_drift) FILTER (usable)) AS highest_peer_drift")}"""
METRICS = f"""tp AS true_positives, fn AS false_negatives, alarmed AS false_positives, quiet AS true_negatives,
  {rate('tp', 'tp + alarmed', 'precision')}, {rate('tp', 'tp + fn', 'recall')},
  {rate('alarmed', 'alarmed + quiet', 'false_positive_rate')}, {rate('fn', 'tp + fn', 'false_negative_rate')},
  {rate('tp + alarmed', 'tp + fn + alarmed + quiet', 'warning_frequency')}, {o.r6('(round_even(lead, 1)::DOUBLE) AS median_lead_time')}"""
COUNTS = "count(*) FILTER (verdict = 'flagged') AS tp, count(*) FILTER (verdict = 'missed') AS fn, median(lead) FILTER (verdict = 'flagged') AS lead"
WIDE_EP = o.values(
    "ep",
    "episode, entity, label, baseline, event, win, threshold",
    [(n, e.entity, e.label, e.baseline, e.event, 2, 1.5) for n, e in enumerate(EP)],
)


def _component(name: str, source: str, value: str, order: list[str]) -> str:
    position = "CASE " + " ".join(f"WHEN {name} = {o.lit(x)} THEN {n}" for n, x in enumerate(order)) + " END"
    return f"""d_{name} AS (
      SELECT episode, first({name} ORDER BY rise DESC, {position}) AS dominant_{name} FROM (
        SELECT r.episode, b.{name}, t.{value} - b.{value} AS rise FROM rp r
        JOIN {source} b ON b.entity = r.entity AND b.period = r.baseline
        JOIN {source} t ON t.entity = r.entity AND t.period = r.peak_period AND t.{name} = b.{name} WHERE usable) GROUP BY 1)"""


SCHEMES = f"""{o.SC}, {EPISODES}, {o.values('eq', 'pillar, w', list(M.equal_weights().pillar_weights.items()))},
both_schemes AS (
  SELECT 'weighted' AS scheme, entity, period, risk_score FROM scores
  UNION ALL SELECT 'equal_weight', entity, period, sum(pillar_score * w) / sum(w) FROM pil JOIN eq USING (pillar) GROUP BY 2, 3)"""

ORACLE = {
    "b3_replay": f"""{R} SELECT episode, entity, baseline, event, {o.r6('threshold::DOUBLE AS threshold')},
        {o.r6('(CASE WHEN usable THEN base END) AS baseline_score', '(CASE WHEN usable THEN ev END) AS event_score', '(CASE WHEN usable THEN peak END) AS peak_score')},
        CASE WHEN usable THEN peak_period END AS peak_period, {delta('ev', 'delta')}, {delta('peak', 'peak_delta')}, verdict FROM rp""",
    "b4_lead_time": f"{R} SELECT episode, entity, verdict, CASE WHEN verdict = 'flagged' THEN lead END AS lead_time FROM rp",
    "b5_drift": f"{R} SELECT episode, risen, compared, {o.r6('peer_drift')} FROM dr",
    "b6_dominant": f"""{R}, {_component('pillar', 'pil', 'pillar_score', list(M.active_pillars))}, {_component('sector', 'sec', 'sector_score', list(M.sectors))}
        SELECT episode, entity, verdict, dominant_pillar, dominant_sector FROM rp LEFT JOIN d_pillar USING (episode) LEFT JOIN d_sector USING (episode)""",
    "b7_summary": f"{R} SELECT {SUMMARY} FROM rp LEFT JOIN dr d USING (episode)",
    "b8_ordinary_windows": f"{R}, {ordinary('scores', 1, 3.0, True)} SELECT alarmed, quiet FROM tally",
    "b9_false_alarm": f"""{R}, {ordinary('scores', 2, 4.0, False)}
        SELECT alarmed, quiet, {rate('alarmed', 'alarmed + quiet', 'false_alarm_rate')} FROM tally""",
    "b10_metrics": f"""{R}, {ordinary('scores', 1, 3.0, True)}
        SELECT {METRICS}, {rate('tp', 'tp + fn', 'detection_rate')} FROM (SELECT {COUNTS} FROM rp), tally""",
    "b11_comparison": f"""{SCHEMES}, {replayed('both_schemes', part='scheme')}, {ordinary('both_schemes', 1, 3.0, True, 'scheme')}
        SELECT scheme, s.* EXCLUDE (scheme), m.* EXCLUDE (scheme) FROM
          (SELECT scheme, {SUMMARY} FROM rp LEFT JOIN dr d USING (scheme, episode) GROUP BY scheme) s
          JOIN (SELECT scheme, {METRICS} FROM (SELECT scheme, {COUNTS} FROM rp GROUP BY scheme) JOIN tally USING (scheme)) m USING (scheme)""",
    "b12_overrides": f"""{o.SC}, {WIDE_EP}, {replayed('scores')} SELECT episode, win AS "window", {o.r6('threshold::DOUBLE AS threshold', '(CASE WHEN usable THEN peak END) AS peak_score')},
        CASE WHEN usable THEN peak_period END AS peak_period, {delta('peak', 'peak_delta')}, verdict,
        CASE WHEN verdict = 'flagged' THEN lead END AS lead_time FROM rp""",
}
