"""Plain SQL twins of the registered queries, for a second engine to check the results.

The shared prefix builds panel, z-scores, pillars and scores of the nation panel as CTEs. It is
written from the definitions, not from the Spark plans: long tables and self-joins throughout.
"""

from __future__ import annotations

from panelscore.plans import bindings as b

M = b.NATION_MODEL
P = M.params


def r6(*names: str, digits: int = 6) -> str:
    """Rounded output columns; a tiny negative must not print as -0.0."""
    out = []
    for name in names:
        expr, _, alias = name.partition(" AS ")
        out.append(
            f"CASE WHEN abs({expr}) < 0.5e-{digits} THEN 0.0 ELSE round({expr}, {digits}) END AS {alias or expr}"
        )
    return ", ".join(out)


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


BAND = (
    "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 20 THEN 'Low' WHEN {0} < 40 THEN 'Moderate' "
    "WHEN {0} < 60 THEN 'Elevated' WHEN {0} < 80 THEN 'High' ELSE 'Severe' END"
)
ZSCORE = "CASE WHEN {n} < {m} THEN NULL WHEN {s} <= 1e-12 * abs({mean}) THEN 0.0 ELSE ({v} - {mean}) / {s} END"


def band(x: str) -> str:
    return BAND.format(x)


BASE = """
dim AS (
  SELECT n_nationkey, n_name AS entity, r_name AS region, CASE WHEN n_regionkey < 4 THEN r_name END AS peer_group
  FROM nation JOIN region ON n_regionkey = r_regionkey),
bo AS (
  SELECT entity, year(o_orderdate)::INT AS period, sum(o_totalprice) / count(*) AS AVG_ORDER_VALUE,
         count(*)::DOUBLE AS ORDER_COUNT,
         count(*) FILTER (o_orderstatus = 'O') / count(*) AS OPEN_SHARE,
         count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS URGENT_SHARE
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN dim ON c_nationkey = n_nationkey GROUP BY 1, 2),
bl AS (
  SELECT entity, year(l_shipdate)::INT AS period, avg(l_discount) AS AVG_DISCOUNT,
         avg(l_tax) AS AVG_TAX, count(*) FILTER (l_returnflag = 'R') / count(*) AS RETURN_SHARE,
         count(*)::DOUBLE AS LINE_COUNT
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN dim ON s_nationkey = n_nationkey GROUP BY 1, 2),
base AS (
  SELECT coalesce(bo.entity, bl.entity) AS entity, coalesce(bo.period, bl.period) AS period,
         AVG_ORDER_VALUE, ORDER_COUNT, OPEN_SHARE, URGENT_SHARE, AVG_DISCOUNT, AVG_TAX, RETURN_SHARE, LINE_COUNT
  FROM bo FULL JOIN bl ON bo.entity = bl.entity AND bo.period = bl.period)"""


def _base_long() -> str:
    parts = [
        f"SELECT entity, period, '{c}' AS indicator, {c} AS value FROM base WHERE {c} IS NOT NULL" for c in b.NATION_BASE
    ]
    return "obs AS (" + " UNION ALL ".join(parts) + ")"


DERIVED = """
w AS (
  SELECT *, lag(value, 1) OVER s AS lag1, lag(value, 3) OVER s AS lag3,
         avg(value) OVER (s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3,
         count(value) OVER (s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3,
         avg(value) OVER (s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean5,
         count(value) OVER (s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n5
  FROM obs WINDOW s AS (PARTITION BY entity, indicator ORDER BY period)),
derived AS (
  SELECT entity, period, 'ORDER_VALUE_YOY' AS indicator, (value - lag1) / nullif(lag1, 0) * 100 AS value
  FROM w WHERE indicator = 'AVG_ORDER_VALUE'
  UNION ALL SELECT entity, period, 'ORDER_COUNT_GAP', CASE WHEN n3 >= 2 THEN value - mean3 END
  FROM w WHERE indicator = 'ORDER_COUNT'
  UNION ALL SELECT entity, period, 'RETURN_SHARE_3Y', value - lag3 FROM w WHERE indicator = 'RETURN_SHARE'
  UNION ALL SELECT entity, period, 'DISCOUNT_TREND_DEV', (value - mean5) / mean5 * 100
  FROM w WHERE indicator = 'AVG_DISCOUNT' AND n5 >= 3 AND mean5 > 0
  UNION ALL SELECT a.entity, a.period, 'LINES_PER_ORDER', a.value / d.value
  FROM obs a JOIN obs d ON a.entity = d.entity AND a.period = d.period
  WHERE a.indicator = 'LINE_COUNT' AND d.indicator = 'ORDER_COUNT' AND d.value > 0),
full_long AS (SELECT * FROM obs UNION ALL SELECT * FROM derived WHERE value IS NOT NULL)"""


def _panel() -> str:
    cells = ", ".join(f"max(value) FILTER (indicator = '{c}') AS {c}" for c in M.codes)
    return f"panel0 AS (SELECT entity, period, {cells} FROM full_long GROUP BY 1, 2), panel AS (SELECT panel0.*, peer_group, coalesce(peer_group, '__all__') AS grp FROM panel0 JOIN dim USING (entity))"


def _model() -> str:
    rows = [(i.code, i.name, i.category, i.pillar, float(i.weight), float(i.direction), i.unit) for i in M.indicators]
    pillars = [
        (p, float(w), next((s for s, listed in M.sectors.items() if p in listed), None), n)
        for n, (p, w) in enumerate(M.pillar_weights.items())
    ]
    return ", ".join(
        [
            values("ind", "indicator, label, category, pillar, weight, risk_direction, unit", rows),
            values("pw", "pillar, pillar_weight, sector, pillar_order", pillars),
            values("sw", "sector, sector_weight", [(s, float(w)) for s, w in M.sector_weights.items()]),
        ]
    )


def _cells(panel: str = "panel", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}entity, period, grp, '{c}' AS indicator, {c} AS v FROM {panel}" for c in M.codes
    )


def zscores(panel: str = "panel", suffix: str = "", extra: str = "") -> str:
    """CTEs cells, zz (z table) and drv (driver table) of a wide panel."""
    by = extra.replace(" ", "").rstrip(",")
    part = f"{by}, " if by else ""
    using = f"{part}indicator, period, grp"
    return f"""
cells{suffix} AS ({_cells(panel, extra)}),
peer{suffix} AS (
  SELECT {using}, count(v) AS pn, avg(v) AS pm, stddev_pop(v) AS ps FROM cells{suffix} GROUP BY ALL),
zz{suffix} AS (
  SELECT *, {ZSCORE.format(n="hn", m=P.min_history_obs, s="hs", v="v", mean="hm")} AS z_time,
         {ZSCORE.format(n="pn", m=P.min_peer_obs, s="ps", v="v", mean="pm")} AS z_peer
  FROM (SELECT *, count(v) OVER s AS hn, avg(v) OVER s AS hm, stddev_pop(v) OVER s AS hs FROM cells{suffix}
        WINDOW s AS (PARTITION BY {part}entity, indicator ORDER BY period ROWS UNBOUNDED PRECEDING)) h
  JOIN peer{suffix} USING ({using})),
drv{suffix} AS (
  SELECT *, z_combined * risk_direction AS z_risk, z_combined * risk_direction * weight AS weighted_contribution
  FROM (SELECT *, coalesce((coalesce(z_time, 0) * {P.history_z_weight} + coalesce(z_peer, 0) * {P.peer_z_weight})
          / nullif((z_time IS NOT NULL)::INT * {P.history_z_weight} + (z_peer IS NOT NULL)::INT * {P.peer_z_weight}, 0), 0)
          AS z_combined FROM zz{suffix}) c JOIN ind USING (indicator))"""


def rollup(suffix: str = "", by: str = "") -> str:
    """CTEs pil, sec, sc: pillars, sectors, composite."""
    part = f"{by}, " if by else ""
    keys = f"{part}entity, period"
    beta = P.sector_composite_weight
    return f"""
pil{suffix} AS (
  SELECT {keys}, pillar, pillar_weight, sector, pillar_order, greatest(0.0, least(100.0, 50.0 + 18.0 * c / a)) AS pillar_score
  FROM (SELECT {keys}, pillar, sum(weighted_contribution) AS c,
               sum(CASE WHEN v IS NOT NULL THEN weight ELSE 0 END) AS a FROM drv{suffix} GROUP BY ALL) g
  JOIN pw USING (pillar) WHERE a > 0),
sec{suffix} AS (
  SELECT {keys}, sector, sum(pillar_score * pillar_weight) / sum(pillar_weight) AS sector_score FROM pil{suffix} GROUP BY ALL),
sc{suffix} AS (
  SELECT {keys}, completeness AS data_completeness, sector_score,
         {1.0 - beta} * pillar_view + {beta} * sector_score AS risk_score
  FROM (SELECT {keys}, least(1.0, round(sum(CASE WHEN v IS NOT NULL THEN weight ELSE 0 END), 6) / {M.total_weight}) AS completeness
        FROM drv{suffix} GROUP BY ALL) k
  LEFT JOIN (SELECT {keys}, sum(pillar_score * pillar_weight) / sum(pillar_weight) AS pillar_view FROM pil{suffix} GROUP BY ALL) p USING ({keys})
  LEFT JOIN (SELECT {keys}, sum(sector_score * sector_weight) / sum(sector_weight) AS sector_score
             FROM sec{suffix} JOIN sw USING (sector) GROUP BY ALL) s USING ({keys}))"""


SCORES = f"""
sc1 AS (
  SELECT *, {band('risk_score')} AS risk_band,
         risk_score - lag(risk_score, 1) OVER s AS trend_1y_delta, risk_score - lag(risk_score, 2) OVER s AS trend_2y_delta
  FROM sc WINDOW s AS (PARTITION BY entity ORDER BY period)),
scores AS (
  SELECT *, CASE WHEN trend_1y_delta IS NULL THEN NULL WHEN abs(trend_1y_delta) <= {P.trend_threshold_points} THEN 'Stable'
                 WHEN trend_1y_delta > 0 THEN 'Deteriorating' ELSE 'Improving' END AS trend_direction
  FROM sc1 JOIN (SELECT entity, peer_group FROM dim) USING (entity))"""

LONG = f"WITH {BASE}, {_base_long()}"
FULL = f"{LONG}, {DERIVED}"
PANEL = f"{FULL}, {_panel()}, {_model()}"
Z = f"{PANEL}, {zscores()}"
SC = f"{Z}, {rollup()}, {SCORES}"

EVENT_OBS = """
WITH raw AS (
  SELECT 'U' || user_id AS entity, event_type AS indicator,
         CASE WHEN event_id % 101 = 0 THEN NULL ELSE date_diff('day', DATE '2024-01-01', ts::DATE) END::INT AS period,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value, 'feed-' || (user_id % 3) AS source,
         epoch_us(ts) * 1000 + event_id % 1000 AS seq
  FROM events),
flagged AS (
  SELECT raw.*, CASE WHEN value IS NULL THEN 'missing' WHEN value < low OR value > high THEN 'out_of_range' ELSE 'ok' END AS flag
  FROM raw JOIN bounds USING (indicator)),
clean AS (
  SELECT * FROM flagged WHERE period IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entity, indicator, period ORDER BY seq DESC) = 1)
""".replace("WITH raw", "WITH " + values("bounds", "indicator, low, high", [(t, *v) for t, v in b.EVENT_BOUNDS.items()]) + ", raw")
