"""The same operators on panels that grow with the data: supplier x month and user x day."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.functions import ranks
from panelscore.operators import accrue, asof, backtest, episodes, history, network, pruned, rank
from panelscore.operators import score as scoring
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy, work_folder
from panelscore.session import pin

S, U = b.SUPPLIER_MODEL, b.EVENT_MODEL


def supplier_scores(spark, sf):
    return scoring.score_panel(b.supplier_month(spark, sf), S)


def user_scores(spark, sf):
    return scoring.score_panel(b.user_day(spark, sf), U)


def scale_z(spark, sf):
    return tidy(supplier_scores(spark, sf).select("entity", "period", "data_completeness", "risk_score", "trend_1y_delta"))


def scale_users(spark, sf):
    return tidy(user_scores(spark, sf).select("entity", "period", "data_completeness", "risk_score", "risk_band"))


def scale_standing(spark, sf):
    scores = pin(user_scores(spark, sf).select("entity", "period", "peer_group", F.round("risk_score", 6).alias("risk_score")))
    return rank.peer_standing(scores)


def scale_b9(spark, sf):
    tally = backtest.ordinary_windows(supplier_scores(spark, sf), window=3, threshold=5.0)
    return tidy(backtest.false_alarm_rate(tally))


def order_episodes(spark, sf):
    """An episode from every order: a supplier by its number, the month ordered as baseline, windows and thresholds in turn."""
    k, month = F.col("o_orderkey"), F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return b.read(spark, sf, "orders").select(
        k.alias("episode"), F.concat(F.lit("s"), (k % 997 % 103 + 1).cast("string")).alias("entity"), month.alias("baseline"),
        (month + 1 + k % 6).cast("int").alias("event"), (k % 3).cast("int").alias("window"), (F.lit(2.0) + k % 4).alias("threshold"),
    )


def scale_episodes(spark, sf):
    scores = pin(supplier_scores(spark, sf).select("entity", "period", "risk_score"))
    found = pin(episodes.replay(scores, order_episodes(spark, sf)))
    drift = episodes.peer_drift(scores, found)
    return tidy(found.join(drift, "episode", "left").select("episode", "verdict", "peak_period", "peak_delta", "delta", "lead_time", "risen", "compared", "peer_drift"))


def scale_ordinary(spark, sf):
    """Ordinary windows of the suppliers without what an episode of every 20th order excludes."""
    few = order_episodes(spark, sf).where("episode % 20 = 0")
    return episodes.ordinary_windows(supplier_scores(spark, sf), few, window=2, threshold=4.0)


def score_vintages(spark, sf):
    """Supplier scores twice: from the first two lines of each order, known half a month after the period, and from all, known two months later."""
    out = None
    for vintage, lines, days in ((1, "l_linenumber <= 2", 15), (2, "true", 75)):
        scores = scoring.score_panel(b.supplier_month(spark, sf, lines), S).where("risk_score IS NOT NULL")
        ended = F.make_date(F.floor(F.col("period") / 12).cast("int"), F.lit(1), F.lit(1))
        known = F.date_add(F.add_months(ended, F.col("period") % 12), days)
        part = scores.select("entity", "period", known.alias("known_at"), F.lit(vintage).alias("vintage"), "risk_score")
        out = part if out is None else out.unionByName(part)
    return out


def point_in_time(spark, sf):
    """For every order, what was known of a supplier on its day: the newest period, in its newest vintage."""
    k = F.col("o_orderkey")
    questions = b.read(spark, sf, "orders").select(
        k.alias("question"), F.concat(F.lit("s"), (k % 997 % 103 + 1).cast("string")).alias("entity"), F.col("o_orderdate").cast("date").alias("asked_at")
    )
    return tidy(asof.known_scores(score_vintages(spark, sf), questions, by_period=False))


def point_in_time_period(spark, sf):
    """The same questions about the period two months before the day."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    questions = b.read(spark, sf, "orders").select(
        k.alias("question"), F.concat(F.lit("s"), (k % 997 % 103 + 1).cast("string")).alias("entity"), day.alias("asked_at"),
        (F.year(day) * 12 + F.month(day) - 2).alias("period"),
    )
    return tidy(asof.known_scores(score_vintages(spark, sf), questions))


def sketched_medians(spark, sf):
    """Median scores by day from the merged sketches of three loads: are they within three times the stated rank error?"""
    scores = pin(user_scores(spark, sf).select("entity", "period", "risk_score"))
    part = F.pmod(F.xxhash64("entity"), F.lit(3))
    sketches = accrue.quantile_sketches(scores.where(part == 0), ["period"], "risk_score")
    for k in (1, 2):
        sketches = accrue.merge_sketches(sketches, accrue.quantile_sketches(scores.where(part == k), ["period"], "risk_score"), ["period"])
    found = pin(accrue.quantiles(sketches, ["period"], {"median": 0.5}))
    table = ranks.rank_table(scores, ["period"], "risk_score").withColumnRenamed("period", "_period")
    here = (F.col("period") == F.col("_period")) & (F.col("median") == F.col("risk_score"))
    slack = 3 * accrue.rank_error() * F.col("n_total") + 1
    within = (F.col("n_less") - slack <= F.col("n_total") / 2) & (F.col("n_total") / 2 <= F.col("n_less") + F.col("n_equal") + slack)
    return found.join(table, here, "left").select("period", F.col("n").cast("long").alias("n"), F.coalesce(within, F.lit(False)).alias("within"))


def scale_n2(spark, sf):
    """Edges among all suppliers, in several blocks."""
    vectors = pin(network.delta_vectors(supplier_scores(spark, sf)))
    found = network.correlations(vectors, min_pairs=12, threshold=0.4, block_rows=64)
    return tidy(network.pair_table(found))


def z1_incremental(spark, sf):
    """Suppliers scored in four loads, the last of them repeated, each from the state that the one before left."""
    path, panel = work_folder(spark), b.supplier_month(spark, sf)
    cuts = (1993 * 12, 1994 * 12 + 6, 1997 * 12, 1997 * 12, 10**6)
    parts = [history.advance(spark, path, panel.where(F.col("period") < cut), S) for cut in cuts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return tidy(out.select("entity", "period", "data_completeness", "risk_score", "trend_1y_delta", "trend_2y_delta", "trend_direction"))


def pruned_edges(spark, sf):
    """The same edges over blocks that the triangle inequality does not part."""
    vectors = pin(network.delta_vectors(supplier_scores(spark, sf)))
    return tidy(pruned.edges(vectors, min_pairs=12, threshold=0.4, block_rows=64)[0])


QUERIES = {
    "n4_pruned_edges": pruned_edges,
    "z1_incremental": z1_incremental,
    "scale_z": scale_z,
    "scale_users": scale_users,
    "scale_standing": scale_standing,
    "scale_b9": scale_b9,
    "scale_episodes": scale_episodes,
    "scale_ordinary": scale_ordinary,
    "r7_sketched_medians": sketched_medians,
    "p9_point_in_time": point_in_time,
    "s12_vintage_of_period": point_in_time_period,
    "scale_n2": scale_n2,
}


def scored(panel: str, model) -> str:
    """CTEs up to ``ss`` for a pillar-only model on a wide panel CTE ``pan``."""
    p = model.params
    cells = " UNION ALL ".join(f"SELECT entity, period, peer_group AS grp, '{c}' AS indicator, {c} AS v FROM pan" for c in model.codes)
    ind = o.values("im", "indicator, pillar, weight, dir", [(i.code, i.pillar, float(i.weight), float(i.direction)) for i in model.indicators])
    pw = o.values("pw", "pillar, pillar_weight", [(k, float(w)) for k, w in model.pillar_weights.items()])
    return f"""WITH {panel}, {ind}, {pw}, cells AS ({cells}),
peer AS (SELECT indicator, period, grp, count(v) AS pn, avg(v) AS pm, stddev_pop(v) AS ps FROM cells GROUP BY ALL),
zz AS (
  SELECT *, {o.ZSCORE.format(n="hn", m=p.min_history_obs, s="hs", v="v", mean="hm")} AS zt, {o.ZSCORE.format(n="pn", m=p.min_peer_obs, s="ps", v="v", mean="pm")} AS zp
  FROM (SELECT *, count(v) OVER s AS hn, avg(v) OVER s AS hm, stddev_pop(v) OVER s AS hs FROM cells
        WINDOW s AS (PARTITION BY entity, indicator ORDER BY period ROWS UNBOUNDED PRECEDING)) JOIN peer USING (indicator, period, grp)),
ct AS (
  SELECT *, coalesce((coalesce(zt, 0) * {p.history_z_weight} + coalesce(zp, 0) * {p.peer_z_weight})
    / nullif((zt IS NOT NULL)::INT * {p.history_z_weight} + (zp IS NOT NULL)::INT * {p.peer_z_weight}, 0), 0) * dir * weight AS c FROM zz JOIN im USING (indicator)),
pl AS (SELECT entity, period, pillar, greatest(0.0, least(100.0, 50.0 + 18.0 * sum(c) / sum(CASE WHEN v IS NOT NULL THEN weight END))) AS ps
       FROM ct GROUP BY ALL HAVING sum(CASE WHEN v IS NOT NULL THEN weight END) > 0),
ss AS (
  SELECT entity, period, grp, completeness AS data_completeness, risk_score, risk_score - lag(risk_score) OVER (PARTITION BY entity ORDER BY period) AS trend_1y_delta
  FROM (SELECT entity, period, grp, least(1.0, round(sum(CASE WHEN v IS NOT NULL THEN weight ELSE 0 END), 6) / {model.total_weight}) AS completeness FROM ct GROUP BY ALL)
  LEFT JOIN (SELECT entity, period, sum(ps * pillar_weight) / sum(pillar_weight) AS risk_score FROM pl JOIN pw USING (pillar) GROUP BY ALL) USING (entity, period))"""


SUPPLIER_PANEL = """pan AS (SELECT 'S' || l_suppkey AS entity, n_name AS peer_group, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS period,
      sum(l_extendedprice * (1 - l_discount)) AS REVENUE, avg(l_discount) AS DISCOUNT, count(*) FILTER (l_returnflag = 'R') / count(*) AS RETURN_SHARE
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE {lines} GROUP BY ALL)"""
SUPPLIERS = scored(SUPPLIER_PANEL.format(lines="true"), S)
USERS = scored(
    f"""pan AS (SELECT 'U' || user_id AS entity, 'G' || (user_id % 5) AS peer_group, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS period,
      {", ".join(f"avg(value) FILTER (event_type = '{t}') AS {t}" for t in b.EVENT_TYPES)} FROM events GROUP BY ALL)""",
    U,
)

KNOWN = "CAST(make_date((period // 12)::INT, 1, 1) + to_months((period % 12)::INT) + to_days({days}) AS DATE)"
VINTAGES = "WITH vi AS (" + " UNION ALL ".join(
    f"SELECT entity, period, {KNOWN.format(days=days)} AS asked_at, {vintage}::INT AS vintage, risk_score FROM ({scored(SUPPLIER_PANEL.format(lines=lines), S)} SELECT * FROM ss WHERE risk_score IS NOT NULL)"
    for vintage, lines, days in ((1, "l_linenumber <= 2", 15), (2, "true", 75))
) + """), one AS (SELECT * FROM vi QUALIFY row_number() OVER (PARTITION BY entity, asked_at ORDER BY period DESC, vintage DESC) = 1),
qu AS (SELECT o_orderkey AS question, 'S' || (o_orderkey % 997 % 103 + 1) AS entity, o_orderdate::DATE AS asked_at, (year(o_orderdate) * 12 + month(o_orderdate) - 2)::INT AS period FROM orders)"""
ORDER_EPISODES = """ep AS (SELECT o_orderkey AS episode, 'S' || (o_orderkey % 997 % 103 + 1) AS entity, m AS baseline, (m + 1 + o_orderkey % 6)::INT AS event,
  (o_orderkey % 3)::INT AS win, 2.0 + o_orderkey % 4 AS threshold FROM (SELECT *, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS m FROM orders))"""
REPLAYED = f"""{SUPPLIERS}, r AS MATERIALIZED (SELECT entity, period, risk_score AS s FROM ss WHERE risk_score IS NOT NULL), {ORDER_EPISODES},
pk AS (SELECT episode, max(s) AS peak_score, arg_max(period, (s, -period)) AS peak_period FROM ep JOIN r ON r.entity = ep.entity AND period BETWEEN event AND event + win GROUP BY 1),
j AS (SELECT ep.*, x.s AS bs, y.s AS es, peak_score, peak_period, round_even(peak_score - x.s, 1)::DOUBLE + 0.0 AS rise FROM ep LEFT JOIN pk USING (episode)
  LEFT JOIN r x ON x.entity = ep.entity AND x.period = baseline LEFT JOIN r y ON y.entity = ep.entity AND y.period = event),
fi AS (SELECT episode, min(period) AS first FROM j JOIN r ON r.entity = j.entity AND period BETWEEN baseline AND event AND peak_score - s >= threshold WHERE rise >= threshold GROUP BY 1),
wi AS (SELECT DISTINCT baseline, event, win FROM ep), th AS (SELECT DISTINCT baseline, event, win, threshold FROM ep),
pe AS (SELECT w.*, b.entity, max(p.s) - any_value(b.s) AS rise FROM wi w JOIN r b ON b.period = w.baseline JOIN r p ON p.entity = b.entity AND p.period BETWEEN event AND event + win GROUP BY ALL),
co AS (SELECT baseline, event, win, threshold, count(*) FILTER (rise >= threshold) AS risen, count(*) AS compared FROM pe JOIN th USING (baseline, event, win) GROUP BY ALL),
dr AS (SELECT episode, risen - coalesce(peak_score - bs >= threshold, false)::INT AS risen, compared - (bs IS NOT NULL AND peak_score IS NOT NULL)::INT AS compared
  FROM j JOIN co USING (baseline, event, win, threshold))"""

EDGES = f"""{SUPPLIERS}, yr AS (SELECT period, lag(period) OVER (ORDER BY period) AS adj FROM (SELECT DISTINCT period FROM ss WHERE risk_score IS NOT NULL)),
    dl AS (SELECT a.entity, a.period, a.risk_score - x.risk_score AS delta FROM ss a JOIN yr USING (period) JOIN ss x ON x.entity = a.entity AND x.period = adj
               WHERE a.risk_score IS NOT NULL AND x.risk_score IS NOT NULL),
    cr AS (SELECT a.entity AS a, b.entity AS b, count(*) AS pairs, corr(a.delta, b.delta) AS r FROM dl a JOIN dl b ON a.period = b.period AND a.entity < b.entity GROUP BY 1, 2)
    SELECT a, b, {o.r6('r AS correlation')}, pairs FROM cr WHERE pairs >= 12 AND abs(r) >= 0.4"""

ORACLE = {
    "scale_episodes": f"""{REPLAYED} SELECT episode, CASE WHEN rise IS NULL THEN 'inconclusive' WHEN rise >= threshold THEN 'flagged' ELSE 'missed' END AS verdict,
        CASE WHEN rise IS NOT NULL THEN peak_period END AS peak_period, rise AS peak_delta, CASE WHEN rise IS NOT NULL THEN round_even(es - bs, 1)::DOUBLE + 0.0 END AS delta,
        event - first AS lead_time, d.risen::BIGINT AS risen, d.compared::BIGINT AS compared, round_even(d.risen / d.compared, 3)::DOUBLE AS peer_drift
        FROM j LEFT JOIN fi USING (episode) LEFT JOIN (SELECT * FROM dr WHERE compared > 0) d USING (episode)""",
    "r7_sketched_medians": f"{USERS} SELECT period, count(risk_score) AS n, true AS within FROM ss WHERE risk_score IS NOT NULL GROUP BY period",
    "p9_point_in_time": f"""{VINTAGES} SELECT question, qu.entity AS entity, qu.asked_at AS asked_at, one.asked_at AS matched_at, one.period AS period, vintage, {o.r6('risk_score')}
        FROM qu ASOF LEFT JOIN one ON qu.entity = one.entity AND qu.asked_at >= one.asked_at""",
    "s12_vintage_of_period": f"""{VINTAGES} SELECT question, qu.entity AS entity, qu.asked_at AS asked_at, qu.period AS period, vi.asked_at AS matched_at, vintage, {o.r6('risk_score')}
        FROM qu ASOF LEFT JOIN vi ON qu.entity = vi.entity AND qu.period = vi.period AND qu.asked_at >= vi.asked_at""",
    "scale_ordinary": f"""{SUPPLIERS}, {ORDER_EPISODES}, ex AS (SELECT entity, unnest([baseline] || range(event - win, event + win + 1)) AS period FROM ep WHERE episode % 20 = 0),
        r AS (SELECT a.entity, a.period, max(y.risk_score) - any_value(a.risk_score) AS rise FROM ss a
          JOIN ss y ON y.entity = a.entity AND y.period BETWEEN a.period AND a.period + 2 WHERE a.risk_score IS NOT NULL GROUP BY 1, 2)
        SELECT count(*) FILTER (rise >= 4) AS alarmed, count(*) FILTER (rise < 4) AS quiet FROM r WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.entity = r.entity AND ex.period = r.period)""",
    "scale_z": f"{SUPPLIERS} SELECT entity, period, {o.r6('data_completeness::DOUBLE AS data_completeness', 'risk_score', 'trend_1y_delta')} FROM ss",
    "z1_incremental": f"""{SUPPLIERS}, d AS (SELECT *, risk_score - lag(risk_score, 2) OVER (PARTITION BY entity ORDER BY period) AS trend_2y_delta FROM ss)
        SELECT entity, period, {o.r6('data_completeness::DOUBLE AS data_completeness', 'risk_score', 'trend_1y_delta', 'trend_2y_delta')},
          CASE WHEN trend_1y_delta IS NULL THEN NULL WHEN abs(trend_1y_delta) <= {S.params.trend_threshold_points} THEN 'Stable'
            WHEN trend_1y_delta > 0 THEN 'Deteriorating' ELSE 'Improving' END AS trend_direction FROM d""",
    "scale_users": f"""{USERS} SELECT entity, period, {o.r6('data_completeness::DOUBLE AS data_completeness', 'risk_score')}, {o.band('risk_score')} AS risk_band FROM ss""",
    "scale_standing": f"""{USERS}, rs AS (SELECT entity, period, grp, round(risk_score, 6) AS r FROM ss WHERE risk_score IS NOT NULL),
        k AS (SELECT *, count(*) OVER (PARTITION BY period, grp) - 1 AS n, rank() OVER (PARTITION BY period, grp ORDER BY r DESC) AS rank FROM rs)
        SELECT entity, period, CASE WHEN n > 0 THEN round_even((n - rank + 1) * 100.0 / n, 0)::INT END AS percentile,
          CASE WHEN n > 0 THEN round_even((rank - 1) * 100.0 / n, 0)::INT END AS riskier_share, CASE WHEN n > 0 THEN rank END AS rank, n, grp AS group_name FROM k""",
    "scale_b9": f"""{SUPPLIERS}, r AS (SELECT a.entity, a.period, max(y.risk_score) - any_value(a.risk_score) AS rise FROM ss a
          JOIN ss y ON y.entity = a.entity AND y.period BETWEEN a.period AND a.period + 3 WHERE a.risk_score IS NOT NULL GROUP BY 1, 2),
        q AS (SELECT count(*) FILTER (rise >= 5) AS alarmed, count(*) FILTER (rise < 5) AS quiet FROM r)
        SELECT alarmed, quiet, {o.r6('(round_even(alarmed / (alarmed + quiet), 3)::DOUBLE) AS false_alarm_rate')} FROM q""",
    "scale_n2": EDGES,
    "n4_pruned_edges": EDGES,
}
