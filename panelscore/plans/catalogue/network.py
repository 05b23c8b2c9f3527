"""Co-movement of nation x year scores."""

from __future__ import annotations

from panelscore.operators import network
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy
from panelscore.plans.catalogue.ranking import table
from panelscore.session import pin

STRONG = 0.9


def n1(spark, sf):
    return tidy(network.score_deltas(table(spark, sf)).select("entity", "period", "delta"))


def _found(spark, sf, threshold=network.THRESHOLD):
    vectors = pin(network.delta_vectors(table(spark, sf)))
    return vectors, network.correlations(vectors, threshold=threshold, whole=threshold == 0)


def n2(spark, sf):
    """The correlation matrix itself, upper half, of the 25 nations."""
    return tidy(network.pair_table(_found(spark, sf, 0.0)[1]))


def n4(spark, sf):
    return network.edges(_found(spark, sf)[1])


def n5(spark, sf):
    vectors, found = _found(spark, sf, STRONG)
    return network.clusters(vectors, pin(network.edges(found))).select("entity", "cluster")


def n6(spark, sf):
    found = pin(_found(spark, sf)[1])
    return network.nodes(found, network.edges(found))


def n7(spark, sf):
    found = pin(_found(spark, sf)[1])
    return network.summary(found, network.edges(found))


def n8(spark, sf):
    return network.strongest(network.edges(_found(spark, sf)[1]))


QUERIES = {
    "n1_deltas": n1,
    "n2_pairwise_corr": n2,
    "n4_edges": n4,
    "n5_components": n5,
    "n6_nodes": n6,
    "n7_summary": n7,
    "n8_strongest": n8,
}

DELTAS = f"""{o.SC}, yr AS (SELECT period, lag(period) OVER (ORDER BY period) AS adj FROM (SELECT DISTINCT period FROM scores WHERE risk_score IS NOT NULL)),
dl AS (
  SELECT a.entity, a.period, a.risk_score - p.risk_score AS delta FROM scores a JOIN yr USING (period)
  JOIN scores p ON p.entity = a.entity AND p.period = yr.adj WHERE a.risk_score IS NOT NULL AND p.risk_score IS NOT NULL)"""
PAIRS = f"""{DELTAS}, cr AS (
  SELECT a.entity AS a, b.entity AS b, count(*) AS pairs,
         CASE WHEN count(*) >= 4 AND stddev_pop(a.delta) > 0 AND stddev_pop(b.delta) > 0
              THEN covar_pop(a.delta, b.delta) / (stddev_pop(a.delta) * stddev_pop(b.delta)) END AS r
  FROM dl a JOIN dl b ON a.period = b.period AND a.entity < b.entity GROUP BY 1, 2),
cand AS (SELECT a, b, round_even(r, 4)::DOUBLE AS correlation, pairs FROM cr WHERE abs(r) >= {network.THRESHOLD}),
edg AS (SELECT * FROM cand),
nd AS (SELECT DISTINCT entity FROM scores WHERE risk_score IS NOT NULL)"""

ORACLE = {
    "n1_deltas": f"{DELTAS} SELECT entity, period, {o.r6('delta')} FROM dl",
    "n2_pairwise_corr": f"{PAIRS} SELECT a, b, {o.r6('r AS correlation')}, pairs FROM cr WHERE r IS NOT NULL",
    "n4_edges": f"{PAIRS} SELECT a, b, correlation, pairs FROM edg",
    "n5_components": f"""{PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)},
        und AS (SELECT a, b FROM cr WHERE abs(r) >= {STRONG} UNION ALL SELECT b, a FROM cr WHERE abs(r) >= {STRONG}),
        reach AS (SELECT entity, entity AS other FROM nd UNION SELECT reach.entity, und.b FROM reach JOIN und ON und.a = reach.other),
        lab AS (SELECT entity, min(other) AS label FROM reach GROUP BY 1)
        SELECT entity, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab""",
    "n6_nodes": f"""{PAIRS}, bothways AS (SELECT a AS entity, r FROM cr UNION ALL SELECT b, r FROM cr)
        SELECT entity, round_even(avg(abs(r)), 4)::DOUBLE AS integration,
          (SELECT count(*) FROM edg WHERE edg.a = nd.entity OR edg.b = nd.entity) AS degree
        FROM nd LEFT JOIN bothways USING (entity) GROUP BY entity""",
    "n7_summary": f"""{PAIRS} SELECT (SELECT count(*) FROM nd) AS entities,
        (SELECT count(*) * (count(*) - 1) // 2 FROM nd)::BIGINT AS pairs_considered,
        (SELECT round_even(avg(abs(r)), 4)::DOUBLE FROM cr) AS mean_abs_correlation, (SELECT count(*) FROM edg) AS edges,
        (SELECT round_even(avg((correlation >= 0)::INT), 4)::DOUBLE FROM edg) AS positive_edge_share""",
    "n8_strongest": f"{PAIRS} SELECT a, b, correlation, pairs FROM edg ORDER BY abs(correlation) DESC, a, b LIMIT 8",
}
