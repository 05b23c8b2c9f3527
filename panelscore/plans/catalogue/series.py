"""Time-series derivations on nation x year."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.operators import clean, derive
from panelscore.operators.derive import Derivation
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy
from panelscore.plans.catalogue.panel import NATION_ORDERS, _order_groups


def _rule(*rules: Derivation):
    def run(spark, sf):
        out = derive.derive(b.nation_long(spark, sf), rules)
        return tidy(out.select("entity", "indicator", "period", "value"))

    return run


def d9(spark, sf):
    quarterly = _order_groups(
        spark, sf, F.year("o_orderdate").cast("int").alias("period"), F.quarter("o_orderdate").alias("quarter")
    ).withColumn("v", F.col("top"))
    return derive.year_end(quarterly, ["entity", "period"], "quarter", "v", digits=None).select(
        "entity", "period", F.round("value", 4).alias("value")
    )


def d10(spark, sf):
    return tidy(derive.annual_mean(b.read(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice"), 4)


def _global_level(spark, sf):
    return derive.annual_mean(b.read(spark, sf, "lineitem"), [], "l_shipdate", "l_discount")


def d4(spark, sf):
    entities = b.read(spark, sf, "nation").select(F.col("n_name").alias("entity"))
    series = clean.fan_out(derive.global_yoy(_global_level(spark, sf)), entities)
    # The window saw every year; the request is cut afterwards.
    return tidy(clean.between_periods(series, 1996, 2000).select("entity", "period", "value"))


def p14(spark, sf):
    customers = b.read(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity"))
    return tidy(clean.fan_out(_global_level(spark, sf), customers).select("entity", "period", "value"), 9)


def d11(spark, sf):
    panel = b.nation_year(spark, sf)
    return tidy(derive.latest_deviation(panel, "DISCOUNT_TREND_DEV"))


QUERIES = {
    "d1_yoy": _rule(*[Derivation(f"{c}_YOY", c, "yoy", digits=None) for c in b.NATION_BASE]),
    "d2_level": _rule(Derivation("TAX_LEVEL", "AVG_TAX", "level", digits=None)),
    "d3_diff": _rule(Derivation("TAX_DIFF_BPS", "AVG_TAX", "diff_bps", digits=None, only_entity="NATION_7")),
    "d4_global_yoy": d4,
    "d5_trailing_gap": _rule(*[Derivation(f"{c}_GAP", c, "trailing_gap", digits=None) for c in ("ORDER_COUNT", "AVG_TAX")]),
    "d6_lag3": _rule(*[Derivation(f"{c}_3Y", c, "lag3", digits=None) for c in ("RETURN_SHARE", "OPEN_SHARE")]),
    "d7_ratio": _rule(Derivation("LINES_PER_ORDER", "LINE_COUNT", "ratio", other="ORDER_COUNT", digits=None)),
    "d8_centered_dev": _rule(*[Derivation(f"{c}_DEV", c, "centered", digits=None) for c in ("AVG_DISCOUNT", "AVG_ORDER_VALUE")]),
    "d9_year_end": d9,
    "d10_annual_mean": d10,
    "d11_latest_deviation": d11,
    "p14_fanout": p14,
}


def _w(select: str, where: str) -> str:
    return f"{o.FULL} SELECT entity, indicator, period, {o.r6('value')} FROM (SELECT entity, period, {select} FROM w WHERE {where})"


YEAR_MEAN = "SELECT year(l_shipdate)::INT AS period, avg(l_discount) AS value FROM lineitem GROUP BY 1"

ORACLE = {
    "d1_yoy": _w("indicator || '_YOY' AS indicator, (value - lag1) / nullif(lag1, 0) * 100 AS value", "true"),
    "d2_level": _w("'TAX_LEVEL' AS indicator, value", "indicator = 'AVG_TAX'"),
    "d3_diff": _w("'TAX_DIFF_BPS' AS indicator, (value - lag1) * 100 AS value", "indicator = 'AVG_TAX' AND entity = 'NATION_7'"),
    "d4_global_yoy": f"""WITH g AS ({YEAR_MEAN}), y AS (
        SELECT period, (value - lag(value) OVER (ORDER BY period)) / lag(value) OVER (ORDER BY period) * 100 AS value FROM g)
        SELECT n_name AS entity, period, {o.r6('value')} FROM y CROSS JOIN nation WHERE value IS NOT NULL AND period BETWEEN 1996 AND 2000""",
    "d5_trailing_gap": _w("indicator || '_GAP' AS indicator, CASE WHEN n3 >= 2 THEN value - mean3 END AS value", "indicator IN ('ORDER_COUNT', 'AVG_TAX')"),
    "d6_lag3": _w("indicator || '_3Y' AS indicator, value - lag3 AS value", "indicator IN ('RETURN_SHARE', 'OPEN_SHARE')"),
    "d7_ratio": f"{o.FULL} SELECT entity, indicator, period, {o.r6('value')} FROM derived WHERE indicator = 'LINES_PER_ORDER'",
    "d8_centered_dev": _w(
        "indicator || '_DEV' AS indicator, (value - mean5) / mean5 * 100 AS value",
        "indicator IN ('AVG_DISCOUNT', 'AVG_ORDER_VALUE') AND n5 >= 3 AND mean5 > 0",
    ),
    "d9_year_end": f"""SELECT entity, period, round(v, 4) AS value FROM (
          SELECT n_name AS entity, year(o_orderdate)::INT AS period, quarter(o_orderdate) AS q, max(o_totalprice) AS v
          FROM {NATION_ORDERS} GROUP BY 1, 2, 3)
        QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY q DESC) = 1""",
    "d10_annual_mean": """SELECT o_orderpriority, year(o_orderdate)::INT AS period, round(avg(o_totalprice), 4) AS value
        FROM orders GROUP BY 1, 2""",
    "d11_latest_deviation": f"""{o.PANEL}, l AS (SELECT entity, period, DISCOUNT_TREND_DEV AS latest FROM panel
          WHERE DISCOUNT_TREND_DEV IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) = 1)
        SELECT entity, period, {o.r6('latest')}, CASE WHEN latest > 0 THEN 'WEAKER than its 5-year trend'
          WHEN latest < 0 THEN 'STRONGER than its 5-year trend' ELSE 'AT its 5-year trend' END AS label FROM l""",
    "p14_fanout": f"SELECT 'C' || c_custkey AS entity, period, {o.r6('value', digits=9)} FROM ({YEAR_MEAN}) CROSS JOIN customer",
}
