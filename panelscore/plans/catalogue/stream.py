"""Observations that land in parts, merged by a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.operators import clean
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy, work_folder
from panelscore.streaming import upsert

PARTS, LATENESS = 3, 5


def _merged(spark, sf):
    """Three landings, each followed by a run of the stream; rows of one event in ten land every time, newer ones not later."""
    folder = work_folder(spark)
    obs = b.event_obs(spark, sf).withColumn("part", F.pmod(F.col("seq"), F.lit(7)) % PARTS)
    again = F.pmod(F.col("seq"), F.lit(10)) == 0
    table = None
    for k in range(PARTS):
        landing = obs.where((F.col("part") == k) | again).drop("part")
        landing.write.mode("append").parquet(f"{folder}/landed")
        table = upsert.run(spark, f"{folder}/landed", f"{folder}/table", f"{folder}/checkpoint", landing.schema, lateness=LATENESS)
    return table, f"{folder}/table"


def e1(spark, sf):
    table, _ = _merged(spark, sf)
    return tidy(clean.flag_quality(table, b.EVENT_MODEL).select("entity", "indicator", "period", "value", "source", "flag"))


def e1_facts(spark, sf):
    """What the stream says about itself: rows read, late ones, and the greatest period."""
    table, path = _merged(spark, sf)
    facts = upsert.versions.current(spark, path).facts
    counts = table.agg(F.count(F.lit(1)).alias("kept"))
    return counts.select("kept", *(F.lit(facts[k]).cast("long").alias(k) for k in ("rows", "late", "high")))


QUERIES = {"e1_stream_upsert": e1, "e1_stream_facts": e1_facts}

LANDED = f"""{o.EVENT_OBS}, l AS (
  SELECT part, period FROM raw, range({PARTS}) AS p(part) WHERE period IS NOT NULL AND ((seq % 7) % {PARTS} = part OR seq % 10 = 0)),
high AS (SELECT part, max(max(period)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l GROUP BY part)"""

ORACLE = {
    "e1_stream_upsert": f"{o.EVENT_OBS} SELECT entity, indicator, period, {o.r6('value')}, source, flag FROM clean",
    "e1_stream_facts": f"""{LANDED} SELECT (SELECT count(*) FROM clean) AS kept, count(*) AS rows,
        count(*) FILTER (period < before - {LATENESS}) AS late, max(period)::BIGINT AS high FROM l JOIN high USING (part)""",
}
