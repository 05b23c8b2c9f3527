"""Ratings derived from the nation table against nation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.operators import benchmark
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy
from panelscore.plans.catalogue.ranking import table

SP = benchmark.LETTERS_SP_FITCH
MO = benchmark.LETTERS_MOODYS


def ratings(spark, sf):
    """Two or three letters per nation, one of them unknown to every scale."""
    n = b.read(spark, sf, "nation").withColumnRenamed("n_name", "entity")
    key = F.col("n_nationkey")
    first = F.element_at(F.array(*[F.lit(x) for x in SP]), (key % 21 + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(x) for x in MO]), (key * 2 % 21 + 1).cast("int"))
    third = F.when(key % 3 == 0, None).when(key == 4, "ZZ+").when(key == 7, "D").otherwise(first)
    letters = F.array(
        F.struct(F.lit("S&P").alias("agency"), first.alias("letter")),
        F.struct(F.lit("Moody's").alias("agency"), second.alias("letter")),
        F.struct(F.lit("Fitch").alias("agency"), third.alias("letter")),
    )
    return n.select(F.lower("entity").alias("entity"), F.explode(letters).alias("_l")).select("entity", "_l.*")


def a1(spark, sf):
    r = ratings(spark, sf)
    return r.select(F.upper("entity").alias("entity"), "agency", "letter", benchmark.ordinal(F.col("agency"), F.col("letter")).alias("ordinal"))


def a2(spark, sf):
    return benchmark.reference(ratings(spark, sf))


def a4(spark, sf):
    return tidy(benchmark.compare(table(spark, sf), ratings(spark, sf)))


def a5(spark, sf):
    return tidy(benchmark.agreement(benchmark.compare(table(spark, sf), ratings(spark, sf))))


QUERIES = {"a1_ordinals": a1, "a2_reference": a2, "a4_benchmark": a4, "a5_spearman": a5}

RATED = f"""rt AS (
  SELECT n_name AS entity, n_nationkey AS k, ({list(SP)})[n_nationkey % 21 + 1] AS sp, ({list(MO)})[n_nationkey * 2 % 21 + 1] AS mo FROM nation),
lt AS (
  SELECT entity, 'S&P' AS agency, sp AS letter FROM rt UNION ALL SELECT entity, 'Moody''s', mo FROM rt
  UNION ALL SELECT entity, 'Fitch', CASE WHEN k % 3 = 0 THEN NULL WHEN k = 4 THEN 'ZZ+' WHEN k = 7 THEN 'D' ELSE sp END FROM rt),
od AS (
  SELECT *, CASE WHEN agency = 'Moody''s' THEN list_position({list(MO)}, letter) WHEN letter = 'D' THEN 21
                 ELSE list_position({list(SP)}, letter) END::DOUBLE AS ord FROM lt),
rf AS (
  SELECT entity, round_even(avg(ord), 3)::DOUBLE AS ordinal, round_even((avg(ord) - 1) / 20 * 100, 1)::DOUBLE AS reference_risk
  FROM od WHERE ord > 0 GROUP BY 1)"""
COMPARED = f"""{o.SC}, {RATED},
ls AS (SELECT * FROM scores WHERE risk_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) = 1),
cm AS (SELECT entity, ordinal, reference_risk, risk_score AS engine_score, risk_band AS engine_band,
              risk_band = {o.band('reference_risk')} AS bands_match FROM rf JOIN ls USING (entity)),
rk AS (SELECT *, rank() OVER (ORDER BY engine_score) + (count(*) OVER (PARTITION BY engine_score) - 1) / 2 AS rx,
              rank() OVER (ORDER BY reference_risk) + (count(*) OVER (PARTITION BY reference_risk) - 1) / 2 AS ry FROM cm)"""

ORACLE = {
    "a1_ordinals": f"WITH {RATED} SELECT entity, agency, letter, nullif(ord, 0) AS ordinal FROM od",
    "a2_reference": f"WITH {RATED} SELECT entity, ordinal, reference_risk FROM rf",
    "a4_benchmark": f"{COMPARED} SELECT entity, {o.r6('ordinal', 'reference_risk', 'engine_score')}, engine_band, bands_match FROM cm",
    "a5_spearman": f"""{COMPARED} SELECT count(*) AS n, {o.r6('(round_even(corr(rx, ry), 3)::DOUBLE) AS spearman', '(round_even(avg(bands_match::INT), 3)::DOUBLE) AS band_match_share')} FROM rk""",
}
