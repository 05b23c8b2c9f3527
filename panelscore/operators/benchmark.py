"""Comparison of scores with external ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscore.functions.ranks import rank_table
from panelscore.functions.scalar import band
from panelscore.functions.stats import safe_corr
from panelscore.schema import ENTITY, PERIOD
from panelscore.session import pin

# Long-term scales from safest (1) to default (21).
LETTERS_SP_FITCH = (
    "AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-",
    "CCC+", "CCC", "CCC-", "CC", "C",
)
LETTERS_MOODYS = (
    "Aaa", "Aa1", "Aa2", "Aa3", "A1", "A2", "A3", "Baa1", "Baa2", "Baa3", "Ba1", "Ba2", "Ba3", "B1", "B2", "B3",
    "Caa1", "Caa2", "Caa3", "Ca", "C",
)
DEFAULT_ORDINAL = 21


def ordinal(agency: Column, letter: Column) -> Column:
    """A1: letter to ordinal on the scale of its agency; unknown letters give null."""

    def scale(letters) -> Column:
        pairs = [F.lit(x) for n, letter in enumerate(letters, start=1) for x in (letter, float(n))]
        return F.create_map(*pairs)

    key = F.trim(letter)
    other = F.when(key == "D", float(DEFAULT_ORDINAL)).otherwise(F.element_at(scale(LETTERS_SP_FITCH), key))
    return F.when(agency == "Moody's", F.element_at(scale(LETTERS_MOODYS), key)).otherwise(other)


def reference(ratings: DataFrame) -> DataFrame:
    """A2: mean ordinal and 0-100 reference risk per entity from (entity, agency, letter) rows."""
    ranked = ratings.select(F.upper(ENTITY).alias(ENTITY), ordinal(F.col("agency"), F.col("letter")).alias("_o"))
    mean = ranked.where(F.col("_o").isNotNull()).groupBy(ENTITY).agg(F.avg("_o").alias("_m"))
    return mean.select(
        ENTITY,
        F.bround("_m", 3).alias("ordinal"),
        F.bround((F.col("_m") - 1.0) / 20.0 * 100.0, 1).alias("reference_risk"),
    )


def latest_scores(scores: DataFrame) -> DataFrame:
    """A3: newest scored row per entity, combined before the shuffle."""
    known = scores.where(F.col("risk_score").isNotNull())
    last = F.max_by(F.struct("risk_score", "risk_band"), PERIOD).alias("_l")
    return known.groupBy(F.upper(ENTITY).alias(ENTITY)).agg(last).select(ENTITY, "_l.risk_score", "_l.risk_band")


def compare(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """A4: entities with both views and whether the bands agree."""
    joined = reference(ratings).join(latest_scores(scores), ENTITY)
    return joined.select(
        ENTITY,
        "ordinal",
        "reference_risk",
        F.col("risk_score").alias("engine_score"),
        F.col("risk_band").alias("engine_band"),
        (F.col("risk_band") == band(F.col("reference_risk"))).alias("bands_match"),
    )


def average_rank(table: DataFrame, value: str) -> DataFrame:
    """Ties share the mean of their positions; from the distributed rank table."""
    ranks = rank_table(table, [], value)
    return ranks.select(value, (F.col("n_less") + (F.col("n_equal") + 1) / 2.0).alias(f"_rank_{value}"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """A5: one row; null with fewer than two rows or a constant side."""
    known = pin(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y))
    ranked = known.join(average_rank(known, x), x).join(average_rank(known, y), y)
    return ranked.agg(
        F.count(F.lit(1)).alias("n"), F.bround(safe_corr(F.col(f"_rank_{x}"), F.col(f"_rank_{y}")), 3).alias("spearman")
    )


def agreement(compared: DataFrame) -> DataFrame:
    """Number of entities, rank correlation and share of agreeing bands."""
    compared = pin(compared)
    share = F.bround(F.avg(F.when(F.col("bands_match").isNotNull(), F.col("bands_match").cast("int"))), 3)
    # Two aggregates of one row each.
    return spearman(compared, "engine_score", "reference_risk").crossJoin(compared.agg(share.alias("band_match_share")))
