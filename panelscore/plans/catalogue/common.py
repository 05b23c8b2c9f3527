"""Helpers of the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.operators import score
from panelscore.plans import bindings as b
from panelscore.session import checkpoint_folder


def work_folder(spark: SparkSession) -> str:
    """A new folder for a query's own tables, where ``release`` finds it."""
    return f"{checkpoint_folder(spark)}/panelscore/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles, so that two engines compare equal."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def nation_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.z_frame(b.nation_year(spark, sf_dir), b.NATION_MODEL)


def nation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scores_from_z(nation_z(spark, sf_dir), b.NATION_MODEL)
