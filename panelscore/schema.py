"""Column names and types of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENTITY, INDICATOR, PERIOD, VALUE = "entity", "indicator", "period", "value"
SOURCE, FLAG, SEQ, PEER_GROUP = "source", "flag", "seq", "peer_group"

# ``seq`` is the arrival order: "keep the last one" needs it, rows in Spark have no position.
LONG_PANEL = T.StructType(
    [
        T.StructField(ENTITY, T.StringType()),
        T.StructField(INDICATOR, T.StringType()),
        T.StructField(PERIOD, T.IntegerType()),
        T.StructField(VALUE, T.DoubleType()),
        T.StructField(SOURCE, T.StringType()),
        T.StructField(FLAG, T.StringType()),
        T.StructField(SEQ, T.LongType()),
    ]
)
LONG_COLUMNS = [ENTITY, INDICATOR, PERIOD, VALUE, SOURCE, FLAG]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail while the plan is built, not when it runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; found {df.columns}")
    return df
