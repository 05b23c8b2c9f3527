"""Panels bound to the star-schema tables: nation x year, supplier x month, user x day, raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelscore.functions.scalar import micros
from panelscore.model import Episode, Indicator, Model, Preset, ScoringParams
from panelscore.operators.clean import finalize
from panelscore.operators.derive import Derivation, derive, derive_columns
from panelscore.schema import ENTITY, FLAG, INDICATOR, PEER_GROUP, PERIOD, SEQ, SOURCE, VALUE
from panelscore.session import pin


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the star schema; the footer is read once per path and process."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


NATION_MODEL = Model(
    indicators=(
        Indicator("AVG_ORDER_VALUE", "Demand", 0.15, -1, "Average order value", "Orders", "USD", "orders", None, None,
                  "Shrinking order values", "Strong order values"),
        Indicator("ORDER_COUNT", "Demand", 0.10, -1, "Order count", "Orders", "orders", "orders", 0.0, None,
                  "Thin order book", "Full order book"),
        Indicator("ORDER_VALUE_YOY", "Demand", 0.05, -1, "Order value growth", "Momentum", "% YoY", "derived"),
        Indicator("ORDER_COUNT_GAP", "Demand", 0.05, -1, "Order count gap", "Momentum", "orders", "derived"),
        Indicator("AVG_DISCOUNT", "Pricing", 0.15, 1, "Average discount", "Prices", "share", "lineitem", 0.0, 0.05,
                  "Deep discounting", "Firm prices"),
        Indicator("AVG_TAX", "Pricing", 0.05, -1, "Average tax", "Prices", "share", "lineitem", 0.0, 1.0),
        Indicator("DISCOUNT_TREND_DEV", "Pricing", 0.0, 1, "Discount against trend", "Prices", "%", "derived"),
        Indicator("RETURN_SHARE", "Quality", 0.20, 1, "Return share", "Returns", "share", "lineitem", 0.0, 1.0,
                  "Many returns", "Few returns"),
        Indicator("RETURN_SHARE_3Y", "Quality", 0.05, 1, "Return share change", "Returns", "share", "derived"),
        Indicator("OPEN_SHARE", "Service", 0.10, 1, "Open orders", "Service", "share", "orders", 0.0, 1.0,
                  "Growing backlog", "Orders closed in time"),
        Indicator("URGENT_SHARE", "Service", 0.10, 1, "Urgent orders", "Service", "share", "orders", 0.0, 1.0),
        Indicator("LINES_PER_ORDER", "Service", 0.0, 1, "Lines per order", "Service", "lines", "derived"),
    ),
    pillar_weights={"Demand": 0.35, "Pricing": 0.20, "Quality": 0.25, "Service": 0.20},
    sectors={"Commercial": ("Demand", "Pricing"), "Operations": ("Quality", "Service")},
    sector_weights={"Commercial": 0.55, "Operations": 0.45},
    params=ScoringParams(sector_composite_weight=0.30),
)
NATION_BASE = (
    "AVG_ORDER_VALUE", "ORDER_COUNT", "OPEN_SHARE", "URGENT_SHARE", "AVG_DISCOUNT", "AVG_TAX", "RETURN_SHARE",
    "LINE_COUNT",
)
NATION_DERIVED = (
    Derivation("ORDER_VALUE_YOY", "AVG_ORDER_VALUE", "yoy", digits=None),
    Derivation("ORDER_COUNT_GAP", "ORDER_COUNT", "trailing_gap", digits=None),
    Derivation("RETURN_SHARE_3Y", "RETURN_SHARE", "lag3", digits=None),
    Derivation("DISCOUNT_TREND_DEV", "AVG_DISCOUNT", "centered", digits=None),
    Derivation("LINES_PER_ORDER", "LINE_COUNT", "ratio", other="ORDER_COUNT", digits=None),
)
NATION_EPISODES = (
    Episode("NATION_0", "Episode 0", 1996, 1998),
    Episode("NATION_3", "Episode 3", 1996, 1999),
    Episode("NATION_6", "Episode 6", 1997, 1999, note="three-year build-up"),
    Episode("NATION_9", "Episode 9", 1995, 1997, window=2),
    Episode("NATION_12", "Episode 12", 1998, 2000),
    Episode("NATION_15", "Episode 15", 1999, 2001, threshold=5.0),
    Episode("NATION_18", "Episode 18", 1996, 2000),
    Episode("NATION_21", "Episode 21", 1998, 1999, window=0),
    Episode("ATLANTIS", "Unknown entity", 1997, 1999),
    Episode("NATION_5", "Out of range", 2000, 2005),
)
NATION_PRESETS = (
    Preset("discount_push", "Discount shock", "AVG_DISCOUNT", 0.005, ("RETURN_SHARE", "OPEN_SHARE", "NOT_IN_PANEL"),
           "share", "average-discount"),
    Preset("demand_slump", "Demand shock", "ORDER_COUNT", -20.0, ("AVG_ORDER_VALUE", "OPEN_SHARE", "URGENT_SHARE"),
           "orders", "order-count"),
    Preset("value_drop", "Value shock", "AVG_ORDER_VALUE", -50000.0, ("RETURN_SHARE", "AVG_DISCOUNT"),
           "USD", "order-value"),
    Preset("flat_driver", "Constant driver", "FLAT", 1.0, ("RETURN_SHARE", "AVG_TAX"), "units", "flat"),
)


def nation_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 nations and 5 regions whatever the scale factor: both tables are fixed by the schema.

    Nations of the last region belong to no peer group.
    """
    regions = F.broadcast(read(spark, sf_dir, "region"))
    return F.broadcast(read(spark, sf_dir, "nation")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        "n_nationkey",
        F.col("n_name").alias(ENTITY),
        F.col("r_name").alias("region"),
        F.when(F.col("n_regionkey") < 4, F.col("r_name")).alias(PEER_GROUP),
    )


def nation_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide base series per nation and year.

    Facts are aggregated by their own foreign key first. A customer or supplier with a third of all
    rows then leaves every task as a handful of rows, and the joins move aggregates, not facts. Both
    sides meet in one union and one more ``groupBy`` instead of an outer join.
    """
    orders = (
        read(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").cast("int").alias(PERIOD))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("o_totalprice").alias("price"),
            F.count_if(F.col("o_orderstatus") == "O").alias("open"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        )
        .join(
            read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .drop("o_custkey", "c_custkey")
    )
    lines = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").cast("int").alias(PERIOD))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("l_discount").alias("discount"),
            F.sum("l_tax").alias("tax"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        )
        .join(
            read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
        .drop("l_suppkey", "s_suppkey")
    )
    parts = ("orders", "price", "open", "urgent", "lines", "discount", "tax", "returned")
    cells = (
        orders.unionByName(lines, allowMissingColumns=True)
        .groupBy("n_nationkey", PERIOD)
        .agg(*[F.sum(c).alias(c) for c in parts])
    )

    def per(total: str, n: str) -> Column:
        return F.try_divide(F.col(total), F.col(n))

    return cells.join(nation_dimension(spark, sf_dir).select("n_nationkey", ENTITY), "n_nationkey").select(
        ENTITY,
        PERIOD,
        per("price", "orders").alias("AVG_ORDER_VALUE"),
        F.col("orders").cast("double").alias("ORDER_COUNT"),
        per("open", "orders").alias("OPEN_SHARE"),
        per("urgent", "orders").alias("URGENT_SHARE"),
        per("discount", "lines").alias("AVG_DISCOUNT"),
        per("tax", "lines").alias("AVG_TAX"),
        per("returned", "lines").alias("RETURN_SHARE"),
        F.col("lines").cast("double").alias("LINE_COUNT"),
    )


def nation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed base cells, long."""
    wide = nation_base(spark, sf_dir)
    return (
        wide.unpivot([ENTITY, PERIOD], list(NATION_BASE), INDICATOR, VALUE)
        .where(F.col(VALUE).isNotNull())
        .withColumn(SOURCE, F.when(F.col(INDICATOR).isin("AVG_DISCOUNT", "AVG_TAX", "RETURN_SHARE", "LINE_COUNT"), "lineitem").otherwise("orders"))
        .withColumn(FLAG, F.lit("ok"))
    )


def nation_full_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = nation_long(spark, sf_dir)
    return finalize(base, derive(base, NATION_DERIVED))


def nation_year(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Wide panel with peer group: the input of scoring, written once because scoring reads it twice."""
    wide = derive_columns(nation_base(spark, sf_dir), NATION_DERIVED)
    groups = nation_dimension(spark, sf_dir).select(ENTITY, PEER_GROUP)
    return pin(wide.join(F.broadcast(groups), ENTITY).select(ENTITY, PEER_GROUP, PERIOD, *NATION_MODEL.codes, *extra))


SUPPLIER_MODEL = Model(
    indicators=(
        Indicator("REVENUE", "Volume", 0.5, -1, "Revenue", "Volume", "USD"),
        Indicator("DISCOUNT", "Terms", 0.3, 1, "Discount", "Terms", "share"),
        Indicator("RETURN_SHARE", "Terms", 0.2, 1, "Return share", "Terms", "share"),
    ),
    pillar_weights={"Volume": 0.5, "Terms": 0.5},
)


def supplier_month(spark: SparkSession, sf_dir: str, lines: str = "true") -> DataFrame:
    """Scale panel: supplier x month, peer group = nation; of the order lines that a condition picks."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    facts = (
        read(spark, sf_dir, "lineitem")
        .where(lines)
        .groupBy("l_suppkey", month.alias(PERIOD))
        .agg(
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("REVENUE"),
            F.avg("l_discount").alias("DISCOUNT"),
            (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("RETURN_SHARE"),
        )
    )
    suppliers = read(spark, sf_dir, "supplier").join(
        nation_dimension(spark, sf_dir).select("n_nationkey", F.col(ENTITY).alias("nation")),
        F.col("s_nationkey") == F.col("n_nationkey"),
    )
    panel = facts.join(suppliers.select("s_suppkey", "nation"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias(ENTITY),
        F.col("nation").alias(PEER_GROUP),
        PERIOD,
        *SUPPLIER_MODEL.codes,
    )
    return pin(panel)


# Plausibility bounds of the event indicators (low, high).
EVENT_BOUNDS = {
    "click": (1.0, 200.0), "error": (0.5, None), "purchase": (None, 150.0), "signup": (None, None), "view": (2.0, 250.0),
}
EVENT_TYPES = tuple(EVENT_BOUNDS)
EVENT_MODEL = Model(
    indicators=tuple(
        Indicator(t, "Activity" if t in ("click", "view") else "Outcome", 0.2, 1 if t == "error" else -1, low=lo, high=hi)
        for t, (lo, hi) in EVENT_BOUNDS.items()
    ),
    pillar_weights={"Activity": 0.4, "Outcome": 0.6},
)


def event_day(ts: str = "ts"):
    """Days since 2024-01-01: the integer period of the event panels."""
    return F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date"))


def event_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw long observations as text: padded ids, unreadable numbers, repeated keys."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit(" ")).alias(ENTITY),
        F.concat(F.col("event_type"), F.lit(" ")).alias(INDICATOR),
        F.when(F.col("event_id") % 101 == 0, "n/a").otherwise(event_day().cast("string")).alias(PERIOD),
        F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string")).alias(VALUE),
        F.concat(F.lit("feed-"), (F.col("user_id") % 3).cast("string")).alias(SOURCE),
        # Microseconds order the arrivals; the id breaks ties.
        (micros(F.col("ts")) * 1000 + F.col("event_id") % 1000).alias(SEQ),
    )


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale panel: user x day, one column per event type, peer group = user modulo 5."""
    cells = [F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in EVENT_TYPES]
    return pin(
        read(spark, sf_dir, "events")
        .groupBy("user_id", event_day().alias(PERIOD))
        .agg(*cells)
        .select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias(ENTITY),
            F.concat(F.lit("G"), (F.col("user_id") % 5).cast("string")).alias(PEER_GROUP),
            PERIOD,
            *EVENT_TYPES,
        )
    )
