"""Response log (S10-S13) and freshness (Q11, Q12): append-only rows, newest per key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how long a response stays fresh, in seconds.
DEFAULT_TTL_SECONDS = 21_600


def cache_key(source: Column, url: Column, params: Column | None = None) -> Column:
    """Deterministic key; ``params`` is the request as JSON text with sorted keys, or null."""
    raw = F.concat_ws("|", source, url) if params is None else F.concat_ws("|", source, url, params)
    return F.sha2(raw, 256)


def newest_per_key(log: DataFrame, keys: Sequence[str] = ("cache_key",), at: str = "retrieved_at", tie: str | None = None) -> DataFrame:
    """What an upsert would have left. Combined before the shuffle, so a hot key is no problem; each task sorts its rows
    by key for that. Entries without a time are oldest; ties fall to ``tie``, or else to the greatest rest of the row."""
    rest = [c for c in log.columns if c not in keys]
    order = F.struct(F.col(at).isNotNull(), at, *([tie] if tie else [c for c in rest if c != at]))
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_n"))
    return newest.select(*keys, "_n.*").select(*log.columns)


def age_seconds(as_of: Column, at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", at, as_of) / 1e6


def lookup(log: DataFrame, as_of: Column, ttl: int = DEFAULT_TTL_SECONDS, at: str = "retrieved_at", tie: str | None = None) -> DataFrame:
    """Newest entry per key if it is not older than the time to live."""
    age = age_seconds(as_of, F.col(at))
    newest = newest_per_key(log, at=at, tie=tie).where(age <= ttl)
    return newest.withColumn("freshness_seconds", F.floor(age))


def last_known_good(log: DataFrame, as_of: Column, ttl: int = DEFAULT_TTL_SECONDS, at: str = "retrieved_at", tie: str | None = None) -> DataFrame:
    """Newest entry per key whatever its age, with age and stale mark."""
    age = age_seconds(as_of, F.col(at))
    newest = newest_per_key(log, at=at, tie=tie)
    return newest.withColumn("freshness_seconds", F.floor(age)).withColumn("stale", age > ttl)


def statistics(log: DataFrame, at: str = "retrieved_at") -> DataFrame:
    """Entries, oldest and newest per source and in total; ``is_total`` tells the total from entries without a source."""
    stats = [F.count(F.lit(1)).alias("entries"), F.min(at).alias("oldest"), F.max(at).alias("newest")]
    return log.rollup("source").agg((F.grouping("source") == 1).alias("is_total"), *stats)


def freshness(
    log: DataFrame, as_of: Column, ttl: int = DEFAULT_TTL_SECONDS, at: str = "retrieved_at", ok: Column | None = None
) -> DataFrame:
    """Q11: state per source.

    Newest attempt good: LIVE within the time to live, STALE after it. Newest attempt failed: CACHED
    while an older good one exists, else UNAVAILABLE.
    """
    good = F.col("status_code") == 200 if ok is None else ok
    newest = log.groupBy("source").agg(F.max(at).alias("_attempt"), F.max(F.when(good, F.col(at))).alias("newest"))
    age = age_seconds(as_of, F.col("newest"))
    state = (
        F.when(F.col("newest").isNull(), "UNAVAILABLE")
        .when(F.col("_attempt") > F.col("newest"), "CACHED")
        .when(age <= ttl, "LIVE")
        .otherwise("STALE")
    )
    return newest.select("source", "newest", F.floor(age).alias("age_seconds"), state.alias("state"))


def bookkeeping(fetches: DataFrame, as_of: Column, ttl: int = DEFAULT_TTL_SECONDS, at: str = "retrieved_at") -> DataFrame:
    """Q12: per source how many keys were fresh or served from the log, and the newest served date."""
    newest = newest_per_key(fetches, at=at).withColumn("_fresh", age_seconds(as_of, F.col(at)) <= ttl)
    return newest.groupBy("source").agg(
        F.count_if("_fresh").alias("fresh"),
        F.count_if(~F.col("_fresh")).alias("cached"),
        F.max(F.when(~F.col("_fresh"), F.col(at))).alias("cache_date"),
    )
