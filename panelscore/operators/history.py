"""Own-history scores without the history (Z1, Z11 from a state table).

The state has one row per entity: for each indicator the count, mean and sum of squared deviations of the values so far, and
the scores of the last two rows. Appended periods are scored from it by merging moments; peers are compared within the
appended periods. Reading, shuffling and writing grow with the appended rows and the entities, not with the past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.functions import text as t
from panelscore.model import Model
from panelscore.operators import score
from panelscore.schema import ENTITY, PERIOD
from panelscore.session import pin
from panelscore.sources import versions

RECENT = f"array<struct<{PERIOD}: int, risk_score: double>>"


def moment_columns(model: Model) -> list[str]:
    return [f"{p}{n}" for n in range(len(model.indicators)) for p in ("sn", "sm", "sq")]


def empty_state(spark: SparkSession, model: Model) -> DataFrame:
    kinds = {"sn": "long", "sm": "double", "sq": "double"}
    columns = ", ".join(f"{c} {kinds[c[:2]]}" for c in moment_columns(model))
    return spark.createDataFrame([], f"{ENTITY} string, last_period int, {columns}, recent {RECENT}")


def merged(an: str, am: str, aq: str, bn: str, bm: str, bq: str) -> tuple[str, str, str]:
    """Count, mean and squared deviations of two sets of values taken together; an empty set has null for the last two."""
    n = f"(coalesce({an}, 0L) + coalesce({bn}, 0L))"
    gap = f"(coalesce({bm}, {am}) - coalesce({am}, {bm}))"
    mean = f"(coalesce({am}, {bm}) + {gap} * try_divide(coalesce({bn}, 0L), {n}) * if({am} IS NULL, 0D, 1D))"
    squares = f"(coalesce({aq}, 0D) + coalesce({bq}, 0D) + coalesce({gap} * {gap} * coalesce({an}, 0L) * try_divide(coalesce({bn}, 0L), {n}), 0D))"
    return n, mean, squares


def _with_history_z(df: DataFrame, model: Model, numbers: list[int]) -> DataFrame:
    """zt<n> and zc<n>, the expanding window of the appended rows taken together with the state's moments."""
    own = [f"{f} {score.SEEN} AS {p}{n}" for n in numbers for p, f in (("wn", f"count(v{n})"), ("wm", f"avg(v{n})"), ("wq", f"count(v{n}) {score.SEEN} * var_pop(v{n})"))]
    seen = df.selectExpr("*", *own)
    kept = [*score.KEYS, *[f"{p}{n}" for n in numbers for p in ("v", "zp")]]
    both = []
    for n in numbers:
        count, mean, squares = merged(f"sn{n}", f"sm{n}", f"sq{n}", f"wn{n}", f"wm{n}", f"wq{n}")
        both += [f"{count} AS hn{n}", f"{mean} AS hm{n}", f"sqrt(try_divide({squares}, {count})) AS hs{n}"]
    timed = seen.selectExpr(*kept, *both)
    least = model.params.min_history_obs
    timed = timed.selectExpr(*kept, *[f"{t.zscore(f'v{n}', f'hm{n}', f'hs{n}', f'hn{n}', least)} AS zt{n}" for n in numbers])
    return timed.selectExpr("*", *[f"{score.blend(f'zt{n}', f'zp{n}', model)} AS zc{n}" for n in numbers])


def append(panel: DataFrame, state: DataFrame | None, model: Model, peers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores of the rows of ``panel``, the state after them): as if the whole panel had been scored at once.

    ``panel`` is wide and holds whole periods, each after the last one that the state has of any of its entities; an earlier
    row is an error where it is read. Entities may be new, or missing for a while. An empty panel changes nothing.
    """
    state = empty_state(panel.sparkSession, model) if state is None else state
    numbers = score.present(panel, model)
    joined = score.with_peer_statistics(score.prepare(panel, model, peers), numbers)
    peer = joined.selectExpr(*score.KEYS, *[f"v{n}" for n in numbers], *[f"{score.peer_z(n, model)} AS zp{n}" for n in numbers])
    late = F.raise_error(F.concat(F.lit("a row before the state's last period: "), ENTITY, F.lit(" "), F.col(PERIOD).cast("string"))).cast("int")
    held = state.select(F.col(ENTITY).alias("_entity"), "last_period", *[c for n in numbers for c in (f"sn{n}", f"sm{n}", f"sq{n}")])
    peer = peer.join(held, F.col(ENTITY) == F.col("_entity"), "left")
    peer = peer.withColumn(PERIOD, F.when(F.col("last_period") >= F.col(PERIOD), late).otherwise(F.col(PERIOD)))
    z = _with_history_z(peer, model, numbers)
    trend = ("trend_1y_delta", "trend_2y_delta", "trend_direction")
    scored = pin(score.scores_from_z(z, model, [f"v{n}" for n in numbers]).drop(*trend))
    # The last rows of the past stand before the appended ones of their entity.
    past = state.select(ENTITY, F.explode("recent").alias("r")).select(ENTITY, "r.*", F.lit(True).alias("_past"))
    rows = scored.drop(*[f"v{n}" for n in numbers]).withColumn("_past", F.lit(False)).unionByName(past, allowMissingColumns=True)
    scores = score.trend_columns(rows, model).where("NOT _past").drop("_past")
    return scores, _advanced(state, scored, numbers)


def _advanced(state: DataFrame, scored: DataFrame, numbers: list[int]) -> DataFrame:
    new = scored.groupBy(F.col(ENTITY).alias("_entity")).agg(
        F.max(PERIOD).alias("_last"),
        *[F.expr(e) for n in numbers for e in (f"count(v{n}) AS bn{n}", f"avg(v{n}) AS bm{n}", f"count(v{n}) * var_pop(v{n}) AS bq{n}")],
        # One row per period at most.
        F.slice(F.sort_array(F.collect_list(F.struct(PERIOD, "risk_score")), asc=False), 1, 2).alias("_recent"),
    )
    both = state.join(new, F.col(ENTITY) == F.col("_entity"), "full")
    out = [f"coalesce({ENTITY}, _entity) AS {ENTITY}", "coalesce(_last, last_period) AS last_period"]
    for column in (c for c in state.columns if c[:2] in ("sn", "sm", "sq")):
        n = int(column[2:])
        if n in numbers:
            parts = merged(f"sn{n}", f"sm{n}", f"sq{n}", f"bn{n}", f"bm{n}", f"bq{n}")
            out.append(f"{parts[('sn', 'sm', 'sq').index(column[:2])]} AS {column}")
        else:
            out.append(column)
    recent = f"CAST(slice(sort_array(concat(coalesce(recent, array()), coalesce(_recent, array())), false), 1, 2) AS {RECENT}) AS recent"
    return both.selectExpr(*out, recent)


def advance(spark: SparkSession, path: str, panel: DataFrame, model: Model, peers: DataFrame | None = None) -> DataFrame:
    """Scores of the periods of ``panel`` after the last one that the state table at ``path`` has seen; the table moves on.

    Periods that were scored before are left out, so a load that is repeated changes nothing. The state is a versioned table:
    a run that fails leaves it as it was, and of two that run at once one is refused.
    """
    base = versions.current(spark, path)
    high = base.facts.get("high") if base else None
    state = versions.read_version(spark, path, base.number) if base else None
    fresh = panel if high is None else panel.where(F.col(PERIOD) > high)
    scores, after = append(fresh, state, model, peers)
    scores = pin(scores)
    newest = scores.agg(F.max(PERIOD)).first()[0]
    if newest is not None:
        versions.commit(after, path, partition_by=None, facts={"high": newest}, base=base)
    return scores
