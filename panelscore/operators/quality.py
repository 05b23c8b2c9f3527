"""Data quality and governance checks (Q1-Q10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscore.functions.scalar import col
from panelscore.model import Episode, Model, episode_table, local_table
from panelscore.operators.clean import to_long
from panelscore.operators.derive import Derivation, derive
from panelscore.schema import ENTITY, INDICATOR, PERIOD, VALUE

SEVERITY_ERROR, SEVERITY_WARNING = "error", "warning"
CHECK_COLUMNS = ["check", "severity", "ref", "detail"]


def coverage(panel: DataFrame, entities: DataFrame, indicators: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Q1: distinct (indicator, period) cells per entity; flagged rows count, absent entities get 0.

    The duplicates collapse before the shuffle, then one count per entity.
    """
    expected = max(1, len(indicators) * len(periods))
    asked = panel.where(F.col(INDICATOR).isin(list(indicators)) & F.col(PERIOD).isin(list(periods)))
    seen = asked.select(F.upper(ENTITY).alias(ENTITY), INDICATOR, PERIOD).distinct().groupBy(ENTITY).agg(F.count(F.lit(1)).alias("_n"))
    observed = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    return entities.select(F.upper(ENTITY).alias(ENTITY)).distinct().join(seen, ENTITY, "left").select(
        ENTITY,
        F.lit(expected).cast("bigint").alias("expected"),
        observed.alias("observed"),
        (observed * 100.0 / expected).alias("coverage_pct"),
    )


def missing_indicators(panel: DataFrame, model: Model) -> DataFrame:
    """Q2: weighted indicators without a single value in the long panel."""
    wanted = local_table(
        panel.sparkSession, [(i.code, i.pillar, float(i.weight)) for i in model.weighted], "indicator string, pillar string, weight double"
    )
    found = panel.where(F.col(VALUE).isNotNull()).select(INDICATOR).distinct()
    return wanted.join(found, INDICATOR, "left_anti")


def structure_problems(model: Model) -> list[tuple[str, str]]:
    """Q3: weighted pillars without a weighted indicator, and pillars the sectors do not partition."""
    occupied = {i.pillar for i in model.weighted}
    listed = {p for members in model.sectors.values() for p in members}
    rows = [("pillar_coverage", p) for p in sorted(set(model.active_pillars) - occupied)]
    if model.sectors and model.params.sector_composite_weight > 0:
        rows += [("sector_partition", p) for p in sorted(occupied ^ listed)]
    return rows


def empty_pillars(spark, model: Model) -> DataFrame:
    """Q3 as a table."""
    return local_table(spark, structure_problems(model), "check string, pillar string")


def latest_covered_period(panel: DataFrame, model: Model, min_coverage: float = 0.8, min_entities: int = 5) -> DataFrame:
    """Q4: newest period in which enough entities carry enough of the indicator weight (long panel)."""
    weights = local_table(
        panel.sparkSession, [(i.code, float(i.weight)) for i in model.weighted], "indicator string, weight double"
    )
    cells = panel.where(F.col(VALUE).isNotNull()).select(ENTITY, PERIOD, INDICATOR).distinct().join(weights, INDICATOR)
    share = cells.groupBy(ENTITY, PERIOD).agg((F.sum("weight") / F.lit(model.total_weight)).alias("_share"))
    # Weights are sums of decimals: forgive the last bits.
    good = share.where(F.col("_share") >= min_coverage - 1e-9).groupBy(PERIOD).agg(F.count(F.lit(1)).alias("entities"))
    return good.where(F.col("entities") >= min_entities).agg(
        F.max(PERIOD).alias(PERIOD), F.max_by("entities", PERIOD).alias("entities")
    )


def derivation_drift(wide: DataFrame, rules: Sequence[Derivation], tolerance: float = 1e-6) -> DataFrame:
    """Q5: re-derive from the base columns and compare with the stored ones."""
    present = set(wide.columns)
    usable = [r for r in rules if {r.code, r.base} <= present and (r.other is None or r.other in present)]
    if not usable:
        return wide.sparkSession.createDataFrame([], f"{INDICATOR} string, max_drift double, rows bigint, drifted boolean")
    codes = sorted({r.code for r in usable} | {c for r in usable for c in (r.base, r.other) if c})
    long = to_long(wide, codes).where(F.col(VALUE).isNotNull())
    expected = derive(long, usable).select(ENTITY, PERIOD, INDICATOR, F.col(VALUE).alias("_expected"))
    # Undefined re-derivations pair with an absent cell; both sides keep their row.
    actual = to_long(wide, sorted({r.code for r in usable})).select(ENTITY, PERIOD, INDICATOR, F.col(VALUE).alias("_actual"))
    gap = F.abs(F.col("_expected") - F.col("_actual"))
    out = expected.join(actual, [ENTITY, PERIOD, INDICATOR]).groupBy(INDICATOR).agg(
        F.max(gap).alias("max_drift"), F.count(F.lit(1)).alias("rows")
    )
    return out.withColumn("drifted", F.coalesce(F.col("max_drift") > tolerance, F.lit(False)))


def episode_checks(panel: DataFrame, episodes: Sequence[Episode], entities: DataFrame | None = None) -> DataFrame:
    """Q6: episodes of unknown entities or with years outside the panel."""
    spark = panel.sparkSession
    table = episode_table(spark, episodes)
    known = panel.select(F.upper(ENTITY).alias(ENTITY))
    if entities is not None:
        known = known.unionByName(entities.select(F.upper(ENTITY).alias(ENTITY)))
    # Only the episodes' own entities matter: one row each, whatever the size of the panel.
    known = known.join(table.select(ENTITY).distinct(), ENTITY, "left_semi").distinct().withColumn("_known", F.lit(True))
    span = panel.agg(F.min(PERIOD).alias("_low"), F.max(PERIOD).alias("_high"))
    joined = table.join(known, ENTITY, "left").crossJoin(span)

    def outside(name: str) -> Column:
        return (F.col(name) < F.col("_low")) | (F.col(name) > F.col("_high"))

    problem = (
        F.when(F.col("_known").isNull(), "unknown entity")
        .when(outside("baseline") & outside("event"), "baseline and event outside panel")
        .when(outside("baseline"), "baseline outside panel")
        .when(outside("event"), "event outside panel")
    )
    return joined.select("episode", ENTITY, "label", "baseline", "event", problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def report(
    wide: DataFrame, model: Model, rules: Sequence[Derivation], episodes: Sequence[Episode]
) -> DataFrame:
    """Q7: one row: size, period range, covered indicators, every check and the status."""
    spark = wide.sparkSession
    weighted = [i.code for i in model.weighted]
    covered = [c for c in weighted if c in wide.columns]
    structure_ok = not structure_problems(model)
    drift = derivation_drift(wide, rules).agg(
        F.coalesce(F.bool_and(~F.col("drifted")), F.lit(True)).alias("derivations")
    )
    warned = episode_checks(wide, episodes).agg((F.count(F.lit(1)) == 0).alias("episode_windows_in_range"))
    # Entities are deduplicated by a shuffle, periods by the calendar: no big state in one task.
    entities = wide.select(F.upper(F.col(ENTITY)).alias(ENTITY)).distinct().agg(F.count(F.lit(1)).alias("entities"))
    span = wide.agg(F.min(PERIOD).alias("period_min"), F.max(PERIOD).alias("period_max"))
    out = span
    for part in (entities, drift, warned):
        # Every part is one row.
        out = out.crossJoin(part)
    out = (
        out.withColumn("indicators_total", F.lit(len(weighted)).cast("bigint"))
        .withColumn("indicators_covered", F.lit(len(covered)).cast("bigint"))
        .withColumn("indicator_columns", F.lit(len(covered) == len(weighted)))
        .withColumn("pillar_coverage", F.lit(structure_ok))
    )
    ok = F.col("indicator_columns") & F.col("pillar_coverage") & F.col("derivations")
    return out.withColumn("status", F.when(ok, "ok").otherwise("issues"))


def provenance(
    panel: DataFrame, entities: int, model: Model, period: int, sources: dict[str, str]
) -> DataFrame:
    """Q8: what was expected and received at a period, which sources delivered, what failed.

    ``sources`` maps a flag name to the text its source label contains.
    """
    expected = entities * len(model.indicators)
    at = panel.where(F.col(PERIOD) == int(period))
    received = at.select(ENTITY, INDICATOR).distinct().agg(F.count(F.lit(1)).alias("received"))
    flags = [
        F.coalesce(F.bool_or(F.lower("source").contains(text.lower())), F.lit(False)).alias(f"{name}_ok")
        for name, text in sources.items()
    ]
    facts = panel.agg(F.count_if(F.col("flag") == "out_of_range").alias("out_of_range"), *flags)
    out = facts.crossJoin(received)
    share = F.lit(0.0) if expected == 0 else F.bround(F.col("received") * 100.0 / expected, 1)
    notes = F.array(
        F.when(
            F.col("out_of_range") > 0,
            F.format_string("%d observation(s) fell outside configured bounds", F.col("out_of_range")),
        ),
        *[F.when(~F.col(f"{name}_ok"), F.lit(f"{text} delivered nothing")) for name, text in sources.items()],
    )
    return out.select(
        F.lit(int(period)).alias(PERIOD),
        F.lit(expected).cast("bigint").alias("expected"),
        "received",
        share.alias("coverage_pct"),
        "out_of_range",
        *[f"{name}_ok" for name in sources],
        F.filter(notes, lambda n: n.isNotNull()).alias("notes"),
    )


def run_metadata(panel: DataFrame, entities: int, model: Model, periods: int = 1) -> DataFrame:
    """Q9: counts of a run over a long panel with unique keys; expected are entities x indicators x periods."""
    per_entity = panel.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("entity_count"), F.sum("_n").alias("observations_received")
    )
    codes = panel.where(F.col(INDICATOR).isin(model.codes)).select(INDICATOR).distinct().agg(
        F.count(F.lit(1)).alias("indicator_count")
    )
    joined = per_entity.crossJoin(codes)
    received = F.coalesce(F.col("observations_received"), F.lit(0))
    return joined.select(
        "entity_count",
        "indicator_count",
        received.alias("observations_received"),
        F.greatest(F.lit(0).cast("bigint"), F.lit(entities * len(model.codes) * periods).cast("bigint") - received).alias("observations_missing"),
    )


def fingerprint(df: DataFrame, table: str, partition: Column | None = None) -> DataFrame:
    """Q10: order-free content hash per partition of a table; partially aggregated.

    Sums of 64-bit hashes as decimals, so nothing overflows and repeated rows do not cancel.
    """
    h = F.xxhash64(*[col(c) for c in df.columns])
    part = (F.lit("all") if partition is None else partition.cast("string")).alias("partition")
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash")
    ).select(F.lit(table).alias("table"), "partition", "rows", "hash")


def compare_fingerprints(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Q10: ok, drifted or missing per recorded partition; new partitions are listed as well."""
    old = recorded.select("table", "partition", F.col("rows").alias("old_rows"), F.col("hash").alias("_old"))
    new = current.select("table", "partition", F.col("rows").alias("new_rows"), F.col("hash").alias("_new"))
    status = (
        F.when(F.col("_new").isNull(), "missing")
        .when(F.col("_old").isNull(), "new")
        .when((F.col("_old") == F.col("_new")) & (F.col("old_rows") == F.col("new_rows")), "ok")
        .otherwise("drifted")
    )
    return old.join(new, ["table", "partition"], "full").select("table", "partition", "old_rows", "new_rows", status.alias("status"))


def overall_status(compared: DataFrame) -> DataFrame:
    drifted, missing = F.count_if(F.col("status") == "drifted"), F.count_if(F.col("status") == "missing")
    overall = F.when(drifted > 0, "drifted").when(missing > 0, "inconsistent").otherwise("consistent")
    return compared.agg(drifted.alias("drifted"), missing.alias("missing"), overall.alias("overall"))
