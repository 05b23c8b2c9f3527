"""The batch run: observations in, tables out.

One pass per table. Scoring reads the wide panel twice, so it is written first; scores and drivers
are written once and every report, rank or replay afterwards reads those tables by period.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.model import Episode, Model, Preset
from panelscore.operators import backtest, clean, explain, quality, rank, scenario
from panelscore.operators import score as scoring
from panelscore.operators.derive import Derivation, derive_columns
from panelscore.schema import ENTITY, INDICATOR, PERIOD, VALUE
from panelscore.session import exists, pin, scratch, tune
from panelscore.sources.files import write_table


@dataclass(frozen=True)
class Outputs:
    """Folders of one run."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))


def run(
    observations: DataFrame,
    model: Model,
    out: str,
    derivations: Sequence[Derivation] = (),
    peers: DataFrame | None = None,
    presets: Sequence[Preset] = (),
    episodes: Sequence[Episode] = (),
    periods: Iterable[int] | None = None,
    generated_at: str = "",
    entities: DataFrame | None = None,
    names: DataFrame | None = None,
    sources: Mapping[str, str] | None = None,
) -> Outputs:
    """Clean, derive, widen, score, stress, explain, replay, check. A run replaces all tables of the one before.

    ``entities`` are those expected (the delivered ones if not given). The reports carry the first preset as their scenario
    block; ``names`` (entity, name) and ``sources`` (name to the text in a source label) enter their text. What a run
    pins on the way is removed at its end.
    """
    spark = observations.sparkSession
    tune(spark)
    with scratch(spark):
        return _run(observations, model, Outputs(out), derivations, peers, presets, episodes, periods, generated_at, entities, names, dict(sources or {}))


def _run(observations, model, outputs, derivations, peers, presets, episodes, periods, generated_at, entities, names, sources) -> Outputs:
    spark = observations.sparkSession
    before = pin(outputs.read(spark, "fingerprints")) if exists(spark, outputs.path("fingerprints")) else None
    write_table(clean.clean_long(observations, model, periods), outputs.path("observations"))
    cleaned = outputs.read(spark, "observations")

    inputs = {*model.codes, *(r.base for r in derivations), *(r.other for r in derivations if r.other)}
    # A series nobody delivered gets no column, so that the coverage check can name it. The list is
    # bounded by the model, not by the data.
    listed = cleaned.where(F.col(INDICATOR).isin(sorted(inputs)) & F.col(VALUE).isNotNull()).select(INDICATOR).distinct()
    found = {r[0] for r in listed.collect()}
    usable = [r for r in derivations if r.base in found and (r.other is None or r.other in found)]
    write_table(derive_columns(clean.to_wide(cleaned, sorted(found)), usable), outputs.path("panel"))
    panel = outputs.read(spark, "panel")

    z = pin(scoring.z_frame(panel, model, peers))
    top = f"{scoring.ranked(z, model, explain.TOP_DRIVERS)} AS top"
    write_table(scoring.scores_from_z(z, model, extra=[top]), outputs.path("scores"))
    write_table(scoring.drivers(z, model), outputs.path("drivers"))
    scores = outputs.read(spark, "scores")
    write_table(rank.trajectories(scores), outputs.path("trajectories"), partition_by=None)

    shown = {}
    if presets:
        estimated = pin(scenario.estimates(panel, presets))
        shocks = scenario.narrative(scenario.shock_scores(panel, model, presets, peers, estimated), presets)
        write_table(shocks, outputs.path("scenarios"))
        first = F.col("preset") == presets[0].key
        shown = {
            "scenarios": outputs.read(spark, "scenarios").where(first),
            "channels": scenario.target_deltas(panel, presets, estimated).where(first),
            "preset": presets[0],
        }
    write_table(explain.reports(scores, model, generated_at, names, list(sources), **shown), outputs.path("reports"))
    if episodes:
        write_table(backtest.run_backtest(scores, episodes, model), outputs.path("episodes"), partition_by=None)
        replayed = outputs.read(spark, "episodes")
        tally = backtest.ordinary_windows(scores, episodes)
        write_table(backtest.summary(replayed).crossJoin(backtest.metrics(replayed, tally).drop("detection_rate")), outputs.path("backtest"), partition_by=None, fmt="json")

    expected = (panel if entities is None else entities).select(F.upper(ENTITY).alias(ENTITY)).distinct()
    years = rank.scored_periods(scores)
    write_table(quality.coverage(cleaned, expected, model.codes, years), outputs.path("entity_coverage"), partition_by=None)
    count = expected.count()
    write_table(quality.run_metadata(cleaned, count, model, len(years)), outputs.path("run_metadata"), partition_by=None, fmt="json")
    write_table(quality.report(panel, model, derivations, episodes), outputs.path("coverage"), partition_by=None, fmt="json")
    if years:
        write_table(quality.provenance(cleaned, count, model, years[-1], sources), outputs.path("provenance"), partition_by=None, fmt="json")
    now = fingerprints(outputs, spark)
    write_table(now, outputs.path("fingerprints"), partition_by=None)
    write_table(quality.compare_fingerprints(outputs.read(spark, "fingerprints") if before is None else before, outputs.read(spark, "fingerprints")), outputs.path("changes"), partition_by=None, fmt="json")
    return outputs


def fingerprints(outputs: Outputs, spark: SparkSession, names: Sequence[str] = ("observations", "panel", "scores", "drivers")) -> DataFrame:
    """Content hashes per table and period, to be compared with those of another run."""
    frames = [quality.fingerprint(outputs.read(spark, n), n, F.col(PERIOD)) for n in names]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out

