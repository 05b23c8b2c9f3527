"""Explanation text and nested marts (T1-T8), as column expressions for all slices at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscore.functions import text as t
from panelscore.functions.ranks import order_statistic, rank_table
from panelscore.model import Model, Preset
from panelscore.operators import rank
from panelscore.operators import score as scoring
from panelscore.schema import ENTITY, PEER_GROUP, PERIOD
from panelscore.session import pin

SCORE = "risk_score"
# Drivers listed in a report, tolerance of the trend and peer phrases, coverage levels.
REPORT_DRIVERS, TOP_DRIVERS = 3, 6
UNCHANGED, IN_LINE = 1.5, 2.0
FULL, PARTIAL = 0.95, 0.7

# Wording of the report.
POSITIONING = (
    "This score is a relative-positioning signal within the panel, not a standalone forecast or a credit rating — "
    "treat it as a prioritization tool for where to look closer, not a substitute for that closer look."
)
LIMITATIONS = (
    "Each indicator is z-scored against both the country's own history (time dimension, minimum five years) "
    "and its peer group in the same year (cross-sectional dimension), then blended — a side with too few "
    "observations is dropped so the other carries the full weight rather than forcing garbage into the blend.",
    "The composite is a weighted blend of the pillar-level view and a sector-level aggregate "
    "(pillars grouped into sectors such as Macro & Fiscal and Financial & External); the sector "
    "share and the sector weights are configurable, so this score is best treated as one consistent "
    "methodology across countries rather than a fixed, undisclosed proprietary index.",
    "Scenario elasticities are pooled-panel OLS correlations, not a causal or structural model — "
    "they ignore lags, expectations effects, and country-specific transmission channels.",
    "Several indicators (e.g. external debt, credit-to-GDP gap) are only reported by their source for a subset "
    "of countries; a missing indicator is excluded and remaining weights renormalized, which can understate risk "
    "for a country with a real but unmeasured vulnerability in that category.",
)
CAUTION = "Only %s%% of the indicator weight had data for this country-year — treat this score with extra caution relative to a fully-populated one."
NO_ESTIMATE = "Insufficient historical data in this panel to estimate a reliable effect — see Limitations."
LEVER = (
    "The Scenario section above stress-tests sensitivity to %s specifically — it is one lever among several, "
    "not necessarily the top driver above."
)
RATE_DRIVER = "POLICY_RATE_YOY_CHANGE_BPS"
RATE_LABEL = "the US annual-average federal-funds-rate change increases by"
NO_SOURCES = "- See the indicator table for the per-indicator source mapping."


def whole(value: str) -> str:
    """A number without decimals, exact halves to the even neighbour."""
    return f"format_string('%.0f', bround({value}, 0))"


def signed(value: str, digits: int) -> str:
    """A number with its sign; a tiny negative keeps its minus."""
    return f"concat(if({value} < 0, '-', '+'), format_string('%.{digits}f', bround(abs({value}), {digits})))"


def _phrases(model: Model, code: str, better: bool) -> str:
    of = {i.code: (i.better_phrase if better else i.worse_phrase) or i.name for i in model.indicators}
    cases = " ".join(f"WHEN {t.text(c)} THEN {t.text(p)}" for c, p in of.items())
    return f"CASE {code} {cases} END"


def driver_phrase(model: Model, code: str, contribution: str) -> str:
    """Wording by indicator and sign; the label where none is configured."""
    return f"if({contribution} > 0D, {_phrases(model, code, False)}, {_phrases(model, code, True)})"


def story_scores(z: DataFrame, model: Model, k: int = TOP_DRIVERS) -> DataFrame:
    """Scores with each slice's k largest drivers as an array column, written once."""
    top = f"{scoring.ranked(z, model, k)} AS top"
    return pin(scoring.scores_from_z(z, model, extra=[top]))


def with_trend(scores: DataFrame) -> DataFrame:
    """Phrase against the calendar year before; null without that score."""
    w = Window.partitionBy(ENTITY).orderBy(PERIOD).rangeBetween(-1, -1)
    out = scores.withColumn("_before", F.first(SCORE).over(w))
    delta = f"({SCORE} - _before)"
    phrase = (
        f"CASE WHEN {delta} IS NULL THEN NULL "
        f"WHEN abs({delta}) < {t.num(UNCHANGED)} THEN concat('broadly unchanged from ', {whole('_before')}, ' a year earlier') "
        f"ELSE concat(if({delta} > 0D, 'up', 'down'), ' from ', {whole('_before')}, ' a year earlier (', "
        f"{signed(delta, 1)}, ' pts)') END AS trend_phrase"
    )
    return out.selectExpr("*", phrase).drop("_before")


def peer_medians(scores: DataFrame) -> DataFrame:
    """Median of the other members of the peer group, per scored and grouped slice.

    The group's middle values come from the distributed rank table; leaving oneself out shifts the
    position by one for entities ranked at or below it.
    """
    known = scores.where(F.col(SCORE).isNotNull() & F.col(PEER_GROUP).isNotNull()).select(ENTITY, PERIOD, PEER_GROUP, SCORE)
    keys = [PERIOD, PEER_GROUP]
    table = rank_table(known, keys, SCORE)
    n = F.col("n_total")
    low, high = F.floor(n / 2), F.ceil(n / 2)
    middle = table.groupBy(*keys).agg(
        *[
            order_statistic(at, SCORE).alias(name)
            for name, at in (("_l0", low), ("_l1", low + 1), ("_h0", high), ("_h1", high + 1))
        ]
    )
    own = known.join(table, [*keys, SCORE]).join(middle, keys)
    at = F.col("n_less") + 1

    def without_self(position: Column, here: str, after: str) -> Column:
        return F.when(position < at, F.col(here)).otherwise(F.col(after))

    median = (without_self(low, "_l0", "_l1") + without_self(high, "_h0", "_h1")) / 2.0
    return own.where(n > 1).select(ENTITY, PERIOD, median.alias("peer_median"))


def with_peers(scores: DataFrame) -> DataFrame:
    """Phrase against the median of the other group members."""
    out = scores.join(peer_medians(scores), [ENTITY, PERIOD], "left")
    gap = f"({SCORE} - peer_median)"
    phrase = (
        f"CASE WHEN {gap} IS NULL THEN NULL WHEN abs({gap}) < {t.num(IN_LINE)} THEN 'roughly in line with its peer group' "
        f"ELSE concat(if({gap} > 0D, 'above', 'below'), ' its peer-group median (', {whole('peer_median')}, ')') END AS peer_phrase"
    )
    return out.selectExpr("*", phrase)


def confidence_level(information: str | None = None) -> str:
    """T4: coverage level, one step lower when the scenario estimate carries little information."""
    base = f"CASE WHEN data_completeness >= {t.num(FULL)} THEN 'HIGH' WHEN data_completeness >= {t.num(PARTIAL)} THEN 'MODERATE' ELSE 'LOW' END"
    if information is None:
        return base
    weak = f"coalesce({information} IN ('LOW INFORMATION', 'INSUFFICIENT DATA'), false)"
    return f"CASE WHEN {weak} AND ({base}) = 'HIGH' THEN 'MODERATE' WHEN {weak} THEN 'LOW' ELSE {base} END"


def confidence_section(scenario: bool) -> str:
    share = whole("data_completeness * 100D")
    label = (
        f"CASE WHEN data_completeness >= {t.num(FULL)} THEN 'High coverage' "
        f"WHEN data_completeness >= {t.num(PARTIAL)} THEN 'Moderate coverage' ELSE 'Partial coverage' END"
    )
    data = f"concat('- Data: ', {label}, ' for this country-year (', {share}, '% of indicator weight populated).')"
    parts = [
        f"concat('Confidence: ', {confidence_level('information' if scenario else None)}, ' — a data-quality flag, not a statistical confidence interval.')",
        data,
    ]
    if scenario:
        lowered = f"information IN ('LOW INFORMATION', 'INSUFFICIENT DATA') AND data_completeness >= {t.num(PARTIAL)}"
        parts += [
            "if(information IS NOT NULL, concat('- Scenario estimate: ', information, '.'), NULL)",
            f"if({lowered}, '- The scenario impact should be read with extra caution.', NULL)",
            "if(out_of_sample, '- The scenario shock exceeds the observed driver range (extrapolation).', NULL)",
        ]
    return f"concat_ws('\\n', {', '.join(parts)})"


def limitations() -> str:
    """T5: fixed notes, preceded by a caution for thin slices."""
    caution = f"if(data_completeness < {t.num(PARTIAL)}, concat('- ', format_string({t.text(CAUTION)}, {whole('data_completeness * 100D')})), NULL)"
    fixed = ", ".join(t.text(f"- {note}") for note in LIMITATIONS)
    return f"concat_ws('\\n', {caution}, {fixed})"


# The wording in the functions below, up to reports(), and in with_trend, with_peers and confidence_section.
def _scenario_parts(preset: Preset) -> list[str]:
    rate = preset.driver == RATE_DRIVER
    label = RATE_LABEL if rate else f"{preset.driver} moves by"
    unit = "bps" if rate else ""
    shock = t.text(f'"If {label} {preset.amount:+.0f}{unit} from current levels..."')
    moving = (
        "if(scenario_band <> baseline_band, concat('moving the country into the ', scenario_band, ' band'), "
        "concat('staying within the ', scenario_band, ' band'))"
    )
    head = (
        "concat('Under this historical-sensitivity stress test, the model estimates a ', if(delta > 0D, 'deterioration', 'improvement'), "
        "' in the composite risk score of ', format_string('%.1f', bround(abs(delta), 1)), ' points (', "
        f"{whole('baseline_score')}, ' -> ', {whole('scenario_score')}, '), ', {moving}, '.')"
    )
    channel = (
        "transform(channels, c -> concat('Channel: ', c.target, ' estimated to move by ', "
        f"coalesce({signed('c.estimated_delta', 2)}, '+nan'), ' (', "
        "if(c.r_squared < 0.1D, 'low-information', 'moderate-information'), ', pooled-panel R²=', "
        "coalesce(format_string('%.2f', bround(c.r_squared, 2)), 'nan'), ', n=', c.n_obs, ').'))"
    )
    impact = f"if(delta IS NULL, {t.text(NO_ESTIMATE)}, concat_ws(' ', {head}, {channel}))"
    return ["'**Scenario:**'", shock, "''", "'**Impact:**'", impact, "''"]


def reports(
    scores: DataFrame,
    model: Model,
    generated_at: str,
    names: DataFrame | None = None,
    sources: Sequence[str] = (),
    scenarios: DataFrame | None = None,
    channels: DataFrame | None = None,
    preset: Preset | None = None,
) -> DataFrame:
    """The full text of every slice.

    ``scores`` comes from ``story_scores``. ``names`` (entity, name) replaces codes by names. A
    scenario block needs one preset, its rows from ``shock_scores`` and its ``target_deltas``.
    """
    rows = with_peers(with_trend(scores))
    if names is not None:
        rows = rows.join(names.select(ENTITY, F.col("name").alias("_name")), ENTITY, "left")
    else:
        rows = rows.withColumn("_name", F.lit(None).cast("string"))
    rows = rows.selectExpr("*", f"coalesce(_name, {ENTITY}) AS name")
    shocked = preset is not None
    if shocked:
        rows = rows.join(
            scenarios.select(
                ENTITY, PERIOD, "baseline_score", "baseline_band", "scenario_score", "scenario_band", "delta",
                "information", "out_of_sample",
            ),
            [ENTITY, PERIOD],
            "left",
        )
        # A handful of targets per slice, in the order of the preset.
        packed = channels.groupBy(ENTITY, PERIOD).agg(
            F.array_sort(F.collect_list(F.struct("position", "target", "estimated_delta", "r_squared", "n_obs"))).alias("channels")
        )
        rows = rows.join(packed, [ENTITY, PERIOD], "left")

    bullets = f"concat_ws('\\n', transform(slice(top, 1, {REPORT_DRIVERS}), d -> concat('- ', {driver_phrase(model, 'd.indicator', 'd.weighted_contribution')})))"
    lead = driver_phrase(model, "get(top, 0).indicator", "get(top, 0).weighted_contribution")
    view = [
        f"concat(name, '\\'s composite score of ', {whole(SCORE)}, ' places it in the ', lower(risk_band), ' risk band.')",
        "concat('That score is ', trend_phrase, '.')",
        "concat('It sits ', peer_phrase, '.')",
        f"concat('The single largest swing factor this period is ', lower({lead}), '.')",
        *([t.text(LEVER % preset.driver.replace("_", " ").lower())] if shocked else []),
        t.text(POSITIONING),
    ]
    listed = "\n".join(f"- {s}" for s in sources) if sources else NO_SOURCES
    lines = [
        f"concat('**', name, ' — Risk Score: ', {whole(SCORE)}, '/100 (', risk_band, ')**')",
        "''",
        "'**Main drivers:**'",
        bullets,
        "''",
        *(_scenario_parts(preset) if shocked else []),
        "'**Analyst view:**'",
        f"concat_ws(' ', {', '.join(view)})",
        "''",
        "'**Limitations:**'",
        limitations(),
        "''",
        "'**Confidence:**'",
        confidence_section(shocked),
        "''",
        t.text(f"**Sources:**\n{listed}\n\nGenerated: {generated_at}"),
    ]
    unscored = f"concat('No sufficient data to score ', name, ' for ', {PERIOD}, '.')"
    return rows.selectExpr(ENTITY, PERIOD, f"if({SCORE} IS NULL, {unscored}, concat_ws('\\n', {', '.join(lines)})) AS report")


def dossiers(
    scores: DataFrame, model: Model, scenarios: DataFrame | None = None
) -> DataFrame:
    """One nested row per scored slice; ``scores`` comes from ``story_scores`` with k = 6.

    An entity's trajectory is the same for all its slices: it is a table of its own (``rank.trajectories``), looked up by
    entity when a slice is shown, since repeated in each slice it would grow with the square of the periods.
    """
    pillars = scoring.pillar_list(rank.scored(scores), model)
    contributions = (
        "transform(top, d -> named_struct('indicator', d.indicator, 'label', d.label, 'category', d.category, 'pillar', d.pillar, "
        "'contribution_points', d.weighted_contribution * 100D, 'raw_value', d.raw_value, 'unit', d.unit)) AS top_drivers"
    )
    rows = pillars.selectExpr(
        ENTITY, PERIOD, SCORE, "risk_band", "data_completeness",
        "named_struct('direction', trend_direction, 'delta_1', trend_1y_delta, 'delta_2', trend_2y_delta) AS trend",
        "pillars", contributions,
    )
    standing = rank.peer_standing(scores).select(
        ENTITY, PERIOD, F.struct("percentile", "riskier_share", "rank", "n", "group_name").alias("peer_standing")
    )
    out = rows.join(standing, [ENTITY, PERIOD], "left")
    if scenarios is not None:
        packed = scenarios.groupBy(ENTITY, PERIOD).agg(
            F.array_sort(
                F.collect_list(F.struct("preset", "scenario_score", "scenario_band", "delta", "information", "out_of_sample"))
            ).alias("scenarios")
        )
        out = out.join(packed, [ENTITY, PERIOD], "left")
    return out


def complete(dossiers: DataFrame, trajectories: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """T7 with R14: slices with their entity's trajectory, null where there is none.

    ``wanted`` holds the (entity, period) pairs to show, in any case of letters; pairs without a dossier give no row and
    repeated pairs one. By default each entity's latest slice is shown.
    """
    if wanted is None:
        latest = F.max_by(F.struct(*(c for c in dossiers.columns if c != ENTITY)), PERIOD).alias("slice")
        rows = dossiers.groupBy(ENTITY).agg(latest).select(ENTITY, "slice.*")
    else:
        pairs = wanted.select(F.upper(ENTITY).alias(ENTITY), PERIOD).distinct()
        rows = dossiers.join(pairs, [ENTITY, PERIOD], "left_semi")
    return rows.join(trajectories.select(ENTITY, "trajectory"), ENTITY, "left").select(*dossiers.columns, "trajectory")


def lookup(dossiers: DataFrame, trajectories: DataFrame, entity: str, period: int | None = None) -> DataFrame:
    """One slice, complete: of the period, or the entity's latest; no row where there is none.

    Over written tables both filters stand before the aggregate and the join; how much a scan skips depends on how they are sorted.
    """
    mine = dossiers.where(F.col(ENTITY) == entity.upper())
    if period is not None:
        mine = mine.where(F.col(PERIOD) == period)
    return complete(mine, trajectories.where(F.col(ENTITY) == entity.upper()))


def history(scores: DataFrame, entity: str | None = None) -> DataFrame:
    """Score history, all periods."""
    rows = rank.scored(scores)
    if entity is not None:
        rows = rows.where(F.col(ENTITY) == entity.upper())
    return rows.select(ENTITY, PERIOD, SCORE, "risk_band", "data_completeness", "trend_direction", "trend_1y_delta")


