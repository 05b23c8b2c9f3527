"""What-if scenarios.

A shock moves the target cells of one (entity, period) and asks for that cell's score only. So no
panel is scored again: the history statistics before the cell and the peer statistics around it are
known, and replacing one value updates both in closed form. Every preset for every cell of the panel
comes out of one pass with the same single exchange by entity as scoring itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscore.functions import text as t
from panelscore.functions.scalar import col, finite
from panelscore.functions.stats import ols
from panelscore.model import Model, Preset
from panelscore.operators import score as scoring
from panelscore.schema import ENTITY, PERIOD

BEFORE = f"OVER (PARTITION BY {ENTITY} ORDER BY {PERIOD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

# Information labels with the least observations and median r-squared they need.
HIGH, MODERATE, LOW, NONE = "HIGH INFORMATION", "MODERATE INFORMATION", "LOW INFORMATION", "INSUFFICIENT DATA"
HIGH_BAR, MODERATE_BAR = (80, 0.35), (30, 0.10)
EXTRAPOLATION = " The chosen shock sits outside the observed historical range of the driver and is an extrapolation."


def usable_targets(panel: DataFrame, preset: Preset) -> list[str]:
    """Targets in the panel; none without the driver."""
    return [target for target in preset.targets if target in panel.columns] if preset.driver in panel.columns else []


def _pairs(panel: DataFrame, presets: Sequence[Preset]) -> list[tuple[int, Preset, int, str]]:
    return [(s, p, k, target) for s, p in enumerate(presets) for k, target in enumerate(usable_targets(panel, p))]


def estimates(panel: DataFrame, presets: Sequence[Preset]) -> DataFrame:
    """One row: regression of every (driver, target) pair (X1), the delta it implies (X3), the range of
    every driver (X6), the estimation window (X7) and the information label (X4).

    All pairs share a single pass with partial aggregation. Columns end in _<preset>_<target>.
    """
    aggregates = [F.min(PERIOD).alias("from_period"), F.max(PERIOD).alias("to_period")]
    for s, preset, k, target in _pairs(panel, presets):
        found = ols(finite(col(preset.driver)), finite(col(target)))
        aggregates += [e.alias(f"{name}_{s}_{k}") for name, e in found.items()]
    for s, preset in enumerate(presets):
        # Nothing is known of a driver that nobody delivered.
        driver = finite(col(preset.driver)) if preset.driver in panel.columns else F.lit(None).cast("double")
        aggregates += [F.min(driver).alias(f"low_{s}"), F.max(driver).alias(f"high_{s}")]
    one = panel.agg(*aggregates)
    deltas = [f"slope_{s}_{k} * {t.num(p.amount)} AS delta_{s}_{k}" for s, p, k, _ in _pairs(panel, presets)]
    one = one.selectExpr("*", *deltas)
    labels = []
    for s, preset in enumerate(presets):
        models = [
            f"named_struct('d', delta_{s}_{k}, 'r', r_squared_{s}_{k}, 'n', n_obs_{s}_{k})"
            for k in range(len(usable_targets(panel, preset)))
        ]
        usable = f"filter(array({', '.join(models)}), m -> m.d IS NOT NULL)" if models else None
        labels.append(f"{_information(usable)} AS information_{s}")
    return one.selectExpr("*", *labels)


def _information(usable: str | None) -> str:
    if usable is None:
        return t.text(NONE)
    known = f"array_sort(transform(filter({usable}, m -> m.r IS NOT NULL), m -> m.r))"
    size = f"size({known})"
    median = f"(element_at({known}, CAST(({size} + 1) DIV 2 AS INT)) + element_at({known}, CAST({size} DIV 2 + 1 AS INT))) / 2"
    least = f"array_min(transform({usable}, m -> m.n))"

    def clears(bar: tuple[int, float]) -> str:
        return f"({least} >= {bar[0]} AND {size} > 0 AND {median} >= {t.num(bar[1])})"

    return (
        f"CASE WHEN size({usable}) = 0 THEN {t.text(NONE)} WHEN {clears(HIGH_BAR)} THEN {t.text(HIGH)} "
        f"WHEN {clears(MODERATE_BAR)} THEN {t.text(MODERATE)} ELSE {t.text(LOW)} END"
    )


def regressions(panel: DataFrame, presets: Sequence[Preset]) -> DataFrame:
    """X1, X4 as rows: one per preset and target."""
    rows = ", ".join(
        f"named_struct('preset', {t.text(p.key)}, 'driver', {t.text(p.driver)}, 'target', {t.text(target)}, "
        f"'slope', slope_{s}_{k}, 'r_squared', r_squared_{s}_{k}, 'n_obs', n_obs_{s}_{k}, "
        f"'driver_min', driver_min_{s}_{k}, 'driver_max', driver_max_{s}_{k}, 'information', information_{s})"
        for s, p, k, target in _pairs(panel, presets)
    )
    return estimates(panel, presets).selectExpr(f"inline({_rows(rows, REGRESSION)})")


def _rows(structs: str, fields: str) -> str:
    return f"array({structs})" if structs else f"CAST(array() AS ARRAY<STRUCT<{fields}>>)"


REGRESSION = "preset: STRING, driver: STRING, target: STRING, slope: DOUBLE, r_squared: DOUBLE, n_obs: BIGINT, driver_min: DOUBLE, driver_max: DOUBLE, information: STRING"
DELTA = (
    "preset: STRING, target: STRING, position: INT, baseline_value: DOUBLE, estimated_delta: DOUBLE, r_squared: DOUBLE, n_obs: BIGINT, "
    "baseline_driver_value: DOUBLE, shocked_driver_value: DOUBLE"
)


def target_deltas(panel: DataFrame, presets: Sequence[Preset], found: DataFrame | None = None) -> DataFrame:
    """Estimated move of every target for every cell and preset; ``position`` is the target's place in the preset.

    ``found`` may pass finished ``estimates``, the one row that is joined to every cell.
    """
    found = estimates(panel, presets) if found is None else found
    rows = ", ".join(
        f"named_struct('preset', {t.text(p.key)}, 'target', {t.text(target)}, 'position', {k}, 'baseline_value', CAST(`{target}` AS DOUBLE), "
        f"'estimated_delta', delta_{s}_{k}, 'r_squared', r_squared_{s}_{k}, 'n_obs', n_obs_{s}_{k}, "
        f"'baseline_driver_value', CAST(`{p.driver}` AS DOUBLE), 'shocked_driver_value', `{p.driver}` + {t.num(p.amount)})"
        for s, p, k, target in _pairs(panel, presets)
    )
    return panel.crossJoin(found).selectExpr(ENTITY, PERIOD, f"inline({_rows(rows, DELTA)})")


def _replaced_peer_z(n: int, x: str, model: Model) -> str:
    """Peer z after one member of the group moved from v to x: same n, shifted mean, updated spread."""
    mean = f"(pm{n} + ({x} - v{n}) / pn{n})"
    before = f"pn{n} * ps{n} * ps{n}"
    square = f"({before} + ({x} - v{n}) * ({x} - {mean} + v{n} - pm{n}))"
    # What is left of the spread when nearly all of it is taken away is rounding.
    square = f"if({square} <= {t.num(t.NO_SPREAD)} * ({before} + ({x} - v{n}) * ({x} - v{n})), 0D, {square})"
    return t.zscore(x, mean, f"sqrt({square} / pn{n})", f"pn{n}", model.params.min_peer_obs)


def _replaced_history_z(n: int, x: str, model: Model) -> str:
    """History z when the current value is x: everything before, plus x."""
    count = f"(bn{n} + 1)"
    mean = f"coalesce(bm{n} + ({x} - bm{n}) / {count}, {x})"
    square = f"coalesce(bs{n} * bs{n} * bn{n} + ({x} - bm{n}) * ({x} - bm{n}) * bn{n} / {count}, 0D)"
    return t.zscore(x, mean, f"sqrt({square} / {count})", count, model.params.min_history_obs)


def _moved(n: int) -> str:
    """A move below the last digits of the value is none."""
    return f"abs(x{n} - v{n}) > {t.num(t.NO_SPREAD)} * abs(v{n})"


def shock_scores(
    panel: DataFrame, model: Model, presets: Sequence[Preset], peers: DataFrame | None = None, found: DataFrame | None = None
) -> DataFrame:
    """X5-X7 for every scored cell and preset: baseline and shocked score, bands, extrapolation, labels, status.

    ``panel`` should be a table: the regressions take one pass over it, unless ``found`` passes finished ``estimates``, and
    the scores another. A row unfolds into its presets after the windows, so the update formulas exist once, not per preset.
    A preset whose driver nobody delivered gives rows without a shocked score and with that status.
    """
    found = estimates(panel, presets) if found is None else found
    numbers = scoring.present(panel, model)
    number_of = {model.indicators[n].code: n for n in numbers}
    pairs = [(s, k, number_of[target]) for s, _, k, target in _pairs(panel, presets) if target in number_of]
    moved = sorted({n for _, _, n in pairs})
    drivers = sorted({p.driver for p in presets if p.driver in panel.columns})
    keys = scoring.KEYS

    carried = [f"CAST(`{d}` AS DOUBLE) AS driver_{j}" for j, d in enumerate(drivers)]
    values = scoring.prepare(panel, model, peers, carried)
    joined = scoring.with_peer_statistics(values, numbers)
    staged = joined.selectExpr(
        *values.columns,
        *[f"{p}{n}" for n in moved for p in ("pn", "pm", "ps")],
        *[f"{scoring.peer_z(n, model)} AS zp{n}" for n in numbers],
    )
    before = [
        f"{f}(v{n}) {BEFORE} AS {p}{n}" for n in moved for p, f in (("bn", "count"), ("bm", "avg"), ("bs", "stddev_pop"))
    ]
    staged = scoring.with_history_z(staged.selectExpr("*", *before), model, numbers)

    def rolled(df: DataFrame, combined: dict[int, str], name: str) -> DataFrame:
        pillars = scoring.pillar_exprs(model, set(numbers), combined)
        columns = {p: f"{name}p_{j}" for j, p in enumerate(pillars)}
        df = df.selectExpr("*", *[f"{pillars[p]} AS {c}" for p, c in columns.items()])
        sectors = scoring.sector_exprs(model, columns)
        names = {s: f"{name}s_{j}" for j, s in enumerate(sectors)}
        df = df.selectExpr("*", *[f"{sectors[s]} AS {c}" for s, c in names.items()])
        composite, _ = scoring.composite_exprs(model, columns, names)
        return df.selectExpr("*", f"{composite} AS {name}_score").drop(*columns.values(), *names.values())

    staged = rolled(staged, {}, "baseline").crossJoin(found)
    delta_of = {(s, n): f"delta_{s}_{k}" for s, k, n in pairs}
    rows = []
    for s, p in enumerate(presets):
        known = p.driver in drivers
        driver = f"driver_{drivers.index(p.driver)}" if known else "CAST(NULL AS DOUBLE)"
        after = f"({driver} + {t.num(p.amount)})"
        low, high = f"low_{s}", f"high_{s}"
        # Without an estimate a target does not move.
        moves = ", ".join(f"'d{n}', {delta_of.get((s, n), 'CAST(NULL AS DOUBLE)')}" for n in moved)
        rows.append(
            f"named_struct('preset', {t.text(p.key)}, 'baseline_driver_value', {driver}, 'shocked_driver_value', {after}, "
            f"'information', information_{s}, 'known', {str(known).lower()}, "
            f"'out_of_sample', coalesce({after} < {low} OR {after} > {high}, false){', ' + moves if moves else ''})"
        )
    staged = staged.selectExpr("*", f"inline(array({', '.join(rows)}))")
    staged = staged.selectExpr("*", *[f"v{n} + d{n} AS x{n}" for n in moved])
    timed = []
    for n in moved:
        timed.append(f"if({_moved(n)}, {_replaced_history_z(n, f'x{n}', model)}, zt{n}) AS t{n}")
        timed.append(f"if({_moved(n)}, {_replaced_peer_z(n, f'x{n}', model)}, zp{n}) AS q{n}")
    staged = staged.selectExpr("*", *timed)
    staged = staged.selectExpr("*", *[f"{scoring.blend(f't{n}', f'q{n}', model)} AS c{n}" for n in moved])
    out = rolled(staged, {n: f"c{n}" for n in moved}, "scenario").selectExpr("* EXCEPT (scenario_score)", "if(known, scenario_score, NULL) AS scenario_score")
    window = "concat(from_period, '–', to_period)"
    return out.selectExpr(
        *keys,
        "preset",
        "baseline_score",
        f"{t.band('baseline_score')} AS baseline_band",
        "scenario_score",
        f"coalesce({t.band('scenario_score')}, 'Unavailable') AS scenario_band",
        "scenario_score - baseline_score AS delta",
        "baseline_driver_value",
        "shocked_driver_value",
        "information",
        "out_of_sample",
        f"{window} AS estimation_window",
        "CASE WHEN NOT known THEN 'driver not in the panel' WHEN baseline_score IS NULL THEN 'no baseline score' ELSE 'ok' END AS status",
    )


def narrative(scenarios: DataFrame, presets: Sequence[Preset]) -> DataFrame:
    """One sentence per scenario row."""

    def pick(of) -> str:
        return "CASE preset " + " ".join(f"WHEN {t.text(p.key)} THEN {t.text(of(p))}" for p in presets) + " END"

    # The wording of the sentence.
    head = pick(
        lambda p: f"{p.name or 'Custom'} shock: a {abs(p.amount):g} {p.unit} change in the {p.driver_label or p.driver} ({p.driver}) moves "
    )
    direction = "CASE WHEN delta > 1e-9D THEN 'elevated risk' WHEN delta < -1e-9D THEN 'moderated risk' ELSE 'unchanged risk' END"
    sentence = (
        f"concat({head}, {ENTITY}, '\\'s risk score from ', format_string('%.1f', bround(baseline_score, 1)), ' (', baseline_band, ') to ', "
        "format_string('%.1f', bround(scenario_score, 1)), ' (', scenario_band, ') — a ', format_string('%.1f', bround(abs(delta), 1)), "
        f"'-point move indicating ', {direction}, '. Estimation: pooled-panel bivariate OLS on the ', estimation_window, ' sample; ', "
        f"lower(information), '.', if(out_of_sample, {t.text(EXTRAPOLATION)}, ''))"
    )
    return scenarios.selectExpr("*", f"if(status = 'ok', {sentence}, NULL) AS narrative")


def run_shock(
    panel: DataFrame, model: Model, preset: Preset, entity: str, period: int, peers: DataFrame | None = None
) -> DataFrame:
    """One slice of one preset. Raises where the slice or its score does not exist."""
    rows = narrative(shock_scores(panel, model, [preset], peers), [preset]).where(
        (F.col(ENTITY) == entity.upper()) & (F.col(PERIOD) == int(period))
    )
    found = rows.select("status").head(1)
    if not found:
        raise ValueError("the selected slice is not in the panel")
    if found[0]["status"] == "no baseline score":
        raise ValueError("no baseline score is available for the selected slice")
    if found[0]["status"] != "ok":
        raise ValueError(f"scenario driver {preset.driver} is not in the panel")
    return rows
