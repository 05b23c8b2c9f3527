"""Scoring (Z1-Z17): two z-scores, pillars, sectors, composite, trend, drivers.

The panel stays wide, one row per (entity, period). That fixes the whole layout:

* peer statistics: one partially aggregated ``groupBy(period, peer_group)`` over all indicators,
  written out and joined back. Catalyst broadcasts that table when its files are small and otherwise
  shuffles, where AQE splits a hot group (skew join). No window over a peer group exists.
* own history: one exchange by entity; all indicators and the trend share its sort. An entity has
  at most one row per period, so a window partition is bounded by the calendar.
* the panel is read twice (statistics, scores), so it should be a table or pinned. Everything after
  it is deterministic to the last bit, which ranks and self-joins on scores rely on.
* blend, pillars, sectors, completeness, composite: row expressions, no further shuffle. The driver
  table and top-k drivers unfold from the row as well.

Column names: v<n> value, zp<n> peer z, zt<n> history z, zc<n> blend of indicator number n.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscore.functions import text as t
from panelscore.model import Indicator, Model, pillar_column, sector_column
from panelscore.schema import ENTITY, PEER_GROUP, PERIOD, require
from panelscore.session import pin

NO_GROUP = "__all__"
KEYS = (ENTITY, PERIOD, PEER_GROUP)
SEEN = f"OVER (PARTITION BY {ENTITY} ORDER BY {PERIOD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def present(panel: DataFrame, model: Model) -> list[int]:
    found = [n for n, i in enumerate(model.indicators) if i.code in panel.columns]
    if not found:
        raise ValueError("no configured indicator was found in the panel")
    return found


def peer_groups(peers: DataFrame) -> DataFrame:
    """(entity, peer_group) with upper-case ids; an entity in two groups is an error where it is read."""
    one = peers.groupBy(F.upper(F.col(ENTITY).cast("string")).alias(ENTITY)).agg(F.min(PEER_GROUP).alias(PEER_GROUP), F.max(PEER_GROUP).alias("_last"))
    twice = F.raise_error(F.concat(F.lit("more than one peer group for "), F.col(ENTITY))).cast("string")
    return one.select(ENTITY, F.when(F.col(PEER_GROUP).eqNullSafe(F.col("_last")), F.col(PEER_GROUP)).otherwise(twice).alias(PEER_GROUP))


def prepare(
    panel: DataFrame, model: Model, peers: DataFrame | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """Typed columns v<n>, one per indicator present; peer_group stays null where there is none."""
    require(panel, ENTITY, PERIOD)
    if peers is not None:
        panel = panel.drop(PEER_GROUP).withColumn(ENTITY, F.upper(F.col(ENTITY).cast("string")))
        panel = panel.join(peer_groups(peers), ENTITY, "left")
    elif PEER_GROUP not in panel.columns:
        panel = panel.withColumn(PEER_GROUP, F.lit(None).cast("string"))
    return panel.selectExpr(
        f"upper(CAST({ENTITY} AS STRING)) AS {ENTITY}",
        f"CAST({PERIOD} AS INT) AS {PERIOD}",
        PEER_GROUP,
        # NaN counts as missing.
        *[
            f"nullif(CAST(`{model.indicators[n].code}` AS DOUBLE), CAST('NaN' AS DOUBLE)) AS v{n}"
            for n in present(panel, model)
        ],
        *extra,
    )


def peer_statistics(values: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """n, mean and population std per (period, group) and indicator.

    Entities without a group are compared with each other.
    """
    aggregates = [
        F.expr(f"{function}(v{n}) AS {prefix}{n}")
        for n in numbers
        for prefix, function in (("pn", "count"), ("pm", "avg"), ("ps", "stddev_pop"))
    ]
    return values.groupBy(
        F.col(PERIOD).alias("_period"), F.expr(f"coalesce({PEER_GROUP}, '{NO_GROUP}')").alias("_group")
    ).agg(*aggregates)


def with_peer_statistics(values: DataFrame, numbers: Sequence[int]) -> DataFrame:
    # A small table of its own: written once, its real size decides between broadcast and shuffle.
    stats = pin(peer_statistics(values, numbers))
    on = F.expr(f"{PERIOD} = _period AND coalesce({PEER_GROUP}, '{NO_GROUP}') = _group")
    return values.join(stats, on, "left").drop("_period", "_group")


def peer_z(n: int, model: Model, v: str | None = None) -> str:
    """Z2 from joined statistics."""
    return t.zscore(v or f"v{n}", f"pm{n}", f"ps{n}", f"pn{n}", model.params.min_peer_obs)


def blend(z_time: str, z_peer: str, model: Model) -> str:
    """Z3: weighted mean of the sides present, 0 when neither is."""
    p = model.params
    return f"coalesce({t.weighted_mean([z_time, z_peer], [p.history_z_weight, p.peer_z_weight])}, 0D)"


def with_history_z(df: DataFrame, model: Model, numbers: Sequence[int], extra: Sequence[str] = ()) -> DataFrame:
    """Expanding window (this row and everything before it, never a later one), then the blend."""
    stats = [f"{f}(v{n}) {SEEN} AS {p}{n}" for n in numbers for p, f in (("hn", "count"), ("hm", "avg"), ("hs", "stddev_pop"))]
    seen = df.selectExpr("*", *stats)
    least = model.params.min_history_obs
    kept = [c for c in df.columns]
    timed = seen.selectExpr(
        *kept, *[f"{t.zscore(f'v{n}', f'hm{n}', f'hs{n}', f'hn{n}', least)} AS zt{n}" for n in numbers], *extra
    )
    return timed.selectExpr("*", *[f"{blend(f'zt{n}', f'zp{n}', model)} AS zc{n}" for n in numbers])


def z_frame(panel: DataFrame, model: Model, peers: DataFrame | None = None) -> DataFrame:
    """Wide z table: v<n>, zp<n>, zt<n>, zc<n> per indicator present."""
    numbers = present(panel, model)
    joined = with_peer_statistics(prepare(panel, model, peers), numbers)
    peer = joined.selectExpr(*KEYS, *[f"v{n}" for n in numbers], *[f"{peer_z(n, model)} AS zp{n}" for n in numbers])
    return with_history_z(peer, model, numbers)


def numbers_in(z: DataFrame) -> set[int]:
    return {int(c[2:]) for c in z.columns if c.startswith("zc")}


def contribution(n: int, indicator: Indicator, combined: Mapping[int, str] | None = None) -> str:
    """Z4."""
    return f"({(combined or {}).get(n, f'zc{n}')}) * {t.num(indicator.direction)} * {t.num(indicator.weight)}"


def pillar_exprs(model: Model, numbers: set[int], combined: Mapping[int, str] | None = None) -> dict[str, str]:
    """Sum of contributions over available weight, mapped to 0-100; null without data.

    ``combined`` replaces the blended z of single indicators, as a scenario does.
    """
    out = {}
    for pillar in model.active_pillars:
        members = [(n, i) for n, i in enumerate(model.indicators) if i.pillar == pillar and n in numbers]
        weighted = [(n, i) for n, i in members if i.weight != 0]
        if not members:
            continue
        total = t.sum_of([contribution(n, i, combined) for n, i in weighted])
        available = t.sum_of([f"if(v{n} IS NULL, 0D, {t.num(i.weight)})" for n, i in weighted])
        signal = f"try_divide({total}, nullif(greatest({available}, 0D), 0D))"
        out[pillar] = t.signal_to_score(signal, f"{available} > 0D")
    return out


def sector_exprs(model: Model, pillars: Mapping[str, str]) -> dict[str, str]:
    """Mean of member pillars, renormalised by pillar weight."""
    out = {}
    for sector, listed in model.sectors.items():
        members = [p for p in listed if p in pillars]
        if members:
            out[sector] = t.weighted_mean([pillars[p] for p in members], [model.pillar_weights[p] for p in members])
    return out


def composite_exprs(model: Model, pillars: Mapping[str, str], sectors: Mapping[str, str]) -> tuple[str, str]:
    """(composite, aggregate sector score)."""
    pillar_view = t.weighted_mean(list(pillars.values()), [model.pillar_weights[p] for p in pillars])
    sector_view = t.weighted_mean(list(sectors.values()), [model.sector_weights[s] for s in sectors])
    beta = model.params.sector_composite_weight
    blended = f"{pillar_view} * {t.num(1.0 - beta)} + {sector_view} * {t.num(beta)}"
    return (blended if sectors else pillar_view), sector_view


def completeness_expr(model: Model, numbers: set[int]) -> str:
    """Weight of the indicators with a value over all configured weight, also of absent ones."""
    seen = t.sum_of(
        [f"if(v{n} IS NULL, 0D, {t.num(i.weight)})" for n, i in enumerate(model.indicators) if n in numbers and i.weight != 0]
    )
    return f"greatest(0D, least(1D, try_divide(bround({seen}, 6), {t.num(model.total_weight)})))"


def trend_columns(scores: DataFrame, model: Model, keys: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Deltas over 1 and 2 rows and their reading."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {PERIOD})"
    limit = t.num(model.params.trend_threshold_points)
    out = scores.selectExpr(
        "*",
        f"risk_score - lag(risk_score, 1) {over} AS trend_1y_delta",
        f"risk_score - lag(risk_score, 2) {over} AS trend_2y_delta",
    )
    return out.selectExpr(
        "*",
        f"CASE WHEN trend_1y_delta IS NULL THEN NULL WHEN abs(trend_1y_delta) <= {limit} THEN 'Stable' "
        f"WHEN trend_1y_delta > {limit} THEN 'Deteriorating' ELSE 'Improving' END AS trend_direction",
    )


def rolled_up(z: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """Pillar columns next to ``keep``; later steps refer to them by name."""
    pillars = pillar_exprs(model, numbers_in(z))
    return z.selectExpr(*keep, *[f"{e} AS {pillar_column(p)}" for p, e in pillars.items()])


def scores_from_z(z: DataFrame, model: Model, extra: Sequence[str] = ()) -> DataFrame:
    """One row per (entity, period) with pillar and sector scores as columns.

    ``extra`` expressions over the z table ride along, which saves a join of the row with itself.
    """
    staged = rolled_up(z, model, [*KEYS, f"{completeness_expr(model, numbers_in(z))} AS data_completeness", *extra])
    pillars = {p: pillar_column(p) for p in model.active_pillars if pillar_column(p) in staged.columns}
    staged = staged.selectExpr("*", *[f"{e} AS {sector_column(s)}" for s, e in sector_exprs(model, pillars).items()])
    sectors = {s: sector_column(s) for s in model.sectors if sector_column(s) in staged.columns}
    composite, sector_view = composite_exprs(model, pillars, sectors)
    staged = staged.selectExpr("*", f"{composite} AS risk_score", f"{sector_view} AS sector_score")
    return trend_columns(staged.selectExpr("*", f"{t.band('risk_score')} AS risk_band"), model)


def score_panel(panel: DataFrame, model: Model, peers: DataFrame | None = None) -> DataFrame:
    return scores_from_z(z_frame(panel, model, peers), model)


def _unfold(scores: DataFrame, entries: Sequence[str], value: str, keep: Sequence[str] = KEYS[:2]) -> DataFrame:
    out = scores.selectExpr(*keep, f"inline(array({', '.join(entries)}))")
    return out.where(F.col(value).isNotNull())


def pillar_scores(scores: DataFrame, model: Model, keep: Sequence[str] = KEYS[:2]) -> DataFrame:
    """Long pillar table, a narrow unfold of the score row."""
    entries = [
        f"named_struct('pillar', {t.text(p)}, 'pillar_score', {pillar_column(p)}, 'pillar_weight', {t.num(model.pillar_weights[p])})"
        for p in model.active_pillars
        if pillar_column(p) in scores.columns
    ]
    return _unfold(scores, entries, "pillar_score", keep).selectExpr("*", f"{t.band('pillar_score')} AS pillar_band")


def sector_scores(scores: DataFrame, model: Model, keep: Sequence[str] = KEYS[:2]) -> DataFrame:
    entries = [
        f"named_struct('sector', {t.text(s)}, 'sector_score', {sector_column(s)}, 'sector_weight', {t.num(model.sector_weights[s])})"
        for s in model.sectors
        if sector_column(s) in scores.columns
    ]
    return _unfold(scores, entries, "sector_score", keep).selectExpr("*", f"{t.band('sector_score')} AS sector_band")


def driver_array(z: DataFrame, model: Model) -> str:
    """Array of driver structs of a row."""

    def entry(n: int, i: Indicator) -> str:
        z_risk = f"zc{n} * {t.num(i.direction)}"
        return (
            f"named_struct('indicator', {t.text(i.code)}, 'category', {t.text(i.category)}, 'pillar', {t.text(i.pillar)}, "
            f"'label', {t.text(i.name)}, 'raw_value', v{n}, 'unit', {t.text(i.unit)}, "
            f"'risk_direction', {t.num(i.direction)}, 'weight', {t.num(i.weight)}, 'z_time', zt{n}, 'z_peer', zp{n}, "
            f"'z_combined', zc{n}, 'z_risk', {z_risk}, 'weighted_contribution', {z_risk} * {t.num(i.weight)})"
        )

    numbers = numbers_in(z)
    return f"array({', '.join(entry(n, i) for n, i in enumerate(model.indicators) if n in numbers)})"


def drivers(z: DataFrame, model: Model) -> DataFrame:
    """Long driver table."""
    return z.selectExpr(ENTITY, PERIOD, f"inline({driver_array(z, model)})")


def ranked(z: DataFrame, model: Model, k: int | None = None) -> str:
    """Array of a row's drivers by size of contribution, ties by indicator; the first k of them.

    Equal up to the twelfth decimal counts as a tie, so rounding noise never decides. Small keys are
    sorted, and only the chosen drivers get their full record.
    """
    numbers = sorted(numbers_in(z))
    kept = [model.indicators[n] for n in numbers]
    keys = []
    for position, (n, i) in enumerate(zip(numbers, kept)):
        c = contribution(n, i)
        keys.append(f"named_struct('k', -rint(abs({c}) * 1e12D), 'i', {t.text(i.code)}, 'n', {position}, 'c', {c})")
    order = f"array_sort(array({', '.join(keys)}))"
    if k is not None:
        order = f"slice({order}, 1, {int(k)})"

    def fixed(values: Sequence[str]) -> str:
        return f"get(array({', '.join(values)}), x.n)"

    def column(prefix: str) -> str:
        return fixed([f"{prefix}{n}" for n in numbers])

    z_risk = f"{column('zc')} * {fixed([t.num(i.direction) for i in kept])}"
    return (
        f"transform({order}, x -> named_struct('indicator', x.i, 'category', {fixed([t.text(i.category) for i in kept])}, "
        f"'pillar', {fixed([t.text(i.pillar) for i in kept])}, 'label', {fixed([t.text(i.name) for i in kept])}, "
        f"'raw_value', {column('v')}, 'unit', {fixed([t.text(i.unit) for i in kept])}, "
        f"'risk_direction', {fixed([t.num(i.direction) for i in kept])}, 'weight', {fixed([t.num(i.weight) for i in kept])}, "
        f"'z_time', {column('zt')}, 'z_peer', {column('zp')}, 'z_combined', {column('zc')}, 'z_risk', {z_risk}, "
        "'weighted_contribution', x.c))"
    )


def top_driver(z: DataFrame, model: Model, field: Sequence[str]) -> str:
    """One property, listed by indicator, of a row's largest driver."""
    numbers = sorted(numbers_in(z))
    keys = ", ".join(
        f"named_struct('k', -rint(abs({contribution(n, model.indicators[n])}) * 1e12D), 'i', {t.text(model.indicators[n].code)}, 'f', {t.text(field[n])})"
        for n in numbers
    )
    return f"array_min(array({keys})).f"


def top_drivers(z: DataFrame, model: Model, k: int = 6) -> DataFrame:
    """The k largest contributions of every slice, sorted inside the row."""
    top = z.selectExpr(ENTITY, PERIOD, f"posexplode({ranked(z, model, k)}) AS (_pos, _d)")
    return top.selectExpr(ENTITY, PERIOD, "_pos + 1 AS position", "_d.*")


def signed_drivers(z: DataFrame, model: Model, up: int = 6, down: int = 6) -> DataFrame:
    """Largest contributions on either side, with the bar width against the slice maximum."""
    packed = z.selectExpr(ENTITY, PERIOD, f"{ranked(z, model)} AS _all")
    sides = packed.selectExpr(
        ENTITY,
        PERIOD,
        "array_max(transform(_all, d -> abs(d.weighted_contribution))) AS _max",
        "explode(array("
        f"named_struct('side', 'up', 'd', slice(filter(_all, d -> d.weighted_contribution > 0), 1, {int(up)})),"
        f"named_struct('side', 'down', 'd', slice(filter(_all, d -> d.weighted_contribution < 0), 1, {int(down)}))"
        ")) AS _s",
    )
    rows = sides.selectExpr(ENTITY, PERIOD, "_max", "_s.side", "posexplode(_s.d) AS (_pos, _d)")
    return rows.selectExpr(
        ENTITY,
        PERIOD,
        "side",
        "_pos + 1 AS position",
        "_d.indicator",
        "_d.label",
        "_d.weighted_contribution",
        "abs(_d.weighted_contribution) / greatest(_max, 1e-11D) AS bar_share",
    )


def pillar_list(scores: DataFrame, model: Model) -> DataFrame:
    """Pillars of a slice ordered by score, highest first, as one array column; scores equal to nine decimals are ties."""
    entries = ", ".join(
        f"named_struct('k', rint({pillar_column(p)} * 1e9D), 'pillar', {t.text(p)}, 'score', {pillar_column(p)}, 'band', {t.band(pillar_column(p))}, "
        f"'weight', {t.num(model.pillar_weights[p])})"
        for p in model.active_pillars
        if pillar_column(p) in scores.columns
    )
    ordered = f"sort_array(filter(array({entries}), p -> p.score IS NOT NULL), false)"
    return scores.selectExpr(
        "*", f"transform({ordered}, p -> named_struct('score', p.score, 'pillar', p.pillar, 'band', p.band, 'weight', p.weight)) AS pillars"
    )


def scheme_scores(z: DataFrame, model: Model) -> DataFrame:
    """Configured and equal-weight composites of the same pillars, from one pass."""
    staged = rolled_up(z, model, KEYS)
    pillars = {p: pillar_column(p) for p in model.active_pillars if pillar_column(p) in staged.columns}
    sectors = sector_exprs(model, pillars)
    staged = staged.selectExpr("*", *[f"{e} AS {sector_column(s)}" for s, e in sectors.items()])
    names = {s: sector_column(s) for s in sectors}
    weighted, _ = composite_exprs(model, pillars, names)
    equal, _ = composite_exprs(model.equal_weights(), pillars, {})
    rows = staged.selectExpr(
        *KEYS,
        *pillars.values(),
        *names.values(),
        f"inline(array(named_struct('scheme', 'weighted', 'risk_score', {weighted}), "
        f"named_struct('scheme', 'equal_weight', 'risk_score', {equal})))",
    )
    return rows.selectExpr("*", f"{t.band('risk_score')} AS risk_band")
