"""SQL text for the wide score expressions.

A model with dozens of indicators needs hundreds of operators per plan. As text they reach the JVM in
one call per column, where building them operator by operator from Python costs seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from panelscore.functions.scalar import BAND_CUTS, BANDS, SCORE_CENTRE, SCORE_SLOPE


#: A spread below this share of the mean is what rounding leaves of equal values.
NO_SPREAD = 1e-12


def num(value: float) -> str:
    return f"{float(value)!r}D"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def zscore(v: str, mean: str, std: str, n: str, min_obs: int) -> str:
    """Null below ``min_obs``; exactly 0 where the spread is 0 up to rounding of the mean, also for a null value."""
    return (
        f"CASE WHEN {n} < {int(min_obs)} THEN NULL WHEN {std} <= {num(NO_SPREAD)} * abs({mean}) THEN 0D "
        f"ELSE try_divide({v} - {mean}, {std}) END"
    )


def weighted_mean(values: Sequence[str], weights: Sequence[float]) -> str:
    """Mean over the values present, weights renormalised over them; null when none is present."""
    if not values:
        return "CAST(NULL AS DOUBLE)"
    total = " + ".join(f"coalesce({v} * {num(w)}, 0D)" for v, w in zip(values, weights))
    weight = " + ".join(f"if({v} IS NULL, 0D, {num(w)})" for v, w in zip(values, weights))
    return f"try_divide({total}, nullif({weight}, 0D))"


def sum_of(terms: Sequence[str]) -> str:
    return " + ".join(["0D", *terms])


def signal_to_score(signal: str, defined: str) -> str:
    """50 + 18 x, clipped to 0..100, where ``defined`` holds. Without that guard a null signal would
    come out as 100, since greatest and least skip nulls."""
    clipped = f"greatest(0D, least(100D, {num(SCORE_CENTRE)} + {num(SCORE_SLOPE)} * {signal}))"
    return f"if({defined}, {clipped}, NULL)"


def band(score: str) -> str:
    cases = " ".join(f"WHEN {score} < {num(cut)} THEN {text(name)}" for cut, name in zip(BAND_CUTS, BANDS))
    return f"CASE WHEN {score} IS NULL THEN NULL {cases} ELSE {text(BANDS[-1])} END"
