"""Correlation and regression aggregates that are safe on constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson aggregate, null where either side has no variance (built-in ``corr`` divides by 0)."""
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.when((sx > 0) & (sy > 0), sx * sy))


def ols(x: Column, y: Column, min_obs: int = 5) -> dict[str, Column]:
    """Aggregates of y ~ x over complete pairs.

    Below ``min_obs`` everything but n is null; a constant x leaves slope and r2 null but keeps
    the range; a constant y leaves r2 null.
    """
    both = x.isNotNull() & y.isNotNull()
    cx = F.when(both, x)
    cy = F.when(both, y)
    n = F.count(cx)
    sx, sy = F.stddev_pop(cx), F.stddev_pop(cy)
    cov = F.covar_pop(x, y)
    usable = (n >= min_obs) & (sx > 0)
    r = F.try_divide(cov, sx * sy)
    return {
        "slope": F.when(usable, F.try_divide(cov, sx * sx)),
        "r_squared": F.when(usable & (sy > 0), r * r),
        "n_obs": n,
        "driver_min": F.when(n >= min_obs, F.min(cx)),
        "driver_max": F.when(n >= min_obs, F.max(cx)),
    }
