"""Every registered query next to its SQL twin."""

from __future__ import annotations

from importlib import import_module

from panelscore.session import tune

FAMILIES = ("panel", "series", "scoring", "ranking", "quality", "replay", "network", "benchmark", "scenario", "explain", "scale", "stream")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(import_module(f"{__name__}.{family}"), attribute))
    return out


def _tuned(query):
    def run(spark, sf_dir):
        return query(tune(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _tuned(query) for name, query in _merged("QUERIES").items()}


def oracle_sql() -> dict:
    return _merged("ORACLE")
