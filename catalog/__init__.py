"""Every operator as a named query over the given tables, next to an independent SQL statement of its result."""

from __future__ import annotations

from importlib import import_module

SECTIONS = (
    "sources", "projections", "shapes", "joins", "aggregates", "windows", "extremes",
    "records", "scalars", "charts", "models", "incremental", "quality", "streams",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for section in SECTIONS:
        part = getattr(import_module(f"catalog.{section}"), attribute)
        twice = merged.keys() & part.keys()
        if twice:
            raise ValueError(f"named twice: {sorted(twice)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
