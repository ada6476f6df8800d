"""The queries by operator identifier, and their SQL."""

from __future__ import annotations


def registries() -> list:
    from . import climate, coast, space

    return [climate.registry, space.registry, coast.registry]


def queries() -> dict:
    return {k: q for r in registries() for k, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for r in registries() for k, q in r.sql.items()}
