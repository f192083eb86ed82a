"""Registered queries and their SQL twins, grouped by area."""

from importlib import import_module

AREAS = ["cleanup", "intervals", "sources", "clips", "translate", "speakers", "jobs"]


def gather(kind: str) -> dict:
    """``kind`` is ``queries`` or ``oracles``."""
    found: dict = {}
    for area in AREAS:
        for name, value in getattr(import_module(f"cuesheet.queries.{area}").query, kind).items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = value
    return found
