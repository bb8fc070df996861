"""Queries by operator and the SQL that each is checked against, module by module."""

from __future__ import annotations

from . import flagship, market, models, research, rolling, statistics

MODULES = (flagship, market, rolling, statistics, models, research)


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
