"""The registered queries: each plan module has QUERIES and ORACLES under the same names."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import corpora, details, evaluation, files, hygiene, measures, readings, relations, signals, subwords, texts, whole

MODULES = (hygiene, texts, relations, measures, corpora, files, readings, evaluation, whole, subwords, signals, details)


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
