"""Every operator as a query over the driver tables, with SQL that must give the same rows."""

from postweir.plans.catalog import annotations, corpora, evaluation, geo, ordering, stream, text

MODULES = [stream, text, annotations, corpora, ordering, evaluation, geo]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
