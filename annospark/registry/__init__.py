"""All queries of the library over the test tables, with SQL to check them."""

from __future__ import annotations

from annospark.registry import base


def _load() -> None:
    from annospark.registry import boxes, catalogs, draws, folders, formats, policies, quality  # noqa: F401


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return dict(base.ORACLES)
