"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .queries import datasets, forecasts, joins, more, pipelines, scalar  # noqa: F401
from .queries.registry import QUERIES, SQL


def flagship(spark, sf_dir):
    return QUERIES["flagship_alerts"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
