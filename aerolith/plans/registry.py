"""All queries on the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembled, curate, detect, flight, hybrid, imports, learn, mined, reports, telemetry

Query = Callable[[SparkSession, str], DataFrame]
_ALL = flight.QUERIES | curate.QUERIES | telemetry.QUERIES | detect.QUERIES | hybrid.QUERIES | imports.QUERIES | reports.QUERIES | assembled.QUERIES | learn.QUERIES | mined.QUERIES
flagship = flight.flagship


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
