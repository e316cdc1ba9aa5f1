"""All queries of the library, and the SQL that each can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parzelle.plans import charts, concentration, domain, entries, geometry, more, register, relational, reports  # noqa: F401  (they register their queries)
from parzelle.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["conc_by_nation"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
