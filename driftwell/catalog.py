"""Query name -> DataFrame function and, where SQL can say the same, SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwell.queries import corpus, decisions, extras, retrieval, support, workflow
from driftwell.session import ship

FAMILIES = (retrieval, decisions, corpus, extras, workflow, support)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: run for f in FAMILIES for name, run in f.QUERIES.items()}
    return {name: lambda spark, sf_dir, run=run: run(ship(spark), sf_dir) for name, run in found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for f in FAMILIES for name, sql in getattr(f, "ORACLE", {}).items()}
