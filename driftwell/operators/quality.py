"""Data-quality rules: each is a name and a DataFrame of offending rows; a suite counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """``(rule, violations)``, one row per rule, counted where the rows are."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.union, rows)


def row_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, violations)`` of conditions on single rows, all counted in one scan; a condition that is null offends."""
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])
    return counted.select(F.inline(rows))


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def unmatched(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key the other table lacks; null keys are unmatched."""
    right = other.select(F.col(other_key).alias("_k"))
    return df.join(right, F.col(key) == F.col("_k"), "left_anti")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one table only, with the side they are on."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1))
    y = b.select(F.col(key).alias("_k")).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, F.col(key).eqNullSafe(F.col("_k")), "full").filter("_a is null or _b is null")
    return both.select(F.coalesce(key, "_k").alias(key), F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def require_none(df: DataFrame, message: str) -> None:
    """Fail if any row offends."""
    if not df.isEmpty():
        raise ValueError(message)
