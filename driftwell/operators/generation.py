"""Seeded orders, exact stratified samples, rules in force, corpus expansion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A permutation key: a multiplier and modulus every engine can compute in 64 bits.
MULTIPLIER, MODULUS = 2654435761, 2147483647


def shuffle_key(key: Column, seed: int) -> Column:
    """Pseudo-random order of ids below 2^31 by integer arithmetic; ties go by id."""
    return (key.cast("long") % MODULUS * F.lit(MULTIPLIER % MODULUS) + F.lit(seed * 40503 % MODULUS)) % MODULUS


def shuffled(df: DataFrame, key: str, seed: int, *by: str) -> DataFrame:
    """``df`` with its place in the seeded order of each group."""
    w = Window.partitionBy(*by).orderBy(shuffle_key(F.col(key), seed), key)
    return df.withColumn("place", F.row_number().over(w).cast("long"))


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """An exact-count sample: each stratum gives round(n * its share) rows, the first of its seeded order."""
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    quota = sizes.crossJoin(total).select("_s", F.round(F.lit(n) * F.col("_size") / F.col("_total")).alias("_quota"))  # one row of totals
    placed = shuffled(df, key, seed, stratum)
    return placed.join(quota, F.col(stratum) == F.col("_s")).filter(F.col("place") <= F.col("_quota")).drop("_s", "_quota", "place")


def as_of(asked: DataFrame, changes: DataFrame, key: str, at: str, since: str, value: str, default: Column | None = None) -> DataFrame:
    """``asked(key, at)`` with the value of the latest change at or before ``at``, in one sort per key.

    Changes and questions share one ordered stream, so no pair of both is made.
    """
    q = asked.withColumn("_t", F.col(at)).withColumn("_q", F.lit(1)).withColumn("_v", F.lit(None).cast(changes.schema[value].dataType))
    c = changes.select(F.col(key), F.col(since).alias("_t"), F.lit(0).alias("_q"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = q.unionByName(c, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_q = 1")
    return (both.withColumn(value, F.coalesce(value, default)) if default is not None else both).drop("_t", "_q", "_v")


def merged_changes(base: DataFrame, more: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Changes of both tables; where both have one, the additional table's."""
    b = base.select(*keys, F.col(value).alias("_b"))
    m = more.select(*keys, F.col(value).alias("_m"))
    return b.join(m, keys, "full").select(*keys, F.coalesce("_m", "_b").alias(value))


def expanded(articles: DataFrame, variants: int, quarters: int = 4) -> DataFrame:
    """Each article in each quarter and variant, numbered from 1."""
    rows = articles.withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(quarters))))
    return rows.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))


def _normals(seed: int, stream: int, number: int, dims: int) -> np.ndarray:
    """Standard normals from a counter-based generator: the same for a number wherever it is drawn."""
    return np.random.Generator(np.random.Philox(key=[seed, (stream << 56) + number])).standard_normal(dims, dtype=np.float32)


def clusters(n: int, cluster: int) -> int:
    return -(-n // cluster)


def cluster_of(number: np.ndarray, n: int, cluster: int, seed: int) -> np.ndarray:
    """The cluster of each row: clusters are equally large, give or take one, and their rows lie scattered."""
    step = MULTIPLIER % n or 1
    while math.gcd(step, n) != 1:
        step += 1
    return (number * step + seed) % n % clusters(n, cluster)


def _drawn(spark: SparkSession, n: int, vector: Callable[[int], np.ndarray]) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                ids = b.column(0).slice(i, 500)
                rows = np.stack([vector(k) for k in ids.to_pylist()])
                rows /= np.sqrt((rows.astype(np.float64) ** 2).sum(1, keepdims=True)).astype(np.float32)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ids.to_numpy() + 1), values], ["id", "ins", "v"])

    return spark.range(n).mapInArrow(draw, "id long, ins long, v array<float>")


def clustered_vectors(spark: SparkSession, n: int, dims: int, cluster: int, noise: float, seed: int) -> DataFrame:
    """``(id, ins, v)``: unit vectors in clusters of ``cluster`` rows, each a Gaussian prototype with Gaussian ``noise``.

    Each vector follows from the seed and its number alone, so tasks draw in any order and a lost one draws the same again.
    """
    kept: dict[int, np.ndarray] = {}

    def vector(k: int) -> np.ndarray:
        c = int(cluster_of(np.int64(k), n, cluster, seed))
        if c not in kept:
            if len(kept) * dims > 1 << 24:
                kept.clear()
            kept[c] = _normals(seed, 1, c, dims)
            kept[c] /= np.sqrt((kept[c].astype(np.float64) ** 2).sum())
        return kept[c] + np.float32(noise) * _normals(seed, 2, k, dims)

    return _drawn(spark, n, vector)


def clustered_queries(spark: SparkSession, asked: int, n: int, dims: int, cluster: int, seed: int) -> DataFrame:
    """``(id, ins, v)``: prototypes of ``clustered_vectors`` drawn with replacement, as queries."""
    return _drawn(spark, asked, lambda k: _normals(seed, 1, int(np.random.Generator(np.random.Philox(key=[seed, (3 << 56) + k])).integers(clusters(n, cluster))), dims))
