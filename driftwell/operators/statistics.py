"""Matched-pair statistics: t intervals, exact sign-flip tests, Holm's correction, effect sizes, contrasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Two-sided 95 % quantiles of Student's t for 1 to 10 degrees of freedom.
T95 = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852)
#: Pairs up to which all 2 ^ n sign assignments are enumerated; beyond, sums of the two halves are matched.
ENUMERATED, MOST_FLIPS = 16, 44


def t_quantile(df: Column) -> Column:
    """From the table up to 10 degrees of freedom; beyond, the Cornish-Fisher expansion to the fourth order."""
    z = 1.959963984540054
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    v = df.cast("double")
    far = F.lit(z) + F.lit(g[0]) / v + F.lit(g[1]) / (v * v) + F.lit(g[2]) / (v * v * v)
    return F.when(df < 1, F.lit(None)).when(df <= len(T95), F.get(F.array(*[F.lit(t) for t in T95]), (df - 1).cast("int"))).otherwise(far)


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample deviation, 95 % interval, extremes."""
    out = rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd_samp"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    half = t_quantile(F.col("n") - 1) * F.col("sd_samp") / F.sqrt("n")
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def effect_size(mean: Column, sd: Column) -> Column:
    """Cohen's dz; null without spread."""
    return F.when(sd > 0, mean / F.when(sd > 0, sd).otherwise(1.0))


def paired(left: DataFrame, right: DataFrame, key: str, metrics: list[str], equal: tuple[str, ...] = ()) -> DataFrame:
    """``(key, metric, diff)``; runs must match one to one, and agree in the columns ``equal``, or the query fails."""
    a = left.select(F.col(key).alias("_a"), *[F.col(m).alias(f"a_{m}") for m in (*metrics, *equal)])
    b = right.select(F.col(key).alias("_b"), *[F.col(m).alias(f"b_{m}") for m in (*metrics, *equal)])
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    sure = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a run has no partner")).cast("long"))
    for m in equal:
        sure = sure.when(~F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}")), F.raise_error(F.lit(f"paired runs differ in {m}")).cast("long"))
    sure = sure.otherwise(F.col("_a"))
    diffs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"a_{m}") - F.col(f"b_{m}")).alias("diff")) for m in metrics]))
    return both.select(sure.alias(key), diffs.alias("_d")).select(key, "_d.metric", "_d.diff")


def flip_share(diffs: list[float]) -> float:
    """The share of sign assignments whose sum is at least as far from zero as the given one, exactly.

    Sums of each half's assignments are listed (2 ^ 22 at most); how many of one half reach the bound with each of
    the other is found by binary search.
    """
    if len(diffs) > MOST_FLIPS:
        raise ValueError("too many pairs for an exact test")
    seen, slack = abs(sum(diffs)), len(diffs) * 1e-12
    sums = []
    for half in (diffs[: len(diffs) // 2], diffs[len(diffs) // 2 :]):
        s = np.zeros(1)
        for d in half:
            s = np.concatenate((s + d, s - d))
        sums.append(np.sort(s))
    bound = seen - slack
    if bound <= 0:
        return 1.0
    a, b = sums
    hits = (len(b) - np.searchsorted(b, bound - a, "left")).sum() + np.searchsorted(b, -bound - a, "right").sum()
    return float(hits) / 2.0 ** len(diffs)


def sign_flip(spark: SparkSession, diffs: DataFrame, key: str, *by: str) -> DataFrame:
    """Exact two-sided p: the share of sign assignments whose mean is at least as far from zero.

    Groups of up to ``ENUMERATED`` pairs spread their assignments over tasks; larger ones are matched by halves, and
    over ``MOST_FLIPS`` pairs are an error.  A group's pairs are as many as a condition has runs.
    """
    groups = diffs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key), "diff"))).alias("_d"), F.abs(F.sum("diff")).alias("_seen"), F.count("*").alias("_n"))
    small = groups.filter(F.col("_n") <= ENUMERATED).withColumn("_size", F.expr("shiftleft(1L, cast(_n as int))"))
    masks = small.withColumn("_mask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)))
    total = F.expr("abs(aggregate(transform(_d, (x, i) -> if(shiftright(_mask, i) & 1L = 1L, -x.diff, x.diff)), 0.0D, (s, x) -> s + x))")
    out = masks.groupBy(*by, "_size").agg(F.count_if(total >= F.col("_seen") - F.col("_n") * 1e-12).alias("_hits"))
    out = out.select(*by, (F.col("_hits") / F.col("_size")).alias("p"))

    @F.pandas_udf("double")
    def halves(values: pd.Series) -> pd.Series:
        return values.map(lambda v: flip_share(list(v)))

    return out.union(groups.filter(F.col("_n") > ENUMERATED).select(*by, halves(F.transform("_d", lambda x: x["diff"])).alias("p")))


def holm(rows: DataFrame, p: str, *block: str) -> DataFrame:
    """Step-down adjusted p within each block of tests."""
    by = Window.partitionBy(*block) if block else Window.partitionBy(F.lit(1))
    ordered = by.orderBy(p)
    m, rank = F.count("*").over(by), F.row_number().over(ordered)
    raw = rows.withColumn("_adj", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    return raw.withColumn("holm_p", F.max("_adj").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_adj")


def contrasts(cells: DataFrame, run: str, value: str) -> DataFrame:
    """The four simple effects of a 2 x 2 design: ``cells(run, a, b, value)`` with a and b in {0, 1}."""
    wide = cells.groupBy(run).agg(*[F.max(F.when((F.col("a") == i) & (F.col("b") == j), F.col(value))).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    named = [("a at b=0", "c10", "c00"), ("a at b=1", "c11", "c01"), ("b at a=0", "c01", "c00"), ("b at a=1", "c11", "c10")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), (F.col(x) - F.col(y)).alias("diff")) for n, x, y in named]))
    return wide.select(run, rows.alias("_r")).select(run, "_r.contrast", "_r.diff")
