"""Fading accuracy: ``num = decay * num + x; den = decay * den + 1; num / den``.

The end of a run is a plain weighted sum, so it aggregates before the shuffle.  Running values use prefix sums of
``x * decay ^ -n`` in blocks of rows short enough that the power stays finite.  What a block takes over from the
block before it has faded by ``e ^ -REACH`` one block further, far below what a double can tell, so a block needs
the sums of one predecessor only: work is linear in a run of any length, at any decay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exponent of e that a block's powers reach, and the most rows of a block.
REACH, BLOCK = 300.0, 65_536


def block_rows(decay: float) -> int:
    """Rows after which a power of the decay leaves what a double can tell."""
    return 1 << 62 if decay == 1 else max(1, int(REACH / -math.log(decay)))


def final(rows: DataFrame, run: str, value: str, order: str, decay: float) -> DataFrame:
    """Reliability and observations at the end of each run; ``order`` numbers its observations from 1."""
    ends = rows.groupBy(run).agg(F.max(order).alias("_end")).withColumnRenamed(run, "_run")
    weighed = rows.join(ends, F.col(run) == F.col("_run")).withColumn("_w", F.pow(F.lit(decay), F.col("_end") - F.col(order)))
    out = weighed.groupBy(run).agg(F.sum(F.col(value) * F.col("_w")).alias("_n"), F.sum("_w").alias("_d"), F.count("*").alias("observations"))
    return out.select(run, "observations", (F.col("_n") / F.col("_d")).alias("fea"))


def running(rows: DataFrame, run: str, value: str, order: str, decay: float, start: tuple[float, float] = (0.0, 0.0), most: int = BLOCK) -> DataFrame:
    """``rows`` with the reliability after each observation; ``order`` counts them from 1, ``start`` is num and den before."""
    sums = _running_sums(rows, run, F.col(value), F.lit(1.0), order, decay, start, most)
    return sums.withColumn("fea", F.col("_n") / F.col("_d")).drop("_o", "_n", "_d")


def _running_sums(rows: DataFrame, run: str, num: Column, den: Column, order: str, decay: float, start: tuple[float, float], most: int) -> DataFrame:
    """``rows`` with num and den after each observation as ``_n`` and ``_d``, both divided by the decay of the row's place in its block (``_o``)."""
    fades = block_rows(decay)
    size, n = min(fades, most), F.col(order)
    marked = rows.withColumn("_b", F.floor((n - 1) / F.lit(size)).cast("long"))
    marked = marked.withColumn("_o", (n - F.col("_b") * F.lit(size)).cast("double")).withColumn("_up", F.pow(F.lit(decay), -F.col("_o")))
    w = Window.partitionBy(run, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = marked.groupBy(F.col(run).alias("_run"), (F.col("_b") + 1).alias("_next")).agg(F.max("_o").alias("_m"), F.sum(num * F.col("_up")).alias("_s"), F.sum(den * F.col("_up")).alias("_t"))
    marked = marked.withColumn("_n", F.sum(num * F.col("_up")).over(w)).withColumn("_d", F.sum(den * F.col("_up")).over(w))
    # A block's sums as they stand at its end.
    faded = F.pow(F.lit(decay), F.col("_m"))
    ends = ends.select("_run", "_next", (faded * F.col("_s")).alias("_s"), (faded * F.col("_t")).alias("_t"))
    if size < fades:  # blocks before the last one count too; the last block of a run may be short, but nothing follows it
        whole = decay**size
        own = ends.select(F.col("_run").alias("_own"), F.col("_next").alias("_at"), F.col("_s").alias("_x"), F.col("_t").alias("_y"))
        carried = _running_sums(own, "_own", F.col("_x"), F.col("_y"), "_at", whole, start, 1 << 62)
        at = F.pow(F.lit(whole), F.col("_o"))
        ends = carried.select(F.col("_own").alias("_run"), F.col("_at").alias("_next"), (at * F.col("_n")).alias("_s"), (at * F.col("_d")).alias("_t"))
    both = marked.join(ends, (F.col(run) == F.col("_run")) & (F.col("_b") == F.col("_next")), "left")
    # The first block takes over the start instead.
    num = F.col("_n") + F.coalesce("_s", F.when(F.col("_b") == 0, F.lit(float(start[0]))).otherwise(0.0))
    den = F.col("_d") + F.coalesce("_t", F.when(F.col("_b") == 0, F.lit(float(start[1]))).otherwise(0.0))
    return both.withColumn("_n", num).withColumn("_d", den).drop("_b", "_up", "_run", "_next", "_s", "_t")


def trailing_mean(value: Column, run: str, order: str, window: int) -> Column:
    """Mean of the last ``window`` graded values, the current one included."""
    return F.avg(value).over(Window.partitionBy(run).orderBy(order).rowsBetween(-(window - 1), 0))
