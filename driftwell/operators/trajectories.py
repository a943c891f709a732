"""Running rates along a run and their means across runs.

Sums along a run are taken in two levels: blocks of neighbouring positions apart, each by a task of its own, and then
the totals of a run's blocks, one row a block.  So one run may be the whole table.  Across runs everything is partial
aggregation by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions of one block of a run.
BLOCK = 65_536


def prefix_sums(rows: DataFrame, run: str, measures: dict[str, Column], order: str = "position", keep: tuple[str, ...] = (), size: int = BLOCK) -> DataFrame:
    """``(run, order, *keep, *measures)``: each measure summed from the run's first row to this one.

    ``order`` is a whole number, unique in a run, gaps allowed; null measures count as nothing.  Rows without a run are one
    run.  Rows are shuffled once, by run and block; what meets them again is a block's total.
    """
    # Never null, so that no filter tells the two uses of the shuffled rows apart and they are made once.
    block = F.coalesce(F.floor(F.col(order) / F.lit(size)).cast("long"), F.lit(0))
    # A struct is equal to its like also where it holds null, so the runs' name may be missing.
    marked = rows.select(F.struct(run).alias("_run"), block.alias("_block"), order, *keep, *[m.alias(f"_{n}") for n, m in measures.items()])
    w = Window.partitionBy("_run", "_block").orderBy(order)
    here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = marked.select("_run", "_block", order, *keep, *[F.sum(f"_{n}").over(here).alias(f"_{n}") for n in measures])
    totals = inner.groupBy("_run", "_block").agg(*[F.max_by(f"_{n}", order).alias(f"_{n}") for n in measures])
    before = Window.partitionBy("_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_run").alias("_r"), F.col("_block").alias("_b"), *[F.sum(f"_{n}").over(before).alias(f"_before_{n}") for n in measures])
    both = inner.join(starts, (F.col("_run") == F.col("_r")) & (F.col("_block") == F.col("_b")))
    return both.select(F.col(f"_run.{run}").alias(run), order, *keep, *[(F.coalesce(f"_{n}", F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in measures])


def running_rates(
    rows: DataFrame, run: str, rates: dict[str, tuple[Column, Column, float | None]], order: str = "position", keep: tuple[str, ...] = (), size: int = BLOCK
) -> DataFrame:
    """``(run, order, *keep, *rates)``: of ``(hit, counted, empty)`` the share of hits among the counted rows so far, ``empty`` before the first."""
    sums = {}
    for name, (hit, counted, _) in rates.items():
        sums |= {f"{name}_n": F.when(counted, 1).otherwise(0), f"{name}_h": F.when(counted & hit, 1).otherwise(0)}
    made = prefix_sums(rows, run, sums, order, keep, size)

    def rate(name: str, empty: float | None) -> Column:
        n = F.col(f"{name}_n")
        return F.when(n > 0, F.col(f"{name}_h") / F.when(n > 0, n).otherwise(1)).otherwise(F.lit(empty).cast("double")).alias(name)

    return made.select(run, order, *keep, *[rate(name, empty) for name, (_, _, empty) in rates.items()])


def replay_error(trace_abstain: str = "abstain") -> Column:
    """Error had the model always gone first: the human's where it abstains, else its own."""
    return F.when(F.col(trace_abstain), ~F.col("human_correct")).otherwise(~F.col("gold_correct"))


def pointwise(values: DataFrame, position: str, value: str) -> DataFrame:
    """Mean and population deviation across runs at each position, nulls aside."""
    return values.groupBy(position).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.count(value).alias("runs"))


def ranges(rows: DataFrame, run: str, label: str, order: str = "position") -> DataFrame:
    """Islands of equal neighbouring labels: (run, label, first, last)."""
    w = Window.partitionBy(run).orderBy(order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("_new", new).withColumn("_island", island)
    return marked.groupBy(run, "_island", label).agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_island")


def last_value(rows: DataFrame, run: str, value: str, order: str = "position") -> DataFrame:
    """The last value that is neither null nor NaN."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return rows.groupBy(run).agg(F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(order))).alias(value))


def averaged(trace: DataFrame, run: str) -> DataFrame:
    """``(label, position, mean, sd_pop)`` of the trajectories that a trace has.

    Final and human-only error always; reliability and model-first replay only where some ticket had a controller.
    """
    nominal = ~F.col("extra")
    rates = {"final_error": (F.col("final_error"), nominal, 0.0), "human_error": (~F.col("human_correct"), nominal, 0.0), "replay_error": (replay_error(), F.lit(True), None)}
    rows = running_rates(trace, run, rates, keep=("fea_after",)).withColumnRenamed("fea_after", "fea")
    values = ("fea", *rates)
    rows = rows.select("position", *[F.col(k).cast("double").alias(f"_{k}") for k in values])
    rows = rows.select("position", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"_{k}").alias("value")) for k in values])).alias("_v"))
    out = rows.groupBy("_v.label", "position").agg(F.avg("_v.value").alias("mean"), F.stddev_pop("_v.value").alias("sd_pop"))
    controlled = trace.agg(F.coalesce(F.bool_or(F.col("state_before") != "controller_free"), F.lit(False)).alias("_controlled"))  # one row
    return out.crossJoin(F.broadcast(controlled)).filter(F.col("_controlled") | F.col("label").isin("final_error", "human_error")).drop("_controlled")
