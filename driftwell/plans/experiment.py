"""Experiments: repetitions of a decision stream, their saved traces, resuming and reuse.

Repetitions are independent and run as groups of one job.  A trace is written by repetition; which
repetitions are complete is read from the written rows, so a job that lost executors, or its driver, goes on
with what is missing.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.operators import controller as C
from driftwell.operators import generation as G
from driftwell.operators.quality import require_none

RUN = "repetition"
#: Columns of a ticket that a reused prefix must agree in.
SAME = ("event_id", "quarter", "quarter_position", "position", "category", "difficulty", "extra", "abstain", "covers", "gold_correct", "human_correct")


def repetitions(tickets: DataFrame, runs: int, seed: int, key: str = "event_id") -> DataFrame:
    """Every ticket in each repetition, shuffled within quarters by the repetition's own seed."""
    numbers = tickets.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias(RUN))
    rows = tickets.drop("position", "quarter_position").crossJoin(F.broadcast(numbers))  # as many rows as runs
    order = G.shuffle_key(F.col(key) + F.col(RUN) * 7919, seed)
    within = F.row_number().over(Window.partitionBy(RUN, "quarter").orderBy(order, key))
    overall = F.row_number().over(Window.partitionBy(RUN).orderBy("quarter", "quarter_position"))
    return rows.withColumn("quarter_position", within).withColumn("position", overall)


def run(tickets: DataFrame, c: C.Condition) -> DataFrame:
    return C.fold(tickets, RUN, c)


def save(trace: DataFrame, folder: str, c: C.Condition, name: str) -> None:
    """Append repetitions to a job's folder and note its condition."""
    trace.write.mode("append").partitionBy(RUN).parquet(f"{folder}/trace")
    note = trace.sparkSession.createDataFrame([(name, json.dumps(asdict(c), sort_keys=True))], "name string, condition string")
    note.write.mode("overwrite").json(f"{folder}/condition")


def saved(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/trace")


def progress(spark: SparkSession, folder: str, tickets: DataFrame) -> DataFrame:
    """``(repetition, wanted, done, status)``: completed, running or queued."""
    want = tickets.groupBy(RUN).agg(F.count("*").alias("wanted"))
    try:
        have = saved(spark, folder)
    except Exception as e:  # a job that wrote nothing yet has no trace
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return want.select(RUN, "wanted", F.lit(0).cast("long").alias("done"), F.lit("queued").alias("status"))
    done = have.groupBy(F.col(RUN).alias("_r")).agg(F.count_distinct("position").alias("done"))
    rows = want.join(done, F.col(RUN) == F.col("_r"), "left").select(RUN, "wanted", F.coalesce("done", F.lit(0)).cast("long").alias("done"))
    return rows.withColumn("status", F.when(F.col("done") == 0, "queued").when(F.col("done") >= F.col("wanted"), "completed").otherwise("running"))


def resume(spark: SparkSession, folder: str, tickets: DataFrame, c: C.Condition, name: str = "job") -> DataFrame:
    """Run what is missing and return the whole trace.

    A repetition that stopped midway is folded again from its start: the saved rows must come out the same.
    """
    state = progress(spark, folder, tickets)
    open_runs = state.filter("status <> 'completed'").select(F.col(RUN).alias("_r"))
    todo = run(tickets.join(open_runs, F.col(RUN) == F.col("_r"), "left_semi"), c)
    if state.filter("done > 0").isEmpty():
        save(todo, folder, c, name)
        return saved(spark, folder)
    before = saved(spark, folder)
    require_none(diverged(before, todo), "saved tickets differ from their replay")
    rest = todo.join(before.select(F.col(RUN).alias("_r"), F.col("position").alias("_p")), (F.col(RUN) == F.col("_r")) & (F.col("position") == F.col("_p")), "left_anti")
    save(rest, folder, c, name)
    return saved(spark, folder)


def diverged(before: DataFrame, again: DataFrame, close: float = 1e-12) -> DataFrame:
    """Tickets of both traces whose outcome differs, reliabilities by more than ``close``."""
    cols = ("state_before", "state_after", "final_origin", "final_is_correct", "observations_after", "fea_after")
    a = before.select(RUN, "position", *[F.col(c).alias(f"_{c}") for c in cols])
    both = again.select(RUN, "position", *cols).join(a, [RUN, "position"])
    other = F.lit(False)
    for c in cols[:-1]:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.filter(other | (F.abs(F.col("fea_after") - F.col("_fea_after")) > close))


def reusable_prefix(trace: DataFrame, tickets: DataFrame, ours: C.Condition, theirs: C.Condition, quarter: int = 1) -> DataFrame:
    """The saved rows of the first quarter, if the other job's may stand for them.

    Conditions must be equal, every repetition must be there from position 1 without gaps, and tickets must
    agree in all of ``SAME``; otherwise this is an error.
    """
    if ours != theirs:
        raise ValueError("conditions differ")
    part, wanted = trace.filter(F.col("quarter") == quarter), tickets.filter(F.col("quarter") == quarter)
    gaps = part.groupBy(RUN).agg(F.count("*").alias("n"), F.max("position").alias("last")).filter("n <> last")
    require_none(gaps, "a repetition of the other job has gaps")
    cols = (RUN, *SAME)
    require_none(part.select(*cols).exceptAll(wanted.select(*cols)), "the other job has other tickets")
    require_none(wanted.select(*cols).exceptAll(part.select(*cols)), "the other job lacks tickets")
    return part
