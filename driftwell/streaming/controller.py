"""The controller and reliability as Structured Streaming, and windowed counts of a stream.

State is one controller per key: five numbers and the recent gold window, however long the stream.  Positions order a key's tickets; a
micro-batch is put in order within each key, and positions at or before the last one seen are replays and
pass without effect, so a restarted source repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.operators import controller as C
from driftwell.sources.jobs import commit_batch

STATE = "state string, numerator double, denominator double, observations int, last int, recent array<boolean>"
INPUTS = ("quarter_position", "extra", "bootstrap", "abstain", "covers", "gold_correct", "human_correct", "coin")


def controlled(tickets: DataFrame, by: str, c: C.Condition) -> DataFrame:
    """A stream of tickets with the outcome of each step, as the batch fold gives it."""
    schema = f"{by} {tickets.schema[by].dataType.simpleString()}, position int, {C.STEP}"
    names = [x.split()[0] for x in schema.split(", ")]
    options = asdict(c)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("position")
        state, num, den, obs, last, recent = held.get if held.exists else ("SO", 0.0, 0.0, 0, 0, [])
        ctl = C.Controller(C.Condition(**options), state, num, den, obs)
        ctl.recent.extend(recent)
        out = []
        for r in rows.to_dict("records"):
            if r["position"] > last:
                last = r["position"]
                out.append((key[0], last, *ctl.step(*(r[x] for x in INPUTS))))
        held.update((ctl.state, float(ctl.num), float(ctl.den), ctl.obs, int(last), [bool(x) for x in ctl.recent]))
        made = pd.DataFrame(out, columns=names)
        made["observation"] = made["observation"].astype("Int32")
        yield made

    return tickets.groupBy(by).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Tumbling counts per type; rows later than the watermark are dropped, as windows close."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def to_folder(stream: DataFrame, folder: str, checkpoint: str):
    """Write what has arrived and stop; offsets and state stay in ``checkpoint``."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flushed(stream: DataFrame, folder: str, checkpoint: str, told: Callable[[int, bool], None] | None = None):
    """Write what has arrived as numbered batches of JSON lines and stop.

    A micro-batch is replayed under its own number where the stream died between its write and its commit, and
    ``jobs.commit_batch`` takes a number once; ``told(number, new)`` hears of each.  ``jobs.read_batches`` reads them.
    """

    def write(rows: DataFrame, number: int) -> None:
        new = commit_batch(rows, folder, number)
        if told:
            told(number, new)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
