"""The decision workflow over repetitions of any length: searched ahead, then played in chunks of positions.

What a ticket retrieves depends on answers, but which records it retrieves does not: a record's vector is its question's,
and its age is a difference of positions.  So all tickets search first, in parallel, over a memory of all repetitions
packed into blocks (``operators.scan``).  Then chunk after chunk is played: in a chunk each repetition is one group, which
holds that chunk's tickets without vectors, the answers of earlier chunks that they retrieve (at most K a ticket, brought by
a join), and the controller's state.  Nothing that a task holds grows with the repetition.

A run lives in a folder of the shared file system.  A finished chunk is a table there, with the controllers' state at
its end; whoever opens the folder again goes on after the last one, without repeating its model calls.

Defined cases: positions of a repetition are 1, 2, ... without gaps or repeats, else an error; a ticket without a vector is an
error; no tickets give an empty trace; a folder that holds a run under other settings, or over other tickets' number, is refused; a chunk that was
cut short is played again as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.operators import controller as C
from driftwell.operators import scan as S
from driftwell.operators.models import Model, call_context
from driftwell.operators.quality import duplicated, require_none
from driftwell.operators.retrieval import ONLINE, Rule
from driftwell.plans import workflow as W
from driftwell.session import shared_dir
from driftwell.sources.jobs import exists, read_json, write_json

#: Tickets of one repetition that are played at once, and the first window of their search.
CHUNK, WINDOW = 4096, 256
#: Where a controller stands after a chunk.
STAND = "struct<state:string,numerator:double,denominator:double,observations:int,recent:array<boolean>>"
PLAYED = f"{W.TRACE}, _question string, _stand {STAND}"
PLAYED_NAMES = [*W.NAMES, "_question", "_stand"]


class Found:
    """A chunk's memory: its tickets come with what they retrieve, and answers given in this chunk are filled in here."""

    def __init__(self, before: int):
        self.before, self.records = before, []

    def append(self, ident: str, question: str, answer: str, found: dict) -> None:
        self.records.append((ident, question, answer))

    def search(self, found: dict) -> list[dict]:
        known = {k["ins"]: (k["record_id"], k["question"], k["final_answer"]) for k in found["known"] or []}
        out = []
        for h in found["hits"] or []:
            record = known[h["ins"]] if h["ins"] <= self.before else self.records[h["ins"] - self.before - 1]
            out.append(
                dict(zip(("record_id", "question", "final_answer"), record, strict=True))
                | {"insertion_index": h["ins"], "age": h["age"], "cosine_similarity": h["cosine"], "rectified_similarity": h["cosine"], "temporal_score": h["score"]}
            )
        return out


def asks(c: C.Condition, baseline: bool) -> Column:
    """Tickets whose model call will search the memory."""
    if not baseline:
        return F.lit(c.enabled)
    return (F.col("quarter") != "Q1") & ((F.col("quarter") == "Extra") | (F.col("quarter_position") > c.review))


class LongRun:
    """One condition's repetitions in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def prepare(self, tickets: DataFrame, c: C.Condition, rule: W.Search = W.Search(), baseline: bool = False, chunk: int = CHUNK) -> LongRun:
        """Search for all tickets and store them by chunk; a folder that is prepared so already is left as it is."""
        per = tickets.groupBy("repetition").agg(F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"))
        total, longest, bad = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.expr("low <> 1 or high <> n"))).first()
        said = {"condition": asdict(c), "search": asdict(rule), "baseline": baseline, "chunk": chunk, "tickets": total, "chunks": -(-longest // chunk)}
        if exists(self.spark, f"{self.folder}/run.json"):
            if read_json(self.spark, f"{self.folder}/run.json") != said:
                raise ValueError(f"{self.folder} holds a run of other settings or tickets")
            return self
        if bad:
            raise ValueError(f"{bad} repetitions whose positions are not 1, 2, ...")
        require_none(duplicated(tickets, "repetition", "position"), "positions repeat")
        # Repetitions lie one after the other in one memory; one row a repetition.
        offsets = per.select("repetition", F.coalesce(F.sum("n").over(Window.orderBy("repetition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
        rows = tickets.select(*W.TICKET).join(offsets, "repetition").withColumn("_at", F.col("_offset") + F.col("position"))
        store = S.BlockStore.write(rows.select(F.col("_at").alias("id"), F.col("_at").alias("ins"), "v"), f"{self.folder}/memory")
        asked = rows.filter(asks(c, baseline)).select(F.col("_at").alias("qid"), F.col("_at").alias("qins"), "v", (F.col("_offset") + 1).alias("first"))
        found = S.walk(asked, store, Rule(rule.decay, rule.tau, rule.k), S.growing(WINDOW), order=ONLINE).select("qid", "hits")
        rows = rows.drop("v").join(found, F.col("_at") == F.col("qid"), "left")
        local = F.transform("hits", lambda h: F.struct((h["ins"] - F.col("_offset")).cast("int").alias("ins"), h["age"].cast("int").alias("age"), h["cosine"].alias("cosine"), h["score"].alias("score")))
        rows = rows.withColumn("hits", local).withColumn("chunk", F.floor((F.col("position") - 1) / chunk).cast("int")).drop("_offset", "_at", "qid")
        rows.repartition("chunk", "repetition").write.mode("overwrite").partitionBy("chunk").parquet(f"{self.folder}/tickets")
        store.drop(self.spark)
        write_json(self.spark, f"{self.folder}/run.json", said)
        return self

    def _played(self, k: int) -> str:
        return f"{self.folder}/trace/chunk={k}"

    def done(self) -> int:
        """Finished chunks."""
        chunks = read_json(self.spark, f"{self.folder}/run.json")["chunks"]
        return next((k for k in range(chunks) if not exists(self.spark, f"{self._played(k)}/_SUCCESS")), chunks)

    def _read(self, chunks: range) -> DataFrame:
        if not len(chunks):
            return self.spark.createDataFrame([], f"{PLAYED}, chunk int")
        return self.spark.read.schema(f"{PLAYED}, chunk int").option("basePath", f"{self.folder}/trace").parquet(*[self._played(k) for k in chunks])

    def play(self, model: Model, most: int | None = None, told: Callable[[int, int], None] | None = None) -> int:
        """Play what is left, or ``most`` chunks of it; chunks still left.  ``told(done, chunks)`` hears of each that ends."""
        said = read_json(self.spark, f"{self.folder}/run.json")
        first, chunks = self.done(), said["chunks"]
        last = chunks if most is None else min(chunks, first + most)
        for k in range(first, last):
            self._chunk(k, said, model).write.mode("overwrite").parquet(self._played(k))
            if told:
                told(k + 1, chunks)
        return chunks - last

    def _chunk(self, k: int, said: dict, model: Model) -> DataFrame:
        options, baseline, before = said["condition"], said["baseline"], k * said["chunk"]
        rows = self.spark.read.option("basePath", f"{self.folder}/tickets").parquet(f"{self.folder}/tickets").filter(F.col("chunk") == k).drop("chunk")
        if k:
            wanted = rows.select("repetition", "position", F.explode("hits.ins").alias("ins")).filter(F.col("ins") <= before)
            wanted = wanted.withColumn("chunk", F.floor((F.col("ins") - 1) / said["chunk"]).cast("int"))
            answers = self._read(range(k)).select("repetition", "chunk", F.col("global_position").alias("ins"), F.col("ticket_id").alias("record_id"), F.col("_question").alias("question"), "final_answer")
            known = wanted.join(answers, ["repetition", "chunk", "ins"]).groupBy("repetition", "position").agg(F.collect_list(F.struct("ins", "record_id", "question", "final_answer")).alias("known"))
            rows = rows.join(known, ["repetition", "position"], "left")
        else:
            rows = rows.withColumn("known", F.lit(None).cast("array<struct<ins:int,record_id:string,question:string,final_answer:string>>"))
        # One row a repetition.
        stands = self._read(range(k - 1, k) if k else range(0)).filter("_stand is not null").select("repetition", "_stand.*")

        def run(tickets: pd.DataFrame, stand: pd.DataFrame) -> pd.DataFrame:
            if not len(tickets):
                return pd.DataFrame(columns=PLAYED_NAMES)
            c = C.Condition(**options)
            control = C.Controller(c)
            if len(stand):
                s = W.native(stand)[0]
                control = C.Controller(c, s["state"], s["numerator"], s["denominator"], s["observations"])
                control.recent.extend(s["recent"])
            rep = W.Repetition(c, model, Found(before), baseline, control)
            out = []
            for t in W.native(tickets.sort_values("position", ignore_index=True)):
                t["v"] = {"hits": t.pop("hits"), "known": t.pop("known")}
                with call_context(repetition=t["repetition"], ticket_id=t["id"], global_position=t["position"]):
                    out.append(rep.ticket(t) | {"_question": t["question"], "_stand": None})
            out[-1]["_stand"] = {"state": control.state, "numerator": float(control.num), "denominator": float(control.den), "observations": control.obs, "recent": [bool(x) for x in control.recent]}
            return pd.DataFrame(out, columns=PLAYED_NAMES)

        return rows.groupBy("repetition").cogroup(stands.groupBy("repetition")).applyInPandas(run, PLAYED)

    def trace(self) -> DataFrame:
        """The trace, as ``workflow.rollout`` gives it, of the finished chunks."""
        return self._read(range(self.done())).select(*W.NAMES)


def rollout(tickets: DataFrame, c: C.Condition, model: Model, rule: W.Search = W.Search(), baseline: bool = False, chunk: int = CHUNK, folder: str | None = None) -> DataFrame:
    """The whole trace; without ``folder`` the run has one of its own in the shared folder."""
    spark = tickets.sparkSession
    run = LongRun(spark, folder or shared_dir(spark, "workflow")).prepare(tickets, c, rule, baseline, chunk)
    run.play(model)
    return run.trace()
