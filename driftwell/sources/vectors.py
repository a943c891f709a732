"""Vector tables: batch inference, period files with a manifest, a store with upserts, and probes of its state."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions import vectors as V
from driftwell.operators.quality import duplicated, require_none
from driftwell.session import delete, shared_dir
from driftwell.sources.jobs import exists, read_json, write_json


def embedded(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "question", batch: int = 64) -> DataFrame:
    """``rows(id, <text>)`` as ``(id, v)``: ``encode`` is called with at most ``batch`` texts; vectors come to unit length.

    Repeated ids, vectors of unequal size and ones without a direction are errors.
    """
    require_none(duplicated(rows, "id"), "ids repeat")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = None
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                made = np.asarray(encode(part["t"].tolist()), float)
                if made.ndim != 2 or len(made) != len(part) or (size is not None and made.shape[1] != size):
                    raise ValueError("the encoder returned vectors of another number or size")
                size = made.shape[1]
                norm = np.linalg.norm(made, axis=1, keepdims=True)
                if not (np.isfinite(norm).all() and (norm > 0).all()):
                    raise ValueError("a vector is zero or not finite")
                yield pd.DataFrame({"id": part["id"].values, "v": list(made / norm)})

    return rows.select(F.col("id").cast("string").alias("id"), F.col(text).alias("t")).mapInPandas(run, "id string, v array<double>")


def write_periods(periods: dict[str, DataFrame], folder: str, model: str, replace: bool = False, only: str | None = None) -> dict:
    """``(id, v)`` of each period as a table of its own, and ``manifest.json`` written last.

    An existing folder is refused unless ``replace``.  ``only`` writes one period into a folder whose manifest names the
    same model; sizes of vectors must agree throughout.
    """
    spark = next(iter(periods.values())).sparkSession
    place = f"{folder}/manifest.json"
    if only is None:
        if exists(spark, folder) and not replace:
            raise FileExistsError(f"{folder} exists")
        files, size = {}, None
    else:
        if not exists(spark, place):
            raise ValueError("one period needs an existing manifest")
        before = read_json(spark, place)
        if before["model"] != model:
            raise ValueError("the manifest names another model")
        if only in before["files"] and not replace:
            raise FileExistsError(f"{folder}/{only} exists")
        files, size = dict(before["files"]), before["dimension"]
    for name, rows in periods.items():
        if only not in (None, name):
            continue
        require_none(duplicated(rows, "id"), f"ids of {name} repeat")
        rows.select("id", "v").write.mode("overwrite").parquet(f"{folder}/{name}")
        written = spark.read.parquet(f"{folder}/{name}")
        n, low, high, check = written.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.bit_xor(F.xxhash64("id", "v"))).first()
        if n and (low != high or size not in (None, low)):
            raise ValueError(f"vectors of {name} differ in size")
        size = low if n else size
        files[name] = {"records": n, "xxhash64_xor": check}
    manifest = {"model": model, "dimension": size, "normalization": "L2", "record_key": "id", "files": files}
    write_json(spark, place, manifest)
    return manifest


def changed_periods(spark: SparkSession, folder: str) -> list[str]:
    """Periods whose table is not what the manifest says."""
    manifest = read_json(spark, f"{folder}/manifest.json")
    out = []
    for name, said in manifest["files"].items():
        n, check = spark.read.parquet(f"{folder}/{name}").agg(F.count("*"), F.bit_xor(F.xxhash64("id", "v"))).first()
        if (n, check) != (said["records"], said["xxhash64_xor"]):
            out.append(name)
    return out


STORED = "id long, ins long, v array<double>, batch int, run int, gone boolean"


class VectorStore:
    """A memory table ``(id, ins, v)`` with upserts and deletes by id.

    It is a base, ranged by insertion index and of unique ids, and runs: what was written or deleted since, each sorted by
    insertion index.  Of an id the last run that names it counts.  ``store.json`` names the tables that are live and is
    replaced as a whole, so a reader sees the store before a write or after it, and what a broken write left is never
    read.  Over ``MOST_RUNS`` runs are merged into the base.  One writer at a time.
    """

    MOST_RUNS = 32

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _state(self) -> dict:
        return read_json(self.spark, f"{self.folder}/store.json")

    def _table(self, *names: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[f"{self.folder}/{n}" for n in names])

    def create(self, replace: bool = True) -> None:
        """An empty store; an existing one is dropped."""
        if exists(self.spark, self.folder):
            if not replace:
                raise FileExistsError(self.folder)
            delete(self.spark, self.folder)
        write_json(self.spark, f"{self.folder}/store.json", {"base": [], "runs": [], "before": [], "next": 1})

    def _append(self, rows: DataFrame) -> None:
        state = self._state()
        number = state["next"]
        name = f"run-{number:08d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("run", F.lit(number)).select("id", "ins", "v", "batch", "run", "gone").sortWithinPartitions("ins").write.parquet(f"{self.folder}/{name}")
        write_json(self.spark, f"{self.folder}/store.json", state | {"runs": [*state["runs"], name], "next": number + 1})
        if len(state["runs"]) >= self.MOST_RUNS:
            self.compact()

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Write one batch; the call returns when it is durable.  Of rows that repeat an id the largest insertion index counts."""
        unit = rows.select(F.col("id").cast("long"), F.col("ins").cast("long"), V.normalised(F.col("v")).alias("v"), F.lit(batch).cast("int").alias("batch"), F.lit(False).alias("gone"))
        require_none(unit.filter("v is null"), "a vector is zero or not finite")
        self._append(unit)

    def delete(self, ids: DataFrame) -> None:
        """Rows of these ids leave the store; ids that it does not hold are no error."""
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ins", "long"), ("v", "array<double>"), ("batch", "int"))]
        self._append(ids.select(F.col("id").cast("long").alias("id"), *nothing, F.lit(True).alias("gone")))

    def rows(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """``(id, ins, v)``, of insertion indices ``low`` to ``high`` where given: the base's files outside the range are not read.

        Only the runs are grouped by id; the base loses the ids that they name.
        """
        state = self._state()

        def within(rows: DataFrame) -> DataFrame:
            rows = rows if low is None else rows.filter(F.col("ins") >= low)
            return (rows if high is None else rows.filter(F.col("ins") <= high)).select("id", "ins", "v")

        base = within(self._table(*state["base"]))
        if not state["runs"]:
            return base
        last = self._table(*state["runs"]).groupBy("id").agg(F.max_by(F.struct("ins", "v", "gone"), F.struct("run", "ins")).alias("r"))
        newer = within(last.filter("not r.gone").select("id", "r.ins", "r.v"))
        # Which ids the runs name, without their vectors.
        named = self._table(*state["runs"]).select(F.col("id").alias("_id")).distinct()
        return base.join(named, F.col("id") == F.col("_id"), "left_anti").unionByName(newer)

    def compact(self) -> None:
        """Merge the runs into a base ranged by insertion index; the tables before stay for readers under way until the next merge."""
        state = self._state()
        name = f"base-{state['next']:08d}-{uuid.uuid4().hex[:8]}"
        whole = self.rows().select("id", "ins", "v", F.lit(None).cast("int").alias("batch"), F.lit(state["next"]).alias("run"), F.lit(False).alias("gone"))
        whole.repartitionByRange("ins").sortWithinPartitions("ins").write.parquet(f"{self.folder}/{name}")
        write_json(self.spark, f"{self.folder}/store.json", {"base": [name], "runs": [], "before": [*state["base"], *state["runs"]], "next": state["next"] + 1})
        for old in state["before"]:
            delete(self.spark, f"{self.folder}/{old}")

    def ingest(self, rows: DataFrame, batch_size: int) -> dict[str, float]:
        """Upserts by insertion index in batches; their number, rate and latencies.  The input is read once, and cut into batches as it is stored."""
        staged = shared_dir(self.spark, "ingest")
        began = time.perf_counter()
        batch = F.floor((F.col("ins") - 1) / batch_size).cast("long")
        rows.select("id", "ins", "v", batch.alias("_k")).repartition("_k").write.partitionBy("_k").parquet(staged)
        parts = self.spark.read.parquet(staged)
        sizes = {r["_k"]: r["count"] for r in parts.groupBy("_k").count().collect()}  # one row a batch
        took = []
        for k in sorted(sizes):
            t = time.perf_counter()
            self.upsert(parts.filter(F.col("_k") == k), k)
            took.append((time.perf_counter() - t) * 1000)
        delete(self.spark, staged)
        total = time.perf_counter() - began
        p50, p95 = np.percentile(took, [50, 95]) if took else (float("nan"), float("nan"))
        return {"batches": len(took), "batch_size": batch_size, "seconds": total, "vectors_per_second": sum(sizes.values()) / total, "p50_batch_ms": float(p50), "p95_batch_ms": float(p95)}

    def status(self) -> dict[str, int]:
        """Points, insertion range, files and bytes."""
        points, low, high = self.rows().agg(F.count("*"), F.min("ins"), F.max("ins")).first()
        state = self._state()
        live = [f"{self.folder}/{n}" for n in (*state["base"], *state["runs"])]
        files = self.spark.read.format("binaryFile").load(live).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first() if live else (0, 0)
        return {"points": points, "first": low, "last": high, "files": files[0], "bytes": files[1]}

    def wait_until(self, points: int, seconds: float = 60.0, every: float = 0.5) -> dict[str, int]:
        """The status once the store holds so many points; a store that does not get there in time is an error."""
        end = time.monotonic() + seconds
        while (now := self.status())["points"] < points:
            if time.monotonic() > end:
                raise TimeoutError(f"{now['points']} of {points} points after {seconds} s")
            time.sleep(every)
        return now


GAP_BLOCK = 100_000


def without_gaps(rows: DataFrame) -> DataFrame:
    """Rows whose insertion index does not follow the one before by 1; none in an append-only memory.

    Blocks of indices are looked through apart, and then the last of each block with the first of the next.
    """
    block = F.floor(F.col("ins") / GAP_BLOCK)
    inner = rows.select("ins", F.lag("ins").over(Window.partitionBy(block).orderBy("ins")).alias("before"))
    ends = rows.groupBy(block.alias("b")).agg(F.min("ins").alias("ins"), F.max("ins").alias("last"))
    # One row a block.
    border = ends.select("ins", F.lag("last").over(Window.orderBy("b")).alias("before"))
    return inner.unionByName(border).filter("before is not null and ins <> before + 1")
