"""Time-decayed top-K retrieval over an append-only memory.

A memory is ``(id, ins, v)``: insertion index from 1 and a unit vector.  A query ``(qid, qins, v)`` sees the
records inserted before it; the newest of them has age 0.  A record passes the gate where its raw cosine is
positive and at least ``tau``; its score is the cosine times ``decay ^ age``.

Queries and memory are packed into blocks of at most ``BLOCK`` rows, by position, so a task holds two blocks
however large the memory is.  A pair of blocks is multiplied at once and gives at most K rows per query;
these partial results are ranked again.  Pairs of blocks that the age window rules out are never made.
Searches that stop by certificate are in ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import vectors as V

BLOCK = 2048
HITS = "qid long, id long, ins long, age long, cosine double, score double"


@dataclass(frozen=True)
class Rule:
    decay: float = 0.99861
    tau: float = 0.2
    k: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.decay <= 1 or self.k < 1:
            raise ValueError("decay lies in (0, 1] and k is positive")


#: Orders of hits, best first.  Online retrieval breaks ties by recency; the exhaustive one by raw cosine first.
ONLINE = ("score", "ins", "id")
EXHAUSTIVE = ("score", "cosine", "ins", "id")
SEMANTIC = ("cosine", "ins", "id")
#: Score alone, ties in insertion order; a leading minus means smallest first.
STANDALONE = ("score", "-ins")


def _blocks(df: DataFrame, keys: list[str], position: str, prefix: str) -> DataFrame:
    """One row per block of neighbouring positions: its bounds and its rows as arrays."""
    block = F.floor((F.col(position) - 1) / BLOCK)
    return df.groupBy(block.alias(f"{prefix}block")).agg(
        F.min(position).alias(f"{prefix}low"), F.max(position).alias(f"{prefix}high"), F.collect_list(F.struct(*keys)).alias(f"{prefix}rows")
    )


def _meeting(q: DataFrame, m: DataFrame, on: Column | list[str]) -> DataFrame:
    """Pairs of blocks, by a shuffle of both sides: a block of queries repeated for each block it meets looks small to the
    planner, which sizes it before it is repeated, and would send the square of the memory through the driver."""
    return q.hint("merge").join(m, on)


def columns(rows: pa.ListArray, i: int) -> dict[str, np.ndarray]:
    """The fields of row ``i``, a list of structs, as numpy columns; a field of vectors becomes a matrix."""
    flat = rows[i].values
    out = {}
    for k in range(flat.type.num_fields):
        values = flat.field(k)
        if pa.types.is_list(values.type):
            sizes = np.diff(values.offsets.to_numpy(zero_copy_only=False))
            if len(sizes) and (sizes != sizes[0]).any():
                raise ValueError("vectors differ in size")
            out[flat.type.field(k).name] = values.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64, copy=False)
        else:
            out[flat.type.field(k).name] = values.to_numpy(zero_copy_only=False)
    return out


def best_of(q: dict, m: dict, rule: Rule, order: tuple, keep: int, oldest: int = 0, last: int = 1 << 40, decay: float | None = None) -> pd.DataFrame:
    """The ``keep`` best gated hits of each query of one block among the records of another."""
    decay = rule.decay if decay is None else decay
    if q["v"].shape[1] != m["v"].shape[1]:
        raise ValueError("vectors differ in size")
    cosine = np.clip(q["v"] @ m["v"].T, -1, 1)
    age = q["qins"][:, None] - 1 - m["ins"][None, :]
    ok = (cosine > 0) & (cosine >= rule.tau) & (age >= oldest) & (age < last)
    newest, first = m["ins"].max(), q["qins"].min() - 1
    if decay == 1:
        score = cosine
    elif newest <= first:  # ages split in two parts, neither of them negative
        score = cosine * np.power(decay, q["qins"] - 1 - newest)[:, None] * np.power(decay, newest - m["ins"])[None, :]
    else:
        score = cosine * np.power(decay, np.maximum(age, 0))
    lead = np.where(ok, score if order[0] == "score" else cosine, -1.0)
    if keep < lead.shape[1]:  # all that reach the query's keep-th best, ties with it included
        ok &= lead >= np.partition(lead, lead.shape[1] - keep, axis=1)[:, -keep][:, None]
    at, of = np.nonzero(ok)
    out = pd.DataFrame({"qid": q["qid"][at], "id": m["id"][of], "ins": m["ins"][of], "age": age[at, of], "cosine": cosine[at, of], "score": score[at, of]})
    out = out.sort_values(["qid", *[c.lstrip("-") for c in order]], ascending=[True] + [c[0] == "-" for c in order])
    return out.groupby("qid", sort=False).head(keep)


def hits(queries: DataFrame, memory: DataFrame, rule: Rule, window: int | None = None, order: tuple = EXHAUSTIVE, keep: int | None = None, oldest: int = 0) -> DataFrame:
    """Gated hits: the best ``keep`` (K unless given) per query and pair of blocks, of ages ``oldest`` to ``window`` - 1."""
    keep = keep or rule.k
    last = window if window is not None else 1 << 40
    if window is not None:
        # The records that any window reaches, as a filter that a Parquet scan of the memory takes over.
        reach = queries.agg(F.min("qins").alias("low"), F.max("qins").alias("high")).first()
        memory = memory.filter((F.col("ins") >= (reach.low or 0) - window) & (F.col("ins") < (reach.high or 0)))
    q = _blocks(queries.select("qid", "qins", "v"), ["qid", "qins", "v"], "qins", "q")
    m = _blocks(memory.select("id", "ins", "v"), ["id", "ins", "v"], "ins", "m")
    # Blocks are joined by number where windows bound their distance, and otherwise as a stated query set
    # against all blocks; either way by bounds, not by rows.
    near = (F.col("mlow") < F.col("qhigh")) & (F.col("mhigh") >= F.col("qlow") - F.lit(last))
    if window is not None:
        reach = window // BLOCK + 1
        first = F.col("qblock") - reach
    else:
        first = F.lit(0).cast("long")
    pairs = _meeting(q.withColumn("_at", F.explode(F.sequence(first, F.col("qblock")))), m, (F.col("_at") == F.col("mblock")) & near)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = best_of(columns(batch.column(0), i), columns(batch.column(1), i), rule, order, keep, oldest, last)
                yield pa.RecordBatch.from_pandas(made, preserve_index=False)

    return pairs.select("qrows", "mrows").mapInArrow(multiply, HITS)


def ranked(found: DataFrame, k: int, order: tuple = EXHAUSTIVE, by: str = "qid") -> DataFrame:
    """The ``k`` best rows of each query with their rank from 1."""
    w = Window.partitionBy(by).orderBy(*[F.col(c[1:]).asc() if c[0] == "-" else F.col(c).desc() for c in order])
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def retrieve(queries: DataFrame, memory: DataFrame, rule: Rule, order: tuple = ONLINE) -> DataFrame:
    """All records before the query: the online order by default, EXHAUSTIVE for ground truth."""
    return ranked(hits(queries, memory, rule, order=order), rule.k, order)


def fixed_recency(queries: DataFrame, memory: DataFrame, rule: Rule, window: int) -> DataFrame:
    """Only the newest ``window`` records."""
    return ranked(hits(queries, memory, rule, window=window), rule.k)


def semantic_candidates(queries: DataFrame, memory: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """The ``limit`` records of largest raw cosine, which an index search would give, by exact search."""
    return ranked(hits(queries, memory, rule, order=SEMANTIC, keep=limit), limit, SEMANTIC)


def rerank(candidates: DataFrame, rule: Rule, first: str | None = None) -> DataFrame:
    """Rank candidates ``(qid, id, ins, age, cosine)`` by decayed score.

    Candidates that repeat an id count once: the one with the smallest ``first``, or any where rows agree.
    """
    rows = candidates
    if first:
        w = Window.partitionBy("qid", "id").orderBy(first)
        rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    else:
        rows = rows.dropDuplicates(["qid", "id"])
    rows = rows.filter((F.col("cosine") > 0) & (F.col("cosine") >= rule.tau))
    score = V.rectified(F.col("cosine")) * V.temporal_weight(rule.decay, F.col("age"))
    return ranked(rows.withColumn("score", score), rule.k)


def context_text(found: DataFrame, text: Column) -> DataFrame:
    """One text per query: its hits in rank order, apart by a blank line; queries without hits read ``None.``."""
    rows = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("r"))
    return rows.select("qid", F.when(F.size("r") == 0, "None.").otherwise(F.array_join(F.transform("r", lambda x: x["t"]), "\n\n")).alias("context"))


def nearest(left: DataFrame, right: DataFrame, same_table: bool = False, same: str | None = None, other: str | None = None) -> DataFrame:
    """``(qid, id, cosine)``: for each left vector ``(qid, v)`` the right ``(id, v)`` most like it, larger ids on ties.

    ``left`` is a stated query set, searched exactly against all rows of ``right``.  Ids are hashed into as many blocks as
    the count asks for (of each label, where only equal labels meet), and pairs of blocks meet by number, so a label with
    most of the rows is spread like any other.  Only rows that agree in column ``same``, or differ in ``other``, are
    compared; rows without a label agree with none and differ from none.  A block pair returns one row a query, and those
    are reduced before they are shuffled again.
    """
    group = same or other
    label = F.col(group) if group else F.lit(0)

    def blocks(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Rows with their block, and the number of blocks of each label."""
        rows = rows.select(F.col(key).alias("id"), "v", label.cast("string").alias("g")).filter("g is not null").withColumn("s", F.col("g") if same else F.lit(""))
        # Half full on average, so that blocks of hashed ids stay under BLOCK rows.
        many = rows.groupBy("s").agg(F.ceil(F.count("*") * 2 / BLOCK).alias("many"))
        own = many.select(F.col("s").alias("_s"), "many")
        cell = rows.join(own, F.col("s") == F.col("_s")).withColumn("b", F.pmod(F.xxhash64("id"), F.col("many")))
        return cell.groupBy("s", "b").agg(F.collect_list(F.struct("id", "v", "g")).alias("rows")), own

    (q, _), (m, there) = blocks(left, "qid"), blocks(right, "id")
    q = q.join(there, F.col("s") == F.col("_s")).select("s", F.col("rows").alias("qrows"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("b"))
    pairs = _meeting(q, m.withColumnRenamed("rows", "mrows"), ["s", "b"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = columns(batch.column(0), i), columns(batch.column(1), i)
                order = np.argsort(-y["id"], kind="stable")
                ids = y["id"][order]
                c = np.clip(x["v"] @ y["v"].T, -1, 1)[:, order]
                if other:
                    c[x["g"][:, None] == y["g"][order][None, :]] = -2
                if same_table:
                    c[x["id"][:, None] == ids[None, :]] = -2
                at = c.argmax(1)
                best = c[np.arange(len(at)), at]
                keep = best > -2
                yield pa.RecordBatch.from_arrays([pa.array(x["id"][keep]), pa.array(ids[at][keep]), pa.array(best[keep])], ["qid", "id", "cosine"])

    found = pairs.select("qrows", "mrows").mapInArrow(multiply, "qid long, id long, cosine double")
    best = found.groupBy("qid").agg(F.max(F.struct("cosine", "id")).alias("m"))
    return best.select("qid", "m.id", "m.cosine")
