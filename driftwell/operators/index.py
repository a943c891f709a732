"""Approximate candidates from inverted lists: vectors by their nearest centroid, queries against a few lists.

Centroids are fitted by spherical k-means on a bounded sample (``SAMPLE`` vectors, the first by a hash of the id);
every row is indexed.  A list travels in blocks of ``BLOCK`` rows, so one that holds a third of all rows is no single
task.  What a search may miss is measured against the exact one by ``recall``; exact retrieval stays the other way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators import retrieval as R

SAMPLE, ROUNDS, BLOCK = 20_000, 12, 2048


def fit(memory: DataFrame, lists: int, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Unit centroids, at most ``lists`` of them; fewer where the sample holds fewer vectors."""
    rows = memory.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # at most ``sample``
    x = np.array([r.v for r in rows], float)
    if not len(x):
        return np.empty((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def assigned(rows: DataFrame, centroids: np.ndarray, lists: int = 1) -> DataFrame:
    """``rows`` with a column ``list`` for each of their ``lists`` nearest centroids."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", list int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-(np.array(b.v.tolist(), float) @ centroids.T), axis=1, kind="stable")[:, :lists]
                out = b.loc[b.index.repeat(near.shape[1])].reset_index(drop=True)
                yield out.assign(list=near.ravel().astype("int32"))

    return rows.mapInPandas(run, schema)


def _blocks(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows of a list in blocks; a row's block is by its hash within the list's expected number of blocks."""
    cell = F.pmod(F.xxhash64(order), F.lit(1 << 20))
    number = F.floor(F.row_number().over(Window.partitionBy("list", cell % 64).orderBy(order)) / (BLOCK // 16))
    return rows.withColumn("_c", cell % 64).withColumn("_b", number).groupBy("list", "_c", "_b").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "list"])).alias(name)).drop("_c", "_b")


def candidates(queries: DataFrame, memory: DataFrame, centroids: np.ndarray, rule: R.Rule, limit: int, probes: int) -> DataFrame:
    """The ``limit`` records of largest cosine before each query in its ``probes`` nearest lists: (qid, id, ins, age, cosine, score, rank)."""
    q = _blocks(assigned(queries.select("qid", "qins", "v"), centroids, probes), "qid", "qrows")
    m = _blocks(assigned(memory.select("id", "ins", "v"), centroids), "id", "mrows")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = R.best_of(R.columns(batch.column(0), i), R.columns(batch.column(1), i), rule, R.SEMANTIC, limit, decay=1.0)
                yield pa.RecordBatch.from_pandas(made, preserve_index=False)

    found = q.join(m, "list").select("qrows", "mrows").mapInArrow(multiply, R.HITS)
    return R.ranked(found, limit, R.SEMANTIC)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``(qid, recall)``: the share of each query's true hits that were found."""
    both = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
