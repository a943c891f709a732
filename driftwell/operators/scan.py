"""Newest-first search over a memory packed once into blocks.

``BlockStore.write`` packs a memory ``(id, ins, v)`` into one file for each ``BLOCK`` insertion indices, in the shared
folder.  A search deals its queries out by position; a task takes neighbouring queries together and walks the files from
the newest record they can see, one file in memory at a time, until each query's certificate holds: no record that is
older than what has been seen can enter its top K.  Files beyond the certificate, or outside a recency window, are never
opened, and no vector of the memory is shuffled.

A walk tests certificates at the ends of a schedule of windows, and reports for each query where it stopped (``horizon``),
how many windows it asked for (``calls``), how many records passed the gate (``candidates``) and how many files were
opened for it (``files``).

Defined cases: a query that sees no record, a memory without rows: no hits, horizon 0, one call; records with equal
insertion indices are told apart by id; vectors of another size than the memory's, and null ones, are an error; a
decay of 1 certifies nothing, so the walk ends at the oldest record; scores that decay to 0 are hits like any other,
and certify nothing unless the order breaks ties by recency.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators.retrieval import BLOCK, EXHAUSTIVE, Rule, ranked
from driftwell.session import delete, shared_dir

#: Queries that walk together, and the parts that the queries of one block of positions are dealt to.
TOGETHER, PARTS = 256, 8
#: Hits that a group of queries holds before they are cut to the best K of each query.
HELD = 1 << 18
HIT = "struct<id:bigint,ins:bigint,age:bigint,cosine:double,score:double>"
WALK = f"qid long, qins long, horizon long, calls long, candidates long, files long, hits array<{HIT}>"

#: The window after ``h``, given how many have been asked for.
Schedule = Callable[[int], int]


def steps(size: int) -> Schedule:
    """Windows that grow by ``size`` records."""
    return lambda h: h + size


def growing(initial: int, growth: float = 2.0) -> Schedule:
    """Windows that begin at ``initial`` and grow by a factor."""
    return lambda h: initial if h == 0 else max(h + 1, int(-(-h * growth // 1)))


def _matrix(column: pa.Array) -> np.ndarray:
    if column.null_count or column.flatten().null_count:
        raise ValueError("vectors and their elements are never null")
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in size")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class BlockStore:
    """A packed memory: its folder and, by block number, the smallest and largest insertion index."""

    path: str
    bounds: dict[int, tuple[int, int]]

    @staticmethod
    def write(memory: DataFrame, path: str | None = None) -> BlockStore:
        """Pack ``memory``; a file is written under a temporary name and moved, so a repeated task only replaces it by its like."""
        spark = memory.sparkSession
        path = path or shared_dir(spark, "blocks")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = pafs.FileSystem.from_uri(path)
            files.create_dir(root, recursive=True)
            number, parts = None, []

            def flush() -> pa.RecordBatch:
                ids, ins = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                out = io.BytesIO()
                np.savez(out, id=ids, ins=ins, v=np.concatenate([p[2] for p in parts]))
                temporary = f"{root}/_tmp-{number}-{np.random.default_rng().integers(1 << 62)}"
                with files.open_output_stream(temporary) as f:
                    f.write(out.getbuffer())
                files.move(temporary, f"{root}/{number}.npz")
                return pa.RecordBatch.from_pydict({"block": [number], "low": [int(ins.min())], "high": [int(ins.max())]})

            for b in batches:
                blocks = b.column(0).to_numpy()
                for s, e in zip(cuts := [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()], [*cuts[1:], len(blocks)], strict=True):
                    if e > s:
                        if number is not None and blocks[s] != number:
                            yield flush()
                            parts = []
                        number = int(blocks[s])
                        part = b.slice(s, e - s)
                        parts.append((part.column(1).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3))))
            if parts:
                yield flush()

        rows = memory.select(F.floor((F.col("ins") - 1) / BLOCK).alias("block"), F.col("id").cast("long").alias("id"), F.col("ins").cast("long").alias("ins"), "v")
        rows = rows.repartition("block").sortWithinPartitions("block", "ins", "id")
        # One row of three numbers a block.
        found = rows.mapInArrow(pack, "block long, low long, high long").collect()
        return BlockStore(path, {r.block: (r.low, r.high) for r in found})

    def drop(self, spark: SparkSession) -> None:
        delete(spark, self.path)


class _Reader:
    """Blocks of one store, newest first; the last one read is kept, for the next queries often begin there."""

    def __init__(self, store: BlockStore):
        self.store = store
        self.files, self.root = pafs.FileSystem.from_uri(store.path)
        self.numbers = sorted(store.bounds, reverse=True)
        self.kept: tuple[int, dict] | None = None

    def older_than(self, ins: int) -> Iterator[tuple[int, int]]:
        """``(block, lowest index)`` of the blocks with a record before ``ins``."""
        for n in self.numbers:
            if self.store.bounds[n][0] < ins:
                yield n, self.store.bounds[n][0]

    def read(self, number: int) -> dict:
        if self.kept is None or self.kept[0] != number:
            with self.files.open_input_file(f"{self.root}/{number}.npz") as f, np.load(io.BytesIO(f.readall())) as x:
                # Newest first, and among equal indices the larger id.
                order = np.lexsort((-x["id"], -x["ins"]))
                self.kept = number, {"id": x["id"][order], "ins": x["ins"][order], "v": x["v"][order].astype(np.float64)}
        return self.kept[1]


def _first(kept: list[tuple], order: tuple, k: int) -> tuple:
    """The best ``k`` in ``order`` of each query, of hits ``(query, id, ins, age, cosine, score)``."""
    found = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
    who, by = found[0], dict(zip(("id", "ins", "age", "cosine", "score"), found[1:], strict=True))
    at = np.lexsort((*[-by[x] for x in reversed(order)], who))
    place = np.arange(len(at)) - np.searchsorted(who[at], who[at], "left")
    return tuple(x[at[place < k]] for x in found)


def _walk(
    reader: _Reader, qid: np.ndarray, qins: np.ndarray, v: np.ndarray, rule: Rule, schedule: Schedule, window: int | None, first: np.ndarray | None = None, order: tuple = EXHAUSTIVE
) -> list[tuple]:
    """One group of queries: ``(qid, qins, horizon, calls, candidates, files, hits)`` each; ``first`` is the oldest index that a query sees."""
    n = len(qid)
    size = np.maximum(qins - (1 if first is None else first), 0)
    end, calls = np.full(n, schedule(0)), np.ones(n, np.int64)
    horizon, candidates, opened = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # What is missing or does not pass the gate lies below every score, also below one that has decayed to 0.
    top = np.full((n, rule.k), -1.0)
    kept: list[tuple] = []
    # Where ties go to the newer record, an older one that could only tie cannot enter either.
    newer = order[:2] == ("score", "ins")
    if window is not None:
        end = np.full(n, window)
    elif rule.decay == 1:
        end = np.maximum(size, 1)
    horizon[(size == 0)] = 0
    # No window is longer than what its query sees, so a slice never reaches another memory's records.
    end = np.minimum(end, np.maximum(size, 1))

    def settle(q: np.ndarray) -> None:
        """Queries whose window ``end`` has been seen: stop, or ask for the next one."""
        kth = top[q].min(1)
        done = end[q] >= size[q]
        if window is None and rule.decay < 1:
            bound = np.power(rule.decay, end[q].astype(float))
            done |= (kth >= 0) & (bound <= kth) if newer else (kth > 0) & (bound < kth)
        else:
            done[:] = True
        horizon[q[done]] = np.minimum(end[q[done]], size[q[done]])
        for i in q[~done]:
            end[i] = min(schedule(int(end[i])), int(size[i]))
            calls[i] += 1

    for number, low in reader.older_than(int(qins.max())):
        live = np.flatnonzero(horizon < 0)
        if not len(live):
            break
        live = live[(low < qins[live])]
        # Windows that end above this block's newest record have nothing to read here.
        reach = qins[live] - 1 - reader.store.bounds[number][1]
        while len(late := live[reach >= end[live]]):
            settle(late)
            live = live[horizon[live] < 0]
            reach = qins[live] - 1 - reader.store.bounds[number][1]
        if not len(live):
            continue
        m = reader.read(number)
        if m["v"].shape[1] != v.shape[1]:
            raise ValueError("vectors differ in size")
        opened[live] += 1
        cosine = np.clip(v[live] @ m["v"].T, -1, 1)
        age = qins[live][:, None] - 1 - m["ins"][None, :]
        fits = (cosine > 0) & (cosine >= rule.tau) & (age >= 0)
        score = np.full(cosine.shape, -1.0)
        score[fits] = cosine[fits] * np.power(rule.decay, age[fits])
        seen = qins[live] - low
        at = np.zeros(len(live), np.int64)
        # Queries that find nothing here have their windows settled before the next block is read.
        rows = np.flatnonzero(fits.any(1))
        while len(rows):
            # Each query's next slice: from where it is to its window's end or the block's, whichever comes first.
            stop = np.searchsorted(-m["ins"], end[live[rows]] - qins[live[rows]] + 1, "left")
            width = int((stop - at[rows]).max())
            if width > 0:
                index = at[rows][:, None] + np.arange(width)[None, :]
                inside = index < stop[:, None]
                index = np.minimum(index, age.shape[1] - 1)
                part = np.where(inside, np.take_along_axis(score[rows], index, 1), -1.0)
                q = live[rows]
                candidates[q] += (part >= 0).sum(1)
                both = np.concatenate([top[q], part], axis=1)
                top[q] = np.partition(both, both.shape[1] - rule.k, axis=1)[:, -rule.k :]
                who, where = np.nonzero((part >= 0) & (part >= top[q].min(1)[:, None]))
                col = index[who, where]
                r = rows[who]
                kept.append((live[r], m["id"][col], m["ins"][col], age[r, col], cosine[r, col], score[r, col]))
            at[rows] = stop
            ended = rows[end[live[rows]] <= seen[rows]]
            if not len(ended):
                break
            settle(live[ended])
            rows = ended[horizon[live[ended]] < 0]
        if sum(len(x[0]) for x in kept) > HELD:
            kept = [_first(kept, order, rule.k)]
    rest = np.flatnonzero(horizon < 0)
    while len(rest):  # the oldest record has been seen
        settle(rest)
        rest = rest[horizon[rest] < 0]

    hits: list[list[dict]] = [[] for _ in range(n)]
    if kept:
        for i, *hit in zip(*(x.tolist() for x in _first(kept, order, rule.k)), strict=True):
            hits[i].append(dict(zip(("id", "ins", "age", "cosine", "score"), hit, strict=True)))
    return list(zip(qid.tolist(), qins.tolist(), horizon.tolist(), calls.tolist(), candidates.tolist(), opened.tolist(), hits, strict=True))


def walk(queries: DataFrame, store: BlockStore, rule: Rule, schedule: Schedule, window: int | None = None, order: tuple = EXHAUSTIVE) -> DataFrame:
    """A row for each query ``(qid, qins, v)``: where its search stopped, what it cost, and its best K hits in ``order``.

    With ``window`` only the newest ``window`` records count and no certificate is asked for.  A store may hold several
    memories one after the other: queries then have a column ``first``, the index of their own memory's oldest record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(store)
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("id", "ins", "age")] + [("cosine", pa.float64()), ("score", pa.float64())]))
        for b in batches:
            qins = b.column(1).to_numpy()
            s = 0
            while s < len(qins):
                # Neighbours in position, at most a block apart.
                e = min(s + TOGETHER, int(np.searchsorted(qins, qins[s] + BLOCK, "left")))
                part = b.slice(s, e - s)
                first = part.column(3).to_numpy()
                found = _walk(reader, part.column(0).to_numpy(), qins[s:e], _matrix(part.column(2)).astype(np.float64), rule, schedule, window, first, order)
                *numbers, hits = zip(*found, strict=True)
                names = ["qid", "qins", "horizon", "calls", "candidates", "files", "hits"]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(hits, kind)], names)
                s = e

    first = F.col("first") if "first" in queries.columns else F.lit(1)
    rows = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qins").cast("long").alias("qins"), "v", first.cast("long").alias("first"))
    rows = rows.repartition(F.floor((F.col("qins") - 1) / BLOCK), F.pmod(F.xxhash64("qid"), F.lit(PARTS))).sortWithinPartitions("qins", "qid")
    return rows.mapInArrow(run, WALK)


def hits_of(walked: DataFrame, rule: Rule, order: tuple = EXHAUSTIVE) -> DataFrame:
    """``(qid, id, ins, age, cosine, score, rank)`` of a walk."""
    return ranked(walked.select("qid", F.inline("hits")), rule.k, order)
