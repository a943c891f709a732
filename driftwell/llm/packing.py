"""Packing into fixed windows: non-negative least squares over shallow combinations of lengths.

Every document's ids are cut into whole windows, a main piece of a multiple of ``UNIT`` ids and a tail of
under ``UNIT``.  The driver sees only the histogram of piece lengths (at most 127 classes, whatever the
corpus).  For main pieces it enumerates the combinations of up to ``DEPTH`` lengths that fill a window,
solves for repeat counts against the histogram, rounds them down and repeats the same combinations while the
counts allow.  Residuals are packed greedily, largest first, into windows that they fill exactly, of any depth; tails
fill blocks of one unit in the same way.  The few pieces that are left then are cut once more at powers of two and
laid out in descending size, which leaves no gap; only the corpus' last window can end early.

The plan gives each class runs of places by rank.  A piece's rank is its number within its task and class
plus what earlier tasks hold, so no class is ever gathered or sorted.  Checksums of the possible smaller cuts
are taken while the ids are at hand: text is encoded once and ids are never stored.

Defined cases: null text is an empty text, which packs its end id; very long texts are cut into as many windows as
they fill; null and repeated ids and equal lengths are kept as they are, each row packed by itself; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm._util import frugal, stored, table, texts
from driftwell.llm.tokens import encoder, public_vocabulary

WINDOW, UNIT, DEPTH = 4096, 64, 4


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Least squares with x >= 0 by the active-set method."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            full = np.zeros_like(x)
            full[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if full[active].min(initial=1) > 0:
                x = full
                break
            low = active & (full <= 0)
            step = (x[low] / (x[low] - full[low] + 1e-300)).min()
            x += step * (full - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def combinations(capacity: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` lengths below the capacity that fill it, and repeats of one length."""
    found = [(c,) * (capacity // c) for c in range(1, capacity // depth) if capacity % c == 0]
    for k in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, capacity), k - 1):
            last = capacity - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    return found


def solve(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to use each, never more of a length than the histogram has."""
    combos = [c for c in combinations(capacity) if all(x in hist for x in c)]
    if not combos:
        return []
    lengths = sorted(hist)
    row = {c: i for i, c in enumerate(lengths)}
    a = np.zeros((len(lengths), len(combos)))
    for j, fill in enumerate(combos):
        for c in fill:
            a[row[c], j] += 1
    have = np.array([hist[c] for c in lengths], float)
    counts = np.floor(nnls(a, have / have.sum()) * have.sum() + 1e-6)
    left = have - a @ counts
    for i in np.flatnonzero(left < 0):  # least squares may overshoot a length
        for j in np.flatnonzero((a[i] > 0) & (counts > 0)):
            if left[i] >= 0:
                break
            back = min(counts[j], np.ceil(-left[i] / a[i, j]))
            counts[j] -= back
            left += back * a[:, j]
    for j in np.argsort(-counts, kind="stable"):
        more = np.floor((left[a[:, j] > 0] / a[a[:, j] > 0, j]).min())
        counts[j] += more
        left -= more * a[:, j]
    return [(combos[j], int(counts[j])) for j in np.flatnonzero(counts)]


def greedy(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Residuals, largest first, each with the largest others that still fit; only exact fills count."""
    left, out = dict(left), []
    order = sorted(left, reverse=True)
    for start in order:
        while left[start]:
            use, room = {start: 1}, capacity - start
            for c in order:
                k = min(room // c, left[c] - use.get(c, 0))
                if k:
                    use[c] = use.get(c, 0) + k
                    room -= k * c
            if room:
                break
            times = min(left[c] // k for c, k in use.items())
            for c, k in use.items():
                left[c] -= k * times
            out.append((tuple(c for c, k in sorted(use.items()) for _ in range(k)), times))
    return out


def fills(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Least-squares combinations, then greedy ones of what they leave."""
    out, left = solve(hist, capacity), dict(hist)
    for fill, times in out:
        for c in fill:
            left[c] -= times
    return out + greedy(left, capacity)


def binary_cuts(length: int) -> list[int]:
    """The powers of two that sum to ``length``, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def plan(hist: dict[int, int]) -> list[tuple]:
    """Runs of places: (cls, lo, hi, base, period, stride, first, step, size, cut, shift).

    The piece of class ``cls`` and rank ``k + lo < hi`` begins at id ``base + k // period * stride + first +
    k % period * step`` of the sequence of all windows.  Where ``cut`` is not null the run takes that cut
    of the piece, ``shift`` ids into it.
    """
    runs, at = [], hist.get(WINDOW, 0) * WINDOW
    if at:
        runs.append((WINDOW, 0, hist[WINDOW], 0, 1, WINDOW, 0, 0, WINDOW, None, 0))
    used = dict.fromkeys(hist, 0)

    def place(found: list[tuple[tuple[int, ...], int]], unit: int, stride: int, at: int) -> int:
        for fill, times in found:
            first = 0
            for c in sorted(set(fill)):
                period, cls = fill.count(c), c * unit
                n = period * times
                runs.append((cls, used[cls], used[cls] + n, at, period, stride, first, cls, cls, None, 0))
                used[cls] += n
                first += period * cls
            at += times * stride
        return at

    at = place(fills({c // UNIT: n for c, n in hist.items() if UNIT <= c < WINDOW}, WINDOW // UNIT), UNIT, WINDOW, at)
    tails = fills({c: n for c, n in hist.items() if c < UNIT}, UNIT)
    size = WINDOW // 2
    while size:
        if size == UNIT:
            at = place(tails, 1, UNIT, at)
        # Tail runs are placed before any cut below UNIT is laid out, so what is left of a class is known.
        for cls in sorted(hist):
            if cls < WINDOW and cls & size and (n := hist[cls] - used[cls]) and (cls >= UNIT) == (size >= UNIT):
                cuts = binary_cuts(cls)
                cut = cuts.index(size)
                runs.append((cls, used[cls], hist[cls], at, 1, size, 0, 0, size, cut, sum(cuts[:cut])))
                at += n * size
        size //= 2
    return runs


_PIECES = "doc_id long, doc_tokens long, part long, cls long, rank long, start long, crc long, cut_crcs array<long>"
_RUNS = "cls long, lo long, hi long, base long, period long, stride long, first long, step long, size long, cut int, shift long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Encode and cut every document; ranks count from 0 within each task and class."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary if "/" in vocabulary else public_vocabulary(vocabulary))
        part, seen = TaskContext.get().partitionId(), {}
        tail = np.array([end_id], known.dtype).tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(known.encode(text) + tail, known.dtype).astype("<u4").tobytes()
                n, start = len(ids) // 4, 0
                while start < n:
                    left = n - start
                    cls = WINDOW if left >= WINDOW else left - left % UNIT or left
                    end, cuts, at = start + cls, [], start
                    for size in binary_cuts(cls) if cls < WINDOW else ():
                        cuts.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at += size
                    rank = seen[cls] = seen.get(cls, -1) + 1
                    rows.append((doc_id, n, part, cls, rank, start, zlib.crc32(ids[4 * start : 4 * end]), cuts))
                    start = end
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
            names = [x.split()[0] for x in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return texts(docs).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, vocabulary, end_id), "pieces")
    counts = stored(pieces.groupBy("part", "cls").count(), "piece-counts")
    hist = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("count").alias("n")).collect()}  # at most 127 rows
    earlier = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("part").alias("_part"), F.col("cls").alias("_cls"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    runs = spark.createDataFrame([(r[0], *r[1:]) for r in plan(hist)], _RUNS).withColumnRenamed("cls", "_run_cls")
    ranked = pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("cls") == F.col("_cls"))).withColumn("_rank", F.col("rank") + F.col("before"))
    # The plan is bounded by the number of classes and combinations, not by the corpus.
    placed = ranked.join(
        F.broadcast(runs), (F.col("cls") == F.col("_run_cls")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    )
    k = F.col("_rank") - F.col("lo")
    at = F.col("base") + F.floor(k / F.col("period")) * F.col("stride") + F.col("first") + k % F.col("period") * F.col("step")
    return placed.withColumn("_at", at.cast("long")).select(
        "doc_id",
        (F.col("start") + F.col("shift")).alias("start"),
        F.col("size").alias("length"),
        F.when(F.col("cut").isNull(), F.col("crc")).otherwise(F.col("cut_crcs")[F.coalesce(F.col("cut"), F.lit(0))]).alias("ids_crc32"),
        "doc_tokens",
        F.expr(f"_at div {WINDOW}").alias("sequence_id"),
        (F.col("_at") % WINDOW).alias("offset"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)
