"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are held in classes of equal factors, refined as the factors grow by one word.  Only what left
the larger part of a split class is looked at again (the smaller-half strategy), so a position moves at most as often
as its class can halve: n log n steps for a text of n words, however often it repeats itself.  Each class is a linked
list in text order.  Neighbours in a class at a distance equal to the length of its factors start a square; the root
of such a square is primitive, as an occurrence in between would part the neighbours.  Squares of one period that
start at consecutive words are one run.

Runs of fewer than ``least`` words do not count, so the classes start at factors of ``least // 2`` words: neighbours
at that distance or less then reveal the short periods all at once.  A text in which no such factor occurs twice has no
run; one pass over the hashes of a batch finds those texts, and hashes decide nothing else.

Defined cases: null or empty text: no words and no run; a null id is kept, and its text is taken as it stands; very long
texts are read whole, one at a time; repeated rows give equal rows; an empty table gives an empty table; other columns
are not read, whatever their names.  Ties for the longest run: the smallest start, then the smallest period.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import frugal, table, texts
from driftwell.llm.byte_words import byte_class, chunks, cut, mixed, numbered

LEAST = 12
WORD_BYTES = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
RUN = "struct<start:bigint,length:bigint,period:bigint>"
Run = tuple[int, int, int]
#: From which word on a text repeats its words, and with which period.
Repeat = Callable[[int | None, int], tuple[int, int] | None]


def equal_factors(ids: np.ndarray, length: int) -> np.ndarray:
    """The class of the factor of ``length`` words at each position, by joining classes of shorter ones."""
    out, have = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        pair = out[:-step] * (out.max() + 1) + out[step:]
        out, have = np.unique(pair, return_inverse=True)[1], have + step
    return out


def refined(classes: np.ndarray, length: int, most: int) -> dict[int, set[int]]:
    """Where squares start, by period, for classes of equal factors of ``length`` words refined up to ``most`` words.

    For periods below ``length`` the set has the positions whose factor of ``length`` words occurs again a period on.
    """
    m = len(classes)
    active = np.flatnonzero(np.bincount(classes)[classes] > 1)
    if not len(active):
        return {}
    order = active[np.argsort(classes[active], kind="stable")]
    kind = classes[order]
    border = np.flatnonzero(np.diff(kind, prepend=-1))
    number = np.cumsum(np.diff(kind, prepend=-1) != 0) - 1
    where = np.full(m, -1)
    where[order] = number
    after, before = np.full(m, -1), np.full(m, -1)
    same = number[1:] == number[:-1]
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    size = np.diff(border, append=len(order)).tolist()
    tail = order[np.append(border[1:], len(order)) - 1].tolist()
    gap = np.where(after >= 0, after - np.arange(m), 0)
    found: dict[int, set[int]] = {}
    for d in range(1, length + 1):
        at = np.flatnonzero(gap == d)
        if len(at):
            found[d] = set(at.tolist())
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in np.flatnonzero((gap > length) & (gap <= most)).tolist():
        waiting[int(gap[i])].append(i)
    successor = np.append(classes[1:], -1)[active]
    by = np.argsort(successor, kind="stable")
    parts = np.split(active[by], np.flatnonzero(np.diff(successor[by])) + 1)
    movers = [x.tolist() for x in parts if len(x)]
    where, after, before = where.tolist(), after.tolist(), before.tolist()

    def unlink(i: int, old: int) -> None:
        a, b = before[i], after[i]
        if a >= 0:
            after[a] = b
        if b >= 0:
            before[b] = a
            if a >= 0 and length < b - a <= most:
                waiting[b - a].append(a)
        else:
            tail[old] = a
        size[old] -= 1

    while movers and length < most:
        if len(movers) == 1 and len(movers[0]) == 1:
            # One position leaves its class: the usual step near the end of a text that repeats itself.
            i = movers[0][0]
            old = where[i]
            if old < 0 or size[old] == 1:
                break
            unlink(i, old)
            before[i] = after[i] = -1
            where[i] = len(size)
            size.append(1)
            tail.append(i)
            length += 1
            starts = {i for i in waiting.pop(length, ()) if after[i] == i + length}
            if starts:
                found[length] = starts
            movers = [[i - 1]] if i else []
            continue
        born: dict[int, list[int]] = {}
        for part in movers:
            fresh: dict[int, int] = {}
            for i in part:
                old = where[i]
                if old < 0 or size[old] == 1 and old not in born:
                    continue
                unlink(i, old)
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(size)
                    size.append(0)
                    tail.append(-1)
                    born.setdefault(old, []).append(new)
                a = tail[new]
                before[i], after[i] = a, -1
                if a >= 0:
                    after[a] = i
                    if length < i - a <= most:
                        waiting[i - a].append(a)
                tail[new], where[i] = i, new
                size[new] += 1
        length += 1
        starts = {i for i in waiting.pop(length, ()) if after[i] == i + length}
        if starts:
            found[length] = starts
        movers = []
        for old, parts in born.items():
            if size[old]:
                parts.append(old)
            if len(parts) > 1:
                parts.remove(max(parts, key=size.__getitem__))
                for c in parts:
                    members, i = [], tail[c]
                    while i >= 0:
                        members.append(i - 1)
                        i = before[i]
                    if members[-1] < 0:
                        members.pop()
                    members.reverse()
                    movers.append(members)
    return found


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """Every run ``(start, length, period)`` of at least ``least`` words and two periods, by start, then period."""
    n, base = len(ids), max(1, least // 2)
    if n < max(2, least):
        return []
    classes = equal_factors(ids, base)
    out = []
    for q, starts in refined(classes, base, n // 2).items():
        at = np.array(sorted(starts))
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        for s, e in zip(at[np.append(0, cuts)].tolist(), at[np.append(cuts, len(at)) - 1].tolist(), strict=True):
            length = e - s + max(q, base) + q
            if length >= max(least, 2 * q):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


def _may_repeat(ids: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Texts in which a factor of ``length`` words may occur twice; certain for those left out."""
    m = len(ids) - length + 1
    if m < 2:
        return np.zeros(0, np.int64)
    word, key = mixed(ids + 1), np.zeros(m, np.uint64)
    for k in range(length):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[k : k + m]
    key = mixed(key) ^ mixed(owner[:m] + (1 << 40))
    key, at = key[(within := owner[:m] == owner[length - 1 :])], owner[:m][within]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    return np.unique(at[np.isin(key, np.unique(twice))]) if len(twice) else twice.astype(np.int64)


def find_runs(docs: DataFrame, least: int = LEAST, repeat: Repeat | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: the runs of each whole text, and its words without the repeated periods.

    With ``repeat``, a text of n words for whose id it gives ``(a, p)`` is read with word ``a + (i - a) % p`` in place of
    each word ``i`` from ``a`` on.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, borders, data in chunks(b.column(1)):
                words, counts = cut(borders, data, WORD_BYTES)
                ids = numbered(words)[0]
                keys = b.column(0).slice(i, j - i)
                first = np.append(0, np.cumsum(counts))
                owner = np.repeat(np.arange(j - i), counts)
                again = set(_may_repeat(ids, owner, max(1, least // 2)).tolist())
                runs, left = [], []
                for k, key in enumerate(keys.to_pylist()):
                    n = int(counts[k])
                    own = data[borders[k] : borders[k + 1]].tobytes().split()
                    change = repeat(key, n) if repeat is not None and n else None
                    found: list[Run] = []
                    if change is not None or k in again:
                        mine = ids[first[k] : first[k + 1]]
                        if change is not None:
                            a, p = change
                            index = np.arange(n)
                            index[a:] = a + (index[a:] - a) % p
                            mine, own = mine[index], [own[x] for x in index.tolist()]
                        found = runs_of(mine, least)
                        if found:
                            own = [own[x] for x in np.flatnonzero(kept_words(n, found)).tolist()]
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    left.append(b" ".join(own))
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return texts(docs).mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def by_id(key: int | None, n: int) -> tuple[int, int] | None:
    """The repetition that op12's contract asks for: one text in ten, by the checksum of its id."""
    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), LEAST, by_id)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
