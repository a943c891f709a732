"""Repeated passages by a depth-limited radix sort of suffixes, most significant digits first.

Suffixes are told apart only through their first ``depth`` bytes (400), so groups that stay equal are exactly
the windows that occur more than once.  The passes read bytes 0-127, then 128-255, then the rest of each suffix.
The first two digits are read as 64-bit hashes, so their order is that of the hash; the last pass reads the rest
through a 128-bit BLAKE2 digest of all bytes, which also settles equality.  After each pass a group of one leaves.

Sorting every suffix by itself would move hundreds of bytes for each byte of text, so two reductions go before:

1. Runs.  A window's minimizer is its ``DIGIT``-byte string of smallest hash (leftmost of equals), which equal
   windows have at the same place.  Neighbouring windows with the same occurrence of it form a run.  A run
   whose minimizer occurs nowhere else leaves: none of its windows is repeated.
2. Blocks.  What remains is told apart by the string that all windows of ``BLOCK`` neighbours share.

In either, rows whose bytes all coincide (by digest) are settled as repeated, and one of them goes on as the
others' counterpart.  Rows that differ go on; their windows take part in the radix passes one by one.  Hashes
can only bring too many rows together; that windows are equal is always settled by digests of their bytes.

Groups are counted and joined, never gathered.  Texts travel as pieces of ``PIECE`` bytes with an overlap, so no
row holds more parts than a piece has bytes, whatever the length of a text; merged spans of a document, each at
least ``depth`` bytes, meet in one row with its text.  Texts without a repeated minimizer are never shuffled.

Defined cases: null text is an empty text; texts under 400 bytes keep every byte; very long texts are cut into
pieces and lose no window; rows that repeat both id and text are two documents with the same passages; null ids
are allowed; ties cannot matter, as every copy is treated alike; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from hashlib import blake2b, sha256
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import Scratch, frugal, table

DEPTH, DIGIT, BLOCK = 400, 128, 32
PIECE = 1 << 18
#: Where the first digits of a suffix end; the last ends at the depth.
PASSES = 128, 256
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random bytes values, powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    values = np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
    return values, out[0], out[1]


class Rolling:
    """Hashes of any substring of ``data`` from prefix sums: ``span(start, end)``."""

    def __init__(self, data: np.ndarray):
        values, self.powers, inverse = _powers(2 * PIECE + (1 << 12))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * inverse[: len(data)], out=self.sums[1:])

    def span(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.powers[start]


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of substrings, as two columns of signed 64-bit numbers."""
    made = b"".join([blake2b(data[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours; the place is the low bits of each value."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    cells = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & _LOW).astype(np.int64)


def runs_of(pieces: list[tuple[int, int, bytes]], depth: int = DEPTH, digit: int = DIGIT) -> list[np.ndarray]:
    """Runs of windows of ``(row, offset in the text, bytes)``: row, first window, windows, minimizer's place, key, digest (two)."""
    sizes = np.array([len(p[2]) for p in pieces])
    joined = b"".join(p[2] for p in pieces)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(pieces)), np.maximum(sizes - depth + 1, 0))
    if not len(owner):
        return [np.empty(0, np.int64)] * 7
    rolling = Rolling(data)
    at = np.arange(len(data) - digit + 1)
    keys = rolling.span(at, at + digit)
    place = _sliding_argmin(_mix(keys) & ~_LOW | at.astype(np.uint64), depth - digit + 1)
    begins = np.concatenate([np.arange(e - s, e - depth + 1) for s, e in zip(sizes, ends, strict=True)])
    place = place[begins]
    cut = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    first, last = begins[cut], begins[np.append(cut[1:], len(begins)) - 1]
    p, own = place[cut], owner[cut]
    # Equal bytes have equal minimizers at equal places, so the bytes are all of a run's content.
    c = digests(joined, first, last + depth)
    shift = np.array([x[1] for x in pieces])[own] - (ends - sizes)[own]  # from places here to places in the text
    row = np.array([x[0] for x in pieces])[own]
    return [row, first + shift, last - first + 1, p + shift, keys[p].view(np.int64), c[:, 0], c[:, 1]]


def _pieces(row: int, data: bytes, depth: int) -> Iterator[tuple[int, int, bytes]]:
    for at in range(0, max(1, len(data) - depth + 1), PIECE):
        yield row, at, data[at : at + PIECE + depth - 1]


def _key(name: str = "text") -> list[Column]:
    """Two columns that tell rows apart unless both id and text are equal."""
    text = F.xxhash64(F.coalesce(F.col(name), F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("long"), text).alias("a"), text.alias("b")]


_ROW = "a long, b long, s long, n long, p long, key long, c1 long, c2 long"


def _batch(cols: list[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def runs(docs: DataFrame, depth: int) -> DataFrame:
    """``(a, b, s, n, p, key, c1, c2)``: the runs of every text."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                row, *rest = runs_of(held, depth)
                return _batch([a[row], b[row], *rest], _ROW)

            for i, text in enumerate(batch.column(2)):
                data = text.as_py().encode()
                if len(data) < depth:
                    continue
                for piece in _pieces(i, data, depth):
                    held.append(piece)
                    size += len(piece[2])
                    if size >= PIECE:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    rows = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, _ROW)


def _each(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make(data, start of the data in the text, parts as numpy columns)`` for each piece with its parts."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, low, data, parts in zip(*(batch.column(i) for i in range(5)), strict=True):
                flat = parts.values
                cols = make(data.as_py(), low.as_py(), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)])
                ids = [np.full(len(cols[0]), x.as_py(), np.int64) for x in (a, b)]
                yield _batch([*ids, *cols], schema)

    return rows.select("a", "b", "low", "data", "parts").mapInArrow(run, schema)


def blocks(rows: DataFrame, depth: int, block: int) -> DataFrame:
    """The blocks of parts ``(s, n, p, key, need)`` of each piece.

    A block is the windows whose distance to the minimizer lies in the same ``block`` neighbours; what they share
    is what the widest of such blocks shares.
    """

    def make(data: bytes, low: int, parts: list[np.ndarray]) -> list[np.ndarray]:
        s, n, p, key, need = parts
        rolling = Rolling(np.frombuffer(data, np.uint8))
        reach, least = p - s, p - (s + n - 1)
        count = reach // block - least // block + 1
        part = np.repeat(np.arange(len(s)), count)
        step = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
        which = np.repeat(least // block, count) + step
        far = np.minimum(p[part] - which * block, s[part] + n[part] - 1)
        near = np.maximum(p[part] - which * block - block + 1, s[part])
        shared = p[part] - which * block - low
        digit = rolling.span(shared, shared + depth - block + 1)
        digit = _mix(digit ^ _mix(key[part].view(np.uint64) + which.astype(np.uint64)))
        c = digests(data, near - low, far - low + depth)
        return [near, far - near + 1, p[part], digit.view(np.int64), c[:, 0], c[:, 1], need[part]]

    return _each(rows, f"{_ROW}, need boolean", make)


_SUFFIX = "a long, b long, s long, need boolean, d1 long, d2 long, c1 long, c2 long"


def suffixes(rows: DataFrame, depth: int) -> DataFrame:
    """Each window of the parts with its first digits and the digest of its bytes."""

    def make(data: bytes, low: int, parts: list[np.ndarray]) -> list[np.ndarray]:
        s, n, _, _, need = parts
        rolling = Rolling(np.frombuffer(data, np.uint8))
        part = np.repeat(np.arange(len(s)), n)
        at = s[part] - low + np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
        ends = [0, *(min(x, depth) for x in PASSES)]
        d = [rolling.span(at + i, at + j).view(np.int64) for i, j in pairwise(ends)]
        c = digests(data, at, at + depth)
        return [at + low, need[part], *d, c[:, 0], c[:, 1]]

    return _each(rows, _SUFFIX, make)


def settle(rows: DataFrame) -> DataFrame:
    """Rows of groups of at least two, with ``repeated`` and, for those that go on, ``on``.

    ``need`` is false for counterparts, whose own result is known.
    """
    rows = rows.withColumn("_r", F.xxhash64("a", "b", "s"))
    alike = rows.groupBy("key", "c1", "c2").agg(F.count("*").alias("same"), F.min("_r").alias("stand_in"))
    groups = alike.groupBy("key").agg(F.sum("same").alias("all"), F.count("*").alias("kinds")).filter("all > 1")
    met = alike.join(groups.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select(
        *[F.col(x).alias(f"_{x}") for x in ("key", "c1", "c2")], "same", "stand_in", "kinds"
    )
    found = rows.join(met, (F.col("key") == F.col("_key")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")))
    found = found.withColumn("repeated", F.col("need") & (F.col("same") > 1))
    found = found.withColumn("on", (F.col("kinds") > 1) & ((F.col("same") == 1) | (F.col("_r") == F.col("stand_in"))))
    found = found.withColumn("need", F.col("need") & (F.col("same") == 1))
    return found.filter("repeated or on").select("a", "b", "s", "n", "p", "key", "need", "repeated", "on")


def radix(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """``(a, b, s, n)`` of the suffixes that need a result and stay equal to another through all digits."""
    by: list[str] = []
    for digit in (["d1"], ["d2"], ["c1", "c2"]):
        by += digit
        equal = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        before = rows
        rows = rows.join(equal.select(*[F.col(x).alias(f"_{x}") for x in by]), _same(by)).drop(*[f"_{x}" for x in by])
        rows = tmp.keep(rows, f"radix-{digit[0]}", fewer=3)
        tmp.drop(before)
    return rows.filter("need").select("a", "b", "s", F.lit(1).cast("long").alias("n"))


def _parts(found: DataFrame) -> DataFrame:
    """The parts of each piece that go on; no more than a piece has bytes."""
    part = F.struct("s", "n", "p", "key", "need")
    low = F.expr(f"s - s % {PIECE}").alias("low")
    return found.filter("on").groupBy("a", "b", low).agg(F.collect_list(part).alias("parts"))


def merged(spans: DataFrame, depth: int) -> DataFrame:
    """``(a, b, s, e)``: the bytes that spans ``(s, n)`` of windows cover, joined within pieces."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                s, n = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                s, e = join_spans(s, s + n + depth - 1)
                yield _batch([np.full(len(s), x.as_py(), np.int64) for x in (a, b)] + [s, e], "a long, b long, s long, e long")

    listed = spans.groupBy("a", "b", F.expr(f"s - s % {PIECE}").alias("low")).agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    return listed.select("a", "b", "spans").mapInArrow(run, "a long, b long, s long, e long")


def join_spans(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [s, e) in order, those that touch or overlap as one."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return s[new], e[np.append(new[1:], len(e)) - 1]


def removed(rows: DataFrame) -> DataFrame:
    """``(a, b, n_removed, n_spans, kept_sha256)`` of ``(a, b, text, spans)`` with spans ``(s, e)``."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode()
                s, e = join_spans(*(spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
                gone, at, digest = 0, 0, sha256()
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    digest.update(data[at:x])
                    at = y
                    gone += y - x
                digest.update(data[at:])
                out.append((gone, len(s), digest.hexdigest()))
            n, m, h = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(h, pa.string())],
                ["a", "b", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("a", "b", "text", "spans").mapInArrow(run, "a long, b long, n_removed long, n_spans long, kept_sha256 string")


def _same(names: list[str]) -> Column:
    return reduce(and_, [F.col(x) == F.col(f"_{x}") for x in names])


def repeated_spans(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(a, b, s, e)``: bytes s to e of a text are covered by windows that occur again; spans may touch."""
    tmp = Scratch()
    rows = tmp.keep(runs(docs, depth).withColumn("need", F.lit(True)), "runs")
    first = tmp.keep(settle(rows), "met1", fewer=3)
    tmp.drop(rows)
    keyed = docs.select(*_key(), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("cast(octet_length(data) as long)"), F.lit(PIECE).cast("long"))).alias("low")
    cut = F.expr(f"substring(data, cast(low + 1 as int), {PIECE + depth - 1})").alias("data")
    wanted = first.filter("on").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.expr(f"s - s % {PIECE}").alias("_low")).distinct()
    # Rows that repeat id and text stay apart here: all their runs are settled, and counterparts may be listed twice.
    pieces = keyed.select("a", "b", "data", low).join(wanted, _same(["a", "b", "low"]), "left_semi").select("a", "b", "low", cut)
    pieces = tmp.keep(pieces, "pieces", "zstd", fewer=3)
    rows = tmp.keep(blocks(pieces.join(_parts(first), ["a", "b", "low"]), depth, BLOCK), "blocks")
    second = tmp.keep(settle(rows), "met2", fewer=3)
    tmp.drop(rows)
    rows = tmp.keep(suffixes(pieces.join(_parts(second), ["a", "b", "low"]), depth), "suffixes")
    tmp.drop(pieces)
    last = radix(rows, tmp)
    spans = [x.filter("repeated").select("a", "b", "s", "n") for x in (first, second)]
    # Read by the result, so it stays.
    out = tmp.keep(merged(spans[0].union(spans[1]).union(last), depth), "spans", fewer=3)
    tmp.drop(first, second)
    return out


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_spans(docs, depth)
    listed = spans.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    plain = F.coalesce("text", F.lit(""))
    rows = docs.select(*_key(), F.col("doc_id").cast("long").alias("doc_id"), plain.alias("text"))
    cut = removed(rows.join(listed, _same(["a", "b"]))).distinct().withColumnRenamed("a", "_a").withColumnRenamed("b", "_b")
    rows = rows.select("a", "b", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_sha"))
    return rows.join(cut, _same(["a", "b"]), "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
