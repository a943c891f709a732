"""Near-duplicate classes by Order MinHash: candidates sensitive to edit similarity, verified by alignment.

A document is its sequence of white-space words.  Its shingles of five words, lower-cased and without marks at
their ends, carry an occurrence label (the first, second ... occurrence of the same words).  For each of
``BANDS`` hash functions the sketch takes the shingle with the smallest hash, or in the first ``PAIRED`` bands
the two smallest in text order; two documents are candidates where a whole band agrees.  Short texts, in which
an edit touches every shingle, also have keys of rare words that similar ones are sure to share.  Candidates are
linked when 1 - (word edit distance) / (longer length) of the same normalised words is 0.8 or more.  Lengths and
counts of words in ``BINS`` bins rule out most others before any text moves: similar texts share so many words
for certain.  The rest is verified by alignment: at once where a chain of common word triples already costs
little enough, else bit-parallel within the diagonal band that 0.8 allows.  Classes are the connected components
of links.

Equal texts are one representative first.  A bucket never emits all its pairs: each member is compared with the
bucket's leader, and where that leaves more than one component, with up to ``PEERS`` further leaders, in larger buckets
``CROWD_PEERS``, those with most links first, so the text that joins a group leads it.

What that leaves apart is settled exactly: of all texts that are in a larger bucket that still spans components, every pair of
two components that is similar is found.  Similar texts share so many triples of neighbouring words for certain that their
rarest ones have some in common; a text that shares as many with one of another component, or one that many texts of it have,
meets those, unless lengths, marks of words and bins rule them out.

Defined cases: null text is an empty text; texts of under five words have one shingle, all their words;
documents without words form one class per distinct text; very long texts are read whole, and one text at a time
is in a worker's hands; texts that only rows without id have are told apart by 64 bits, and their class has a null
id unless it holds a row with one; repeated rows stay in the result; rows that share an id count as one document;
ties of a class go to the smallest id; an empty table gives no rows; other columns pass through ``near_dedup``,
whatever their names.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm._util import Scratch, frugal, light, shared_dir, stored, table, texts, with_group

WORDS, SIMILARITY = 5, 0.8
#: Bands of two shingles, which see order, then bands of one: at scattered edits and similarity 0.8 a shingle is
#: shared with probability 0.2, so two texts meet in no band with probability 0.96 ** 8 * 0.8 ** 20, under 0.01.
PAIRED, BANDS = 8, 28
#: Texts of up to SHORT words also have a key for each RARE of their rarest words.
SHORT, RARE = 30, 3
#: Further leaders of a bucket that its members meet; a bucket of up to PEERS + 1 has all its pairs tested.
PEERS = 8
#: Further leaders of larger buckets, whose members also meet by sure keys.
CROWD_PEERS = 2
#: Bins of word counts; one byte each, and none of it where a count needs more.
BINS = 256
#: Words whose hashes a worker holds; few, as an executor runs several workers beside its heap.
CACHE = 100_000
#: Slots in which triples of neighbouring words are counted to put rare ones first: what shares a slot costs time and no link.
SLOTS = 1 << 24
#: Bytes of the texts they are counted in, about; the counts only order the triples, so others may stand for the rest.
COUNTED_BYTES = 1 << 26
#: Bytes of texts whose sure keys meet in one part, about.
PART_BYTES = 1 << 24
#: Rows and roots of a key that meet in a task, as a product; the rows of larger keys are joined.
KEY_PAIRS = 1 << 22
#: 64-bit words of the marks that a text's words leave; they travel with its keys, so there are fewer than bins.
MARKS = 8
#: Pairs whose marks are held against each other at once.
MARKED = 1 << 16
#: Texts of one root that have a key from which on another text meets the root as a whole, not each of them.
FEW = 64
#: Members of a root whose bins are held against another text's at once.
PACK = 16
#: Bytes of texts of one component that meet another text at once.
BLOCK_BYTES = 1 << 16
#: Texts that meet one block in one task, on average.
SENDERS = 1000
_MARKS = ".,;:!?\"'()[]{}*&%$#|-_/\\"
_SEEDS = np.random.default_rng(20240117).integers(1, 1 << 63, BANDS, dtype=np.uint64)
_ODD = np.random.default_rng(20240118).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WORDS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(_MARKS) or word)
        return h


_WORDS = _Words()


def hashed(text: str) -> np.ndarray:
    """Hashes of the normalised words."""
    words = text.split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of ``words`` hashed words in text order, occurrence labels mixed in."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - words + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        grams += h[i : i + n] * _POWERS[i]
    grams = _mix(grams)
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if same.any():
        order = np.argsort(grams, kind="stable")
        same, at = np.append(False, same), np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        grams = np.where(label > 0, _mix(grams + label * np.uint64(0xD6E8FEB86659FD93)), grams)
    return grams


def sketch(grams: np.ndarray) -> list[int | None]:
    """A signed 64-bit sketch for each band; None where there is no shingle."""
    if not len(grams):
        return [None] * BANDS
    # Shingles are mixed hashes, so an odd multiple orders them as well as another hash would.
    hashes = (grams[None, :] ^ _SEEDS[:, None]) * _ODD[:, None]
    at = hashes.argmin(axis=1)
    out = _mix(_SEEDS * np.uint64(0x9FB21C651E98DF25) + grams[at])
    if len(grams) > 1:
        # Equal hashes cannot be in one document: labels make shingles distinct and odd multiples are one to one.
        pairs = np.repeat(at[:PAIRED, None], 2, axis=1)
        hashes[np.arange(PAIRED), at[:PAIRED]] = np.iinfo(np.uint64).max
        pairs[:, 1] = hashes[:PAIRED].argmin(axis=1)
        pairs.sort(axis=1)
        out[:PAIRED] = _mix(_SEEDS[:PAIRED] * np.uint64(0x9FB21C651E98DF25) + grams[pairs[:, 0]])
        out[:PAIRED] = _mix(out[:PAIRED] * np.uint64(0x9FB21C651E98DF25) + grams[pairs[:, 1]])
    return out.view(np.int64).tolist()


def short_keys(text: str) -> list[int]:
    """Keys of a short text; two texts of up to ``SHORT`` words that are similar share one for certain.

    Texts of n words or more that are similar share all but n / 5 words of the shorter.  So, in any one order of
    words, their first n / 5 + RARE words (with occurrence labels) have RARE in common.
    """
    words = text.split()
    # Under five words no edit is allowed, and the one shingle of both is the same.
    if not WORDS <= len(words) <= SHORT:
        return []
    seen: dict = {}
    labelled = []
    for w in words:
        h = _WORDS[w]
        seen[h] = seen.get(h, 0) + 1
        # Repeated and long words first, which are likely to be rare.
        labelled.append((-seen[h], -len(w.lower().strip(_MARKS) or w), h))
    first = sorted(labelled)[: int((1 - SIMILARITY) * len(words) + 1e-9) + RARE]
    return [xxhash.xxh3_64_intdigest(repr(c)) - (1 << 63) for c in itertools.combinations(first, RARE)]


def banded_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two sequences, or ``limit`` + 1 if it is more, by bit-parallel columns.

    Column j holds the rows of ``a`` within ``limit`` of the diagonal, one bit a row, and slides down one
    row with each item of ``b``.
    """
    if len(a) < len(b):
        a, b = b, a
    lo, hi = 0, len(b)
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    cut = 0
    while cut < hi - lo and a[len(a) - 1 - cut] == b[len(b) - 1 - cut]:
        cut += 1
    a, b = a[lo : len(a) - cut], b[lo : len(b) - cut]
    m, n = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if not n:
        return m
    limit = min(limit, m)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # Bit k of column j (from 1) is row j - limit + k of a, rows counted from 1; bit 2 * limit is the lowest.
    width = 2 * limit + 1
    mask = (1 << width) - 1
    # Rows above the matrix have vertical steps of 0, those of column 0 steps of +1.
    up, down = (mask >> limit + 1) << limit + 1, 0
    up &= mask
    # Score of the band's lowest row, which in column 0 is row `limit`.
    score, shift = limit, -limit - 1
    # In column 0, bit k stands for row k - limit: those with rows 1..limit step by +1.
    for j in range(1, n + 1):
        # The column slides: bit k of the new column is bit k + 1 of the old.
        up >>= 1
        down >>= 1
        shift += 1  # row j - limit is item j - limit - 1 of a
        bits = where.get(b[j - 1], 0)
        match = (bits >> shift if shift >= 0 else bits << -shift) & mask
        zero = ((((match & up) + up) ^ up) | match | down) & mask
        plus = down | ~(zero | up) & mask
        minus = zero & up
        # The lowest row is new to the band; its cell is one above-left plus a diagonal step.
        score += not zero >> width - 1 & 1
        plus = plus << 1 & mask
        minus = minus << 1 & mask
        top = j - limit
        if top <= 1:  # the row above the first one of a grows by one each column
            plus |= 1 << max(0, 1 - top)
            above = (1 << max(0, 1 - top)) - 1
        else:
            above = 0
        up = (minus | ~(zero | plus)) & mask
        down = plus & zero
        up, down = up & ~above, down & ~above
    # Walk up from the lowest row of the last column to row m.
    row, k = n + limit, width - 1
    while row > m:
        score -= (up >> k & 1) - (down >> k & 1)
        row, k = row - 1, k - 1
    return min(score, limit + 1)


_TRIPLE = np.array([pow(0xC2B2AE3D27D4EB4F, i, 1 << 64) for i in (1, 2, 3)], np.uint64)


def chained_distance(x: np.ndarray, y: np.ndarray) -> int:
    """The cost of one alignment, at least the edit distance: along common triples of items whose order agrees."""
    if min(len(x), len(y)) < 3:
        return max(len(x), len(y))
    x3, y3 = (_mix(v[:-2] * _TRIPLE[0] + v[1:-1] * _TRIPLE[1] + v[2:] * _TRIPLE[2]) for v in (x, y))
    _, i, j = np.intersect1d(x3, y3, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    ahead = j > np.maximum.accumulate(np.append(-1, j[:-1])) if len(j) else np.empty(0, bool)
    i, j = np.append(i[ahead], len(x)), np.append(j[ahead], len(y))
    di, dj = np.diff(i), np.diff(j)
    # From one triple to the next as many items match as both sides have, three at most; the rest counts in full.
    return int(max(i[0], j[0]) + (np.maximum(di, dj) - np.minimum(3, np.minimum(di, dj))).sum())


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether word edit similarity is ``least`` or more, of the words the shingles are made of: lower-cased, without marks at their ends."""
    x, y = hashed(a), hashed(b)
    return near(x, y, least) if len(x) or len(y) else a == b


def triples_needed(n: np.ndarray | int, m: np.ndarray | int, least: float = SIMILARITY) -> np.ndarray:
    """How many triples of neighbours similar texts of n and m words share at least: an edit touches three at most."""
    longer = np.maximum(n, m)
    return longer - 2 - 3 * ((1 - least) * longer + 1e-9).astype(np.int64)


class Triples:
    """Which of some hashed texts share how many triples of neighbouring words with another one."""

    def __init__(self, words: list[np.ndarray]):
        grams = [shingles(h, 3) for h in words]
        of = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        order = np.argsort(found := np.concatenate([*grams, np.empty(0, np.uint64)]))
        self.grams, self.of, self.n = found[order], of[order], len(words)

    def shared(self, h: np.ndarray) -> np.ndarray:
        grams = shingles(h, 3)
        lo = np.searchsorted(self.grams, grams)
        at, place = _each(np.searchsorted(self.grams, grams, "right") - lo)
        return np.bincount(self.of[lo[at] + place], minlength=self.n)


def near(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """``similar`` of hashed words, one at least."""
    longer = max(len(x), len(y))
    limit = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > limit:
        return False
    if chained_distance(x, y) <= limit:
        return True
    # An edit touches three triples of neighbours at most.
    shared = longer - 2 - 3 * limit
    if shared > 0 and len(np.intersect1d(shingles(x, 3), shingles(y, 3), assume_unique=True)) < shared:
        return False
    x, y = x.tolist(), y.tolist()
    common = sum((Counter(x) & Counter(y)).values())
    return common >= longer - limit and banded_distance(x, y, limit) <= limit


def bins(h: np.ndarray) -> bytes | None:
    """How many of the hashed words fall in each bin."""
    n = np.bincount((h & np.uint64(BINS - 1)).astype(np.uint8), minlength=BINS)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else None


def may_be_similar(n: np.ndarray, m: np.ndarray, a: list[bytes | None], b: list[bytes | None], least: float = SIMILARITY) -> np.ndarray:
    """False where lengths n and m or the words that bins a and b can share at most rule similarity out."""
    longer = np.maximum(n, m)
    limit = ((1 - least) * longer + 1e-9).astype(np.int64)
    ok = longer - np.minimum(n, m) <= limit
    full = bytes([255]) * BINS
    x, y = (np.frombuffer(b"".join([v or full for v in c]), np.uint8).reshape(-1, BINS) for c in (a, b))
    # Where one text has no bins, those of the other are what both can share at most.
    return ok & (np.minimum(x, y).sum(1, dtype=np.int64) >= np.minimum(longer - limit, 255 * BINS))


def marks(h: np.ndarray) -> np.ndarray:
    """A bit for each of the hashed words, other ones than those that tell its bin, in ``MARKS`` unsigned long integers."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[(h >> np.uint64(16)) % np.uint64(64 * MARKS)] = 1
    return np.packbits(bits).view(np.uint64)


def marks_allow(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """False where more words, told by marks a and b, are in one text of lengths n and m alone than there may be edits.

    Each distinct word that the other text lacks takes an edit, and each mark that it lacks is of another word.
    """
    limit = ((1 - least) * np.maximum(n, m) + 1e-9).astype(np.int64)
    alone = [np.bitwise_count(x & ~y).sum(1, dtype=np.int64) for x, y in ((a, b), (b, a))]
    return np.maximum(*alone) <= limit


def sure_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Triples of neighbouring words, rare ones by ``counts`` first, so many that two similar texts have ``keys_shared`` in common.

    With d edits and the longer text's m words, both share all but 3 d of the m - 2 triples, labelled by occurrence.  Of five
    words one edit may touch all, so texts of four or five have their pairs of neighbours too.  Any counts keep this true.
    """
    grams = shingles(h, 3)
    spare = triples_shared(len(h)) - keys_shared(len(h))
    if spare > 0:
        rank = (counts[slots(grams)].astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16))
        grams = grams[rank <= np.partition(rank, len(grams) - 1 - spare)[len(grams) - 1 - spare]]
    elif 4 <= len(h) <= 5:
        grams = np.append(grams, shingles(h, 2))
    return grams.view(np.int64)


def triples_shared(n: np.ndarray | int) -> np.ndarray:
    """How many triples a text of n words shares with any similar one that is no shorter, at least; it may be below 0."""
    longer = np.expand_dims(n, -1) + np.arange(5)  # from five words more on, more is shared
    return (longer - 2 - 3 * ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)).min(-1)


def keys_shared(n: np.ndarray | int) -> np.ndarray:
    """How many sure keys similar texts share for certain, the lesser of what the words n of either say."""
    return np.maximum(1, np.minimum(triples_shared(n), np.asarray(n) // 10))


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(SLOTS - 1)).astype(np.int64)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The id, or 64 bits of the text where there is none."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def members(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, node, sketch, n, bins)``: a node is a distinct text, named by the smallest key of its rows."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(2).to_pylist()
            words = [hashed(t) for t in data]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([xxhash.xxh3_128_digest(t) for t in data], pa.binary()),
                    pa.array([sketch(shingles(h)) + short_keys(t) for h, t in zip(words, data, strict=True)], pa.list_(pa.int64())),
                    pa.array([len(h) for h in words], pa.int64()),
                    pa.array([bins(h) for h in words], pa.binary()),
                ],
                ["doc_id", "key", "content", "sketch", "n", "bins"],
            )

    rows = texts(docs).select("doc_id", row_key().alias("key"), "text")
    made = stored(rows.mapInArrow(run, "doc_id long, key long, content binary, sketch array<long>, n long, bins binary"), "sketches")
    groups = stored(made.groupBy("content").agg(F.min("key").alias("node"), F.count("*").alias("copies")).filter("copies > 1"), "contents")
    named = with_group(made.select("doc_id", "key", "content"), groups, "content", "copies", made.count())
    return named.select("doc_id", "key", "content", F.coalesce("node", "key").alias("node")), made


def _possible(pairs: DataFrame) -> DataFrame:
    """Of ``(node, leader, n, m, bins, leader_bins)``, the pairs that lengths and bins do not rule out."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keep = may_be_similar(n, m, b.column(4).to_pylist(), b.column(5).to_pylist())
            yield b.select(["node", "leader"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("node", "leader", "n", "m", "bins", "leader_bins").mapInArrow(run, "node long, leader long")


def _verified(pairs: DataFrame) -> DataFrame:
    """Of ``(node, leader, text, leader_text)``, the pairs that are similar."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["node", "leader"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("node", "leader", "text", "leader_text").mapInArrow(run, "node long, leader long")


def _near_length(n: str, m: str) -> Column:
    """What similar texts' numbers of words are for certain."""
    return F.greatest(n, m) - F.least(n, m) <= F.greatest(n, m) * F.lit(1 - SIMILARITY) + F.lit(1e-9)


def _met(sketches: DataFrame) -> DataFrame:
    """``(node, band, key, leader, n, m)`` of nodes that share a bucket with another, leaders aside; n and m are their words."""
    rows = sketches.select("node", "n", F.posexplode("sketch").alias("band", "key")).filter("key is not null")
    # Short texts' keys, in any place after the bands, are of one kind.
    rows = rows.withColumn("band", F.least("band", F.lit(BANDS)))
    # Which member leads changes with the bucket, so chains of likeness are met from several sides.
    turn = F.col("key")
    leaders = (
        rows.groupBy("band", "key")
        .agg(F.min(F.col("node").bitwiseXOR(turn)).alias("first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.col("first").bitwiseXOR(turn).alias("leader"))
    )
    leaders = leaders.join(sketches.select(F.col("node").alias("leader"), F.col("n").alias("m")), "leader")
    met = rows.join(leaders, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")))
    return met.filter("node <> leader").select("node", "band", "key", "leader", "n", "m")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: one node of each connected component, for linked nodes.

    Labels stand for most of a component; the few links across labels are then followed: each round every root hooks onto the smallest root next to it, and nodes follow two hooks at once; roots only
    get smaller, so rounds end when no link joins two roots.  Tables written per round keep the lineage short.
    """
    tmp = Scratch()
    named = _labels(links, tmp)
    ends = light(named)
    across = links.join(ends.select("node", F.col("label").alias("a")), "node").join(ends.select(F.col("node").alias("leader"), F.col("label").alias("b")), "leader")
    edges = tmp.keep(across.filter("a <> b").select("a", "b").distinct(), "links", fewer=16)
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    before = None
    while True:
        label = tmp.keep(label, "roots", fewer=16)
        if before is not None:
            tmp.drop(*before)
        known = light(label)
        a = known.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = known.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        hooks = across.select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hooks = tmp.keep(hooks, "hooks", fewer=16)
        if hooks.isEmpty():
            tmp.drop(edges, hooks)
            return named.join(label.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("root"))
        before = label, hooks
        on = light(hooks).select(F.col("root").alias("to"), F.col("to").alias("further"))
        label = label.join(light(hooks.join(on, "to", "left").select("root", F.coalesce("further", "to").alias("to"))), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _one_text(rows: DataFrame) -> DataFrame:
    """A row for each node, also where rows repeat an id; of several texts under one id the smallest stands for all."""
    return rows.groupBy("node").agg(F.min("text").alias("text"))


def _labels(links: DataFrame, tmp: Scratch) -> DataFrame:
    """``(node, label, degree)`` of linked nodes; equal labels mean one component, unequal ones hardly ever mean the same.

    A node knows its least and its greatest neighbour; it takes the least node next to either, then that one's label.
    """
    ways = links.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    ways = ways.union(ways.select("b", "a"))
    base = ways.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("low"), F.max("b").alias("high"), F.count("*").alias("degree"))
    base = tmp.keep(base, "neighbours", fewer=16)
    known = light(base)
    low, high = (known.select(F.col("node").alias(x), F.col("low").alias(f"_{x}")) for x in ("low", "high"))
    label = base.join(low, "low").join(high, "high").select("node", F.least("low", "_low", "_high").alias("near"), "degree")
    label = tmp.keep(label, "labels", fewer=16)
    further = light(label).select(F.col("node").alias("near"), F.col("near").alias("label"))
    out = tmp.keep(label.join(further, "near").select("node", "label", "degree"), "labels", fewer=16)
    tmp.drop(base, label)
    return out


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(band, key, n)`` of buckets of three or more whose members carry more than one label."""
    named = members.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    buckets = named.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return buckets.filter("n > 2 and lo < hi").select("band", "key", "n")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, leader)`` that no chain of links joins yet."""
    ends = labels.select(F.col("node").alias("leader"), F.col("label").alias("_l"))
    both = pairs.join(labels.select("node", "label"), "node", "left").join(ends, "leader", "left")
    return both.filter(F.coalesce("label", "node") != F.coalesce("_l", "leader")).select("node", "leader")


def _peer_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of members of one bucket and its further leaders that no link joins yet: first those with most links.

    In a crowd only texts with links lead: one without is no likelier to match than the leader was, and meets its like
    by other shingles.
    """
    known = members.join(labels, "node", "left")
    known = known.select("node", "words", "band", "key", "led", "n", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
    place = F.row_number().over(Window.partitionBy("band", "key").orderBy(F.desc("degree"), F.col("node").bitwiseXOR(F.col("key"))))
    peers = known.filter(f"not led and (n <= {PEERS + 1} or degree > 0)").withColumn("place", place).filter(F.col("place") <= PEERS)
    peers = peers.filter((F.col("n") <= PEERS + 1) | (F.col("place") <= CROWD_PEERS))
    peers = peers.select("band", "key", F.col("node").alias("peer"), F.col("words").alias("m"), F.col("label").alias("_label"))
    met = known.filter("not led").join(peers, ["band", "key"]).filter("node <> peer and label <> _label").filter(_near_length("words", "m"))
    return met.select(F.greatest("node", "peer").alias("node"), F.least("node", "peer").alias("leader")).distinct()


def _slot_counts(rows: DataFrame) -> DataFrame:
    """``(slot, n)``: how many triples of neighbouring words of ``text`` fall in each slot."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting = [slots(shingles(hashed(t), 3)) for t in b.column(0).to_pylist()]
            slot, n = np.unique(np.concatenate([*waiting, np.empty(0, np.int64)]), return_counts=True)
            for at in range(0, len(slot), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(slot[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["slot", "n"])

    return rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")


_COUNTS: dict[str, np.ndarray] = {}


def _counts(folder: str) -> np.ndarray:
    """The worker's copy of stored slot counts, one where none is stored."""
    if folder not in _COUNTS:
        files, root = pafs.FileSystem.from_uri(folder)
        out = np.ones(SLOTS, np.uint8)
        for x in files.get_file_info(pafs.FileSelector(root)):
            if x.base_name.endswith(".parquet"):
                with files.open_input_file(x.path) as f:
                    rows = pq.read_table(f)
                out[rows["slot"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 255)
        _COUNTS.clear()
        _COUNTS[folder] = out
    return _COUNTS[folder]


def _dealt_keys(rows: DataFrame, folder: str, parts: int) -> DataFrame:
    """``(part, who, marked, keys)``: the sure keys of ``(node, root, bytes, text)`` by part of the keys, those of many texts in one row.

    ``who`` holds node, root, bytes of the root, words and number of keys of each text, ``marked`` its marks.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(folder)
        for b in batches:
            words = [hashed(t) for t in b.column(3).to_pylist()]
            made = [sure_keys(h, counts).view(np.uint64) for h in words]
            of = np.repeat(np.arange(len(made)), [len(k) for k in made])
            keys = np.concatenate([*made, np.empty(0, np.uint64)])
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, of, ends = keys[order], of[order], np.searchsorted(part[order], np.arange(parts + 1))
            marked = np.array([marks(h) for h in words], np.uint64).reshape(-1, MARKS)
            texts = np.stack([b.column(i).to_numpy() for i in range(3)] + [np.array([len(h) for h in words], np.int64)])
            out = []
            for k in np.flatnonzero(np.diff(ends)).tolist():
                here, n = np.unique(of[ends[k] : ends[k + 1]], return_counts=True)
                out.append((k, np.vstack((texts[:, here], n)).tobytes(), marked[here].tobytes(), keys[ends[k] : ends[k + 1]].tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "who", "marked", "keys"])

    return rows.select("node", "root", "bytes", "text").mapInArrow(run, "part long, who binary, marked binary, keys binary")


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where ``new`` is true."""
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def roots_met(who: np.ndarray, keys: np.ndarray, marked: np.ndarray | None = None) -> Iterator[list[np.ndarray | None]]:
    """``[key, node, root, bytes, n, other, leader]`` for keys of more than one root, where lengths allow it and the node's own root
    has fewer bytes than the other one: the node and each text of the other root that has its key, if marks allow it, or if they
    are more than ``FEW`` that root, once; of keys whose rows are too many, the rows as they are, without other and leader.  For two texts,
    key is the number of keys they share here, and n how many similar ones share in all.

    ``who`` has the columns of ``_dealt_keys``, ``keys`` theirs one after the other, ``marked`` a row of marks for each text.
    """
    node, root, size, n, many = who
    of, order = np.repeat(np.arange(len(node)), many), np.argsort(keys)
    keys, of = keys[order], of[order]
    same = keys[1:] == keys[:-1]
    twice = np.append(same, False) | np.append(False, same)
    keys, of = keys[twice], of[twice]
    if not len(keys):
        return
    names, rank = np.unique(root, return_inverse=True)
    order = np.lexsort((rank[of], keys))
    keys, of = keys[order], of[order]
    key_new = np.append(True, keys[1:] != keys[:-1])
    key_of = np.cumsum(key_new) - 1
    entries, held = _runs(key_new | np.append(True, rank[of][1:] != rank[of][:-1]))
    least, most = np.minimum.reduceat(n[of], entries), np.maximum.reduceat(n[of], entries)
    first, roots = _runs(key_new[entries])
    crowd = (np.bincount(key_of) * roots > KEY_PAIRS)[key_of]
    if crowd.any():
        i = of[crowd]
        yield [keys[crowd].view(np.int64), node[i], root[i], size[i], n[i], None, None]
    asks = np.flatnonzero(~crowd & (roots[key_of] > 1))
    one, whole = [np.empty((2, 0), np.int64)], [np.empty(0, np.int64)]
    for lo, hi in _shares(roots[key_of[asks]]):
        ask, place = _each(roots[key_of[asks[lo:hi]]])
        ask = asks[lo:hi][ask]
        entry = first[key_of[ask]] + place
        mine, other = of[ask], of[entries[entry]]
        a, b = size[mine], size[other]
        ok = ((a < b) | (a == b) & (rank[mine] < rank[other])) & _may_be_near(n[mine], least[entry], most[entry])
        mine, entry, other = mine[ok], entry[ok], other[ok]
        few = held[entry] <= FEW
        whole.append(np.unique(mine[~few] * len(names) + rank[other[~few]]))
        mine, entry = mine[few], entry[few]
        for a, b in _shares(held[entry]):
            at, place = _each(held[entry[a:b]])
            x, y = mine[a:b][at], of[entries[entry[a:b]][at] + place]
            ok = _may_be_near(n[x], n[y], n[y])
            pairs, times = np.unique(x[ok] * len(node) + y[ok], return_counts=True)
            for at in range(0, len(pairs), MARKED):
                x, y = np.divmod(pairs[at : at + MARKED], len(node))
                ok = slice(None) if marked is None else marks_allow(n[x], n[y], marked[x], marked[y])
                one.append(np.stack((pairs[at : at + MARKED][ok], times[at : at + MARKED][ok])))
    pairs, times = np.concatenate(one, axis=1)
    pairs, which = np.unique(pairs, return_inverse=True)
    i, j = np.divmod(pairs, len(node))
    yield [np.bincount(which, times, len(pairs)).astype(np.int64), node[i], root[i], size[i], keys_shared(np.minimum(n[i], n[j])), None, node[j]]
    i, j = np.divmod(np.unique(np.concatenate(whole)), len(names))
    yield [np.zeros(len(i), np.int64), node[i], root[i], size[i], n[i], names[j], None]


def _shares(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``many`` with a sum of about ``KEY_PAIRS``."""
    total = np.cumsum(many)
    cuts = np.searchsorted(total, np.arange(0, total[-1], KEY_PAIRS)) if len(total) else []
    return itertools.pairwise(np.unique(np.append(cuts, len(many)).astype(np.int64)).tolist())


def _each(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``many``, and the how manieth of it, for all of their sum."""
    at = np.repeat(np.arange(len(many)), many)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)


def _may_be_near(n: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether similar texts may have n words and from ``least`` to ``most``."""
    m = np.clip(n, least, most)
    return np.abs(n - m) <= np.maximum(n, m) * (1 - SIMILARITY) + 1e-9


def _met_roots(dealt: DataFrame) -> DataFrame:
    """``roots_met`` of the rows of ``_dealt_keys``, part by part."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "root", "bytes", "n", "other", "leader"]

        def met(rows: list) -> Iterator[pa.RecordBatch]:
            who = np.concatenate([np.frombuffer(x, np.int64).reshape(5, -1) for x, _, _ in rows], axis=1)
            marked = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, MARKS) for _, x, _ in rows])
            for cols in roots_met(who, np.concatenate([np.frombuffer(x, np.uint64) for _, _, x in rows]), marked):
                for at in range(0, len(cols[0]), 100_000):
                    n = len(cols[0][at : at + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c[at : at + n]) for c in cols], names)

        rows, held = [], None
        for b in batches:
            for part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and part != held:
                    yield from met(rows)
                    rows = []
                held = part
                rows.append(row)
        if rows:
            yield from met(rows)

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, node long, root long, bytes long, n long, other long, leader long")


def _by_bins(asked: DataFrame) -> DataFrame:
    """``(node, other)`` where lengths and bins do not rule out all of ``them``, of ``(node, other, n, bins, them)``."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                them = b.column(4).flatten()
                of = np.repeat(np.arange(len(b)), b.column(4).value_lengths().to_numpy())
                n, mine = b.column(2).to_numpy()[of], b.column(3).take(pa.array(of)).to_pylist()
                may = may_be_similar(n, them.field("n").to_numpy(), mine, them.field("bins").to_pylist())
                yield b.select(["node", "other"]).take(pa.array(np.unique(of[may])))

    return asked.select("node", "other", "n", "bins", "them").mapInArrow(run, "node long, other long")


def _near_blocks(rows: DataFrame) -> DataFrame:
    """``(node, leader)``: a similar member, if there is one, for each sender of ``(root, block, part, sends, node, text)``, members first."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, words, known, triples = None, [], [], [], None
        for b in batches:
            places = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            found = []
            for here, sends, node, text in zip(places, *(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                if here != held:
                    held, nodes, words, known, triples = here, [], [], [], None
                h = hashed(text)
                if not sends:
                    nodes.append(node)
                    words.append(h)
                    known.append(bins(h))
                    continue
                n = np.array([len(w) for w in words], np.int64)
                may = may_be_similar(np.full(len(n), len(h)), n, [bins(h)] * len(n), known) if len(n) and len(h) else n
                if may.any():
                    triples = triples or Triples(words)
                    may = may.astype(bool) & (triples.shared(h) >= triples_needed(n, len(h)))
                hit = next((nodes[k] for k in np.flatnonzero(may).tolist() if near(h, words[k])), None)
                if hit is not None:
                    found.append((node, hit))
            ends = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(ends, ["node", "leader"])

    return rows.select("root", "block", "part", "sends", "node", "text").mapInArrow(run, "node long, leader long")


def across_links(known: DataFrame, narrow: DataFrame, tmp: Scratch) -> DataFrame:
    """``(node, leader)`` of the stored ``(node, root, text)``: a link, if there is one, of each text to each other root that it is similar to.

    Of two roots, the one with fewer bytes sends its texts to the other, if ``(node, n, bins)`` of ``narrow`` allow it.
    """
    sizes = known.groupBy("root").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("members"))
    sizes = tmp.keep(sizes, "sizes", fewer=16)
    total = sizes.agg(F.sum("bytes")).first()[0]
    counts = tmp.keep(_slot_counts(known.filter(F.pmod(F.xxhash64("node"), F.lit(total // COUNTED_BYTES + 1)) == 0)), "slots", fewer=16)
    parts = max(2 * 12, total // PART_BYTES)
    met = tmp.keep(_met_roots(_dealt_keys(known.join(light(sizes), "root"), counts._scratch, parts)), "met-roots", fewer=3)
    ends = tmp.keep(light(known.select("node", "root")).join(narrow, "node"), "ends", fewer=3)
    leader = ends.select(F.col("node").alias("leader"), F.col("n").alias("m"), F.col("bins").alias("leader_bins"))
    shared = met.filter("leader is not null").groupBy("node", "leader").agg(F.sum("key").alias("shared"), F.min("n").alias("least"))
    pairs = tmp.keep(shared.filter("shared >= least").select("node", "leader"), "pairs", fewer=16)
    pairs = tmp.keep(_possible(light(pairs, 16).join(ends, "node").join(leader, "leader")), "possible", fewer=16)
    text = known.select("node", "text")
    led = light(pairs.select(F.col("leader").alias("node")).distinct(), 8).join(text, "node").select(F.col("node").alias("leader"), F.col("text").alias("leader_text"))
    found = _verified(light(pairs, 16).join(text, "node").join(led, "leader").repartition("node", "leader"))
    wanted, crowd = met.filter("other is not null").select("node", "other"), met.filter("other is null and leader is null")
    if not crowd.isEmpty():
        others = crowd.groupBy("key", F.col("root").alias("_root")).agg(F.first("bytes").alias("_bytes"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        fewer = (F.col("bytes") < F.col("_bytes")) | (F.col("bytes") == F.col("_bytes")) & (F.col("root") < F.col("_root"))
        m = F.greatest("lo", F.least("n", "hi"))
        near_length = F.abs(F.col("n") - m) <= F.greatest("n", m) * F.lit(1 - SIMILARITY) + F.lit(1e-9)
        wanted = wanted.union(crowd.join(others, "key").filter(fewer & near_length).select("node", F.col("_root").alias("other")))
    wanted = tmp.keep(wanted.distinct(), "wanted", fewer=3)
    tmp.drop(counts, met)
    if wanted.isEmpty():
        return found
    packs = ends.join(light(wanted.select(F.col("other").alias("root")).distinct()), "root", "left_semi").join(light(sizes), "root")
    packs = packs.groupBy(F.col("root").alias("other"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / PACK)).alias("pack"))
    packs = tmp.keep(packs.agg(F.collect_list(F.struct("n", "bins")).alias("them")), "packs", fewer=3)
    asked = wanted.join(packs, "other").join(ends.select("node", "n", "bins"), "node")
    before, wanted = wanted, tmp.keep(_by_bins(asked).distinct(), "wanted", fewer=16)
    tmp.drop(before, ends, packs)
    deal = wanted.groupBy(F.col("other").alias("root")).agg(F.count("*").alias("n")).join(sizes, "root")
    deal = tmp.keep(deal.select("root", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("blocks"), F.ceil(F.col("n") / SENDERS).alias("parts")), "deal", fewer=16)
    every, one = (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))), (lambda n: F.pmod(F.xxhash64("node"), F.col(n)))
    members = known.join(deal, "root").select("root", one("blocks").alias("block"), every("parts").alias("part"), F.lit(False).alias("sends"), "node", "text")
    senders = wanted.withColumnRenamed("other", "root").join(deal, "root").join(known.select("node", "text"), "node")
    senders = senders.select("root", every("blocks").alias("block"), one("parts").alias("part"), F.lit(True).alias("sends"), "node", "text")
    place = ["root", "block", "part"]
    # In so many tasks also where there are few bytes: each text may be aligned with a whole block.
    spread = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.union(_near_blocks(members.union(senders).repartition(spread, *place).sortWithinPartitions(*place, "sends")))


def near_links(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(node, leader)``: verified links between nodes, from ``(node, sketch, n, bins)`` of each.

    Links join what is similar; pairs that other links already join are not verified again.
    """
    spark, tmp = docs.sparkSession, Scratch()
    folder = shared_dir(spark, "links")
    narrow = sketches.select("node", "n", "bins")
    met, made = tmp.keep(_met(sketches), "met", fewer=3), 0

    def links() -> DataFrame:
        return spark.read.schema("node long, leader long").option("recursiveFileLookup", "true").parquet(folder)

    def tasks(pairs: DataFrame, each: int) -> int:
        """Tasks for so many pairs, no more than a shuffle has."""
        return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 12 + pairs.count() // each)

    def side(pairs: DataFrame, table: DataFrame, end: str) -> DataFrame:
        """What ``table`` knows of the nodes that are an ``end`` of the pairs; few pairs go to the table."""
        wanted = tmp.keep(pairs.select(F.col(end).alias("node")).distinct(), "ends", fewer=16)
        return light(wanted, 8).join(table, "node")

    def possible(pairs: DataFrame) -> DataFrame:
        pairs = tmp.keep(pairs, "pairs", fewer=16)
        leader = side(pairs, narrow, "leader").select(F.col("node").alias("leader"), F.col("n").alias("m"), F.col("bins").alias("leader_bins"))
        both = light(pairs, 16).join(narrow, "node").join(leader, "leader")
        out = tmp.keep(_possible(both.coalesce(tasks(pairs, 5000))), "possible", fewer=16)
        tmp.drop(pairs)
        return out

    def verify(pairs: DataFrame) -> None:
        """Add the similar ones of the stored ``(node, leader)`` to the links."""
        nonlocal made
        leader = side(pairs, text, "leader").select(F.col("node").alias("leader"), F.col("text").alias("leader_text"))
        both = light(pairs, 16).join(text.select("node", "text"), "node").join(leader, "leader")
        stored(_verified(both.coalesce(tasks(pairs, 200))), "links", path=f"{folder}/{made}")
        made += 1

    if met.isEmpty():
        return spark.createDataFrame([], "node long, leader long")
    wanted = met.select(F.col("node").alias("_n")).union(met.select("leader")).distinct()
    keyed = texts(docs).select(row_key().alias("node"), "text")
    text = tmp.keep(_one_text(keyed.join(wanted, F.col("node") == F.col("_n"), "left_semi")), "candidates", "zstd")
    pairs = possible(met.filter(_near_length("n", "m")).select("node", "leader").distinct())
    # One leader for each node first; most other pairs are joined by then.
    verify(tmp.keep(pairs.groupBy("node").agg(F.min("leader").alias("leader")), "first", fewer=16))
    labels = _labels(links(), tmp)
    rest = tmp.keep(_apart(pairs, light(labels)), "rest", fewer=16)
    if not rest.isEmpty():
        verify(rest)
        tmp.drop(labels)
        labels = _labels(links(), tmp)
    tmp.drop(rest, pairs)
    led = met.select(F.col("leader").alias("node"), F.col("m").alias("words"), "band", "key").distinct().withColumn("led", F.lit(True))
    everyone = met.select("node", F.col("n").alias("words"), "band", "key").withColumn("led", F.lit(False)).union(led)
    members = tmp.keep(everyone.join(_mixed(everyone, light(labels)), ["band", "key"]), "members", fewer=3)
    tmp.drop(met)
    # Whoever matched the leader stays: the text that joins a group is often like members that failed.
    peers = possible(_peer_pairs(members, light(labels)))
    if not peers.isEmpty():
        verify(peers)
        tmp.drop(labels)
        labels = _labels(links(), tmp)
    # Up to PEERS beside the leader have all met; more share too common a text and are told apart by sure keys.
    crowd = members.filter(F.col("n") > PEERS + 1).drop("n")
    crowded = crowd.join(_mixed(crowd, light(labels)).drop("n"), ["band", "key"], "left_semi").select("node").distinct()
    crowded = tmp.keep(crowded, "crowded", fewer=16)
    tmp.drop(members, labels, peers)
    if not crowded.isEmpty():
        roots = tmp.keep(components(links()), "roots", fewer=16)
        known = light(crowded, 8).join(text, "node").join(light(roots), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "text")
        known = tmp.keep(known.coalesce(tasks(crowded, 500)), "crowded", "zstd")
        stored(across_links(known, narrow, tmp), "links", path=f"{folder}/{made}")
        tmp.drop(roots, known)
    tmp.drop(text, crowded)
    return links()


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of the class), class_size, kept (the row that stays)."""
    return _classes(docs).select("doc_id", "class_id", "class_size", "kept")


def _classes(docs: DataFrame) -> DataFrame:
    named, made = members(docs)
    rows = stored(named, "members")
    first = rows.filter("key = node").groupBy("node").agg(F.min("content").alias("_content"))
    sketches = made.join(first, (F.col("key") == F.col("node")) & (F.col("content") == F.col("_content"))).select("node", "sketch", "n", "bins")
    sketches = stored(sketches.dropDuplicates(["node"]), "nodes")
    roots = components(near_links(docs, sketches)).withColumnRenamed("node", "_node")
    rooted = rows.join(roots, F.col("node") == F.col("_node"), "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    classes = rooted.groupBy(F.col("root").alias("_root")).agg(
        F.min("doc_id").alias("class_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("_keeper"), F.count("*").alias("class_size")
    )
    return rooted.join(classes, F.col("root") == F.col("_root")).withColumn("kept", F.col("key") == F.col("_keeper"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: its smallest id.  Rows that repeat that id all stay."""
    dropped = _classes(docs).filter("not kept").select(F.col("key").alias("_dropped")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key().alias("_key"))
    return rows.join(dropped, F.col("_key") == F.col("_dropped"), "left_anti").select("_row.*")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
