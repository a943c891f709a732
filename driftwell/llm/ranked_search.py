"""Ranked lexical search over an inverted index in shards, with posting blocks of variable size.

A task cuts its texts into shards of bounded size and writes one row for each shard and term: the documents that hold
the term, how often, and their lengths.  Corpus figures (documents, terms, documents of a term) are sums over
those rows.  ``build_index`` then turns each posting into its impact, the part of a score that depends on the
document, and parts each list into blocks: dynamic programming over borders every ``UNIT`` postings finds the blocks
whose bound error, the sum of the block's greatest impact less each posting's own, is least for a price per block.

``search`` brings a shard's rows to one task and answers every query there, exactly.  The bounds of the blocks that
cover a document add up to the most it can score.  Documents are scored in the order of that bound; blocks without a
document to score are skipped; once the bound of the next document is below the score of the k-th best so far, no
other can rank.  Each task hands on k documents a query, so what is gathered grows with tasks, not with documents.

Scores are integers: a term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, its impact in a document
``(10^9 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``, n terms of the document among L of N documents.

Defined cases: null text and text without terms: not counted in N, never found; a null id is ranked behind all others of
its score; very long texts are read whole and make a shard of their own; repeated rows rank each by itself; ties go by
ascending id; an empty table, a query without terms or with none of the corpus gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm._util import Scratch, frugal, table, texts
from driftwell.llm.byte_words import byte_class, chunks, cut, numbered

SHARD_BYTES = 16 << 20
UNIT = 16
WIDEST = 16
#: What a block costs, in postings that miss their bound by the list's greatest impact.
PRICE = 2.0
#: Distinct terms of the queries up to which an index may be limited to them.
MOST_TERMS = 1_000_000
#: Queries, and bytes of them, that are answered in one pass.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 4 << 20
NO_ID = (1 << 63) - 1

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
TERM_BYTES = byte_class(_SEPARATORS)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TEXT = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> Counter[str]:
    """The terms of a text and how often each occurs; only A-Z are lower-cased."""
    return Counter(TERM.findall((text or "").translate(_LOWER_TEXT)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 75 + (25 * length.astype(np.int64) * documents) // terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def block_ends(lists: list[np.ndarray], price: float = PRICE) -> list[np.ndarray]:
    """For each list of impacts, the ends of its blocks with the least sum of bound errors and prices.

    Lists of about equal length go through the dynamic programme together.
    """
    out: list[np.ndarray] = [np.array([len(x)]) for x in lists]
    alike: dict[int, list[int]] = {}
    for i, x in enumerate(lists):
        if len(x) > UNIT:
            alike.setdefault((-(-len(x) // UNIT)).bit_length(), []).append(i)
    for rows in alike.values():
        own = np.array([-(-len(lists[i]) // UNIT) for i in rows])
        units = int(own.max())
        values = np.zeros((len(rows), units * UNIT))
        count = np.zeros((len(rows), units * UNIT))
        for r, i in enumerate(rows):
            values[r, : len(lists[i])] = lists[i]
            count[r, : len(lists[i])] = 1
        top, total, n = (f(x.reshape(len(rows), units, UNIT), axis=2).T for f, x in ((np.max, values), (np.sum, values), (np.sum, count)))
        fee = price * values.max(axis=1)
        best = np.full((units + 1, len(rows)), np.inf)
        best[0] = 0
        back = np.zeros((units + 1, len(rows)), np.int64)
        for j in range(1, units + 1):
            high, have, size = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
            for k in range(1, min(j, WIDEST) + 1):
                high = np.maximum(high, top[j - k])
                have, size = have + total[j - k], size + n[j - k]
                cost = best[j - k] + fee + high * size - have
                better = cost < best[j]
                best[j][better] = cost[better]
                back[j][better] = k
        for r, i in enumerate(rows):
            j, ends = int(own[r]), []
            while j:
                ends.append(min(j * UNIT, len(lists[i])))
                j -= int(back[j, r])
            out[i] = np.array(ends[::-1])
    return out


@dataclass
class Index:
    """``frame`` has the rows ``(shard, term, docs, impacts, ends)``; the row of the empty term has a shard's ids."""

    frame: DataFrame
    frequencies: DataFrame
    documents: int


_POSTINGS = "shard string, term string, n_docs long, n_terms long, docs binary, tf binary, lengths binary"


def _postings(docs: DataFrame, known) -> DataFrame:
    """A row for each shard and term, and one of the empty term with the shard's ids and figures."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        only = None if known is None else pa.array(sorted(x.encode() for x in known.value), pa.large_binary())
        for b in batches:
            for i, j, borders, data in chunks(b.column(1), SHARD_BYTES):
                words, counts = cut(borders, _LOWER[data], TERM_BYTES)
                codes, names = numbered(words)
                owner = np.repeat(np.arange(j - i), counts)
                if only is not None and len(names):
                    codes = pc.index_in(names, value_set=only).fill_null(-1).to_numpy(zero_copy_only=False)[codes]
                    owner, codes, names = owner[codes >= 0], codes[codes >= 0], only
                key, tf = np.unique(codes * (j - i) + owner, return_counts=True)
                term, doc = np.divmod(key, j - i)
                edge = np.flatnonzero(np.diff(term, prepend=-1))
                doc, tf = doc.astype("<i4"), tf.astype("<i4")
                length = counts[doc].astype("<i4")
                ids = b.column(0).slice(i, j - i).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                rows = [("", int((counts > 0).sum()), int(counts.sum()), ids.astype("<i8").tobytes(), None, None)]
                stop = np.append(edge, len(term))[1:]
                spelled = names.take(pa.array(term[edge])).to_pylist()
                for name, s, e in zip(spelled, edge.tolist(), stop.tolist(), strict=True):
                    rows.append((name.decode(), e - s, 0, doc[s:e].tobytes(), tf[s:e].tobytes(), length[s:e].tobytes()))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                for a in range(0, len(rows), 4000):
                    some = rows[a : a + 4000]
                    cols = [pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{shard}"] * len(some)), *cols], [x.split()[0] for x in _POSTINGS.split(", ")])
                shard += 1

    return texts(docs).mapInArrow(run, _POSTINGS)


def _blocks(postings: DataFrame, documents: int, terms: int) -> DataFrame:
    """Impacts and block ends of each posting list."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found = b.column(2).to_pylist(), []
            for tf, length in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if tf is None:
                    found.append(np.zeros(0, np.int64))
                else:
                    found.append(impacts(np.frombuffer(tf, "<i4"), np.frombuffer(length, "<i4"), documents, terms))
            ends = block_ends(found)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(docs, pa.binary()),
                    pa.array([x.astype("<i4").tobytes() for x in found], pa.binary()),
                    pa.array([x.astype("<i4").tobytes() for x in ends], pa.binary()),
                ],
                ["shard", "term", "docs", "impacts", "ends"],
            )

    rows = postings.select("shard", "term", "docs", "tf", "lengths")
    return rows.mapInArrow(run, "shard string, term string, docs binary, impacts binary, ends binary")


def build_index(docs: DataFrame, scratch: Scratch, only: set[str] | None = None) -> Index:
    """The index of every document, written to the shared folder; with ``only``, of those terms alone.

    Lengths, and with them scores, count all terms either way.
    """
    spark = docs.sparkSession
    known = None if only is None else spark.sparkContext.broadcast(only)
    postings = scratch.keep(_postings(docs, known), "postings", "zstd")
    total = postings.filter("term = ''").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    frame = scratch.keep(_blocks(postings, total.n or 0, total.t or 1), "index", "zstd")
    frequencies = scratch.keep(postings.filter("term <> ''").groupBy("term").agg(F.sum("n_docs").alias("df")), "frequencies", fewer=4)
    scratch.drop(postings)
    return Index(frame, frequencies, total.n or 0)


class Shard:
    """The lists of one shard, end to end, and their blocks."""

    def __init__(self, ids: np.ndarray, lists: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, self.blocks_read = ids, 0
        self.docs = np.concatenate([x[1] for x in lists])
        self.impacts = np.concatenate([x[2] for x in lists]).astype(np.int64)
        sizes = np.cumsum([0, *(len(x[1]) for x in lists)])
        ends = np.concatenate([x[3] + at for x, at in zip(lists, sizes[:-1], strict=True)])
        self.stop = ends.astype(np.int64)
        self.start = np.append(0, self.stop[:-1])
        self.first, self.last = self.docs[self.start], self.docs[self.stop - 1]
        self.top = np.maximum.reduceat(self.impacts, self.start)
        border = np.cumsum([0, *(len(x[3]) for x in lists)]).tolist()
        self.terms = {x[0]: (a, b) for x, a, b in zip(lists, border[:-1], border[1:], strict=True)}

    def best(self, query: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best documents for the query's weights, best first, ties by id."""
        held = [(*self.terms[t], w) for t, w in query.items() if w > 0 and t in self.terms]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.concatenate([np.arange(a, b) for a, b, _ in held])
        weights = np.repeat([w for *_, w in held], [b - a for a, b, _ in held])
        n = len(self.ids)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, self.first[blocks], weights * self.top[blocks])
        np.add.at(step, self.last[blocks] + 1, -weights * self.top[blocks])
        bound = np.cumsum(step)[:n]
        order = np.argsort(-bound, kind="stable")
        scores = np.zeros(n, np.int64)
        floor, done, many = 1, 0, max(4 * k, 64)
        while done < n and bound[order[done]] >= floor:
            some = order[done : done + many]
            some = some[bound[some] >= floor]
            wanted = np.zeros(n, bool)
            wanted[some] = True
            upto = np.append(0, np.cumsum(wanted))
            hit = upto[self.last[blocks] + 1] > upto[self.first[blocks]]
            read, w = blocks[hit], weights[hit]
            self.blocks_read += len(read)
            size = self.stop[read] - self.start[read]
            at = np.arange(size.sum()) + np.repeat(self.start[read] - np.append(0, np.cumsum(size)[:-1]), size)
            doc, value = self.docs[at], np.repeat(w, size) * self.impacts[at]
            mine = wanted[doc]
            np.add.at(scores, doc[mine], value[mine])
            done += many
            many *= 4
            if (scores > 0).sum() >= k:
                floor = max(floor, int(np.partition(scores, n - k)[n - k]))
        top = np.flatnonzero(scores >= floor)
        top = top[np.lexsort((self.ids[top], -scores[top]))][:k]
        return self.ids[top], scores[top]


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards from rows in the order of shard and term."""
    name, ids, lists = None, None, []
    for b in batches:
        for shard, term, docs, imp, ends in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
            if shard != name:
                if lists:
                    yield Shard(ids, lists)
                name, lists = shard, []
            if term == "":
                ids = np.frombuffer(docs, "<i8")
            else:
                lists.append((term, np.frombuffer(docs, "<i4"), np.frombuffer(imp, "<i4"), np.frombuffer(ends, "<i4")))
    if lists:
        yield Shard(ids, lists)


def _search_block(index: Index, items: list[tuple[int, Counter[str]]], k: int) -> DataFrame:
    """``(number, doc_id, score)``: the best of each task for the items of one block."""
    spark = index.frame.sparkSession
    terms = sorted({t for _, c in items for t in c})
    # Bounded by the block's bytes.
    asked = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array([*terms, ""], pa.string())})))
    df = {r.term: r.df for r in index.frequencies.join(asked, "term", "left_semi").collect()}
    weights = {t: weight(index.documents, n) for t, n in df.items()}
    queries = spark.sparkContext.broadcast([(i, {t: r * weights[t] for t, r in c.items() if t in weights}) for i, c in items])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard in _shards(batches):
            for i, query in queries.value:
                ids, scores = shard.best(query, k)
                if len(ids):
                    if i in best:
                        ids, scores = (np.concatenate(x) for x in zip(best[i], (ids, scores), strict=True))
                        top = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[top], scores[top]
                    best[i] = ids, scores
        if best:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(list(best), [len(x[0]) for x in best.values()]), pa.int64()),
                    pa.array(np.concatenate([x[0] for x in best.values()]), pa.int64()),
                    pa.array(np.concatenate([x[1] for x in best.values()]), pa.int64()),
                ],
                ["number", "doc_id", "score"],
            )

    rows = index.frame.join(asked, "term", "left_semi").select("shard", "term", "docs", "impacts", "ends")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "term")
    return rows.mapInArrow(run, "number long, doc_id long, score long")


def search(index: Index, items: DataFrame, scratch: Scratch, k: int = 20) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each row ``(item_id, text)`` of ``items``."""
    spark = items.sparkSession
    found = None
    for part in _item_blocks(items):
        numbered_items = [(n, terms_of(r.text)) for n, r in enumerate(part)]
        ids = spark.createDataFrame(pa.table({"number": pa.array(range(len(part)), pa.int64()), "item_id": pa.array([r.item_id for r in part], pa.int64())}))
        hits = _search_block(index, numbered_items, k)
        # First within slices of a query, so that no task ranks what all tasks found for it.
        near = Window.partitionBy("number", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(F.desc("score"), "doc_id")
        hits = hits.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
        all_of_it = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
        hits = hits.withColumn("rank", F.row_number().over(all_of_it)).filter(F.col("rank") <= k)
        # At most ``BLOCK_ITEMS`` rows or so.
        hits = hits.join(F.broadcast(ids), "number").select("item_id", "rank", F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "score")
        hits = scratch.keep(hits, "hits", fewer=8)
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Rows of ``(item_id, text)`` in blocks of bounded size; equal rows are separate queries."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(-(-size.n // BLOCK_ITEMS), -(-(size.b or 0) // BLOCK_BYTES))
    for k in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()


def query_terms(items: DataFrame) -> set[str] | None:
    """The terms of all queries, or None if there are more than ``MOST_TERMS``: the index then has every term."""
    out: set[str] = set()
    for part in _item_blocks(items):
        for r in part:
            out.update(terms_of(r.text))
        if len(out) > MOST_TERMS:
            return None
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, items = Scratch(), table(spark, sf_dir, "benchmark")
    index = build_index(table(spark, sf_dir, "documents"), scratch, query_terms(items))
    found = search(index, items, scratch)
    scratch.drop(index.frame, index.frequencies)
    return found


#: Terms are repeated in an item as often as they stand there; ``ln`` is the only step in doubles.
ORACLE_OP13 = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
figures AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM words),
postings AS (
  SELECT d, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT d, doc_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY d, term),
frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (
  SELECT i, any_value(item_id) AS item_id, term, count(*) AS repeats
  FROM (SELECT row_number() OVER () AS i, item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY i, term),
scored AS (
  SELECT i, any_value(item_id) AS item_id, d, any_value(p.doc_id) AS doc_id,
         sum(repeats * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN postings p USING (term) JOIN frequencies USING (term) CROSS JOIN figures GROUP BY i, d)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, d) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
