"""Words as rows of a table: a bounded vocabulary, and shapes for words outside it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm._util import held_out

CACHE = 400_000


def shape(word: str) -> str:
    """Case of the middle and the marks around it, for words without a row of their own."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    core = word[a:b]
    if not core:
        case = "-"
    elif core.isdigit():
        case = "0"
    elif core.islower():
        case = "a"
    elif core.isupper():
        case = "A"
    elif core.istitle():
        case = "Aa"
    else:
        case = "?"
    return f"\0{case}{min(len(core), 20) // 4}|{word[:a][:3]}|{word[b:][:3]}"


AGAIN = "\0again"


def words_of(text: str) -> list[str]:
    """White-space words; one that repeats the word before it is read as a mark of its own."""
    words = text.split()
    return words[:1] + [AGAIN if w == v else w for v, w in pairwise(words)]


def vocabulary(texts: Iterable[str], size: int, least: int) -> dict[str, int]:
    """Row of each of the ``size`` most frequent words and shapes that occur ``least`` times, row 0 for the rest."""
    words, shapes = Counter(), Counter()
    for t in texts:
        words.update(words_of(t))
    for w, n in words.items():
        shapes[shape(w)] += n
    both = [x for c in (words, shapes) for x in c.items() if x[1] >= least]
    both.sort(key=lambda x: (-x[1], x[0]))
    return {w: i + 1 for i, (w, _) in enumerate(both[:size])}


class Rows(dict):
    """Word -> row, filled as words are met."""

    def __init__(self, known: dict[str, int]):
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        row = self.known.get(word)
        if row is None:
            row = self.known.get(shape(word), 0)
        self[word] = row
        return row

    def of(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


_WORKER: dict[str, Rows] = {}


def worker_rows(name: str, known: dict[str, int]) -> Rows:
    """This worker's cache for the model ``name``, kept from task to task."""
    if name not in _WORKER:
        if len(_WORKER) >= 2:
            _WORKER.clear()
        _WORKER[name] = Rows(known)
    return _WORKER[name]


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, rows: int, chars: int) -> list[tuple[str, object]]:
    """Up to ``rows`` labelled texts of at most ``chars`` characters, none of the held-out fold.

    ``value`` is an SQL expression over the label columns; of an id labelled more than once the largest value
    counts.  The ids are the first by a hash, so the sample is the same at every run.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("_id"), F.expr(value).alias("value"))
    known = known.filter("value is not null").groupBy("_id").agg(F.max("value").alias("value"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= chars)
    # At most ``rows`` ids.
    found = found.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "value")
    return [(r.text, r.value) for r in found.orderBy("doc_id", F.xxhash64("text")).limit(rows).collect()]
