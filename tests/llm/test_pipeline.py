import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftwell.llm import near_dedup, packing
from driftwell.llm._util import stored
from driftwell.llm.tokens import encoder, public_vocabulary

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"
WORDS = [f"w{i}" for i in range(500)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA)


def edge_rows():
    r = random.Random(3)
    base = prose(r, 80).split()
    near = base[:]
    near[10] = near[50] = "other"
    rows = [(1, None), (2, ""), (3, " ".join(base)), (4, " ".join(near)), (5, " ".join(base).upper()), (6, prose(r, 9000)), (7, "two words")]
    return rows + [(3, " ".join(base)), (None, prose(r, 60)), (None, " ".join(near)), (8, prose(r, 60))]


def test_stages_on_odd_rows(spark):
    docs = table(spark, edge_rows())
    exact = stored(corpus_pipeline.exact(spark, docs, SF), "test")
    lowered = {}
    for i, t in edge_rows():
        lowered.setdefault((t or "").lower(), []).append(i)
    want = sorted(str(max((i for i in ids if i is not None), default=None)) for ids in lowered.values())
    assert exact.columns == docs.columns and sorted(str(x.doc_id) for x in exact.collect()) == want
    near = stored(corpus_pipeline.near(spark, exact, SF), "test")
    kept = {x.doc_id: x.text for x in near.collect()}
    texts = [t or "" for t in kept.values()]
    assert not any(near_dedup.similar(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if a or b)
    assert len(kept) == 6  # no text, the base, the long one, two words, the two that stand alone
    mixed = stored(corpus_pipeline.mixed(spark, near, SF), "test")
    assert mixed.columns == docs.columns
    pieces = corpus_pipeline.packed(spark, mixed, SF).collect()
    ids = {x.doc_id: encoder(public_vocabulary("word_bpe_49k.json")).library.encode(x.text or "", add_special_tokens=False).ids + [2] for x in near.collect()}
    for x in pieces:
        assert zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    assert sum(x.length for x in pieces) == sum(len(ids[x.doc_id]) for x in mixed.collect())
    assert max(x.offset + x.length for x in pieces) <= packing.WINDOW


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, stage):
    docs = table(spark, edge_rows()).limit(0)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.count() == 0
    if stage < 4:
        assert out.columns == docs.columns


def test_whole_run_against_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, SF)
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {x.doc_id for x in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in clean]) > 0.97 and np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.2
    pieces = corpus_pipeline.run(spark, SF)
    ends = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.filter(f"n <> end or n > {packing.WINDOW}").isEmpty()
    assert {x.doc_id for x in pieces.select("doc_id").distinct().collect()} <= kept
