import numpy as np
import pytest

from driftwell.operators import generation as G
from driftwell.operators import index as I
from driftwell.operators import retrieval as R
from driftwell.queries import workflow as Q

SF = "/root/testdata/sf0.01"


def test_recall_against_exact_search(spark):
    row = Q.ann_recall(spark, SF).first()
    assert row.queries >= 20 and row.recall >= 0.9


def test_clustered_vectors_need_few_lists(spark):
    m = G.clustered_vectors(spark, 3000, 16, 100, 0.05, 7).cache()
    q = m.filter("id % 20 = 0").selectExpr("id as qid", "ins as qins", "v")
    rule = R.Rule(tau=0.5)
    found = I.candidates(q, m, I.fit(m, 30), rule, 10, probes=3)
    truth = R.semantic_candidates(q, m, rule, 10)
    assert np.mean([r.recall for r in I.recall(found, truth).collect()]) >= 0.95


def test_all_lists_are_exact_and_every_row_is_indexed(spark):
    m = G.clustered_vectors(spark, 400, 8, 1, 0.5, 3)
    c = I.fit(m, 7)
    assert I.assigned(m, c).count() == 400
    q = m.filter("id % 20 = 0").selectExpr("id as qid", "ins as qins", "v")
    rule = R.Rule(tau=0.1)
    got = {(r.qid, r.id, r["rank"]) for r in I.candidates(q, m, c, rule, 5, probes=7).collect()}
    assert got == {(r.qid, r.id, r["rank"]) for r in R.semantic_candidates(q, m, rule, 5).collect()}


@pytest.mark.parametrize("size", [0, 1])
def test_tiny_memories(spark, size):
    m = G.clustered_vectors(spark, 50, 8, 5, 0.1, 3).filter(f"id < {size}")
    assert len(I.fit(m, 4)) == size
