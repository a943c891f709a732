import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import vectors as V
from driftwell.operators import retrieval as R
from driftwell.operators import scan as S


def memory(spark, vectors):
    return spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(vectors, 1)], "id long, ins long, v array<double>")


def query(spark, v, size):
    return spark.createDataFrame([(99, size + 1, [float(x) for x in v])], "qid long, qins long, v array<double>")


def ids(found):
    return [(r.id, round(r.score, 9)) for r in found.orderBy("rank").collect()]


def test_decay_reorders(spark):
    m = memory(spark, [(1, 0), (0.8, 0.6), (-1, 0)])
    rule = R.Rule(0.5, 0.6, 2)
    assert ids(R.retrieve(query(spark, (1, 0), 3), m, rule, R.EXHAUSTIVE)) == [(2, 0.4), (1, 0.25)]


def test_zero_cosine_never_passes(spark):
    m = memory(spark, [(0.4, 0.84**0.5), (0, 1), (-1, 0)])
    assert ids(R.retrieve(query(spark, (1, 0), 3), m, R.Rule(0.5, 0.0, 5))) == [(1, 0.1)]


def test_empty_memory(spark):
    assert ids(R.retrieve(query(spark, (1, 0), 0), memory(spark, [(1, 0)]).limit(0), R.Rule())) == []


def test_gate_and_dedup(spark):
    rows = [(9, 1, 1, 2, 0.9), (9, 1, 1, 2, 0.9), (9, 2, 2, 1, 0.8), (9, 3, 3, 0, 0.6)]
    c = spark.createDataFrame(rows, "qid long, id long, ins long, age long, cosine double")
    assert [i for i, _ in ids(R.rerank(c, R.Rule(0.5, 0.7, 5)))] == [2, 1]


def test_certificate_and_horizon(spark):
    row = spark.range(1)

    def safe(decay, w, n, kth):
        return row.select(V.pruning_is_safe(decay, F.lit(w), F.lit(n), F.lit(kth), 5)).first()[0]

    assert safe(0.5, 3, 5, 0.2) and not safe(0.5, 2, 5, 0.2) and not safe(0.5, 3, 4, 0.2) and not safe(1.0, 3, 5, 0.2)
    got = [row.select(V.minimum_safe_horizon(d, F.lit(k))).first()[0] for d, k in ((0.5, 0.25), (0.5, 0.2), (1.0, 0.2))]
    assert got == [3, 3, None]


def test_recall(spark):
    a = [([1, 2, 3], [2, 3, 4]), ([], [])]
    rows = spark.createDataFrame(a, "e array<int>, o array<int>").select(V.recall(F.col("e"), F.col("o")).alias("r")).collect()
    assert [round(r.r, 9) for r in rows] == [round(2 / 3, 9), 1.0]


def walked(q, m, rule, schedule, window=None):
    return S.walk(q, S.BlockStore.write(m), rule, schedule, window)


def test_certified_scan_equals_exhaustive(spark):
    m = memory(spark, [(1, 0)] * 6)
    q, rule = query(spark, (1, 0), 6), R.Rule(0.5, 0.7, 2)
    found = walked(q, m, rule, S.steps(2))
    assert ids(S.hits_of(found, rule)) == ids(R.retrieve(q, m, rule, R.EXHAUSTIVE)) == [(6, 1.0), (5, 0.5)]
    assert found.first().horizon == 2


def test_no_pruning_without_decay(spark):
    m = memory(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    r = walked(query(spark, (1, 0, 0), 3), m, R.Rule(1.0, 0.7, 1), S.steps(1)).first()
    assert (r.horizon, r.calls, r.candidates) == (3, 1, 1)


def test_growing_window_stops_at_its_first_certificate(spark):
    m = memory(spark, [(0, 1)] * 9 + [(1, 0)])
    for decay, want in ((0.5, (2, 1)), (1.0, (10, 1))):
        r = walked(query(spark, (1, 0), 10), m, R.Rule(decay, 0.7, 1), S.growing(2)).first()
        assert (r.horizon, r.calls) == want and [h.id for h in r.hits] == [10]


def by_definition(q, qins, vectors, rule, schedule, window):
    """One query's scan, window by window, over all records before it."""
    size = max(qins - 1, 0)
    cosine = np.clip(vectors[:size] @ q, -1, 1)
    age = qins - 1 - np.arange(1, size + 1)
    rows = [(c * rule.decay**a, c, qins - 1 - a) for c, a in zip(cosine.tolist(), age.tolist(), strict=True) if c > 0 and c >= rule.tau]
    end, calls = window or (max(size, 1) if rule.decay == 1 else schedule(0)), 1
    while True:
        inside = sorted((r for r in rows if qins - 1 - r[2] < end), reverse=True)
        top = inside[: rule.k]
        sure = len(top) == rule.k and rule.decay < 1 and rule.decay**end < top[-1][0]
        if window or end >= size or sure:
            return min(end, size), calls, len(inside), [r[2] for r in top]
        end, calls = schedule(end), calls + 1


@pytest.mark.parametrize("window", [None, 7, 40])
@pytest.mark.parametrize("decay", [0.6, 0.93, 0.995, 1.0])
def test_walks_by_definition(spark, monkeypatch, decay, window):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "TOGETHER", 5)
    r = np.random.default_rng(3)
    vectors = r.standard_normal((90, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[40:60] = vectors[0]
    m = memory(spark, vectors.tolist())
    asked = [(k, int(i), vectors[r.integers(90)]) for k, i in enumerate([1, 2, 91, 91, 91, 17, 16, 33, 60, 75, 90])]
    q = spark.createDataFrame([(k, i, v.tolist()) for k, i, v in asked], "qid long, qins long, v array<double>")
    for rule in (R.Rule(decay, 0.3, 3), R.Rule(decay, 0.9, 2)):
        for schedule in (S.steps(6), S.growing(5), S.steps(50)):
            got = {x.qid: (x.horizon, x.calls, x.candidates, [h.id for h in x.hits]) for x in walked(q, m, rule, schedule, window).collect()}
            assert got == {k: by_definition(v, i, vectors, rule, schedule, window) for k, i, v in asked}


def test_walks_open_only_what_they_need(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    m = memory(spark, [(1, 0)] * 160)
    store = S.BlockStore.write(m)
    assert len(store.bounds) == 10
    q = query(spark, (1, 0), 160)
    opened = [S.walk(q, store, R.Rule(0.5, 0.7, 2), S.steps(4), w).first().files for w in (None, 16, 48, 160)]
    assert opened == [1, 1, 3, 10]


def test_scores_that_decay_to_nothing_are_hits(spark):
    """0.5 ^ 1200 is 0 in doubles: such hits stay, and certify nothing unless the newest come first."""
    vectors = [(1, 0), (0.8, 0.6), (1, 0)] + [(0, 1)] * 1200
    rule = R.Rule(0.5, 0.7, 2)
    m, q = memory(spark, vectors), query(spark, (1, 0), len(vectors))
    for order, want in ((R.ONLINE, [3, 2]), (R.EXHAUSTIVE, [3, 1])):
        store = S.BlockStore.write(m)
        r = S.walk(q, store, rule, S.growing(100), order=order).first()
        assert ([h.id for h in r.hits], {h.score for h in r.hits}, r.horizon, r.candidates) == (want, {0.0}, len(vectors), 3)
        assert [i for i, _ in ids(R.retrieve(q, m, rule, order))] == want
    vectors = [(1, 0)] * 900 + [(0, 1)] * 1200
    store = S.BlockStore.write(memory(spark, vectors))
    for order, horizon in ((R.ONLINE, 1600), (R.EXHAUSTIVE, 2100)):  # ties: an older hit is no better online
        r = S.walk(query(spark, (1, 0), len(vectors)), store, rule, S.growing(100), order=order).first()
        assert ([h.id for h in r.hits], r.horizon) == ([900, 899], horizon)


def test_hits_held_are_cut_to_the_best(spark, monkeypatch):
    vectors = np.array([(1, 0), (0.8, 0.6), (1, 0)] * 20, float)
    monkeypatch.setattr(S, "BLOCK", 4)
    store = S.BlockStore.write(memory(spark, vectors.tolist()))
    cut, first = [], S._first
    monkeypatch.setattr(S, "HELD", 3)
    monkeypatch.setattr(S, "_first", lambda kept, order, k: cut.append(sum(len(x[0]) for x in kept)) or first(kept, order, k))
    found = S._walk(S._Reader(store), np.array([7, 8]), np.array([61, 31]), np.array([(1.0, 0), (0.6, 0.8)]), R.Rule(1.0, 0.7, 2), S.steps(4), None)
    assert len(cut) > 5 and max(cut) <= 2 * (2 + 4)
    assert [[h["id"] for h in r[-1]] for r in found] == [[60, 58], [29, 26]]


def test_triangular_search_stops(spark, tmp_path, monkeypatch):
    """Every record asks, and opens the newest blocks alone, however many there are; hits are those of all pairs."""
    from driftwell.queries import retrieval as Q

    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[700] *= 0.1  # passes no gate: walks to the oldest record
    rows = [(i - 20, v.tolist(), 0) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(Q, "RULE", R.Rule(decay=0.9))
    walks, walk = [], S.walk
    monkeypatch.setattr(S, "walk", lambda *a, **k: walks.append(walk(*a, **k).cache()) or walks[-1])
    got = {}
    for r in Q.triangular_topk(spark, str(tmp_path)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.age, r.score))
    v = vectors.astype(float)
    for n in range(1500):
        cosine = v[:n] @ v[n]
        score = cosine * 0.9 ** np.arange(n - 1, -1, -1.0)
        best = sorted(((s, i) for i, (c, s) in enumerate(zip(cosine, score, strict=True)) if c >= 0.2), reverse=True)[:5]
        assert [x[:3] for x in got.get(n - 20, [])] == [(k, i - 20, n - 1 - i) for k, (_, i) in enumerate(best, 1)]
    opened = {r.qid: r.files for r in walks[0].select("qid", "files").collect()}
    assert len(opened) == 1500 and opened.pop(680) >= 11 and max(opened.values()) <= 3


def test_walks_of_nothing(spark):
    m, rule = memory(spark, [(1, 0)]), R.Rule(0.5, 0.7, 2)
    r = walked(query(spark, (1, 0), 0), m, rule, S.steps(2)).first()
    assert (r.horizon, r.calls, r.files, r.hits) == (0, 1, 0, [])
    r = walked(query(spark, (1, 0), 5), m.limit(0), rule, S.steps(2)).first()
    assert r.hits == [] and r.candidates == 0
    assert walked(query(spark, (1, 0), 1).limit(0), m, rule, S.steps(2)).count() == 0
    with pytest.raises(Exception, match="differ in size"):
        walked(query(spark, (1, 0, 0), 1), m, rule, S.steps(2)).collect()


def test_recency_reaches_the_scan(spark, tmp_path):
    memory(spark, [(1, 0)] * 50).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    found = R.fixed_recency(query(spark, (1, 0), 50), m, R.Rule(0.5, 0.7, 2), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ins,46)" in plan and "LessThan(ins,51)" in plan
    assert ids(found) == [(50, 1.0), (49, 0.5)]


def test_norms_are_evaluated_once_a_vector(spark):
    """The time of a normalised vector grows with its size, not with the square of it."""
    took = []
    for dims in (2000, 8000):
        rows = spark.createDataFrame([([0.5] * dims,)] * 40, "v array<double>").cache()
        rows.count()
        began = time.perf_counter()
        assert rows.select(F.sum(V.norm(V.normalised(F.col("v"))))).first()[0] == pytest.approx(40)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1
    odd = spark.createDataFrame([([0.0, 0.0],), ([],), ([float("inf")],), (None,), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in odd.select(V.normalised(F.col("v"))).collect()] == [None, None, None, None, [0.6, 0.8]]


def test_clustered_vectors(spark):
    from driftwell.operators import generation as G

    rows = G.clustered_vectors(spark, 203, 64, 10, 0.01, 5).repartition(7)
    v = np.array([r.v for r in rows.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-6)
    of = G.cluster_of(np.arange(203), 203, 10, 5)
    sizes = np.bincount(of)
    assert len(sizes) == 21 and sizes.max() - sizes.min() <= 1 and (np.diff(of) != 0).mean() > 0.9
    same = of[:, None] == of[None, :]
    cosine = v @ v.T
    assert cosine[same].min() > 0.98 and cosine[~same].max() < 0.7
    assert np.allclose(np.array([r.v for r in G.clustered_vectors(spark, 203, 64, 10, 0.01, 5).orderBy("id").collect()]), v)
    q = np.array([r.v for r in G.clustered_queries(spark, 9, 203, 64, 10, 5).collect()])
    assert ((q @ v.T) > 0.98).sum(1).min() >= 9


def test_bad_parameters():
    with pytest.raises(ValueError):
        R.Rule(decay=0.0)
    with pytest.raises(ValueError):
        R.Rule(decay=1.5)


def test_blocks_of_queries_do_not_pass_through_the_driver(spark):
    memory = spark.range(3 * R.BLOCK).select("id", (F.col("id") + 1).alias("ins"), F.array(F.lit(0.6), F.lit(0.8)).alias("v"), F.lit("a").alias("label"))
    queries = memory.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("ins").alias("qins"), "v", "label")
    searches = (R.hits(queries, memory, R.Rule()), R.hits(queries, memory, R.Rule(), window=100), R.nearest(queries, memory, same="label"))
    for found in searches:
        assert found.count() > 0
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert not any("BroadcastHashJoin" in line and ("_at" in line or "b#" in line) for line in plan.splitlines())
