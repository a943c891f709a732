import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import models as M
from driftwell.operators import trajectories as J
from driftwell.plans import trace as T
from driftwell.sources import io as S
from driftwell.sources import jobs, vectors
from driftwell.streaming import controller as streaming

TICKET = "global_position int, ticket_id string"


def rows(spark, ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], TICKET)


def test_a_job_is_found_by_its_id(spark, tmp_path):
    root = f"file://{tmp_path}"
    job, folder = jobs.create_job(spark, root, "a label/with marks", {"seed": 3})
    assert jobs.find_job(spark, root, job).split("/")[-1] == folder.split("/")[-1] and "a-label-with-marks__job-" in folder
    assert jobs.read_json(spark, f"{folder}/metadata.json")["configuration"] == {"seed": 3}
    for bad in ("x", job[:-1], "0" * 32):
        with pytest.raises(ValueError):
            jobs.find_job(spark, root, bad)
    (tmp_path / f"twin__job-{job}").mkdir()
    with pytest.raises(ValueError, match="2 folders"):
        jobs.find_job(spark, root, job)


def test_finalized_runs_keep_order_and_drop_the_partial(spark, tmp_path):
    folder = f"file://{tmp_path}/x__job-0"
    jobs.append_tickets(rows(spark, (3, 1, 2)), folder, 1)
    jobs.append_tickets(rows(spark, (5, 4, 3)), folder, 1)
    final = jobs.finalize_run(spark, folder, 1)
    assert [r.ticket_id for r in jobs.read_result(spark, final, TICKET).orderBy("global_position").collect()] == ["t1", "t2", "t3", "t4", "t5"]
    assert [json.loads(r.value)["global_position"] for r in spark.read.text(final).collect()] == [1, 2, 3, 4, 5]
    assert not jobs.exists(spark, jobs.partial_path(folder, 1)) and jobs.finalize_run(spark, folder, 1) == final
    with pytest.raises(ValueError, match="no tickets"):
        jobs.finalize_run(spark, folder, 2)
    size = jobs.run_bytes(spark, folder).first()
    assert size.files == 1 and size.bytes > 50
    assert {len(r.sha256) for r in jobs.artifact_manifest(spark, folder).collect()} == {64}


def test_results_of_three_shapes(spark, tmp_path):
    tickets = [{"global_position": i, "ticket_id": f"t{i}"} for i in (1, 2)]
    (tmp_path / "run-001.partial.jsonl").write_text("\n".join(json.dumps(t) for t in tickets) + "\n\n")
    (tmp_path / "run-002.json").write_text(json.dumps({"repetition": 2, "tickets": tickets}, indent=1))
    suite = {"conditions": [{"repetitions": [{"tickets": []}, {"tickets": tickets}]}]}
    (tmp_path / "result.json").write_text(json.dumps(suite))
    want = [(1, "t1"), (2, "t2")]
    for name, options in (("run-001.partial.jsonl", {}), ("run-002.json", {}), ("result.json", {"repetition": 2})):
        assert sorted(map(tuple, jobs.read_result(spark, f"file://{tmp_path}/{name}", TICKET, **options).collect())) == want
    for options in ({"repetition": 1}, {"condition": 2}):
        with pytest.raises(ValueError, match="no tickets"):
            jobs.read_result(spark, f"file://{tmp_path}/result.json", TICKET, **options)


def test_iso_times(spark):
    t = spark.createDataFrame([("2024-05-01T10:00:00+02:00",), ("no",)], "s string").select(jobs.iso_time(F.col("s")).alias("t"))
    assert [r[0] for r in t.select(jobs.iso_text(F.col("t"))).collect()] == ["2024-05-01T08:00:00.000000+00:00", None]


def test_embedding_and_periods(spark, tmp_path):
    def encode(texts):
        return np.array([[len(t), 1.0, 2.0] for t in texts])

    q = spark.createDataFrame([(f"a{i}", "x" * i) for i in range(1, 9)], "id string, question string")
    made = vectors.embedded(q, encode, batch=3)
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-12 for r in made.collect()) and made.count() == 8
    with pytest.raises(Exception, match="zero or not finite"):
        vectors.embedded(q, lambda t: np.zeros((len(t), 2))).collect()
    folder = f"file://{tmp_path}/vectors"
    vectors.write_periods({"Q1": made, "Q2": made}, folder, "m1")
    with pytest.raises(FileExistsError):
        vectors.write_periods({"Q1": made}, folder, "m1")
    with pytest.raises(ValueError, match="another model"):
        vectors.write_periods({"Q3": made}, folder, "m2", only="Q3")
    manifest = vectors.write_periods({"Q3": made.limit(2)}, folder, "m1", only="Q3")
    assert {k: v["records"] for k, v in manifest["files"].items()} == {"Q1": 8, "Q2": 8, "Q3": 2} and manifest["dimension"] == 3
    assert vectors.changed_periods(spark, folder) == []
    made.limit(1).write.mode("overwrite").parquet(f"{folder}/Q2")
    assert vectors.changed_periods(spark, folder) == ["Q2"]


def test_vector_store(spark, tmp_path):
    store = vectors.VectorStore(spark, f"file://{tmp_path}/store")
    store.create()
    data = spark.createDataFrame([(i, i + 1, [1.0, float(i)]) for i in range(20)], "id long, ins long, v array<double>")
    told = store.ingest(data, 8)
    assert told["batches"] == 3 and told["vectors_per_second"] > 0 and told["p50_batch_ms"] <= told["p95_batch_ms"]
    assert store.wait_until(20)["points"] == 20 and vectors.without_gaps(store.rows()).isEmpty()
    store.upsert(data.filter("id = 3").withColumn("v", F.array(F.lit(0.0), F.lit(5.0))), batch=9)
    assert store.status()["points"] == 20 and store.rows().filter("id = 3").first().v == [0.0, 1.0]
    with pytest.raises(TimeoutError):
        store.wait_until(21, seconds=0.1)
    before = store.rows()
    store.delete(spark.createDataFrame([(5,), (77,)], "id long"))
    store.upsert(spark.createDataFrame([(6, 40, [0.0, 2.0]), (6, 41, [3.0, 0.0])], "id long, ins long, v array<double>"), batch=1)
    want = {i: i + 1 for i in range(20) if i not in (5, 6)} | {6: 41}
    assert {r.id: r.ins for r in store.rows().collect()} == want and store.rows(41, 41).first().v == [1.0, 0.0]
    assert before.count() == 20  # readers under way keep what they saw
    assert {r.id for r in store.rows(3, 8).collect()} == {i for i, at in want.items() if 3 <= at <= 8}
    store.compact()
    assert {r.id: r.ins for r in store.rows().collect()} == want and store.rows().filter("id = 3").first().v == [0.0, 1.0]
    assert "GreaterThanOrEqual(ins,3)" in store.rows(3, 8)._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "store" / "run-00000099-dead").mkdir()  # a write that broke off
    store.MOST_RUNS = 2
    for k in range(3):
        store.upsert(data.filter(f"id = {k}"), batch=k)
    state = store._state()
    assert len(state["runs"]) == 0 and store.status()["points"] == 19 and store.status()["files"] >= 1
    with pytest.raises(FileExistsError):
        store.create(replace=False)
    store.create()
    assert store.rows().isEmpty() and store.status()["files"] == 0


def test_a_batch_is_committed_once(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    assert jobs.read_batches(spark, folder, TICKET).isEmpty()
    assert jobs.commit_batch(rows(spark, (1, 2)), folder, 0) and not jobs.commit_batch(rows(spark, (1, 2, 3)), folder, 0) and jobs.commit_batch(rows(spark, (3,)), folder, 1)
    (tmp_path / "run" / "_tmp-2-dead").mkdir()
    (tmp_path / "run" / "_tmp-2-dead" / "part-0.json").write_text("{")
    assert sorted((r.batch, r.global_position) for r in jobs.read_batches(spark, folder, TICKET).collect()) == [(0, 1), (0, 2), (1, 3)]
    job = f"file://{tmp_path}/x__job-1"
    for _ in range(2):  # the whole run is repeated after a crash
        jobs.append_tickets(rows(spark, (1, 2)), job, 1, batch=0)
        jobs.append_tickets(rows(spark, (4, 3)), job, 1, batch=1)
    assert jobs.read_result(spark, jobs.partial_path(job, 1), TICKET).columns == ["global_position", "ticket_id"]
    final = jobs.finalize_run(spark, job, 1)
    assert [json.loads(r.value)["global_position"] for r in spark.read.text(final).collect()] == [1, 2, 3, 4]


def test_a_stream_that_dies_adds_no_row_twice(spark, tmp_path):
    source, folder, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    heard = []

    def told(number, new):
        heard.append((number, new))
        if heard == [(0, True)]:
            raise RuntimeError("the driver dies between write and commit")

    def flow():
        stream = spark.readStream.schema(TICKET).json(source)
        return streaming.flushed(stream, folder, checkpoint, told)

    rows(spark, (1, 2, 3)).coalesce(1).write.json(source)
    with pytest.raises(Exception, match="between write and commit"):
        flow().awaitTermination()
    flow().awaitTermination()
    rows(spark, (4, 5)).coalesce(1).write.mode("append").json(source)
    flow().awaitTermination()
    assert heard == [(0, True), (0, False), (1, True)]
    assert sorted((r.batch, r.global_position) for r in jobs.read_batches(spark, folder, TICKET).collect()) == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]


def test_request_must_be_the_benchmark(spark):
    t = "id string, question string"
    known = spark.createDataFrame([("a", "qa"), ("b", "qb"), ("c", "qc"), ("d", "qd")], t)
    source = spark.createDataFrame([("a", "qa"), ("b", "qb"), ("c", "other")], t)
    asked = spark.createDataFrame([("a", "qa"), ("b", "changed"), ("c", "qc"), ("d", "qd"), ("e", "?")], t)
    found = {r.id: r.reason for r in S.request_violations(asked, known, source).collect()}
    assert found == {"b": "question differs from the benchmark", "c": "question differs from the embedded one", "d": "no embedded question", "e": "not part of the benchmark"}


def test_models_a_job_needs(spark):
    need = spark.createDataFrame([("x",), ("y",)], "model string")
    assert [r.model for r in M.missing_models(need, need.filter("model = 'x'")).collect()] == ["y"]


def test_hosted_model_over_a_transport():
    sent, waits = [], []

    def post(request):
        sent.append(request)
        if len(sent) == 1:
            raise ConnectionError
        if "known" in json.loads(request["user"]):
            return {"answer": "yes", "abstain": False, "evidence_ids": ["r1"], "reason": "found"}
        return {"covered": True, "confidence": 0.9, "reason": "same"}

    model = M.chat_model(post, "g", "a", M.Retry(sleep=waits.append))
    found = [{"record_id": "r1", "question": "q", "final_answer": "yes"}]
    assert model.decide("q?", found)["answer"] == "yes" and waits == [1.0] and sent[0]["model"] == "g" and json.loads(sent[1]["user"])["known"][0]["id"] == "r1"
    assert model.judge_gold("yes", "yes")["covered"] and sent[-1]["model"] == "a" and "None." not in sent[1]["user"]


def test_controller_free_traces_have_two_trajectories(spark):
    t = T.trace(spark, "/root/testdata/sf0.001").filter("user_id < 2")
    assert {r.label for r in J.averaged(t, "user_id").collect()} == {"fea", "final_error", "human_error", "replay_error"}
    free = t.withColumn("state_before", F.lit("controller_free"))
    assert {r.label for r in J.averaged(free, "user_id").collect()} == {"final_error", "human_error"}


def test_gaps_at_the_borders_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GAP_BLOCK", 10)
    present = [i for i in range(45) if i not in (7, 20, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39)]
    rows = spark.createDataFrame([(i,) for i in present], "ins long").repartition(5)
    assert sorted(map(tuple, vectors.without_gaps(rows).collect())) == [(8, 6), (21, 19), (40, 29)]
    assert vectors.without_gaps(spark.range(100).withColumnRenamed("id", "ins")).isEmpty()


def test_replaced_files_are_never_missing(spark, tmp_path):
    path = f"{tmp_path}/state.json"
    jobs.write_json(spark, path, {"n": 0})
    seen, over = [], threading.Event()

    def watch():
        while not over.is_set():
            with open(path) as f:
                seen.append(json.load(f)["n"])

    reader = threading.Thread(target=watch)
    reader.start()
    for n in range(1, 30):
        jobs.write_json(spark, path, {"n": n})
    over.set()
    reader.join()
    assert seen == sorted(seen) and jobs.read_json(spark, path) == {"n": 29}
    assert [x for x in os.listdir(tmp_path) if "tmp" in x and not x.startswith(".")] == []


def test_lines_without_a_position_are_kept(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (None, "x"), (None, "y")], "global_position long, v string").coalesce(1).write.json(jobs.partial_path(folder, 1))
    found = [json.loads(r.value) for r in spark.read.text(jobs.finalize_run(spark, folder, 1)).collect()]
    assert sorted(x["v"] for x in found[:2]) == ["x", "y"] and [x["v"] for x in found[2:]] == ["a", "b"]
