import hashlib
import json
import threading
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from driftwell.functions import text as X
from driftwell.operators import generation as G
from driftwell.operators import models as M
from driftwell.operators import quality as Q
from driftwell.sources import io

ANSWER = {"answer": "a", "is_correct": True, "behavior": None, "applicability": None, "error_type": None}


def ticket(i, quarter="Q1"):
    return {
        "id": f"t{i}", "quarter": quarter, "sequence_in_quarter": i, "shuffled_order": i, "difficulty": "easy", "category": "billing", "policy_key": "k", "article_title": "x",
        "question": "q", "gold_answer": f"g{quarter}", "profile_answers": {"ceo": ANSWER, "domain_expert_out_of_domain": ANSWER, "intern": ANSWER}, "documentation_anchor": "d",
        "is_changed_answer_near_duplicate": False, "near_duplicate_of": None, "similar_question_ids": [], "drift": None, "requires_model_abstention": quarter == "Extra",
    }


def test_tickets(spark, tmp_path):
    files = {}
    for q in ("Q1", "Extra"):
        files[q] = f"{tmp_path}/{q}.json"
        (tmp_path / f"{q}.json").write_text(json.dumps([ticket(i, q) | {"id": f"{q}-{i}"} for i in (1, 2)]))
    rows = io.read_tickets(spark, files)
    assert rows.count() == 4 and io.read_tickets(spark, files, include_extra=False).count() == 2
    assert {r.violations for r in Q.violations(io.ticket_violations(rows)).collect()} == {0}
    bad = rows.withColumn("difficulty", F.lit("odd")).union(rows)
    found = {r.rule: r.violations for r in Q.violations(io.ticket_violations(bad)).collect()}
    assert found["ids are unique"] == 4 and found["difficulties are known"] == 4
    with pytest.raises(ValueError):
        io.read_tickets(spark, {"Q9": "x"})
    assert spark.range(1).select(io.quarter_rank(F.lit("Extra"))).first()[0] == 5
    gold = io.gold_answers(rows.select("id", "gold_answer"), rows.filter("id = 'Q1-1'").select("id", F.lit("new").alias("gold_answer")))
    assert {r.id: r.gold_answer for r in gold.collect()}["Q1-1"] == "new" and gold.count() == 4


def test_embeddings(spark, tmp_path):
    def save(rows, name):
        spark.createDataFrame(rows, "id string, embedding array<float>").write.parquet(f"{tmp_path}/{name}")
        return io.read_embeddings(spark, f"{tmp_path}/{name}")

    v = save([("a", [3.0, 4.0])], "ok")
    assert [round(x, 6) for x in v.first().v] == [0.6, 0.8]
    for name, rows in (("twice", [("a", [1.0]), ("a", [1.0])]), ("zero", [("a", [0.0, 0.0])]), ("nan", [("a", [float("nan")])]), ("inf", [("a", [float("inf")])])):
        with pytest.raises(ValueError):
            save(rows, name)
    with pytest.raises(Exception, match="no embedding for b"):
        io.attach_embeddings(spark.createDataFrame([("a",), ("b",)], "id string"), v).collect()


def test_checksums_checkpoints_and_runs(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    rows = [("x.bin", hashlib.sha256(b"abc").hexdigest()), ("y.bin", "0")]
    manifest = spark.createDataFrame(rows, "name string, sha256 string")
    assert [r.name for r in io.checksum_failures(spark, f"{tmp_path}/f", manifest).collect()] == ["y.bin"]
    (tmp_path / "p.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in io.read_checkpoint(spark, f"{tmp_path}/p.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "q.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    assert [(r.line, r.value) for r in io.bad_lines(spark, f"{tmp_path}/q.jsonl", "a int").collect()] == [(3, '{"a": ')]
    with pytest.raises(Exception):
        io.read_checkpoint(spark, f"{tmp_path}/q.jsonl", "a int").collect()
    # Many splits of two files, with blank lines and a last line that does not end.
    text = [['{"a": %d}' % i if i % 7 else "" if i % 3 else '{"a": %d' % i for i in range(n)] for n in (400, 91)]
    for name, rows in zip("xy", text, strict=True):
        (tmp_path / f"{name}.jsonl").write_bytes("\n".join(rows).encode())
    want = {(f"{name}.jsonl", i + 1, v) for name, rows in zip("xy", text, strict=True) for i, v in enumerate(rows) if v and not v.endswith("}")}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in ("100", "777", held):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        found = io.bad_lines(spark, f"{tmp_path}/[xy].jsonl", "a int")
        assert {(r.file.split("/")[-1], r.line, r.value) for r in found.collect()} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    (tmp_path / "run-001.json").write_text('{"a": 1}\n')
    assert io.read_runs(spark, str(tmp_path), "a int", 1).first().run == 1
    with pytest.raises(ValueError, match="2"):
        io.read_runs(spark, str(tmp_path), "a int", 2)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x_y")], "a int, b double, c string")
    io.write_csv(df, f"{tmp_path}/csv", ["c", "a", "z"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["c", "a", "z"]
    with pytest.raises(Exception):
        io.write_csv(df, f"{tmp_path}/csv", ["a"])
    io.write_gzip_json(df, f"{tmp_path}/gz")
    io.append_batch(df, f"{tmp_path}/gz")
    assert spark.read.json(f"{tmp_path}/gz").count() == 2
    assert r"x\_y" in io.latex_table(df) and "--" in io.latex_table(df)
    doc = spark.createDataFrame([("q", "2", "B", "r2", None), ("q", "1", "A", "r1", "o")], "quarter string, key string, title string, rule string, owner string")
    assert io.documentation(doc, "quarter").first().markdown.startswith("## A\n\nr1\n\nOwner: o\n\n## B")


def test_models(spark):
    rows = spark.createDataFrame([("1", "q", [("r", "because")]), ("2", "q", [])], "id string, question string, retrieved array<struct<id:string,final_answer:string>>")
    out = {r.id: r for r in M.decisions(rows, M.NearestAnswer()).collect()}
    assert out["1"].answer == "because" and out["1"].evidence_ids == ["r"] and out["2"].abstain and out["2"].answer == ""
    judged = spark.createDataFrame([("1", "a  b", "a b"), ("2", "a", "b")], "id string, answer string, reference string")
    assert {r.id: r.covered for r in M.judgments(judged, M.NearestAnswer()).collect()} == {"1": True, "2": False}


def test_retries_and_fail_safe():
    waits, answers = [], iter([ConnectionError(), M.Malformed(), {"ok": 1}])

    def ask():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert M.Retry(sleep=waits.append).call(ask) == {"ok": 1} and waits == [1.0, 2.0]
    for bad in ({}, {"abstain": False, "reason": "x"}, {"abstain": False, "reason": "x", "answer": "a"}):
        with pytest.raises(M.Malformed):
            M.checked_decision(bad)
    assert M.checked_decision({"abstain": True, "reason": "r"})["evidence_ids"] == []
    with pytest.raises(M.Malformed):
        M.checked_judgment({"covered": True, "confidence": 2, "reason": ""})


def test_each_kind_of_failure_has_its_own_retries():
    waits = []
    rule = M.Retries(M.Backoff(2, 5.0, 8.0), M.Backoff(1), M.Backoff(1, 3.0), M.Backoff(1, 1.0), sleep=waits.append, draw=lambda: 0.0)

    def failing(*errors):
        left = list(errors)

        def ask():
            if left:
                raise left.pop(0)
            return {"ok": 1}

        return ask

    assert rule.call(failing(M.Throttled(), M.Unavailable(), TimeoutError(), M.Malformed(), M.Throttled(after=0.5))) == {"ok": 1}
    assert waits == [2.5, 2.5, 1.5, 0.5, 0.5]
    waits.clear()
    with pytest.raises(M.Throttled):
        rule.call(failing(*[M.Throttled()] * 3))
    assert waits == [2.5, 4.0]  # the second wait is bounded
    with pytest.raises(M.Unavailable):
        rule.call(failing(M.Unavailable(), M.Unavailable()))
    with pytest.raises(KeyError):
        rule.call(failing(KeyError("x")))
    assert [M.Backoff(9, 1.0, 100.0).wait(n, 0.0) for n in (1, 2, 7, 8, 9)] == [0.5, 1.0, 32.0, 32.0, 32.0]


def test_calls_run_side_by_side_within_their_bound():
    lock, now, most, begun = threading.Lock(), [0], [0], []

    def call(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            begun.append((i, M.current_call()["stage"]))
        time.sleep(0.02 * (1 + i % 3))
        with lock:
            now[0] -= 1
        if i == 30:
            raise ValueError("thirty")
        return {"i": i}

    with M.call_context(stage="decide"):
        start = time.perf_counter()
        got = list(M.in_order((partial(call, i) for i in range(24)), 6))
        took = time.perf_counter() - start
    assert [x["i"] for x in got] == list(range(24)) and most[0] == 6 and took < 24 * 0.04 / 2
    assert {s for _, s in begun} == {"decide"}
    begun.clear()
    with M.call_context(stage="x"), pytest.raises(ValueError, match="thirty"):
        list(M.in_order((partial(call, i) for i in range(28, 1000)), 3))
    assert len(begun) <= 7
    with pytest.raises(ValueError):
        list(M.in_order([], 0))


def test_slow_models_side_by_side_in_spark(spark):
    class Slow:
        """Answers late, and not at all where the question says so."""

        def decide(self, question, retrieved):
            time.sleep(0.05)
            return {} if question == "bad" else {"answer": question, "abstain": False, "evidence_ids": [], "reason": "late"}

    rows = spark.createDataFrame([(str(i), "bad" if i == 7 else f"q{i}", []) for i in range(40)], "id string, question string, retrieved array<struct<id:string,final_answer:string>>")
    quick = M.Retries(malformed=M.Backoff(1, 0.0), sleep=lambda s: None)
    out = {r.id: r for r in M.decisions(rows, Slow(), quick, calls=8, width=4).collect()}
    assert len(out) == 40 and all(r.answer == f"q{i}" for i, r in out.items() if i != "7") and out["7"].abstain
    assert M.decisions(rows, Slow(), quick, calls=8, width=4).rdd.getNumPartitions() <= 2
    with pytest.raises(ValueError):
        M.decisions(rows, Slow(), quick, calls=2, width=4)


def test_samples_rules_and_text(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 400, "drift").otherwise("stable").alias("s"))
    got = {r.s: r["count"] for r in G.stratified(df, "id", "s", 20, 1).groupBy("s").count().collect()}
    assert got == {"drift": 8, "stable": 12}
    asked = spark.createDataFrame([("k", 0), ("k", 2), ("k", 5)], "k string, at int")
    changes = spark.createDataFrame([("k", 2, "b"), ("k", 4, "c")], "k string, since int, rule string")
    assert {r["at"]: r.rule for r in G.as_of(asked, changes, "k", "at", "since", "rule", F.lit("a")).collect()} == {0: "a", 2: "b", 5: "c"}
    v = G.clustered_vectors(spark, 60, 8, 20, 0.01, 7)
    assert v.count() == 60 and v.filter("v is null").isEmpty()
    t = spark.createDataFrame([("  A\n b ", "abcd", "bcde")], "x string, a string, b string")
    r = t.select(X.collapsed(F.col("x")).alias("c"), X.slug(F.lit("-A b!c-")).alias("s"), X.matching_ratio(F.col("a"), F.col("b")).alias("r"), X.html_escaped(F.lit("<a&'\">")).alias("h")).first()
    assert (r.c, r.s, r.r, r.h) == ("A b", "a-b-c", 0.75, "&lt;a&amp;&#39;&quot;&gt;")
