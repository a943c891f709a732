import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import controller as C
from driftwell.operators import models as M
from driftwell.operators import reliability as L
from driftwell.operators import trajectories as J
from driftwell.plans import long_runs as R
from driftwell.plans import workflow as W
from driftwell.queries import workflow as Q

SF = "/root/testdata/sf0.001"


def told(rows):
    """Traces with floats rounded, by repetition and position."""

    def plain(x):
        if isinstance(x, float):
            return round(x, 9)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return [plain(r.asDict(recursive=True)) for r in rows.orderBy("repetition", "global_position").collect()]


@pytest.fixture(scope="module")
def tickets(spark):
    # The second repetition is shorter than the first.
    return Q.tickets(spark, SF).filter("repetition = 1 and position <= 45 or repetition = 2 and position <= 28").cache()


@pytest.mark.parametrize("baseline", [False, True])
def test_chunks_equal_one_fold(spark, tickets, tmp_path, baseline):
    whole = told(W.rollout(tickets, Q.CONDITION, M.NearestAnswer(), Q.SEARCH, baseline))
    run = R.LongRun(spark, f"file://{tmp_path}/run").prepare(tickets, Q.CONDITION, Q.SEARCH, baseline, chunk=13)
    heard = []
    assert run.play(M.NearestAnswer(), most=2, told=lambda *x: heard.append(x)) == 2 and heard == [(1, 4), (2, 4)]
    assert told(run.trace()) == [x for x in whole if x["global_position"] <= 26]
    # Another process goes on; what had ended is not played again.
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/run/trace/chunk=0/*.parquet").select("path", "modificationTime").collect()
    (tmp_path / "run/trace/chunk=2").mkdir()  # a chunk that was cut short
    (tmp_path / "run/trace/chunk=2/part-0.json").write_text("x")
    again = R.LongRun(spark, f"file://{tmp_path}/run").prepare(tickets, Q.CONDITION, Q.SEARCH, baseline, chunk=13)
    assert again.play(M.NearestAnswer()) == 0 and told(again.trace()) == whole
    assert files == spark.read.format("binaryFile").load(f"file://{tmp_path}/run/trace/chunk=0/*.parquet").select("path", "modificationTime").collect()
    with pytest.raises(ValueError, match="other settings"):
        again.prepare(tickets, Q.CONDITION, Q.SEARCH, baseline, chunk=14)


def test_odd_runs(spark, tickets, tmp_path):
    empty = tickets.limit(0)
    assert R.rollout(empty, Q.CONDITION, M.NearestAnswer(), Q.SEARCH, folder=f"file://{tmp_path}/empty").count() == 0
    with pytest.raises(ValueError, match="positions"):
        R.rollout(tickets.filter("position <> 3"), Q.CONDITION, M.NearestAnswer(), Q.SEARCH, folder=f"file://{tmp_path}/gap")
    with pytest.raises(Exception, match="never null"):
        bad = tickets.withColumn("v", F.when(F.col("position") != 4, F.col("v")))
        R.rollout(bad, Q.CONDITION, M.NearestAnswer(), Q.SEARCH, folder=f"file://{tmp_path}/null")
    off = C.Condition(enabled=False, strategy="single", single_profile="ceo")
    assert {r.metric_component for r in R.rollout(tickets, off, M.NearestAnswer(), Q.SEARCH, chunk=20, folder=f"file://{tmp_path}/off").collect()} == {"unassisted_human"}


def test_sums_along_runs_in_blocks(spark):
    rng = np.random.default_rng(5)
    data = [("a", i * 3, int(rng.integers(0, 9)), bool(rng.integers(2))) for i in range(500)] + [("b", 7, 2, True), (None, 1, 4, False), (None, 90, 5, True)]
    rows = spark.createDataFrame(data, "run string, at long, x int, hit boolean").repartition(7)
    want, sums, seen = {}, {}, {}
    for run, at, x, hit in data:
        sums[run] = sums.get(run, 0) + x
        n, h = seen.get(run, (0, 0))
        seen[run] = n, h = (n + (x > 3), h + (x > 3 and hit))
        want[run, at] = (sums[run], round(h / n, 12) if n else -1.0)
    for size in (1, 10, 64, 1 << 20):
        got = J.prefix_sums(rows, "run", {"s": F.col("x")}, "at", size=size)
        rate = J.running_rates(rows, "run", {"r": (F.col("hit"), F.col("x") > 3, -1.0)}, "at", ("x",), size)
        assert {(r.run, r["at"]): r.s for r in got.collect()} == {k: v[0] for k, v in want.items()}
        assert {(r.run, r["at"]): round(r.r, 12) for r in rate.collect()} == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("decay", [1.0, 0.9999, 0.5])
def test_reliability_in_blocks_equals_the_fold(spark, decay):
    data = [("a", i + 1, float(i * 7 % 3 == 0)) for i in range(203)] + [("b", 1, 1.0)]
    num, den, want = {"a": 2.0, "b": 2.0}, {"a": 3.0, "b": 3.0}, {}
    for run, n, x in data:
        num[run], den[run] = decay * num[run] + x, decay * den[run] + 1
        want[run, n] = num[run] / den[run]
    rows = spark.createDataFrame(data, "run string, n int, x double").repartition(5)
    for most in (1, 8, 100, 1 << 20):
        got = L.running(rows, "run", "x", "n", decay, (2.0, 3.0), most)
        assert got.columns == ["run", "n", "x", "fea"]
        assert {(r.run, r.n): r.fea for r in got.collect()} == pytest.approx(want, abs=1e-12)


def test_a_fold_over_many_batches_equals_one_fold_a_run(spark):
    """Runs of unequal length, one without a name, in batches that cut through them."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    c = C.Condition(0.5, 0.3, 0.6, 3, 2, 0.9)
    for run, n in ((1, 120), (2, 1), (None, 33), (4, 70)):
        control = C.Controller(c)
        for p in range(1, n + 1):
            x = (1 + (p - 1) % 25, *(bool(v) for v in rng.random(7) < (0.05, 0.05, 0.2, 0.7, 0.7, 0.6, 0.5)))
            rows.append((run, p, *x))
            want[run, p] = control.step(*x)
    tickets = spark.createDataFrame(rows, "run int, position int, quarter_position int, " + ", ".join(f"{x} boolean" for x in C.INPUTS[1:])).orderBy(F.rand(1))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {(r.run, r.position): r for r in C.fold(tickets, "run", c).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    names = [x.split()[0] for x in C.STEP.split(", ")]
    assert got.keys() == want.keys()
    for k, out in want.items():
        assert [got[k][x] for x in names] == list(out)
