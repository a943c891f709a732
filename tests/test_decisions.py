import math

import pytest
from pyspark.sql import functions as F

from driftwell.operators import controller as C
from driftwell.operators import statistics as X
from driftwell.plans import experiment as E
from driftwell.plans import trace as T

SF = "/root/testdata/sf0.001"


def steps(c, tickets):
    ctl = C.Controller(c)
    return [ctl.step(*t) for t in tickets], ctl


def test_fading_accuracy():
    ctl = C.Controller(C.Condition(decay=0.5))
    ctl.observe(1)
    ctl.observe(0)
    assert (ctl.num, ctl.den, round(ctl.fea, 9)) == (0.5, 1.5, round(1 / 3, 9))


def test_reaches_autonomy_one_step_a_ticket():
    c = C.Condition(0.5, 0.1, 0.9, 1, 0, 1.0, "always")
    out, _ = steps(c, [(i, False, False, False, True, True, True, False) for i in (1, 2, 3)])
    assert [(o[0], o[1]) for o in out] == [("SO", "SC"), ("SC", "DS"), ("DS", "DS")] and out[2][10] == "model"


def test_never_accepting_stays_out_of_autonomy():
    c = C.Condition(0.5, 0.1, 0.9, 1, 0, 1.0, "never")
    out, _ = steps(c, [(i, False, False, False, True, True, True, False) for i in (1, 2, 3)])
    assert [o[1] for o in out] == ["SC", "SC", "SC"]


def test_abstention_observes_nothing_and_quarters_reset():
    c = C.Condition(0.5, 0.1, 0.9, 1, 2, 1.0)
    seen = [(p, False, False, False, True, True, True, False) for p in (1, 2, 3, 4, 1, 2)]
    out, _ = steps(c, seen)
    assert [o[1] for o in out] == ["SO", "SC", "DS", "DS", "SC", "DS"]
    assert out[4][13] == "quarterly_ceo_review" and out[5][13] == "quarterly_ceo_review_completion"
    ctl = C.Controller(c, "SC", 1.0, 1.0, 1)
    assert ctl.step(5, False, False, True, True, True, False, False)[3] is None and ctl.obs == 1


def test_disabled_system_leaves_humans_alone():
    out, _ = steps(C.Condition(enabled=False, strategy="single", single_profile="intern"), [(1, False, False, False, False, True, False, False)])
    assert out[0][10:13] == ("human", "unassisted_human", False)


def test_condition_limits():
    for bad in ({"alpha": 0.5, "beta": 0.6}, {"gamma": 0.1}, {"decay": 0}, {"acceptance": "maybe"}, {"strategy": "single"}, {"single_profile": "ceo"}, {"enabled": False}, {"strategy": "round"}):
        with pytest.raises(ValueError):
            C.Condition(**bad)


def test_sql_fold_equals_python_fold(spark):
    t = T.tickets(spark, SF)
    end = {r.user_id: tuple(r)[1:5] for r in C.final_states(t, "user_id", T.CONDITION).collect()}
    rows = C.fold(t, "user_id", T.CONDITION).groupBy("user_id").agg(F.max_by(F.struct("state_after", "numerator", "denominator", "observations_after"), "position").alias("s")).collect()
    assert end == {r.user_id: tuple(r.s) for r in rows}


def test_row_order_does_not_matter(spark):
    t = T.tickets(spark, SF)
    a = C.fold(t, "user_id", T.CONDITION).select("event_id", "state_after", "fea_after")
    b = C.fold(t.orderBy(F.desc("position")).repartition(3, "event_id"), "user_id", T.CONDITION).select("event_id", "state_after", "fea_after")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_interval_sign_flip_and_holm(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(1, 11)] + [("b", i, 1.0) for i in range(10)] + [("c", 0, 1.0), ("c", 1, -1.0)], "m string, k int, diff double")
    d = {r.m: r for r in X.describe(rows, "diff", "m").collect()}
    assert (d["a"].mean, round(d["a"].sd_samp, 10), round(d["a"].ci_low, 6), round(d["a"].ci_high, 6)) == (5.5, 3.0276503541, 3.334149, 7.665851)
    p = {r.m: r.p for r in X.sign_flip(spark, rows, "k", "m").collect()}
    assert p["b"] == 2 / 1024 and p["c"] == 1.0
    q = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.20,)], "p double")
    assert {r.p: round(r.holm_p, 9) for r in X.holm(q, "p").collect()} == {0.01: 0.04, 0.04: 0.09, 0.03: 0.09, 0.20: 0.20}
    assert math.isclose(spark.range(1).select(X.t_quantile(F.lit(30))).first()[0], 2.042272, abs_tol=1e-5)


def test_unpaired_runs_are_an_error(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, m double")
    with pytest.raises(Exception, match="no partner"):
        X.paired(a, a.filter("k = 1"), "k", ["m"]).collect()


def test_resume_equals_a_full_run(spark, tmp_path):
    t = T.tickets(spark, SF).filter("user_id = 0")
    reps = E.repetitions(t, 3, seed=5)
    full = E.run(reps, T.CONDITION)
    folder = f"file://{tmp_path}/job"
    assert {r.status for r in E.progress(spark, folder, reps).collect()} == {"queued"}
    E.save(full.filter("repetition = 1 or (repetition = 2 and position <= 7)"), folder, T.CONDITION, "job")
    assert {r.repetition: r.status for r in E.progress(spark, folder, reps).collect()} == {1: "completed", 2: "running", 3: "queued"}
    out = E.resume(spark, folder, reps, T.CONDITION)
    cols = ("repetition", "position", "event_id", "state_after", "fea_after", "final_origin")
    assert out.select(*cols).exceptAll(full.select(*cols)).isEmpty() and out.count() == full.count()
    assert {r.status for r in E.progress(spark, folder, reps).collect()} == {"completed"}
    first = E.reusable_prefix(out, reps, T.CONDITION, T.CONDITION)
    assert first.count() == reps.filter("quarter = 1").count()
    with pytest.raises(ValueError, match="other tickets"):
        E.reusable_prefix(out, reps.withColumn("covers", ~F.col("covers")), T.CONDITION, T.CONDITION)


def test_stream_equals_batch(spark, tmp_path):
    from driftwell.streaming import controller as S

    t = T.tickets(spark, SF).filter("user_id < 3")
    for i, part in enumerate(("position <= 10", "position > 8 and position <= 30", "position > 30")):  # the second repeats two positions
        t.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
        S.to_folder(S.controlled(live, "user_id", T.CONDITION), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    cols = ("user_id", "position", "state_before", "state_after", "observations_after", "fea_after", "final_origin")
    got, want = spark.read.parquet(f"{tmp_path}/out").select(*cols), C.fold(t, "user_id", T.CONDITION).select(*cols)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_windowed_stream(spark, tmp_path):
    from driftwell.streaming import controller as S

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    S.to_folder(S.windowed_counts(live), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert 0 < spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] <= e.count()


def test_conditions_side_by_side_equal_a_fold_each(spark):
    t = T.tickets(spark, SF)
    conditions = {"slow": T.CONDITION, "never": C.Condition(least_observations=5, review=3, acceptance="never"), "flat": C.Condition(least_observations=3, review=3, decay=1.0)}
    both = C.fold_each(t, "user_id", conditions)
    for name, c in conditions.items():
        got, want = both.filter(F.col("condition") == name).drop("condition"), C.fold(t, "user_id", c)
        assert got.schema == want.schema and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert both.count() == 3 * t.count() and C.fold_each(t.limit(0), "user_id", conditions).count() == 0
    with pytest.raises(ValueError):
        C.fold_each(t, "user_id", {"a": T.CONDITION, "b": C.Condition(review=4)})
    with pytest.raises(ValueError):
        C.fold_each(t, "user_id", {"a": T.CONDITION}, "category")
