import json

from driftwell import __main__ as cli
from driftwell.operators import controller as C
from driftwell.plans import report as P
from driftwell.plans import session_fold as D
from driftwell.plans import trace as T
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_export_of_matched_conditions(spark, tmp_path):
    traces = {}
    for name, c in (("slow", T.CONDITION), ("flat", C.Condition(least_observations=5, review=3, decay=1.0))):
        t = T.trace(spark, SF, c).withColumn("run", F.col("user_id") % 5).withColumn("position", F.struct("position", "user_id"))
        for cohort in ("0", "1"):
            traces[cohort, name] = t.filter(F.col("user_id") % 2 == int(cohort))
    folder = f"file://{tmp_path}/export"
    manifest = P.export(spark, traces, folder, "run", ("slow", "flat"))
    assert len(manifest["tables"]) == 6 and all(f["sha256"] and f["bytes"] > 0 for f in manifest["files"])
    runs = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/per-run-results")
    assert runs.count() == 20 and {"sc_accepted_of", "final_fea", "reliability_observations"} <= set(runs.columns)
    paired = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/paired-comparisons").collect()
    assert len(paired) == 8 and all(r.n == 5 and r.holm_p >= r.p for r in paired)
    audit = json.loads((tmp_path / "export" / "judge-audit.json").read_text())
    assert len(audit) == 4 and sum(a["recorded"] for a in audit) == 2 * T.trace(spark, SF).filter("not extra").count()


def test_session_fold(spark):
    told = [("save", True), ("save", False), ("save", True), ("auto", True), ("reviews", True), ("toggle", True), ("auto", True), ("toggle", True), ("auto", True), ("auto", True),
            ("escalate", True), ("escalate", True), ("intervene", True), ("auto", True), ("reset", True)]
    events = spark.createDataFrame([("s", i, a, g) for i, (a, g) in enumerate(told)], "session string, n int, action string, agrees boolean")
    out = D.fold(events).orderBy("n").collect()
    assert [r.applied for r in out] == [True, True, False, False, True, True, False, True, True, False, True, False, True, False, True]
    assert round(out[0].fea, 9) == round((0.9 * 8.6 + 1) / (0.9 * 10 + 1), 9) and not out[1].gate_open and out[4].gate_open
    assert [r.memory for r in out][:10] == [3, 4, 4, 4, 4, 4, 4, 4, 5, 5] and out[8].authority == "model" and out[12].authority == "human"
    assert (out[14].memory, out[14].observations, out[14].log) == (2, 18, 0)


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "retrieve_topk" in capsys.readouterr().out
    assert cli.main(["run", "decay_titles", SF, "--out", f"file://{tmp_path}/o"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/o").count() == 4
