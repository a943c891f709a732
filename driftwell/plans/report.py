"""Statistics of matched conditions, exported: one folder of CSV tables, an audit and a manifest with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import statistics as X
from driftwell.operators import summaries as S
from driftwell.sources.jobs import artifact_manifest, write_json

PRIMARY = ("final_error_pct", "stable_error_pct", "drift_error_pct", "model_finalized_pct")
KEYS = ("cohort", "controller")


def per_run(traces: dict[tuple[str, str], DataFrame], run: str) -> DataFrame:
    """One row per cohort, controller and run."""
    rows = None
    for (cohort, controller), trace in traces.items():
        part = S.per_run_metrics(trace, run).withColumn("cohort", F.lit(cohort)).withColumn("controller", F.lit(controller))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def summary(runs: DataFrame) -> DataFrame:
    """Mean, deviation, interval and extremes of every percentage and count, by condition."""
    names = [f.name for f in runs.schema.fields if f.name.endswith(("_pct", "_count", "_of")) or f.name == "final_fea"]
    rows = runs.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("_m")).select(*KEYS, "_m.*")
    return X.describe(rows, "value", *KEYS, "metric")


def tested(spark: SparkSession, diffs: DataFrame, run: str, by: tuple[str, ...], block: tuple[str, ...] = ()) -> DataFrame:
    """Differences ``(run, *by, diff)`` described, with exact p, Holm's correction within each block, and effect size."""
    p = X.holm(X.sign_flip(spark, diffs, run, *by), "p", *block)
    described = X.describe(diffs, "diff", *by)
    return described.join(p, list(by)).withColumn("dz", X.effect_size(F.col("mean"), F.col("sd_samp")))


def export(spark: SparkSession, traces: dict[tuple[str, str], DataFrame], folder: str, run: str, pair: tuple[str, str]) -> dict:
    """Write all tables; ``pair`` names the two controllers that are compared run by run in each cohort."""
    runs = per_run(traces, run).persist()
    tables = {"per-run-results": runs, "condition-summary": summary(runs)}
    paired = None
    for cohort in sorted({c for c, _ in traces}):
        a, b = (runs.filter((F.col("cohort") == cohort) & (F.col("controller") == name)) for name in pair)
        part = X.paired(a, b, run, list(PRIMARY)).withColumn("cohort", F.lit(cohort))
        paired = part if paired is None else paired.unionByName(part)
    tables["paired-comparisons"] = tested(spark, paired, run, ("cohort", "metric"), ("cohort",))
    for name, left, right in (("baseline-comparisons", "final_error_pct", "human_only_error_pct"), ("controller-comparisons", "replay_error_pct", "final_error_pct")):
        tables[name] = tested(spark, runs.select(run, *KEYS, (F.col(left) - F.col(right)).alias("diff")), run, KEYS)
    states = runs.groupBy(*KEYS).pivot("final_state", ["SO", "SC", "DS"]).count().fillna(0)
    tables["final-states"] = states
    for name, rows in tables.items():
        rows.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")  # small: runs times metrics
    audits = [S.judge_audit(t).withColumn("cohort", F.lit(c)).withColumn("controller", F.lit(k)) for (c, k), t in traces.items() if "model_answer" in t.columns]
    audit = [r.asDict() for part in audits for r in part.collect()]  # one row a condition
    write_json(spark, f"{folder}/judge-audit.json", audit)
    files = [r.asDict() for r in artifact_manifest(spark, folder).collect()]  # a few files a table
    manifest = {"tables": sorted(tables), "files": files}
    write_json(spark, f"{folder}/manifest.json", manifest)
    runs.unpersist()
    return manifest
