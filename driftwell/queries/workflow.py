"""The decision workflow with its own memory over ``embeddings``: each vector is a ticket, in three shuffled repetitions.

Answers feed later answers through the memory, which SQL does not express; the tests hold the traces against a plain
simulation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions import vectors as V
from driftwell.operators import controller as C
from driftwell.operators import generation as G
from driftwell.operators import index as I
from driftwell.operators import retrieval as R
from driftwell.operators import summaries as S
from driftwell.operators.models import NearestAnswer
from driftwell.plans import long_runs as LR
from driftwell.plans import workflow as W
from driftwell.queries import retrieval as E

RUNS, SEED = 3, 20260717
#: The vectors have no clusters, so a search must probe much of the index to reach a recall of 0.9.
LISTS, PROBES = 24, 16
CONDITION = C.Condition(alpha=0.3, beta=0.1, gamma=0.35, least_observations=5, review=10)
SEARCH = W.Search(k=5, tau=0.2)


def tickets(spark: SparkSession, sf_dir: str, c: C.Condition = CONDITION) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.col("vec_id")
    rows = e.select(i, "label", V.normalised(F.col("embedding")).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(RUNS))).alias("repetition"))
    rows = rows.withColumn("quarter_number", (1 + i % 4).cast("int"))
    order = G.shuffle_key(i + F.col("repetition") * 7919, SEED)
    rows = rows.withColumn("quarter_position", F.row_number().over(Window.partitionBy("repetition", "quarter_number").orderBy(order, "vec_id")))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("repetition").orderBy("quarter_number", "quarter_position")))
    rows = rows.withColumn("extra", i % 29 == 0).withColumn("in_domain", F.col("label") % 5 == 0)
    difficulty = F.when(i % 5 < 2, "easy").when(i % 5 < 4, "normal").otherwise("hard")
    rows = rows.withColumn("difficulty", difficulty).withColumn("coin", (i * 7919 + F.col("repetition")) % 2 == 0)
    rows = rows.withColumn("bootstrap", C.in_bootstrap(F.col("quarter_number"), F.col("extra"), c)).withColumn("review", C.in_review(F.col("quarter_position"), F.col("extra"), c))
    rows = rows.withColumn("profile", C.routed(F.col("bootstrap"), F.col("review"), F.col("difficulty"), F.col("in_domain"), F.col("coin"), c))
    right = C.human_is_correct(F.col("profile"), F.col("in_domain"), i % 10 < 8, i % 10 < 7)
    gold = F.format_string("Answer %d", F.col("label") % 3)
    return rows.withColumn("human_correct", right).select(
        "repetition", "position", "quarter_position", F.format_string("T%06d", i).alias("id"), F.format_string("Q%d", "quarter_number").alias("quarter"),
        F.format_string("c%d", F.col("label") % 5).alias("category"), "difficulty", "profile", "review", "bootstrap", F.format_string("Question %d?", i).alias("question"),
        gold.alias("gold_answer"), F.when(F.col("human_correct"), gold).otherwise("Wrong").alias("human_answer"), "human_correct",
        ((F.col("quarter_number") > 1) & (i % 4 == 0)).alias("is_drift"), F.lit(None).cast("string").alias("near_duplicate_of"), "extra", "coin", "v",
    )


def workflow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticket's outcome under the three-state controller."""
    t = LR.rollout(tickets(spark, sf_dir), CONDITION, NearestAnswer(), SEARCH)
    return t.select(
        "repetition", "global_position", "ticket_id", "state_before", "state_after", "suggestion_accepted", "gold_judgment_reused", "model_evidence_is_valid",
        F.size("retrieved").alias("retrieved"), F.round("fea_after", 9).alias("fea_after"), "final_answer", "final_origin", "metric_component", "final_decision_error",
    )


def baseline_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticket's outcome without a controller: trusted phases, then the model unless it abstains."""
    t = LR.rollout(tickets(spark, sf_dir), CONDITION, NearestAnswer(), SEARCH, baseline=True)
    return t.select("repetition", "global_position", "ticket_id", "phase", F.size("retrieved").alias("retrieved"), "final_answer", "final_origin", "metric_component", "final_decision_error")


def workflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by group over the three repetitions."""
    t = W.in_trace_terms(LR.rollout(tickets(spark, sf_dir), CONDITION, NearestAnswer(), SEARCH))
    out = S.over_runs(S.summary(t, "repetition"))
    return out.select("grp", "label", "decisions", "errors", *[F.round(x, 9).alias(x) for x in ("mean_rate", "sd_rate_pop", "pooled_rate")])


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = E.memory(spark, sf_dir)
    return E.asked(m), I.candidates(E.asked(m), m, I.fit(m, LISTS), E.RULE, E.LIMIT, PROBES)


def ann_candidates_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of an index search, ranked by decayed score."""
    _, found = _indexed(spark, sf_dir)
    return E._out(R.rerank(found.drop("rank", "score"), E.RULE))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of the exact candidates that the index search finds."""
    q, found = _indexed(spark, sf_dir)
    truth = R.semantic_candidates(q, E.memory(spark, sf_dir), E.RULE, E.LIMIT)
    return I.recall(found, truth).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"))


QUERIES = {"ann_candidates_rerank": ann_candidates_rerank, "ann_recall": ann_recall, "workflow_trace": workflow_trace, "baseline_trace": baseline_trace, "workflow_summary": workflow_summary}
