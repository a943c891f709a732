"""The decision trace: tickets bound to the ``events`` table, folded into one row per processed ticket.

A user is a repetition, an event a ticket; phases and answers are integer arithmetic on ids, so any engine
can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.operators import controller as C

CONDITION = C.Condition(least_observations=5, review=3)


def tickets(spark: SparkSession, sf_dir: str, c: C.Condition = CONDITION) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    e = e.withColumn("quarter", F.least(F.lit(4), 1 + F.floor(day * 2 / 15)).cast("int"))
    i = F.col("event_id")
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    within = F.row_number().over(Window.partitionBy("user_id", "quarter").orderBy("event_id"))
    t = e.select(
        "user_id",
        "event_id",
        position.alias("position"),
        "quarter",
        within.alias("quarter_position"),
        F.col("event_type").alias("category"),
        F.when(i % 5 < 2, "easy").when(i % 5 < 4, "normal").otherwise("hard").alias("difficulty"),
        (i % 23 == 0).alias("extra"),
        ((F.col("quarter") > 1) & (i % 4 == 0)).alias("is_drift"),
        (F.col("event_type") == "signup").alias("abstain"),
        (F.col("event_type") != "error").alias("covers"),
        (i % 7 != 0).alias("gold_correct"),
        (i % 3 == 0).alias("in_domain"),
        ((i * 7919 + F.col("user_id") * 104729) % 2 == 0).alias("coin"),
    )
    t = t.withColumn("bootstrap", C.in_bootstrap(F.col("quarter"), F.col("extra"), c)).withColumn("review", C.in_review(F.col("quarter_position"), F.col("extra"), c))
    t = t.withColumn("profile", C.routed(F.col("bootstrap"), F.col("review"), F.col("difficulty"), F.col("in_domain"), F.col("coin"), c, i * 13 % 3))
    # The trusted profile's answer is the gold answer, so covering it is being correct: one judgment serves for both.
    t = t.withColumn("gold_correct", F.when(F.col("profile") == "ceo", F.col("covers")).otherwise(F.col("gold_correct")))
    t = t.withColumn("human_correct", C.human_is_correct(F.col("profile"), F.col("in_domain"), (i * 37) % 10 < 8, (i * 37) % 10 < 7))
    gold = F.format_string("Answer %s Q%d", "category", "quarter")
    wrong = F.when(i % 2 == 0, F.format_string("Wrong %s", "category")).otherwise(F.format_string("Other %s", "category"))
    said = F.when(F.col("gold_correct"), F.format_string("  Answer\t%s  Q%d ", "category", "quarter")).otherwise(F.format_string("Wrong  %s", "category"))
    return t.select(
        "*",
        gold.alias("gold_answer"),
        F.when(F.col("human_correct"), gold).otherwise(wrong).alias("human_answer"),
        F.when(~F.col("abstain"), said).alias("model_answer"),
    )


def trace(spark: SparkSession, sf_dir: str, c: C.Condition = CONDITION, answers: bool = True) -> DataFrame:
    """One row per ticket; ``fea_*`` are reliabilities, ``final_error`` the outcome; ``gold_reused`` where one judgment served twice.

    Without ``answers`` the three answer texts are left out before the shuffle and the fold.
    """
    return traces(spark, sf_dir, {"": c}, answers).drop("condition")


def traces(spark: SparkSession, sf_dir: str, conditions: dict[str, C.Condition], answers: bool = True) -> DataFrame:
    """The trace of each condition, which ``condition`` names, from one pass over the tickets; all must route alike."""
    one = next(iter(conditions.values()))
    rows = tickets(spark, sf_dir, one)
    t = C.fold_each(rows if answers else rows.drop("gold_answer", "human_answer", "model_answer"), "user_id", conditions)
    called, judged = F.lit(one.enabled), F.lit(one.enabled) & ~F.col("abstain")
    return t.select(
        "*",
        (~F.col("final_is_correct")).alias("final_error"),
        F.when(called & F.col("extra"), F.col("abstain")).alias("model_action_is_correct"),
        judged.alias("judged"),
        (judged & (F.col("profile") == "ceo") & (F.col("state_before") != "DS")).alias("gold_reused"),
    )


def tickets_sql(c: C.Condition = CONDITION) -> str:
    return f"""
t0 AS (SELECT *, least(4, 1 + floor(date_diff('day', DATE '2024-01-01', ts::DATE) * 2 / 15.0))::INTEGER AS quarter FROM events),
t1 AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS position, quarter,
    row_number() OVER (PARTITION BY user_id, quarter ORDER BY event_id)::INTEGER AS quarter_position, event_type AS category,
    CASE WHEN event_id % 5 < 2 THEN 'easy' WHEN event_id % 5 < 4 THEN 'normal' ELSE 'hard' END AS difficulty,
    event_id % 23 = 0 AS extra, quarter > 1 AND event_id % 4 = 0 AS is_drift, event_type = 'signup' AS abstain, event_type <> 'error' AS covers,
    event_id % 7 <> 0 AS gold_correct, event_id % 3 = 0 AS in_domain, (event_id * 7919 + user_id * 104729) % 2 = 0 AS coin FROM t0),
t2 AS (SELECT *, NOT extra AND quarter_position <= {c.review} AS review, false AS bootstrap FROM t1),
t3 AS (SELECT *, CASE WHEN review OR difficulty = 'hard' THEN 'ceo' WHEN in_domain THEN 'domain_expert' WHEN difficulty = 'easy' THEN 'intern'
    WHEN coin THEN 'ceo' ELSE 'domain_expert' END AS profile FROM t2),
t AS (SELECT * REPLACE (CASE WHEN profile = 'ceo' THEN covers ELSE gold_correct END AS gold_correct), CASE profile WHEN 'ceo' THEN true
    WHEN 'intern' THEN (event_id * 37) % 10 < 8 ELSE in_domain OR (event_id * 37) % 10 < 7 END AS human_correct FROM t3)"""


def trace_sql(c: C.Condition = CONDITION) -> str:
    """Recursive SQL for the same trace under the gold regime, as CTE ``trace``."""
    d = f"{c.decay!r}::DOUBLE"
    return f"""WITH RECURSIVE {tickets_sql(c)},
s AS (
  SELECT user_id, 0 AS position, 'SO' AS state_after, 0.0::DOUBLE AS numerator, 0.0::DOUBLE AS denominator, 0 AS observations_after, 0.0::DOUBLE AS fea_after,
    NULL::VARCHAR AS state_before, NULL::BOOLEAN AS accepted, NULL::INTEGER AS observation, 0 AS observations_before, 0.0::DOUBLE AS fea_before, NULL::BOOLEAN AS was_reset
  FROM t GROUP BY user_id
  UNION ALL
  SELECT user_id, position,
    CASE WHEN extra OR quarter_position < {c.review} THEN sb
         WHEN sb = 'SO' AND fea > {c.alpha}::DOUBLE AND obs >= {c.least_observations} THEN 'SC'
         WHEN sb = 'SC' AND fea < {c.beta}::DOUBLE THEN 'SO' WHEN sb = 'SC' AND fea > {c.gamma}::DOUBLE THEN 'DS' ELSE sb END,
    num, den, obs, fea, sb, CASE WHEN sb = 'SC' AND NOT abstain AND NOT covers THEN gold_correct END, seen, obs0, fea0, was_reset
  FROM (SELECT *, CASE WHEN den > 0 THEN num / den ELSE 0.0::DOUBLE END AS fea FROM (
    SELECT *, CASE WHEN seen IS NULL THEN num0 ELSE {d} * num0 + seen END AS num, CASE WHEN seen IS NULL THEN den0 ELSE {d} * den0 + 1.0::DOUBLE END AS den,
      obs0 + (seen IS NOT NULL)::INTEGER AS obs FROM (
      SELECT *, CASE WHEN abstain OR sb = 'DS' THEN NULL WHEN sb = 'SC' AND NOT covers THEN gold_correct::INTEGER ELSE covers::INTEGER END AS seen FROM (
        SELECT t.*, s.numerator AS num0, s.denominator AS den0, s.observations_after AS obs0, s.fea_after AS fea0,
          t.quarter_position = 1 AND s.state_after = 'DS' AND NOT t.extra AS was_reset,
          CASE WHEN t.quarter_position = 1 AND s.state_after = 'DS' AND NOT t.extra THEN 'SC' ELSE s.state_after END AS sb
        FROM s JOIN t ON t.user_id = s.user_id AND t.position = s.position + 1))))),
trace0 AS (SELECT t.*, s.* EXCLUDE (user_id, position) FROM t JOIN s USING (user_id, position)),
graded AS (SELECT user_id, position, avg(gold_correct::INTEGER) OVER w AS m, least({c.gold_window}, count(*) OVER w) AS n FROM trace0
    WHERE NOT abstain AND state_before <> 'DS' WINDOW w AS (PARTITION BY user_id ORDER BY position ROWS {c.gold_window - 1} PRECEDING)),
trace AS (SELECT * EXCLUDE (m, n), last_value(m IGNORE NULLS) OVER w AS recent_gold, coalesce(last_value(n IGNORE NULLS) OVER w, 0) AS recent_graded FROM (
  SELECT z.*, NOT final_is_correct AS final_error, CASE WHEN extra THEN abstain END AS model_action_is_correct, NOT abstain AS judged,
    NOT abstain AND profile = 'ceo' AND state_before <> 'DS' AS gold_reused,
    CASE WHEN state_before <> state_after THEN CASE WHEN quarter_position = {c.review} THEN 'quarterly_ceo_review_completion' ELSE 'reliability_threshold' END
         WHEN was_reset THEN 'quarterly_ceo_review' END AS trigger, m, n FROM (
  SELECT *, CASE WHEN state_before = 'DS' AND NOT abstain THEN 'model' WHEN state_before = 'DS' THEN 'human_on_abstention'
      WHEN accepted THEN 'human_revised_to_model' ELSE 'human' END AS final_origin,
    CASE WHEN state_before = 'DS' THEN 'autonomous_model' ELSE 'assisted' END AS component,
    CASE WHEN NOT abstain AND (state_before = 'DS' OR accepted) THEN gold_correct ELSE human_correct END AS final_is_correct
  FROM trace0) z LEFT JOIN graded USING (user_id, position)) WINDOW w AS (PARTITION BY user_id ORDER BY position ROWS UNBOUNDED PRECEDING))
"""
