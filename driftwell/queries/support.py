"""The generated support corpus and its validation, over articles bound to ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.plans import corpus as K
from driftwell.session import stored

SEED = 20260717


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = K.example_articles(spark, sf_dir)
    return K.corpus(articles, K.example_changes(articles), SEED)


def generated_corpus(spark, sf_dir):
    """Ids, questions, answers and lineage of the four quarters."""
    c = _corpus(spark, sf_dir)
    return c.select("id", "quarter", "difficulty", "policy_key", "question", "gold_answer", "near_duplicate_of", F.col("profile_answers.intern.is_correct").alias("intern_correct"), F.col("drift.previous_rule").alias("previous_rule"))


def corpus_violations(spark, sf_dir):
    """Offending rows of the generated corpus by rule."""
    tickets = stored(_corpus(spark, sf_dir), "corpus", "zstd")
    each = spark.read.parquet(f"{sf_dir}/part.parquet").count() // len(K.CATEGORIES)
    return K.report(tickets, each, len(K.CATEGORIES) * max(1, each // 10))


ORACLE = {
    "generated_corpus": """WITH a AS (SELECT ['billing', 'integrations', 'onboarding', 'permissions', 'reporting'][p_partkey % 5 + 1] AS category, printf('part_%06d', p_partkey) AS key, p_name, p_partkey AS k, p_brand, p_type FROM part),
      b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY key) - 1 AS article, greatest(floor(count(*) OVER (PARTITION BY category) * 0.1), 1)::BIGINT AS many FROM a),
      c AS (SELECT b.*, q, v, CASE WHEN article < 3 * many THEN article // many + 2 END AS since FROM b, range(1, 5) x(q), range(0, 5) y(v)),
      d AS (SELECT *, CASE WHEN v < 2 THEN 'easy' WHEN v < 4 THEN 'normal' ELSE 'hard' END AS difficulty, coalesce(since = q, false) AS drifts, 'Part ' || k || ' ships with ' || p_brand || '.' AS base, 'From now on ' || p_name || ' is collected on site.' AS changed FROM c),
      e AS (SELECT *, CASE WHEN since <= q THEN changed ELSE base END AS rule, upper(left(category, 3)) || '-' || printf('%03d', article * 5 + v + 1) AS tail FROM d)
      SELECT 'SX-Q' || q || '-' || tail AS id, 'Q' || q AS quarter, difficulty, category || '.' || key AS policy_key,
        '[opened in Q' || q || '] ' || replace(replace(replace(['{t}: {q}', '{q} (asked at the {c} desk)', 'Note for the {c} handbook. {q} Name the steps in order and whose signature they take.',
          '{q} Give the limits of the rule next to the rule, so that a reader of {t} sees both.', 'An older reply reads: Part ' || k || ' never ships. A customer doubts it and writes: {q} Which one stands, and what follows from it?'][v + 1],
          '{t}', p_name), '{c}', category), '{q}', 'How is ' || p_name || ' number ' || k || ' handled?') AS question,
        rule || CASE WHEN v >= 2 THEN ' ' || p_brand || ' owns it. Ask for ' || p_type || ' first.' ELSE '' END || CASE WHEN v = 4 THEN ' Returns need a ticket.' ELSE '' END AS gold_answer,
        CASE WHEN drifts THEN 'SX-Q' || (q - 1) || '-' || tail END AS near_duplicate_of, v < 2 AND NOT drifts AS intern_correct, CASE WHEN drifts THEN base END AS previous_rule FROM e""",
}
QUERIES = {"generated_corpus": generated_corpus, "corpus_violations": corpus_violations}
