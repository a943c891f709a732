"""Queries around results: gates, bands, titles, strategy summaries, fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions import labels as B
from driftwell.operators import reliability as L
from driftwell.operators import retrieval as R
from driftwell.operators import trajectories as J
from driftwell.plans import trace as T
from driftwell.queries import retrieval as Q
from driftwell.queries.decisions import RUN, observations

#: The demonstration's decay, start and gate.
DEMO_DECAY, DEMO_NUM, DEMO_DEN, DEMO_SEEN, DEMO_LEAST, DEMO_FEA = 0.9, 8.6, 10.0, 18, 20, 0.8


def reliability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability that starts from an earlier state, and when its gate is open."""
    rows = L.running(observations(spark, sf_dir), RUN, "delta", "n", DEMO_DECAY, start=(DEMO_NUM, DEMO_DEN))
    return rows.select(RUN, "event_id", F.round("fea", 9).alias("fea"), ((F.col("n") + DEMO_SEEN >= DEMO_LEAST) & (F.col("fea") > DEMO_FEA)).alias("open"))


def score_bands(spark, sf_dir):
    points = J.pointwise(T.trace(spark, sf_dir, answers=False), "position", "fea_after")
    low, high = B.band(F.col("mean"), F.col("sd_pop"))
    return points.select("position", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def decay_titles(spark, sf_dir):
    """Vectors by the title of their condition: their place names the decay of retrieval, their label that of reliability."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    decays = F.array(*[F.lit(x) for x in Q.LAMBDAS])

    def decay(name: str):
        return F.get(decays, F.pmod(F.col(name), F.lit(len(Q.LAMBDAS))).cast("int"))

    return e.groupBy(B.decay_title(decay("vec_id"), decay("label")).alias("title")).agg(F.count("*").alias("n"))


def resource_types(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = B.resource_type(F.col("p_type"), {"STANDARD": "profile", "SMALL": "model"}, "custom")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def strategy_summary(spark, sf_dir):
    """Per strategy: queries, mean horizon, its share of the memory and mean candidates returned."""
    m = Q.memory(spark, sf_dir)
    q = Q.asked(m)
    sizes = q.select("qid", (F.col("qins") - 1).alias("size"))
    out = None
    for name, found, horizon in (
        ("exhaustive", R.retrieve(q, m, Q.RULE, R.EXHAUSTIVE), F.col("size")),
        ("fixed_recency", R.fixed_recency(q, m, Q.RULE, Q.WINDOW), F.least(F.col("size"), F.lit(Q.WINDOW).cast("long"))),
    ):
        n = found.groupBy(F.col("qid").alias("_q")).agg(F.count("*").alias("n"))
        rows = sizes.join(n, F.col("qid") == F.col("_q"), "left").select(horizon.alias("h"), "size", F.coalesce("n", F.lit(0)).alias("n"))
        share = F.avg(F.when(F.col("size") > 0, F.col("h") / F.when(F.col("size") > 0, F.col("size")).otherwise(1)))
        part = rows.agg(F.count("*").alias("queries"), F.round(F.avg("h"), 9).alias("mean_horizon"), F.round(share, 9).alias("share"), F.round(F.avg("n"), 9).alias("mean_hits"), F.round(F.stddev_pop("n"), 9).alias("sd_hits_pop"))
        part = part.select(F.lit(name).alias("strategy"), "*")
        out = part if out is None else out.union(part)
    return out


def smoke_fixture(spark, sf_dir):
    """A stale record, the last ten distractors and the current record of each user."""
    t = T.tickets(spark, sf_dir).select(RUN, "event_id", "position", "category")
    last = t.groupBy(F.col(RUN).alias("_u")).agg(F.max("position").alias("_last"))
    t = t.join(last, F.col(RUN) == F.col("_u"))
    stale = t.filter("position = 1").withColumn("part", F.lit("stale"))
    distract = t.filter("position > 1 and position < _last and position >= _last - 10").withColumn("part", F.lit("distractor"))
    now = t.filter("position = _last and _last > 1").withColumn("part", F.lit("current"))
    return stale.unionByName(distract).unionByName(now).select(RUN, "event_id", "part")


def event_log(spark, sf_dir):
    """Structured log lines of a run's state changes, as JSON with sorted fields."""
    t = T.trace(spark, sf_dir, answers=False).filter("state_before <> state_after")
    line = F.to_json(F.struct(F.lit("transition").alias("event"), F.col("position"), F.col("state_after").alias("to"), F.col(RUN)))
    return t.select(RUN, "position", line.alias("line"))


_P = Q._pairs()
ORACLE = {
    "reliability_gate": f"""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS delta FROM events),
      f AS (SELECT user_id, -1::BIGINT AS event_id, 0::BIGINT AS n, {DEMO_NUM}::DOUBLE AS a, {DEMO_DEN}::DOUBLE AS b FROM o GROUP BY user_id
        UNION ALL SELECT o.user_id, o.event_id, o.n, {DEMO_DECAY}::DOUBLE * f.a + o.delta, {DEMO_DECAY}::DOUBLE * f.b + 1 FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
      SELECT user_id, event_id, round(a / b, 9) AS fea, n + {DEMO_SEEN} >= {DEMO_LEAST} AND a / b > {DEMO_FEA}::DOUBLE AS open FROM f WHERE n > 0""",
    "score_bands": T.trace_sql() + "SELECT position, round(greatest(0.0::DOUBLE, avg(fea_after) - stddev_pop(fea_after)), 9) AS low, round(least(1.0::DOUBLE, avg(fea_after) + stddev_pop(fea_after)), 9) AS high FROM trace GROUP BY position",
    "decay_titles": f"""SELECT CASE WHEN a < 1 AND b < 1 THEN 'decay' WHEN a < 1 THEN 'retrieval decay only' WHEN b < 1 THEN 'reliability decay only' ELSE 'no decay' END AS title, count(*) AS n
      FROM (SELECT [{', '.join(map(str, Q.LAMBDAS))}][vec_id % 5 + 1] AS a, [{', '.join(map(str, Q.LAMBDAS))}][label % 5 + 1] AS b FROM embeddings) GROUP BY 1""",
    "resource_types": "SELECT CASE WHEN starts_with(p_type, 'STANDARD') THEN 'profile' WHEN starts_with(p_type, 'SMALL') THEN 'model' ELSE 'custom' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "strategy_summary": f"WITH {_P}, "
    + "r AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, q.qid, {h} AS h, q.qins - 1 AS size, coalesce(n, 0) AS n FROM q LEFT JOIN (SELECT qid, count(*) AS n FROM ({s}) GROUP BY qid) USING (qid)"
        for n, h, s in (("exhaustive", "q.qins - 1", Q._TRUTH), ("fixed_recency", f"least(q.qins - 1, {Q.WINDOW})", Q._RECENT))
    )
    + ") SELECT strategy, count(*) AS queries, round(avg(h), 9) AS mean_horizon, round(avg(h::DOUBLE / nullif(size, 0)), 9) AS share, round(avg(n), 9) AS mean_hits, round(stddev_pop(n), 9) AS sd_hits_pop FROM r GROUP BY strategy",
    "smoke_fixture": f"WITH {T.tickets_sql()}, l AS (SELECT *, max(position) OVER (PARTITION BY user_id) AS last FROM t) SELECT user_id, event_id, CASE WHEN position = 1 THEN 'stale' WHEN position = last THEN 'current' ELSE 'distractor' END AS part FROM l WHERE position = 1 OR position >= last - 10",
    "event_log": T.trace_sql() + """SELECT user_id, position, '{"event":"transition","position":' || position || ',"to":"' || state_after || '","user_id":' || user_id || '}' AS line FROM trace WHERE state_before <> state_after""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
