"""Queries over the decision trace (see ``plans.trace``): reliability, controller, summaries, trajectories, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.operators import controller as C
from driftwell.operators import reliability as L
from driftwell.operators import statistics as X
from driftwell.operators import summaries as S
from driftwell.operators import trajectories as J
from driftwell.plans import trace as T
from driftwell.session import stored

DECAY, RUN = 0.99861, "user_id"
PAIRED = C.Condition(alpha=0.6, gamma=0.75, least_observations=3, review=3, decay=1.0)
METRICS = ["final_error_pct", "stable_error_pct", "drift_error_pct", "model_finalized_pct"]
#: Matched statistics compare ten runs of a condition; run r is the tickets of all users whose id ends in r.
RUNS = 10
#: Rows of a block where all tickets are one run; small, so that the sample tables have several.
WHOLE_BLOCK = 4096
#: Two cohorts of users (by the tens of their ids) under four controllers.
CONDITIONS = [(cohort, name, c) for cohort in (0, 1) for name, c in (
    ("slow", T.CONDITION), ("flat", C.Condition(least_observations=5, review=3, decay=1.0)),
    ("eager", C.Condition(alpha=0.6, gamma=0.75, least_observations=3, review=3)), ("eager flat", PAIRED))]


def r9(name: str):
    return F.round(name, 9).alias(name)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace without the answer texts, which only the judges' audit reads."""
    return T.trace(spark, sf_dir, answers=False)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select("user_id", "event_id", n.alias("n"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("delta"))


def fea_final(spark, sf_dir):
    return L.final(observations(spark, sf_dir), RUN, "delta", "n", DECAY).select(RUN, "observations", r9("fea"))


def fea_running(spark, sf_dir):
    return L.running(observations(spark, sf_dir), RUN, "delta", "n", DECAY).select(RUN, "event_id", r9("fea"))


def fea_running_fold(spark, sf_dir):
    """A decay of one half, where prefix sums over a whole run would overflow."""
    return L.running(observations(spark, sf_dir), RUN, "delta", "n", 0.5).select(RUN, "event_id", r9("fea"))


def recent_gold_window(spark, sf_dir):
    """Mean of the last 30 answers graded beside a human (SO and SC), at each such ticket."""
    t = _steps(spark, sf_dir).filter(F.col("judged") & (F.col("state_before") != "DS"))
    mean = L.trailing_mean(F.col("gold_correct").cast("double"), RUN, "position", T.CONDITION.gold_window)
    return t.select(RUN, "position", F.round(mean, 9).alias("recent_gold"))


def controller_states(spark, sf_dir):
    out = C.final_states(T.tickets(spark, sf_dir), RUN, T.CONDITION)
    return out.select(RUN, "state", "observations", r9("fea"))


def trace(spark, sf_dir):
    t = _steps(spark, sf_dir)
    return t.select(RUN, "event_id", "position", "quarter", "quarter_position", "profile", "state_before", "state_after", "accepted", "observation",
                    "observations_after", "final_origin", "component", "final_error", "trigger", "gold_reused", "recent_graded", r9("recent_gold"), r9("fea_before"), r9("fea_after"))


def controller_transitions(spark, sf_dir):
    return S.transitions(_steps(spark, sf_dir), RUN).select(RUN, "position", "quarter", "from_state", "to_state", "cause", "observations", r9("fea"), r9("recent_gold"), "recent_graded", r9("fea_minus_gold"))


def transition_summary(spark, sf_dir):
    out = S.transition_summary(S.transitions(_steps(spark, sf_dir), RUN))
    return out.select("transition", "n", *[r9(f"mean_{x}") for x in ("observations", "position", "fea", "recent_gold", "fea_minus_gold")])


def quarter_reset(spark, sf_dir):
    t = _steps(spark, sf_dir).filter("quarter_position = 1")
    return t.groupBy("quarter", "state_before").agg(F.count("*").alias("runs"))


def final_origin_mix(spark, sf_dir):
    return _steps(spark, sf_dir).groupBy("final_origin", "component").agg(F.count("*").alias("n"))


def baseline_phase(spark, sf_dir):
    """The controller-free workflow: trusted answers in two phases, else the model's unless it abstains."""
    t = T.tickets(spark, sf_dir)
    phase = C.baseline_phase(F.col("quarter"), F.col("quarter_position"), F.col("extra"), T.CONDITION.review)
    t = t.withColumn("phase", phase)
    origin = F.when(F.col("phase") == "bootstrap", "ceo_bootstrap").when(F.col("phase") == "review", "ceo_review").when(F.col("abstain"), "human_on_abstention").otherwise("model")
    wrong = F.when(F.col("phase") != "rag", False).when(F.col("abstain"), ~F.col("human_correct")).otherwise(~F.col("gold_correct"))
    return t.select("phase", origin.alias("origin"), wrong.alias("wrong")).groupBy("phase", "origin").agg(F.count("*").alias("n"), F.count_if("wrong").alias("errors"))


def profile_routing(spark, sf_dir):
    return T.tickets(spark, sf_dir).groupBy("review", "difficulty", "in_domain", "profile").agg(F.count("*").alias("n"))


def human_answer_pick(spark, sf_dir):
    return T.tickets(spark, sf_dir).select("event_id", "profile", "human_correct")


def acceptance_outcomes(spark, sf_dir):
    """What each regime would accept of conflicting suggestions."""
    t = T.tickets(spark, sf_dir).filter("not abstain and not covers")
    coin = (F.col("event_id") * 31 + F.col("user_id") * 17) % 2 == 0
    regimes = [F.struct(F.lit(r).alias("regime"), C.accepted(r, F.col("gold_correct"), coin).alias("taken")) for r in ("always", "never", "gold", "stochastic")]
    rows = t.withColumn("_r", F.explode(F.array(*regimes)))
    return rows.groupBy("_r.regime").agg(F.count("*").alias("n"), F.count_if("_r.taken").alias("taken"))


def evidence_validity(spark, sf_dir):
    """Cited ids are the ticket's predecessor and, for every tenth ticket, one that was never retrieved."""
    t = T.tickets(spark, sf_dir)
    i = F.col("event_id")
    retrieved = F.sequence(F.greatest(F.lit(0).cast("long"), i - 5), i)
    cited = F.when(i % 10 == 0, F.array(i - 1, i + 1)).when(i % 7 == 0, F.array().cast("array<long>")).otherwise(F.array(i - 1))
    return t.filter("event_id > 0").select("event_id", C.evidence_is_valid(cited, retrieved).alias("valid"))


def model_actions(spark, sf_dir):
    t = T.tickets(spark, sf_dir)
    phase = C.baseline_phase(F.col("quarter"), F.col("quarter_position"), F.col("extra"), T.CONDITION.review)
    action = C.model_action(F.col("user_id") % 10 != 9, phase == "rag", F.col("abstain"))
    return t.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def replay_error(spark, sf_dir):
    wrong = C.replay_error(F.lit(True), F.col("abstain"), F.lit(False), ~F.col("human_correct"), F.col("gold_correct"))
    return T.tickets(spark, sf_dir).groupBy(RUN).agg(F.count("*").alias("tickets"), F.count_if(wrong).alias("replay_errors"))


def ticket_summary_groups(spark, sf_dir):
    return S.summary(_steps(spark, sf_dir)).select("grp", "label", "decisions", "errors", r9("error_rate"))


def profile_drift_rates(spark, sf_dir):
    return ticket_summary_groups(spark, sf_dir).filter("grp = 'profile_drift'")


def repetition_aggregate(spark, sf_dir):
    out = S.over_runs(S.summary(_steps(spark, sf_dir), RUN))
    return out.select("grp", "label", "decisions", "errors", r9("mean_rate"), r9("sd_rate_pop"), r9("pooled_rate"))


def scope_counts(spark, sf_dir):
    """Overall, by quarter, by drift, and by both."""
    t = _steps(spark, sf_dir)
    drift = F.when(F.col("is_drift"), "drift").otherwise("stable")
    t = t.withColumn("scope", F.explode(F.array(*[F.struct(q.alias("quarter"), d.alias("drift")) for q in (F.lit(0), F.col("quarter")) for d in (F.lit("all"), drift)])))
    return S.scope_counts(t, "scope").select("scope.*", *S.SCOPE)


def count_distribution(spark, sf_dir):
    per_run = S.scope_counts(_steps(spark, sf_dir), RUN, "quarter")
    out = S.count_distribution(per_run, "model_abstentions", "quarter")
    return out.select("quarter", "total", r9("mean"), r9("sd_pop"), "least", "most")


def rate_distribution(spark, sf_dir):
    per_run = S.scope_counts(_steps(spark, sf_dir), RUN, "quarter")
    out = S.rate_distribution(per_run, "final_errors", "final_decisions", "quarter")
    return out.select("quarter", r9("mean_rate"), r9("sd_rate_pop"), r9("pooled_rate"))


def sc_acceptance(spark, sf_dir):
    out = S.rate_distribution(S.suggestions(_steps(spark, sf_dir), RUN), "taken", "decisions")
    return out.select(r9("mean_rate"), r9("sd_rate_pop"), r9("pooled_rate"))


def _metrics(spark, sf_dir):
    return S.per_run_metrics(_steps(spark, sf_dir), RUN)


def per_run_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(*[r9(f.name) if f.dataType.simpleString() == "double" else f.name for f in m.schema.fields])


def _runs(spark, sf_dir, conditions, *by):
    """The metrics of ten runs that share all users among them, with their fingerprints, by condition.

    All conditions come from one pass over the tickets.  What is kept is a row a run, written and read back, since the
    statistics read it several times.
    """
    t = T.traces(spark, sf_dir, conditions, answers=False).withColumn("run", F.col(RUN) % RUNS).withColumns(dict(by))
    t = t.withColumn("assignment", F.xxhash64(RUN, "event_id", "position", "profile")).withColumn("position", F.struct("position", RUN))
    return stored(S.per_run_metrics(t, "condition", *[name for name, _ in by], "run").coalesce(1), "runs")


def condition_summary(spark, sf_dir):
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in METRICS]))
    out = X.describe(_runs(spark, sf_dir, {"slow": T.CONDITION}).select(pairs.alias("_m")).select("_m.*"), "value", "metric")
    return out.select("metric", "n", *[r9(c) for c in ("mean", "sd_samp", "least", "most", "ci_low", "ci_high")])


def final_state_pivot(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("cohort", F.col(RUN) % 3)
    out = m.groupBy("cohort").pivot("final_state", ["SO", "SC", "DS"]).count().fillna(0)
    return out.select("cohort", "SO", "SC", "DS")


def judge_audit(spark, sf_dir):
    out = S.judge_audit(T.trace(spark, sf_dir))
    return out.select(*[r9(f.name) if f.name.endswith("_pct") else f.name for f in out.schema.fields])


def order_fingerprint(spark, sf_dir):
    return S.fingerprint(T.tickets(spark, sf_dir), RUN, "event_id", "profile")


def latency_percentiles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    out = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd_pop"), p.alias("p"))
    return out.select("event_type", r9("mean"), r9("sd_pop"), F.round(F.col("p")[0], 9).alias("p50"), F.round(F.col("p")[1], 9).alias("p95"))


def _running(spark, sf_dir, hit, counted, name, empty):
    rates = J.running_rates(_steps(spark, sf_dir), RUN, {name: (hit, counted, empty)})
    return rates.select(RUN, "position", r9(name))


def whole_run_rates(spark, sf_dir):
    """All tickets as one run in the order of their ids, in blocks of 4,096: share of drift, of trusted answers, and unfading reliability."""
    t = T.tickets(spark, sf_dir).withColumn("whole", F.lit(0))
    rates = {"drift_rate": (F.col("is_drift"), ~F.col("extra"), None), "ceo_rate": (F.col("profile") == "ceo", F.lit(True), None)}
    rows = J.running_rates(t, "whole", rates, "event_id", ("covers",), WHOLE_BLOCK)
    # Places from 1 are a prefix sum too.
    place = J.prefix_sums(rows.withColumn("delta", F.when(F.col("covers"), 1.0).otherwise(0.0)), "whole", {"n": F.lit(1)}, "event_id", ("drift_rate", "ceo_rate", "delta"), WHOLE_BLOCK)
    out = L.running(place, "whole", "delta", "n", 1.0, most=WHOLE_BLOCK)
    return out.select("event_id", "n", r9("drift_rate"), r9("ceo_rate"), r9("fea"))


def cumulative_error(spark, sf_dir):
    return _running(spark, sf_dir, F.col("final_error"), ~F.col("extra"), "error_rate", 0.0)


def cumulative_human_error(spark, sf_dir):
    return _running(spark, sf_dir, ~F.col("human_correct"), ~F.col("extra"), "human_error_rate", 0.0)


def cumulative_llm_gold_error(spark, sf_dir):
    return _running(spark, sf_dir, ~F.col("gold_correct"), ~F.col("abstain") & ~F.col("extra"), "llm_error_rate", None)


def cumulative_replay_error(spark, sf_dir):
    return _running(spark, sf_dir, J.replay_error(), F.lit(True), "replay_rate", None)


def cumulative_abstention_success(spark, sf_dir):
    return _running(spark, sf_dir, F.col("abstain"), F.col("extra"), "success_rate", None)


def pointwise_mean_std(spark, sf_dir):
    out = J.pointwise(_steps(spark, sf_dir), "position", "fea_after")
    return out.select("position", r9("mean"), r9("sd_pop"), "runs")


def averaged_trajectories(spark, sf_dir):
    return J.averaged(_steps(spark, sf_dir), RUN).select("label", "position", r9("mean"), r9("sd_pop"))


def quarter_ranges(spark, sf_dir):
    return J.ranges(T.tickets(spark, sf_dir), RUN, "quarter")


def state_ranges(spark, sf_dir):
    return J.ranges(_steps(spark, sf_dir), RUN, "state_after")


def drift_rate_by_quarter(spark, sf_dir):
    """Mean drift share over the quarters that have any drift, required abstentions aside."""
    per = T.tickets(spark, sf_dir).filter("not extra").groupBy(RUN, "quarter").agg(F.count("*").alias("n"), F.count_if("is_drift").alias("d")).filter("d > 0")
    return per.groupBy(RUN).agg(F.round(F.avg(F.col("d") / F.col("n")), 9).alias("drift_rate"))


def last_non_null(spark, sf_dir):
    t = _steps(spark, sf_dir).withColumn("v", F.when(F.col("position") % 3 == 0, F.lit(float("nan"))).when(F.col("position") % 5 != 0, F.col("fea_after")))
    return J.last_value(t, RUN, "v").select(RUN, r9("v"))


def _diffs(spark, sf_dir):
    runs = _runs(spark, sf_dir, {"slow": T.CONDITION, "paired": PAIRED})
    slow, paired = (runs.filter(F.col("condition") == name) for name in ("slow", "paired"))
    return X.paired(slow, paired, "run", METRICS, equal=("tickets", "assignment"))


def paired_differences(spark, sf_dir):
    return _diffs(spark, sf_dir).select("run", "metric", r9("diff"))


def student_t_ci(spark, sf_dir):
    out = X.describe(_diffs(spark, sf_dir), "diff", "metric")
    return out.select("metric", "n", r9("mean"), r9("ci_low"), r9("ci_high"))


def sign_flip_p(spark, sf_dir):
    return X.sign_flip(spark, _diffs(spark, sf_dir), "run", "metric").select("metric", r9("p"))


def holm_adjust(spark, sf_dir):
    return X.holm(X.sign_flip(spark, _diffs(spark, sf_dir), "run", "metric"), "p").select("metric", r9("p"), r9("holm_p"))


def cohens_dz(spark, sf_dir):
    out = X.describe(_diffs(spark, sf_dir), "diff", "metric")
    return out.select("metric", F.round(X.effect_size(F.col("mean"), F.col("sd_samp")), 9).alias("dz"))


def factorial_contrasts(spark, sf_dir):
    """Two factors, decay and thresholds, of the final error."""
    conditions = {
        f"{a}{b}": C.Condition(base.alpha, base.beta, base.gamma, base.least_observations, 3, decay)
        for a, decay in enumerate((DECAY, 1.0))
        for b, base in enumerate((T.CONDITION, PAIRED))
    }
    cells = _runs(spark, sf_dir, conditions)
    cells = cells.select("run", *[F.substring("condition", i + 1, 1).cast("int").alias(x) for i, x in enumerate("ab")], "final_error_pct")
    out = X.describe(X.contrasts(cells, "run", "final_error_pct"), "diff", "contrast")
    return out.select("contrast", "n", r9("mean"), r9("sd_samp"))


def _against(spark, sf_dir, left, right):
    """Mean difference of two percentages in eight conditions, exact tests corrected over all eight."""
    cohort = (F.floor(F.col(RUN) / 10) % 2).cast("int")
    rows = _runs(spark, sf_dir, {name: c for _, name, c in CONDITIONS}, ("cohort", cohort))
    rows = rows.select("run", "cohort", F.col("condition").alias("controller"), (F.col(left) - F.col(right)).alias("diff"))
    by = ("cohort", "controller")
    p = X.holm(X.sign_flip(spark, rows, "run", *by), "p")
    return p.join(X.describe(rows, "diff", *by), list(by)).select(*by, "n", r9("mean"), F.round(X.effect_size(F.col("mean"), F.col("sd_samp")), 9).alias("dz"), r9("p"), r9("holm_p"))


def baseline_comparisons(spark, sf_dir):
    """Final minus human-only error."""
    return _against(spark, sf_dir, "final_error_pct", "human_only_error_pct")


def controller_comparisons(spark, sf_dir):
    """Model-first replay minus final error."""
    return _against(spark, sf_dir, "replay_error_pct", "final_error_pct")


def _tr(select: str, c: C.Condition = T.CONDITION) -> str:
    return T.trace_sql(c) + select


def _tk(select: str) -> str:
    return f"WITH {T.tickets_sql()} {select}"


_W = "OVER (PARTITION BY user_id ORDER BY position ROWS UNBOUNDED PRECEDING)"


def _run_sql(hit: str, counted: str, name: str, empty: str) -> str:
    n = f"sum(CASE WHEN {counted} THEN 1 ELSE 0 END) {_W}"
    return _tr(f"SELECT user_id, position, CASE WHEN {n} > 0 THEN round((sum(CASE WHEN ({counted}) AND ({hit}) THEN 1 ELSE 0 END) {_W})::DOUBLE / ({n}), 9) ELSE {empty}::DOUBLE END AS {name} FROM trace")


_OBS = "o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS delta FROM events)"


def _fold_sql(decay: float) -> str:
    return f"""WITH RECURSIVE {_OBS}, f AS (SELECT user_id, -1::BIGINT AS event_id, 0::BIGINT AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM o GROUP BY user_id
      UNION ALL SELECT o.user_id, o.event_id, o.n, {decay}::DOUBLE * f.a + o.delta, {decay}::DOUBLE * f.b + 1 FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)"""


_DRIFT = "CASE WHEN is_drift THEN 'drift' ELSE 'stable' END"
_GROUPS = {
    "overall": "'all'", "quarter": "'Q' || quarter", "profile": "profile", "state": "state_before", "category": "category", "difficulty": "difficulty", "component": "component",
    "drift": _DRIFT, "profile_drift": f"profile || '.' || {_DRIFT}", "component_drift": f"component || '.' || {_DRIFT}",
}
_LABELS = ", g AS (" + " UNION ALL ".join(f"SELECT user_id, final_error AS error, '{k}' AS grp, {v} AS label FROM trace WHERE NOT extra" for k, v in _GROUPS.items()) + " UNION ALL SELECT user_id, NOT model_action_is_correct, 'abstention_challenge', 'Extra' FROM trace WHERE model_action_is_correct IS NOT NULL)"
_SUMMARY = "count(*) AS decisions, count(*) FILTER (error) AS errors"
_TRANSITIONS = """, w AS (SELECT *, coalesce(lag(state_after) OVER o, 'SO') AS was, lag(recent_gold) OVER o AS g, coalesce(lag(recent_graded) OVER o, 0) AS k FROM trace WINDOW o AS (PARTITION BY user_id ORDER BY position)),
x0 AS (SELECT user_id, position, quarter, was AS from_state, state_before AS to_state, 'quarterly_ceo_review' AS cause, observations_before AS observations, fea_before AS fea, g AS recent_gold, k AS recent_graded FROM w WHERE was <> state_before
      UNION ALL SELECT user_id, position, quarter, state_before, state_after, trigger, observations_after, fea_after, recent_gold, recent_graded FROM w WHERE state_before <> state_after),
x AS (SELECT *, CASE WHEN to_state = 'DS' THEN fea - recent_gold END AS fea_minus_gold FROM x0)"""
_SCOPES = "count(*) AS tickets, count(*) AS model_decisions, count(*) FILTER (abstain) AS model_abstentions, count(*) FILTER (NOT extra) AS final_decisions, count(*) FILTER (NOT extra AND final_error) AS final_errors, count(*) FILTER (extra) AS required_abstentions, count(*) FILTER (extra AND abstain) AS correct_abstentions"


def _pct(hit: str, of: str = "true") -> str:
    return f"CASE WHEN count(*) FILTER ({of}) > 0 THEN count(*) FILTER (({of}) AND ({hit})) * 100.0::DOUBLE / count(*) FILTER ({of}) END"


_SCOPED = {
    "human_only_error": ("true", "NOT human_correct"), "final_error": ("true", "final_error"), "llm_gold_error": ("NOT abstain", "NOT gold_correct"),
    "replay_error": ("true", "CASE WHEN abstain THEN NOT human_correct ELSE NOT gold_correct END"), "stable_error": ("NOT is_drift", "final_error"),
    "drift_error": ("is_drift", "final_error"), "model_finalized": ("true", "component = 'autonomous_model'"),
    **{f"abstain_{s.lower()}": (f"state_before = '{s}'", "abstain") for s in ("SO", "SC", "DS")}, "sc_accepted": ("state_before = 'SC' AND accepted IS NOT NULL", "accepted"),
}
_WHOLE = {
    "tickets": "count(*)", **{f"assigned_{p}_count": f"count(*) FILTER (profile = '{p}')" for p in ("ceo", "domain_expert", "intern")},
    **{f"{k}_count": f"count(*) FILTER (({of}) AND ({hit}))" for k, (of, hit) in _SCOPED.items()}, **{f"{k}_of": f"count(*) FILTER ({of})" for k, (of, _) in _SCOPED.items()},
    "final_state": "arg_max(state_after, position)", "reliability_observations": "arg_max(observations_after, position)",
}
_RUNS = {**{f"{k}_pct": _pct(hit, of) for k, (of, hit) in _SCOPED.items()}, "final_fea": "arg_max(fea_after, position)"}


def _metrics_sql(c: C.Condition = T.CONDITION) -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in (_WHOLE | _RUNS).items())
    return _tr(f", runs AS (SELECT user_id, {cols} FROM trace WHERE NOT extra GROUP BY user_id) ", c)


def _sub(c: C.Condition, where: str = "true") -> str:
    """Percentages of the ten runs."""
    cols = ", ".join(f"{v} AS {k}" for k, v in _RUNS.items() if k != "final_fea")
    return f"({_tr(f'SELECT user_id % {RUNS} AS run, {cols} FROM trace WHERE NOT extra AND {where} GROUP BY 1', c)})"


_AB = f"WITH a AS {_sub(T.CONDITION)}, b AS {_sub(PAIRED)}"
_D = f"{_AB}, d AS ({' UNION ALL '.join(f'SELECT a.run, {chr(39)}{m}{chr(39)} AS metric, a.{m} - b.{m} AS diff FROM a JOIN b USING (run)' for m in METRICS)})"
_FLIP = """, i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run) - 1 AS i FROM d),
y AS (SELECT metric, mask, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN -diff ELSE diff END)) AS s FROM i, (SELECT unnest(range(1024)) AS mask) GROUP BY ALL),
p AS (SELECT metric, count(*) FILTER (s >= seen - 1e-11) / 1024.0::DOUBLE AS p FROM y JOIN (SELECT metric, abs(sum(diff)) AS seen FROM d GROUP BY metric) USING (metric) GROUP BY metric)"""
_HOLM = ", h AS (SELECT *, max(adj) OVER (ORDER BY p, metric ROWS UNBOUNDED PRECEDING) AS holm_p FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1) * p) AS adj FROM p))"
_T9 = 2.262157163


def _islands(source: str, label: str) -> str:
    return f"""SELECT user_id, {label}, min(position) AS first, max(position) AS last FROM (
      SELECT user_id, position, {label}, position - row_number() OVER (PARTITION BY user_id, {label} ORDER BY position) AS g FROM {source}) GROUP BY user_id, {label}, g"""


def _cell(a: int, decay: float, b: int, base: C.Condition) -> str:
    c = C.Condition(base.alpha, base.beta, base.gamma, base.least_observations, 3, decay)
    return f"c{a}{b} AS (SELECT run, final_error_pct AS v FROM {_sub(c)})"


_CELLS = "WITH " + ", ".join(_cell(a, d, b, base) for a, d in enumerate((DECAY, 1.0)) for b, base in enumerate((T.CONDITION, PAIRED)))
_EFFECTS = (("a at b=0", "c10", "c00"), ("a at b=1", "c11", "c01"), ("b at a=0", "c01", "c00"), ("b at a=1", "c11", "c10"))



def _against_sql(left: str, right: str) -> str:
    cells = " UNION ALL ".join(f"SELECT run, {cohort}::INTEGER AS cohort, '{name}' AS controller, {left} - {right} AS diff FROM {_sub(c, f'user_id // 10 % 2 = {cohort}')}" for cohort, name, c in CONDITIONS)
    flip = _FLIP.replace("i AS (SELECT *, row", "i AS (SELECT run, diff, cohort || controller AS metric, row").replace("PARTITION BY metric", "PARTITION BY cohort, controller")
    flip = flip.replace("(SELECT metric, abs(sum(diff)) AS seen FROM d GROUP BY metric)", "(SELECT cohort || controller AS metric, abs(sum(diff)) AS seen FROM d GROUP BY ALL)")
    return f"""WITH d AS ({cells}){flip}{_HOLM} SELECT s.cohort, s.controller, s.n, round(s.mean, 9) AS mean, round(dz, 9) AS dz, round(p, 9) AS p, round(holm_p, 9) AS holm_p FROM h
      JOIN (SELECT cohort, controller, count(diff) AS n, avg(diff) AS mean, CASE WHEN stddev_samp(diff) > 0 THEN avg(diff) / stddev_samp(diff) END AS dz FROM d GROUP BY ALL) s ON h.metric = s.cohort || s.controller"""


ORACLE = {
    "fea_final": f"WITH {_OBS} SELECT user_id, count(*) AS observations, round(sum(delta * w) / sum(w), 9) AS fea FROM (SELECT *, pow({DECAY}::DOUBLE, max(n) OVER (PARTITION BY user_id) - n) AS w FROM o) GROUP BY user_id",
    "fea_running": _fold_sql(DECAY) + " SELECT user_id, event_id, round(a / b, 9) AS fea FROM f WHERE n > 0",
    "fea_running_fold": _fold_sql(0.5) + " SELECT user_id, event_id, round(a / b, 9) AS fea FROM f WHERE n > 0",
    "recent_gold_window": _tr("SELECT user_id, position, round(avg(gold_correct::INTEGER) OVER (PARTITION BY user_id ORDER BY position ROWS 29 PRECEDING), 9) AS recent_gold FROM trace WHERE NOT abstain AND state_before <> 'DS'"),
    "controller_states": _tr("SELECT user_id, arg_max(state_after, position) AS state, arg_max(observations_after, position) AS observations, round(arg_max(fea_after, position), 9) AS fea FROM trace GROUP BY user_id"),
    "trace": _tr("SELECT user_id, event_id, position, quarter, quarter_position, profile, state_before, state_after, accepted, observation, observations_after, final_origin, component, final_error, trigger, gold_reused, recent_graded, round(recent_gold, 9) AS recent_gold, round(fea_before, 9) AS fea_before, round(fea_after, 9) AS fea_after FROM trace"),
    "controller_transitions": _tr(_TRANSITIONS + " SELECT user_id, position, quarter, from_state, to_state, cause, observations, round(fea, 9) AS fea, round(recent_gold, 9) AS recent_gold, recent_graded, round(fea_minus_gold, 9) AS fea_minus_gold FROM x"),
    "transition_summary": _tr(_TRANSITIONS + " SELECT from_state || '->' || to_state AS transition, count(*) AS n, round(avg(observations), 9) AS mean_observations, round(avg(position), 9) AS mean_position, round(avg(fea), 9) AS mean_fea, round(avg(recent_gold), 9) AS mean_recent_gold, round(avg(fea_minus_gold), 9) AS mean_fea_minus_gold FROM x GROUP BY 1"),
    "quarter_reset": _tr("SELECT quarter, state_before, count(*) AS runs FROM trace WHERE quarter_position = 1 GROUP BY ALL"),
    "final_origin_mix": _tr("SELECT final_origin, component, count(*) AS n FROM trace GROUP BY ALL"),
    "baseline_phase": _tk("""SELECT phase, origin, count(*) AS n, count(*) FILTER (wrong) AS errors FROM (SELECT phase, CASE phase WHEN 'bootstrap' THEN 'ceo_bootstrap' WHEN 'review' THEN 'ceo_review' ELSE CASE WHEN abstain THEN 'human_on_abstention' ELSE 'model' END END AS origin,
      phase = 'rag' AND CASE WHEN abstain THEN NOT human_correct ELSE NOT gold_correct END AS wrong FROM (SELECT *, CASE WHEN quarter = 1 AND NOT extra THEN 'bootstrap' WHEN NOT extra AND quarter_position <= 3 THEN 'review' ELSE 'rag' END AS phase FROM t)) GROUP BY ALL"""),
    "profile_routing": _tk("SELECT review, difficulty, in_domain, profile, count(*) AS n FROM t GROUP BY ALL"),
    "human_answer_pick": _tk("SELECT event_id, profile, human_correct FROM t"),
    "acceptance_outcomes": _tk("""SELECT regime, count(*) AS n, count(*) FILTER (CASE regime WHEN 'always' THEN true WHEN 'never' THEN false WHEN 'gold' THEN gold_correct ELSE (event_id * 31 + user_id * 17) % 2 = 0 END) AS taken
      FROM t, (VALUES ('always'), ('never'), ('gold'), ('stochastic')) r(regime) WHERE NOT abstain AND NOT covers GROUP BY regime"""),
    "evidence_validity": "SELECT event_id, event_id % 10 <> 0 AS valid FROM events WHERE event_id > 0",
    "model_actions": _tk("SELECT CASE WHEN user_id % 10 = 9 THEN 'disabled' WHEN (quarter = 1 AND NOT extra) OR (NOT extra AND quarter_position <= 3) THEN 'not_called' WHEN abstain THEN 'abstain' ELSE 'answer' END AS action, count(*) AS n FROM t GROUP BY 1"),
    "replay_error": _tk("SELECT user_id, count(*) AS tickets, count(*) FILTER (CASE WHEN abstain THEN NOT human_correct ELSE NOT gold_correct END) AS replay_errors FROM t GROUP BY user_id"),
    "ticket_summary_groups": _tr(_LABELS + f" SELECT grp, label, {_SUMMARY}, round(errors::DOUBLE / decisions, 9) AS error_rate FROM g GROUP BY grp, label"),
    "profile_drift_rates": _tr(_LABELS + f" SELECT grp, label, {_SUMMARY}, round(errors::DOUBLE / decisions, 9) AS error_rate FROM g WHERE grp = 'profile_drift' GROUP BY grp, label"),
    "repetition_aggregate": _tr(_LABELS + f", r AS (SELECT user_id, grp, label, {_SUMMARY} FROM g GROUP BY ALL) SELECT grp, label, sum(decisions)::BIGINT AS decisions, sum(errors)::BIGINT AS errors, round(avg(errors::DOUBLE / decisions), 9) AS mean_rate, round(stddev_pop(errors::DOUBLE / decisions), 9) AS sd_rate_pop, round(sum(errors)::DOUBLE / sum(decisions)::DOUBLE, 9) AS pooled_rate FROM r GROUP BY grp, label"),
    "scope_counts": _tr(f"SELECT q AS quarter, d AS drift, {_SCOPES} FROM trace, LATERAL (SELECT unnest([0, quarter]) AS q), LATERAL (SELECT unnest(['all', {_DRIFT}]) AS d) GROUP BY q, d"),
    "count_distribution": _tr("SELECT quarter, sum(a)::BIGINT AS total, round(avg(a), 9) AS mean, round(stddev_pop(a), 9) AS sd_pop, min(a) AS least, max(a) AS most FROM (SELECT user_id, quarter, count(*) FILTER (abstain) AS a FROM trace GROUP BY ALL) GROUP BY quarter"),
    "rate_distribution": _tr("SELECT quarter, round(avg(e::DOUBLE / nullif(n, 0)), 9) AS mean_rate, round(stddev_pop(e::DOUBLE / nullif(n, 0)), 9) AS sd_rate_pop, round(sum(e)::DOUBLE / nullif(sum(n), 0)::DOUBLE, 9) AS pooled_rate FROM (SELECT user_id, quarter, count(*) FILTER (NOT extra) AS n, count(*) FILTER (NOT extra AND final_error) AS e FROM trace GROUP BY ALL) GROUP BY quarter"),
    "sc_acceptance": _tr("SELECT round(avg(e::DOUBLE / n), 9) AS mean_rate, round(stddev_pop(e::DOUBLE / n), 9) AS sd_rate_pop, round(sum(e)::DOUBLE / sum(n)::DOUBLE, 9) AS pooled_rate FROM (SELECT user_id, count(*) AS n, count(*) FILTER (accepted) AS e FROM trace WHERE state_before = 'SC' AND accepted IS NOT NULL GROUP BY ALL)"),
    "per_run_metrics": _metrics_sql() + f"SELECT user_id, {', '.join(_WHOLE)}, " + ", ".join(f"round({k}, 9) AS {k}" for k in _RUNS) + " FROM runs",
    "condition_summary": f"WITH a AS {_sub(T.CONDITION)}, u AS ({' UNION ALL '.join(f'SELECT {chr(39)}{m}{chr(39)} AS metric, {m} AS v FROM a' for m in METRICS)}) SELECT metric, count(v) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd_samp, round(min(v), 9) AS least, round(max(v), 9) AS most, round(avg(v) - {_T9}::DOUBLE * stddev_samp(v) / sqrt(10.0::DOUBLE), 9) AS ci_low, round(avg(v) + {_T9}::DOUBLE * stddev_samp(v) / sqrt(10.0::DOUBLE), 9) AS ci_high FROM u GROUP BY metric",
    "final_state_pivot": _metrics_sql() + "SELECT user_id % 3 AS cohort, count(*) FILTER (final_state = 'SO') AS SO, count(*) FILTER (final_state = 'SC') AS SC, count(*) FILTER (final_state = 'DS') AS DS FROM runs GROUP BY 1",
    "judge_audit": _tr("""SELECT *, round(sc_rejected * 100.0::DOUBLE / nullif(sc_decisions, 0), 9) AS sc_rejected_pct, round(rejected * 100.0::DOUBLE / nullif(judged, 0), 9) AS rejected_pct,
      round(wrong_human_matches_rejected * 100.0::DOUBLE / nullif(wrong_human_matches, 0), 9) AS wrong_human_matches_rejected_pct, round(gold_matches_accepted * 100.0::DOUBLE / nullif(gold_matches, 0), 9) AS gold_matches_accepted_pct FROM (
      SELECT count(*) AS recorded, count(*) FILTER (NOT abstain) AS judged, count(*) FILTER (NOT abstain AND NOT gold_correct) AS rejected, count(*) FILTER (accepted IS NOT NULL) AS sc_decisions, count(*) FILTER (NOT accepted) AS sc_rejected,
        count(*) FILTER (h) AS wrong_human_matches, count(*) FILTER (h AND NOT gold_correct) AS wrong_human_matches_rejected, count(*) FILTER (NOT abstain AND gold_correct) AS gold_matches, count(*) FILTER (NOT abstain AND gold_correct) AS gold_matches_accepted
      FROM (SELECT *, NOT abstain AND NOT human_correct AND NOT gold_correct AND event_id % 2 = 0 AS h FROM trace WHERE NOT extra))"""),
    "order_fingerprint": _tk("SELECT user_id, sha256(string_agg(event_id || '|' || profile, chr(10) ORDER BY position)) AS fingerprint FROM t GROUP BY user_id"),
    "latency_percentiles": "SELECT event_type, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd_pop, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY event_type",
    "whole_run_rates": _tk("""SELECT event_id, row_number() OVER w AS n, round(avg(CASE WHEN NOT extra THEN is_drift::INTEGER END) OVER w, 9) AS drift_rate,
      round(avg((profile = 'ceo')::INTEGER) OVER w, 9) AS ceo_rate, round(avg(covers::INTEGER) OVER w, 9) AS fea FROM t WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""),
    "cumulative_error": _run_sql("final_error", "NOT extra", "error_rate", "0.0"),
    "cumulative_human_error": _run_sql("NOT human_correct", "NOT extra", "human_error_rate", "0.0"),
    "cumulative_llm_gold_error": _run_sql("NOT gold_correct", "NOT abstain AND NOT extra", "llm_error_rate", "NULL"),
    "cumulative_replay_error": _run_sql("CASE WHEN abstain THEN NOT human_correct ELSE NOT gold_correct END", "true", "replay_rate", "NULL"),
    "cumulative_abstention_success": _run_sql("abstain", "extra", "success_rate", "NULL"),
    "pointwise_mean_std": _tr("SELECT position, round(avg(fea_after), 9) AS mean, round(stddev_pop(fea_after), 9) AS sd_pop, count(*) AS runs FROM trace GROUP BY position"),
    "averaged_trajectories": _tr(f""", z AS (SELECT position, fea_after AS a, sum((NOT extra AND final_error)::INTEGER) {_W} / nullif(sum((NOT extra)::INTEGER) {_W}, 0)::DOUBLE AS b,
      sum((NOT extra AND NOT human_correct)::INTEGER) {_W} / nullif(sum((NOT extra)::INTEGER) {_W}, 0)::DOUBLE AS c, avg((CASE WHEN abstain THEN NOT human_correct ELSE NOT gold_correct END)::INTEGER) {_W} AS d FROM trace),
      v AS (SELECT 'fea' AS label, position, a AS x FROM z UNION ALL SELECT 'final_error', position, coalesce(b, 0) FROM z UNION ALL SELECT 'human_error', position, coalesce(c, 0) FROM z UNION ALL SELECT 'replay_error', position, d FROM z)
      SELECT label, position, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS sd_pop FROM v GROUP BY ALL"""),
    "quarter_ranges": _tk(_islands("t", "quarter")),
    "state_ranges": _tr(_islands("trace", "state_after")),
    "drift_rate_by_quarter": _tk("SELECT user_id, round(avg(d::DOUBLE / n), 9) AS drift_rate FROM (SELECT user_id, quarter, count(*) AS n, count(*) FILTER (is_drift) AS d FROM t WHERE NOT extra GROUP BY ALL HAVING d > 0) GROUP BY user_id"),
    "last_non_null": _tr("SELECT user_id, round(arg_max(fea_after, position), 9) AS v FROM trace WHERE position % 3 <> 0 AND position % 5 <> 0 GROUP BY user_id"),
    "paired_differences": _D + " SELECT run, metric, round(diff, 9) AS diff FROM d",
    "student_t_ci": _D + f" SELECT metric, count(diff) AS n, round(avg(diff), 9) AS mean, round(avg(diff) - {_T9}::DOUBLE * stddev_samp(diff) / sqrt(10.0::DOUBLE), 9) AS ci_low, round(avg(diff) + {_T9}::DOUBLE * stddev_samp(diff) / sqrt(10.0::DOUBLE), 9) AS ci_high FROM d GROUP BY metric",
    "sign_flip_p": _D + _FLIP + " SELECT metric, round(p, 9) AS p FROM p",
    "holm_adjust": _D + _FLIP + _HOLM + " SELECT metric, round(p, 9) AS p, round(holm_p, 9) AS holm_p FROM h",
    "cohens_dz": _D + " SELECT metric, CASE WHEN stddev_samp(diff) > 0 THEN round(avg(diff) / stddev_samp(diff), 9) END AS dz FROM d GROUP BY metric",
    "factorial_contrasts": _CELLS + ", e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS contrast, {x}.v - {y}.v AS diff FROM {x} JOIN {y} USING (run)" for n, x, y in _EFFECTS) + ") SELECT contrast, count(*) AS n, round(avg(diff), 9) AS mean, round(stddev_samp(diff), 9) AS sd_samp FROM e GROUP BY contrast",
    "baseline_comparisons": _against_sql("final_error_pct", "human_only_error_pct"),
    "controller_comparisons": _against_sql("replay_error_pct", "final_error_pct"),
}

QUERIES = {name: globals()[name] for name in ORACLE}
