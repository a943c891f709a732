"""Counts and rates over decision traces.

Rates are null where nothing was counted.  ``_pop`` marks population deviations, ``_samp`` sample ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(errors: Column, count: Column) -> Column:
    return F.when(count > 0, errors / F.when(count > 0, count).otherwise(1))


def labelled(trace: DataFrame) -> DataFrame:
    """A row per ticket and group it counts in.

    Required-abstention tickets count in ``abstention_challenge`` alone, where an answer is the error, and only if the
    model was asked.
    """
    drift = F.when(F.col("is_drift"), "drift").otherwise("stable")
    groups = {
        "overall": F.lit("all"),
        "quarter": F.concat(F.lit("Q"), F.col("quarter").cast("string")),
        "profile": F.col("profile"),
        "state": F.col("state_before"),
        "category": F.col("category"),
        "difficulty": F.col("difficulty"),
        "component": F.col("component"),
        "drift": drift,
        "profile_drift": F.concat_ws(".", "profile", drift),
        "component_drift": F.concat_ws(".", "component", drift),
    }
    error = F.col("final_error")
    pairs = F.array(*[F.struct(F.lit(k).alias("grp"), v.alias("label"), error.alias("error")) for k, v in groups.items()])
    asked = F.array(F.struct(F.lit("abstention_challenge").alias("grp"), F.lit("Extra").alias("label"), (~F.col("model_action_is_correct")).alias("error")))
    rows = trace.filter(~F.col("extra") | F.col("model_action_is_correct").isNotNull())
    return rows.withColumn("_g", F.explode(F.when(F.col("extra"), asked).otherwise(pairs))).select("*", "_g.grp", "_g.label", "_g.error").drop("_g")


def summary(trace: DataFrame, *by: str) -> DataFrame:
    """Decisions, errors and error rate by group, one shuffle of partial counts."""
    counts = labelled(trace).groupBy(*by, "grp", "label").agg(F.count("*").alias("decisions"), F.count_if("error").alias("errors"))
    return counts.withColumn("error_rate", rate(F.col("errors"), F.col("decisions")))


def over_runs(per_run: DataFrame) -> DataFrame:
    """Mean and deviation of the runs' rates beside pooled counts and the pooled rate."""
    out = per_run.groupBy("grp", "label").agg(
        F.avg("error_rate").alias("mean_rate"),
        F.stddev_pop("error_rate").alias("sd_rate_pop"),
        F.sum("decisions").alias("decisions"),
        F.sum("errors").alias("errors"),
    )
    return out.withColumn("pooled_rate", rate(F.col("errors"), F.col("decisions")))


def count_distribution(per_run: DataFrame, value: str, *by: str) -> DataFrame:
    return per_run.groupBy(*by).agg(
        F.sum(value).cast("long").alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd_pop"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


def rate_distribution(per_run: DataFrame, part: str, whole: str, *by: str) -> DataFrame:
    """Pooled rate, mean and deviation of runs; runs with nothing to count are left out."""
    r = rate(F.col(part), F.col(whole))
    out = per_run.groupBy(*by).agg(F.sum(part).alias("_p"), F.sum(whole).alias("_w"), F.avg(r).alias("mean_rate"), F.stddev_pop(r).alias("sd_rate_pop"))
    return out.withColumn("pooled_rate", rate(F.col("_p"), F.col("_w"))).drop("_p", "_w")


#: The seven counters of a scope.
SCOPE = ("tickets", "model_decisions", "model_abstentions", "final_decisions", "final_errors", "required_abstentions", "correct_abstentions")


def scope_counts(trace: DataFrame, *by: str) -> DataFrame:
    """The counters of ``SCOPE``; a model decision is an answer or an abstention, final ones exclude required abstentions."""
    asked = F.col("judged") | F.col("abstain")
    final = ~F.col("extra")
    return trace.groupBy(*by).agg(
        F.count("*").alias("tickets"),
        F.count_if(asked).alias("model_decisions"),
        F.count_if(asked & F.col("abstain")).alias("model_abstentions"),
        F.count_if(final).alias("final_decisions"),
        F.count_if(final & F.col("final_error")).alias("final_errors"),
        F.count_if("extra").alias("required_abstentions"),
        F.count_if(F.col("extra") & F.col("model_action_is_correct")).alias("correct_abstentions"),
    )


def suggestions(trace: DataFrame, *by: str) -> DataFrame:
    """Suggest-state decisions that were taken or not."""
    rows = trace.filter((F.col("state_before") == "SC") & F.col("accepted").isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("decisions"), F.count_if("accepted").alias("taken"), F.count_if(~F.col("accepted")).alias("rejected"))


def transitions(trace: DataFrame, run: str) -> DataFrame:
    """Changes of state, those at quarter starts included, each with the accuracy of the recent graded answers."""
    w = Window.partitionBy(run).orderBy("position")
    t = trace.withColumn("_was", F.lag("state_after", 1, "SO").over(w)).withColumn("_gold", F.lag("recent_gold").over(w)).withColumn("_graded", F.lag("recent_graded", 1, 0).over(w))
    names = (run, "position", "quarter", "from_state", "to_state", "cause", "observations", "fea", "recent_gold", "recent_graded")
    start = t.filter(F.col("_was") != F.col("state_before")).select(
        run, "position", "quarter", "_was", "state_before", F.lit("quarterly_ceo_review"), "observations_before", "fea_before", "_gold", "_graded"
    )
    later = t.filter(F.col("state_before") != F.col("state_after")).select(
        run, "position", "quarter", "state_before", "state_after", "trigger", "observations_after", "fea_after", "recent_gold", "recent_graded"
    )
    both = start.toDF(*names).union(later.toDF(*names))
    return both.withColumn("fea_minus_gold", F.when(F.col("to_state") == "DS", F.col("fea") - F.col("recent_gold")))


def transition_summary(changes: DataFrame) -> DataFrame:
    """Counts and means by kind of change; means leave nulls out."""
    means = ("observations", "position", "fea", "recent_gold", "fea_minus_gold")
    return changes.groupBy(F.concat_ws("->", "from_state", "to_state").alias("transition")).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"mean_{x}") for x in means])


def per_run_metrics(trace: DataFrame, *run: str) -> DataFrame:
    """One row per run: counts, denominators and percentages of its nominal tickets, and last values."""
    drift, sc = F.col("is_drift"), (F.col("state_before") == "SC") & F.col("accepted").isNotNull()
    scopes = {
        "human_only_error": (F.lit(True), ~F.col("human_correct")),
        "final_error": (F.lit(True), F.col("final_error")),
        "llm_gold_error": (F.col("judged"), ~F.col("gold_correct")),
        "replay_error": (F.lit(True), F.when(F.col("abstain"), ~F.col("human_correct")).otherwise(~F.col("gold_correct"))),
        "stable_error": (~drift, F.col("final_error")),
        "drift_error": (drift, F.col("final_error")),
        "model_finalized": (F.lit(True), F.col("component") == "autonomous_model"),
        **{f"abstain_{s.lower()}": (F.col("state_before") == s, F.col("abstain")) for s in ("SO", "SC", "DS")},
        "sc_accepted": (sc, F.col("accepted")),
    }
    out = []
    for name, (of, hit) in scopes.items():
        n, k = F.count_if(of), F.count_if(of & hit)
        out += [k.alias(f"{name}_count"), n.alias(f"{name}_of"), F.when(n > 0, k * 100.0 / F.when(n > 0, n).otherwise(1)).alias(f"{name}_pct")]
    # What paired runs must agree in: a sum over order and assignment that needs no order to be taken.
    same = [F.bit_xor("assignment").alias("assignment")] if "assignment" in trace.columns else []
    return trace.filter(~F.col("extra")).groupBy(*run).agg(
        F.count("*").alias("tickets"),
        *same,
        *[F.count_if(F.col("profile") == p).alias(f"assigned_{p}_count") for p in ("ceo", "domain_expert", "intern")],
        *out,
        F.max_by("fea_after", "position").alias("final_fea"),
        F.max_by("state_after", "position").alias("final_state"),
        F.max_by("observations_after", "position").alias("reliability_observations"),
    )


def judge_audit(trace: DataFrame) -> DataFrame:
    """Nine counters and four rates over nominal tickets; texts match when equal after white space is normalised."""
    from driftwell.functions.text import collapsed

    said = ~F.col("abstain")
    model, human, gold = (collapsed(F.col(x)) for x in ("model_answer", "human_answer", "gold_answer"))
    judged, right = said & F.col("judged"), F.col("gold_correct")
    as_human, as_gold = said & ~F.col("human_correct") & (model == human), said & (model == gold)
    counts = {
        "recorded": F.lit(True),
        "judged": judged,
        "rejected": judged & ~right,
        "sc_decisions": said & F.col("accepted").isNotNull(),
        "sc_rejected": said & ~F.col("accepted"),
        "wrong_human_matches": as_human,
        "wrong_human_matches_rejected": as_human & judged & ~right,
        "gold_matches": as_gold,
        "gold_matches_accepted": as_gold & judged & right,
    }
    out = trace.filter(~F.col("extra")).agg(*[F.count_if(v).alias(k) for k, v in counts.items()])
    rates = (("sc_rejected", "sc_decisions"), ("rejected", "judged"), ("wrong_human_matches_rejected", "wrong_human_matches"), ("gold_matches_accepted", "gold_matches"))
    return out.select("*", *[(100 * rate(F.col(k), F.col(n))).alias(f"{k}_pct") for k, n in rates])


def fingerprint(trace: DataFrame, run: str, *parts: str) -> DataFrame:
    """SHA-256 of a run's ticket order, or of order and more columns."""
    line = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    rows = trace.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"))
    return rows.select(run, F.sha2(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), 256).alias("fingerprint"))
