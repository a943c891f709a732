"""The decision workflow with its own memory: retrieve, decide, judge, accept, append.

A repetition is one ordered group: every ticket retrieves from what the repetition has decided so far, so answers
feed later answers.  Repetitions and conditions are independent and run as groups of one job.  ``rollout`` is the
three-state workflow; with ``baseline`` it is the controller-free one, whose phases say who answers.  Here a
repetition is one task's work, vectors included; ``long_runs`` takes repetitions of any length.

Saved tickets of a prefix are restored without model calls: their outcomes are applied again and must lead to the
same states, observations and reliabilities, or the group fails.

Defined cases: a repetition without tickets gives no rows; missing vectors are an error; ties of scores go to the
later insertion, then the larger id; Extra tickets are graded by abstaining where they require it.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import controller as C
from driftwell.operators.models import Model, call_context, checked_decision, checked_judgment

RETRIEVED = (
    "array<struct<record_id:string,question:string,final_answer:string,insertion_index:int,age:int,"
    "cosine_similarity:double,rectified_similarity:double,temporal_score:double>>"
)
JUDGMENT = "struct<covered:boolean,confidence:double,reason:string>"
#: A row of a trace: what the ticket was, and what became of it.
TRACE = f"""repetition int, global_position int, quarter_position int, ticket_id string, quarter string, category string, difficulty string,
  assigned_profile string, phase string, quarterly_ceo_review boolean, ceo_bootstrap boolean, human_answer string, human_answer_is_correct boolean,
  state_before string, state_after string, retrieved {RETRIEVED}, model_decision struct<answer:string,abstain:boolean,evidence_ids:array<string>,reason:string>,
  model_evidence_is_valid boolean, auxiliary_judgment {JUDGMENT}, gold_judgment {JUDGMENT}, gold_judgment_reused boolean, suggestion_accepted boolean,
  reliability_observation int, observations_before int, observations_after int, fea_before double, fea_after double, recent_gold double,
  final_answer string, final_origin string, metric_component string, final_answer_is_correct boolean, correctness_source string, final_decision_error boolean,
  is_drift boolean, near_duplicate_of string, requires_model_abstention boolean, expected_model_action string, model_action_is_correct boolean, trigger string"""
NAMES = [part.split()[0] for part in re.split(r",\s+", TRACE)]
#: What a rollout reads of a ticket; ``v`` is its unit vector.
TICKET = (
    "repetition", "position", "quarter_position", "id", "quarter", "category", "difficulty", "profile", "review", "bootstrap", "question", "gold_answer",
    "human_answer", "human_correct", "is_drift", "near_duplicate_of", "extra", "coin", "v",
)


@dataclass(frozen=True)
class Search:
    """Which records a ticket sees: ``k`` best by decayed cosine of at least ``tau``."""

    k: int = 5
    tau: float = 0.7
    decay: float = 0.99861


class Memory:
    """Append-only records of one repetition; a record's insertion index is its place, from 1."""

    def __init__(self, rule: Search, size: int, dims: int):
        self.rule, self.vectors, self.records = rule, np.empty((size, dims)), []

    def append(self, ident: str, question: str, answer: str, vector: np.ndarray) -> None:
        self.vectors[len(self.records)] = vector
        self.records.append((ident, question, answer))

    def search(self, vector: np.ndarray) -> list[dict]:
        n = len(self.records)
        cosine = np.clip(self.vectors[:n] @ vector, -1, 1)
        hits = np.flatnonzero((cosine > 0) & (cosine >= self.rule.tau))
        age = n - 1 - hits
        score = cosine[hits] * self.rule.decay**age
        best = sorted(zip(score.tolist(), hits.tolist(), strict=True), key=lambda x: (x[0], x[1], self.records[x[1]][0]), reverse=True)[: self.rule.k]
        return [
            dict(zip(("record_id", "question", "final_answer"), self.records[i], strict=True))
            | {"insertion_index": i + 1, "age": n - 1 - i, "cosine_similarity": float(cosine[i]), "rectified_similarity": float(cosine[i]), "temporal_score": s}
            for s, i in best
        ]


class Repetition:
    """One repetition under way."""

    def __init__(self, c: C.Condition, model: Model, memory, baseline: bool = False, control: C.Controller | None = None):
        self.c, self.model, self.baseline, self.memory = c, model, baseline, memory
        self.control = control or C.Controller(c)

    def _decide(self, t: dict) -> tuple[list[dict], dict]:
        found = self.memory.search(t["v"])
        with call_context(stage="decide"):
            return found, checked_decision(self.model.decide(t["question"], found))

    def _judge(self, stage: str, answer: str, reference: str) -> dict:
        ask = self.model.judge if stage == "judge_human" else self.model.judge_gold
        with call_context(stage=stage):
            return checked_judgment(ask(answer, reference))

    def ticket(self, t: dict, saved: dict | None = None) -> dict:
        """The outcome of ``t``; of a saved one, that outcome once it is seen to lead to the same place."""
        row = saved or (self._controller_free(t) if self.baseline else self._controlled(t))
        if saved:
            self._restore(t, saved)
        self.memory.append(t["id"], t["question"], row["final_answer"], t["v"])
        return row

    def _plain(self, t: dict) -> dict:
        return dict.fromkeys(NAMES) | {
            "repetition": t["repetition"], "global_position": t["position"], "quarter_position": t["quarter_position"], "ticket_id": t["id"], "quarter": t["quarter"],
            "category": t["category"], "difficulty": t["difficulty"], "assigned_profile": t["profile"], "quarterly_ceo_review": t["review"], "ceo_bootstrap": t["bootstrap"],
            "human_answer": t["human_answer"], "human_answer_is_correct": t["human_correct"], "retrieved": [], "model_evidence_is_valid": True, "gold_judgment_reused": False,
            "is_drift": t["is_drift"], "near_duplicate_of": t["near_duplicate_of"], "requires_model_abstention": t["extra"], "expected_model_action": "abstain" if t["extra"] else None,
        }

    def _finish(self, row: dict, answer: str, correct: bool, by_model: bool) -> dict:
        source = "auxiliary_model" if by_model else "dataset_profile_label"
        decision = row["model_decision"]
        if decision:
            row["model_evidence_is_valid"] = set(decision["evidence_ids"]) <= {r["record_id"] for r in row["retrieved"]}
            if row["requires_model_abstention"]:
                row["model_action_is_correct"] = decision["abstain"]
        return row | {"final_answer": answer, "final_answer_is_correct": correct, "final_decision_error": not correct, "correctness_source": source}

    def _controlled(self, t: dict) -> dict:
        c, row = self.c, self._plain(t)
        found, decision, human, gold, reused = [], None, None, None, False
        # The controller's own reset at a quarter's start decides who judges, so it is looked at first.
        state = "SC" if t["quarter_position"] == 1 and self.control.state == "DS" and c.review > 0 and not t["extra"] else self.control.state
        if c.enabled:
            found, decision = self._decide(t)
            if not decision["abstain"]:
                if state != "DS":
                    human = self._judge("judge_human", decision["answer"], t["human_answer"])
                if state != "DS" and t["profile"] == "ceo":  # the trusted answer is the gold answer
                    gold, reused = human | {"reason": "the trusted answer is the gold answer"}, True
                else:
                    gold = self._judge("judge_gold", decision["answer"], t["gold_answer"])
        out = dict(zip(OUTCOME, self.control.step(
            t["quarter_position"], t["extra"], t["bootstrap"], decision is None or decision["abstain"], bool(human and human["covered"]), bool(gold and gold["covered"]), t["human_correct"], t["coin"]
        ), strict=True))
        by_model = out["final_origin"] in ("model", "human_revised_to_model")
        row |= {
            "retrieved": found, "model_decision": decision, "auxiliary_judgment": human, "gold_judgment": gold, "gold_judgment_reused": reused,
            "state_before": out["state_before"], "state_after": out["state_after"], "suggestion_accepted": out["accepted"], "reliability_observation": out["observation"],
            "observations_before": out["observations_before"], "observations_after": out["observations_after"], "fea_before": out["fea_before"], "fea_after": out["fea_after"],
            "recent_gold": out["recent_gold"], "final_origin": out["final_origin"], "metric_component": out["component"], "trigger": out["trigger"], "phase": "controlled",
        }
        return self._finish(row, decision["answer"] if by_model else t["human_answer"], bool(out["final_is_correct"]), by_model)

    def _controller_free(self, t: dict) -> dict:
        row = self._plain(t) | {"state_before": "controller_free", "state_after": "controller_free", "observations_before": 0, "observations_after": 0}
        phase = "ceo_bootstrap" if t["quarter"] == "Q1" else "ceo_review" if t["quarter"] != "Extra" and t["quarter_position"] <= self.c.review else "rag_with_defer"
        row |= {"phase": phase, "ceo_bootstrap": phase == "ceo_bootstrap", "quarterly_ceo_review": phase == "ceo_review"}
        if phase != "rag_with_defer":
            row |= {"final_origin": phase, "metric_component": f"trusted_{phase[4:]}"}
            return self._finish(row, t["human_answer"], t["human_correct"], False)
        row["retrieved"], decision = self._decide(t)
        row["model_decision"] = decision
        if decision["abstain"]:
            return self._finish(row | {"final_origin": "human_on_abstention", "metric_component": "deferred_human"}, t["human_answer"], t["human_correct"], False)
        gold = self._judge("judge_gold", decision["answer"], t["gold_answer"])
        return self._finish(row | {"gold_judgment": gold, "final_origin": "model", "metric_component": "autonomous_model"}, decision["answer"], gold["covered"], True)

    def _restore(self, t: dict, saved: dict) -> None:
        want = {"ticket_id": t["id"], "global_position": t["position"], "quarter_position": t["quarter_position"], "assigned_profile": t["profile"]}
        if not self.baseline:
            decision, human, gold = saved["model_decision"], saved["auxiliary_judgment"], saved["gold_judgment"]
            out = self.control.step(
                t["quarter_position"], t["extra"], t["bootstrap"], decision is None or decision["abstain"], bool(human and human["covered"]), bool(gold and gold["covered"]), t["human_correct"], t["coin"]
            )
            out = dict(zip(OUTCOME, out, strict=True))
            want |= {k: out[k] for k in ("state_before", "state_after", "observations_after")}
            if abs((saved["fea_after"] or 0.0) - out["fea_after"]) > 1e-12:
                raise ValueError(f"saved ticket {t['position']} diverges: reliability {saved['fea_after']}, {out['fea_after']} expected")
        for name, value in want.items():
            if saved[name] != value:
                raise ValueError(f"saved ticket {t['position']} diverges: {name} is {saved[name]!r}, {value!r} expected")


OUTCOME = [x.split()[0] for x in C.STEP.split(", ")]


def play(tickets: list[dict], c: C.Condition, model: Model, rule: Search, baseline: bool = False, saved: list[dict] | None = None) -> list[dict]:
    """The trace of one repetition's tickets, in order; ``saved`` is a prefix of such a trace."""
    if not tickets:
        return []
    run = Repetition(c, model, Memory(rule, len(tickets), len(tickets[0]["v"])), baseline)
    held = saved or []
    out = []
    for i, t in enumerate(tickets):
        with call_context(repetition=t["repetition"], ticket_id=t["id"], global_position=t["position"]):
            out.append(run.ticket(t, held[i] if i < len(held) else None))
    return out


def native(rows: pd.DataFrame) -> list[dict]:
    """Rows as plain Python values, nulls as None."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, np.ndarray | list):
            return [plain(v) for v in x]
        if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return None
        return x.item() if isinstance(x, np.generic) else x

    return [{k: plain(v) for k, v in r.items()} for r in rows.to_dict("records")]


def rollout(tickets: DataFrame, c: C.Condition, model: Model, rule: Search = Search(), baseline: bool = False, saved: DataFrame | None = None) -> DataFrame:
    """The trace of every repetition of ``tickets`` (the columns of ``TICKET``); ``model`` is sent to the workers."""
    options, names = asdict(c), list(TICKET)

    def run(rows: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        rows = rows.sort_values("position", ignore_index=True)
        if rows["v"].isna().any():
            raise ValueError("a ticket has no vector")
        held = native(before.sort_values("global_position")) if before is not None else None
        ordered = [t | {"v": np.asarray(t["v"], float)} for t in native(rows)]
        made = play(ordered, C.Condition(**options), model, rule, baseline, held)
        return pd.DataFrame(made, columns=NAMES)

    groups = tickets.select(*names).groupBy("repetition")
    if saved is None:
        return groups.applyInPandas(lambda rows: run(rows), TRACE)
    return groups.cogroup(saved.groupBy("repetition")).applyInPandas(lambda a, b: run(a, b) if len(a) else pd.DataFrame(columns=NAMES), TRACE)


def in_trace_terms(rows: DataFrame) -> DataFrame:
    """A rollout under the names that summaries and trajectories read."""
    decision = F.col("model_decision")
    return rows.select(
        "repetition",
        F.col("global_position").alias("position"),
        "quarter_position",
        F.regexp_replace("quarter", "^Q", "").cast("int").alias("quarter"),
        "category",
        "difficulty",
        F.col("assigned_profile").alias("profile"),
        F.col("quarterly_ceo_review").alias("review"),
        F.col("requires_model_abstention").alias("extra"),
        "is_drift",
        F.coalesce(decision["abstain"], F.lit(False)).alias("abstain"),
        (decision.isNotNull() & ~decision["abstain"] & F.col("gold_judgment").isNotNull()).alias("judged"),
        F.col("auxiliary_judgment.covered").alias("covers"),
        F.coalesce(F.col("gold_judgment.covered"), F.lit(False)).alias("gold_correct"),
        F.col("human_answer_is_correct").alias("human_correct"),
        "state_before",
        "state_after",
        F.col("suggestion_accepted").alias("accepted"),
        "observations_before",
        "observations_after",
        "fea_before",
        "fea_after",
        "recent_gold",
        "final_origin",
        F.col("metric_component").alias("component"),
        F.col("final_decision_error").alias("final_error"),
        "model_action_is_correct",
        "trigger",
    )
