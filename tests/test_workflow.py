import numpy as np
import pytest

from driftwell.operators import controller as C
from driftwell.operators import models as M
from driftwell.plans import workflow as W
from driftwell.queries import workflow as Q

SF = "/root/testdata/sf0.001"
SINGLE = {"strategy": "single", "single_profile": "ceo"}


def unit(n):
    v = np.array([1.0, n / 1000])
    return v / np.linalg.norm(v)


def ticket(position, n=None, profile="ceo", quarter="Q1", place=None, extra=False, bootstrap=False, review=False, human="correct"):
    n = n or position
    return {
        "repetition": 1, "position": position, "quarter_position": place or position, "id": f"{quarter}-{n:03d}", "quarter": quarter, "category": "billing", "difficulty": "easy",
        "profile": profile, "review": review, "bootstrap": bootstrap, "question": f"Question {n}?", "gold_answer": "correct", "human_answer": human, "human_correct": human == "correct",
        "is_drift": False, "near_duplicate_of": None, "extra": extra, "coin": False, "v": unit(n),
    }


class Says:
    """Answers in the order given (the last one from then on); None abstains.  Judges compare texts."""

    def __init__(self, *answers):
        self.answers, self.decided, self.gold_calls = list(answers), 0, 0

    def decide(self, question, retrieved):
        answer = self.answers[min(self.decided, len(self.answers) - 1)]
        self.decided += 1
        if answer is None:
            return {"abstain": True, "reason": "test"}
        return {"answer": answer, "abstain": False, "evidence_ids": [r["record_id"] for r in retrieved[:1]], "reason": "test"}

    def judge(self, answer, human):
        return {"covered": answer == human, "confidence": 1.0, "reason": "test"}

    def judge_gold(self, answer, gold):
        self.gold_calls += 1
        return self.judge(answer, gold)


def test_contestation_then_autonomy():
    c = C.Condition(0.5, 0.1, 0.9, 1, 0, acceptance="always", **SINGLE)
    out = W.play([ticket(i) for i in (1, 2, 3)], c, Says("correct"), W.Search())
    assert [(x["state_before"], x["state_after"]) for x in out] == [("SO", "SC"), ("SC", "DS"), ("DS", "DS")]
    assert not any(x["final_decision_error"] for x in out) and out[2]["final_origin"] == "model"
    assert [x["suggestion_accepted"] for x in out] == [None, None, None]


def test_extra_keeps_the_state_and_grades_abstention():
    c = C.Condition(0.5, 0.1, 0.9, 1, 1, acceptance="always", **SINGLE)
    out = W.play([ticket(1), ticket(2), ticket(3, quarter="Extra", place=1, extra=True)], c, Says("correct", "correct", None), W.Search())
    assert out[1]["state_after"] == "DS" and (out[2]["state_before"], out[2]["state_after"]) == ("DS", "DS")
    assert out[2]["model_action_is_correct"] is True and out[2]["metric_component"] == "autonomous_model" and out[2]["final_origin"] == "human_on_abstention"


def test_trusted_answers_reuse_their_judgment():
    model = Says("correct", "wrong")
    c = C.Condition(0.5, 0.1, 1.0, 1, 0, acceptance="always", **SINGLE)
    out = W.play([ticket(1), ticket(2)], c, model, W.Search())
    assert out[1]["suggestion_accepted"] is True and out[1]["gold_judgment_reused"] and not out[1]["gold_judgment"]["covered"]
    assert model.gold_calls == 0 and out[1]["final_decision_error"]


def test_gold_regime_accepts_a_correct_disagreement():
    c = C.Condition(0.5, 0.1, 1.0, 1, 0, acceptance="gold", strategy="single", single_profile="domain_expert")
    out = W.play([ticket(1, profile="domain_expert"), ticket(2, profile="domain_expert", human="wrong")], c, Says("correct"), W.Search())
    assert out[1]["suggestion_accepted"] is True and out[1]["final_origin"] == "human_revised_to_model" and out[1]["final_answer_is_correct"]


def review_tickets():
    q1 = [ticket(i) for i in (1, 2, 3)]
    return q1 + [ticket(3 + i, n=i, quarter="Q2", place=i, profile="ceo" if i < 3 else "intern", review=i < 3) for i in (1, 2, 3)]


def test_quarterly_review_leaves_and_enters_autonomy_again():
    c = C.Condition(0.7, 0.55, 0.8, 1, 2, acceptance="always")
    out = W.play([t | {"review": t["quarter_position"] <= 2} for t in review_tickets()], c, Says("correct"), W.Search())
    assert [x["state_after"] for x in out] == ["SO", "SC", "DS", "SC", "DS", "DS"]
    assert [x["trigger"] for x in out[2:5]] == ["reliability_threshold", "quarterly_ceo_review", "quarterly_ceo_review_completion"]
    assert [x["metric_component"] for x in out[3:]] == ["assisted", "assisted", "autonomous_model"] and out[5]["final_origin"] == "model"


def test_fallback_and_resume_equal_the_full_run():
    c = C.Condition(0.7, 0.65, 0.8, 1, 2, decay=1.0)
    full = W.play(review_tickets(), c, Says("correct", "correct", "correct", "wrong", "wrong", "correct"), W.Search())
    assert [x["reliability_observation"] for x in full[3:5]] == [0, 0] and full[4]["fea_after"] == 0.6 and full[4]["state_after"] == "SO"
    assert W.play(review_tickets(), c, Says("correct"), W.Search(), saved=full[:5]) == full
    with pytest.raises(ValueError, match="diverges"):
        W.play(review_tickets(), c, Says("correct"), W.Search(), saved=[full[0] | {"state_after": "DS"}])
    with pytest.raises(ValueError, match="diverges"):
        W.play(review_tickets(), c, Says("correct"), W.Search(), saved=[full[0] | {"fea_after": 0.5}])


def test_bootstrap_holds_the_first_quarter():
    c = C.Condition(0.5, 0.1, 0.9, 1, 1, acceptance="never", bootstrap=True)
    rows = [ticket(1, bootstrap=True), ticket(2, bootstrap=True), ticket(3, n=1, quarter="Q2", place=1, review=True), ticket(4, n=2, quarter="Q2", place=2, profile="intern")]
    out = W.play(rows, c, Says("correct"), W.Search())
    assert [x["state_after"] for x in out] == ["SO", "SO", "SC", "SC"]


def test_baseline_counts_its_own_answers_as_memory():
    rows = [ticket(i) for i in (1, 2, 3)] + [ticket(3 + i, n=10 + i, quarter="Q2", place=i, profile="intern" if i > 2 else "ceo", review=i < 3) for i in (1, 2, 3, 4)]
    model = Says("wrong", None)
    out = W.play(rows, C.Condition(review=2), model, W.Search(k=3), baseline=True)
    assert model.decided == 2 and sum(x["final_decision_error"] for x in out) == 1
    assert [x["metric_component"] for x in out] == ["trusted_bootstrap"] * 3 + ["trusted_review"] * 2 + ["autonomous_model", "deferred_human"]
    assert "wrong" in {r["final_answer"] for r in out[6]["retrieved"]} and out[5]["state_before"] == "controller_free"


def test_calls_carry_their_context():
    calls = []
    model = M.Recorded(Says("correct"), lambda where, stage, answer: calls.append((where["ticket_id"], where["stage"], stage)))
    W.play([ticket(1, profile="intern")], C.Condition(), model, W.Search())
    assert calls == [("Q1-001", s, s) for s in ("decide", "judge_human", "judge_gold")] and M.current_call() == {}


def test_disabled_system_calls_no_model():
    model = Says("correct")
    out = W.play([ticket(1, human="wrong")], C.Condition(enabled=False, **SINGLE), model, W.Search())
    assert model.decided == 0 and out[0]["metric_component"] == "unassisted_human" and out[0]["model_decision"] is None


def naive(rows, decay, tau, k, review):
    """Phases and answers of the baseline, record by record."""
    memory, out = [], []
    for t in rows:
        hits = []
        for i, (ident, answer, v) in enumerate(memory):
            cos = float(np.dot(np.array(v), np.array(t["v"])))
            if cos > 0 and cos >= tau:
                hits.append((cos * decay ** (len(memory) - 1 - i), i, ident, answer))
        best = sorted(hits, reverse=True)[:k]
        trusted = t["quarter"] == "Q1" or t["quarter_position"] <= review
        answer = t["human_answer"] if trusted or not best else best[0][3]
        memory.append((t["id"], answer, t["v"]))
        out.append((t["position"], t["id"], answer, 0 if trusted else len(best)))
    return out


def test_rollout_equals_a_plain_simulation(spark):
    rows = [r.asDict() for r in Q.tickets(spark, SF).filter("repetition = 2").orderBy("position").collect()]
    got = Q.baseline_trace(spark, SF).filter("repetition = 2").orderBy("global_position").collect()
    assert [(x.global_position, x.ticket_id, x.final_answer, x.retrieved) for x in got] == naive(rows, Q.SEARCH.decay, Q.SEARCH.tau, Q.SEARCH.k, Q.CONDITION.review)


def test_rollout_resumes_in_spark(spark):
    t = Q.tickets(spark, SF).filter("repetition < 3 and position <= 60").cache()
    full = W.rollout(t, Q.CONDITION, M.NearestAnswer(), Q.SEARCH).cache()
    again = W.rollout(t, Q.CONDITION, M.NearestAnswer(), Q.SEARCH, saved=full.filter("global_position <= 25 and repetition = 1"))
    assert full.count() == 120 and full.exceptAll(again).isEmpty() and again.exceptAll(full).isEmpty()
    assert {x.state_after for x in full.select("state_after").distinct().collect()} >= {"SO", "SC"}
    assert W.in_trace_terms(full).count() == 120
