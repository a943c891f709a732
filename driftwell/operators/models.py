"""Model calls as typed functions: structured answers are checked, failures retried, decisions fail safe.

A model is any object with ``decide``, ``judge`` and ``judge_gold``.  The built-in one is deterministic and
offline; a hosted one is ``chat_model`` over the caller's transport.
"""

from __future__ import annotations

import json
import random
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISION = "answer string, abstain boolean, evidence_ids array<string>, reason string"
JUDGMENT = "covered boolean, confidence double, reason string"


_CALL: ContextVar[dict] = ContextVar("driftwell_call", default={})


@contextmanager
def call_context(**values: object) -> Iterator[None]:
    """What a model call is for: repetition, ticket, position, stage; inner contexts add to outer ones."""
    token = _CALL.set(_CALL.get() | values)
    try:
        yield
    finally:
        _CALL.reset(token)


def current_call() -> dict:
    """The context of the call under way, for logs and callbacks of a model."""
    return dict(_CALL.get())


class Model(Protocol):
    def decide(self, question: str, retrieved: list[dict]) -> dict: ...

    def judge(self, answer: str, human: str) -> dict: ...

    def judge_gold(self, answer: str, gold: str) -> dict: ...


class NearestAnswer:
    """Answers as the best retrieved record did, abstains without one; judges by equal text."""

    def decide(self, question: str, retrieved: list[dict]) -> dict:
        if not retrieved:
            return {"abstain": True, "reason": "nothing retrieved"}
        best = retrieved[0]
        return {"answer": best["final_answer"], "abstain": False, "evidence_ids": [best.get("record_id", best.get("id"))], "reason": "nearest record"}

    def judge(self, answer: str, human: str) -> dict:
        return {"covered": " ".join(answer.split()) == " ".join(human.split()), "confidence": 1.0, "reason": "text comparison"}

    judge_gold = judge


class Recorded:
    """A model whose calls are passed to ``on_call(context, stage, answer)`` as they return."""

    def __init__(self, model: Model, on_call: Callable[[dict, str, dict], None]):
        self.model, self.on_call = model, on_call

    def _told(self, stage: str, answer: dict) -> dict:
        self.on_call(current_call(), stage, answer)
        return answer

    def decide(self, question: str, retrieved: list[dict]) -> dict:
        return self._told("decide", self.model.decide(question, retrieved))

    def judge(self, answer: str, human: str) -> dict:
        return self._told("judge_human", self.model.judge(answer, human))

    def judge_gold(self, answer: str, gold: str) -> dict:
        return self._told("judge_gold", self.model.judge_gold(answer, gold))


def missing_models(required: DataFrame, available: DataFrame, name: str = "model") -> DataFrame:
    """Required models that are not available; a job asks before its first ticket."""
    have = available.select(F.col(name).alias("_have")).distinct()
    return required.select(name).distinct().join(have, F.col(name) == F.col("_have"), "left_anti")


#: What a hosted model is told; the message itself is one JSON object.
DECIDE = "You get a question and cases that were settled before. Say only what these cases support, list the ids you relied on in evidence_ids, and set abstain where they leave the question open."
JUDGE = "You get a candidate answer and the standard it is held against. Set covered if nothing of weight in the standard is missing from the candidate or contradicted by it."


def chat_model(post: Callable[[dict], dict], generation: str, auxiliary: str, retry: Retry | Retries | None = None) -> Model:
    """A hosted model behind ``post``, which sends a request and returns the structured answer.

    The transport (address, credentials, protocol) is the caller's; requests name the model, the two messages
    and the answer's schema.  Answers are checked, failures retried.
    """
    retry = retry or Retry()

    def ask(model: str, system: str, user: str, check: Callable[[dict], dict], schema: dict) -> dict:
        request = {"model": model, "system": system, "user": user, "schema": schema, "context": current_call()}
        return retry.call(lambda: check(post(request)))

    class Chat:
        def decide(self, question: str, retrieved: list[dict]) -> dict:
            known = [{"id": r["record_id"], "asked": r["question"], "answered": r["final_answer"]} for r in retrieved]
            return ask(generation, DECIDE, json.dumps({"question": question, "known": known}, ensure_ascii=False), checked_decision, DECISION_SCHEMA)

        def judge(self, answer: str, human: str) -> dict:
            return ask(auxiliary, JUDGE, json.dumps({"candidate": answer, "standard": human}, ensure_ascii=False), checked_judgment, JUDGMENT_SCHEMA)

        judge_gold = judge

    return Chat()


def _schema(**fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


DECISION_SCHEMA = _schema(answer={"type": "string"}, abstain={"type": "boolean"}, evidence_ids={"type": "array", "items": {"type": "string"}}, reason={"type": "string"})
JUDGMENT_SCHEMA = _schema(covered={"type": "boolean"}, confidence={"type": "number", "minimum": 0, "maximum": 1}, reason={"type": "string"})


class Malformed(ValueError):
    """A structured answer lacks a field or has one of another type."""


def checked_decision(raw: dict) -> dict:
    """A decision with all fields; abstentions need no answer and cite nothing."""
    if not isinstance(raw.get("abstain"), bool) or not isinstance(raw.get("reason"), str):
        raise Malformed("abstain and reason are required")
    if raw["abstain"]:
        return {"answer": "", "abstain": True, "evidence_ids": [], "reason": raw["reason"]}
    if not isinstance(raw.get("answer"), str) or not all(isinstance(x, str) for x in raw.get("evidence_ids", [None])):
        raise Malformed("answer and evidence_ids are required")
    return {k: raw[k] for k in ("answer", "abstain", "evidence_ids", "reason")}


def checked_judgment(raw: dict) -> dict:
    if not isinstance(raw.get("covered"), bool) or not isinstance(raw.get("reason"), str) or not 0 <= float(raw.get("confidence", -1)) <= 1:
        raise Malformed("covered, confidence and reason are required")
    return {"covered": raw["covered"], "confidence": float(raw["confidence"]), "reason": raw["reason"]}


@dataclass(frozen=True)
class Retry:
    """Attempts with growing waits: 1, 2, 4 ... seconds, ``longest`` at most; other errors are raised at once."""

    attempts: int = 4
    longest: float = 8.0
    on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError, Malformed)
    sleep: Callable[[float], None] = time.sleep

    @property
    def fail_safe(self) -> tuple[type[Exception], ...]:
        return self.on

    def call(self, run: Callable[[], dict]) -> dict:
        for i in range(self.attempts):
            try:
                return run()
            except self.on:
                if i == self.attempts - 1:
                    raise
                self.sleep(min(2.0**i, self.longest))
        raise AssertionError


class Throttled(ConnectionError):
    """The service takes no more calls for now; ``after`` is the wait in seconds that it names, if any."""

    def __init__(self, message: str = "throttled", after: float | None = None):
        super().__init__(message, after)
        self.after = after


class Unavailable(ConnectionError):
    """The service failed on its side."""

    def __init__(self, message: str = "service failed", after: float | None = None):
        super().__init__(message, after)
        self.after = after


@dataclass(frozen=True)
class Backoff:
    """How often a kind of failure is tried again, and how long before: ``first`` doubled each time, ``longest`` at most."""

    retries: int
    first: float = 5.0
    longest: float = 60.0

    def wait(self, failed: int, draw: float) -> float:
        """Seconds after the ``failed``-th failure: between half and all of the bound, as ``draw`` in [0, 1) says."""
        bound = min(self.longest, self.first * 2.0 ** min(failed - 1, 6))
        return bound * (1 + draw) / 2


@dataclass(frozen=True)
class Retries:
    """Four kinds of failure, each counted and waited for by itself; any other error is raised at once.

    A wait that the service names is kept to as it is.  Where answers stay malformed a decision abstains; a service
    that stays away fails the query, for nothing is known of the ticket then.
    """

    throttled: Backoff = Backoff(12, 5.0, 120.0)
    unavailable: Backoff = Backoff(6)
    connection: Backoff = Backoff(6)
    malformed: Backoff = Backoff(3, 1.0, 8.0)
    sleep: Callable[[float], None] = time.sleep
    draw: Callable[[], float] = random.random
    fail_safe: tuple[type[Exception], ...] = (Malformed,)

    def kind(self, e: Exception) -> str | None:
        kinds = ((Throttled, "throttled"), (Unavailable, "unavailable"), (Malformed, "malformed"), ((ConnectionError, TimeoutError), "connection"))
        return next((name for types, name in kinds if isinstance(e, types)), None)

    def call(self, run: Callable[[], dict]) -> dict:
        failed: dict[str, int] = {}
        while True:
            try:
                return run()
            except Exception as e:
                kind = self.kind(e)
                if kind is None or failed.get(kind, 0) >= getattr(self, kind).retries:
                    raise
                failed[kind] = failed.get(kind, 0) + 1
                after = getattr(e, "after", None)
                self.sleep(getattr(self, kind).wait(failed[kind], self.draw()) if after is None else after)


def in_order(calls: Iterable[Callable[[], dict]], width: int) -> Iterator[dict]:
    """Results of ``calls`` in their order, at most ``width`` under way; the context of calls goes along.

    Calls are taken up as results leave, so what is held is bounded by ``width`` however many there are.  The first
    failure is raised once the calls under way have ended, and no other is begun.
    """
    if width < 1:
        raise ValueError("width is positive")
    if width == 1:
        for c in calls:
            yield c()
        return
    with ThreadPoolExecutor(width) as pool:
        under_way: deque[Future] = deque()
        try:
            for c in calls:
                if len(under_way) == width:
                    yield under_way.popleft().result()
                under_way.append(pool.submit(copy_context().run, c))
            while under_way:
                yield under_way.popleft().result()
        finally:
            for f in under_way:
                f.cancel()


def decisions(tickets: DataFrame, model: Model, retry: Retry | Retries = Retry(), calls: int | None = None, width: int = 1) -> DataFrame:
    """``tickets(id, question, retrieved)`` with ``decision``; a model that keeps failing in a fail-safe way abstains.

    ``calls`` bounds how many calls run at once, in all tasks together: ``calls // width`` tasks of ``width`` calls each.
    """
    if calls is not None and calls < width:
        raise ValueError("calls in all are no fewer than those of a task")

    def decide(question: str, found) -> dict:
        rows = [dict(r) for r in (found if found is not None else [])]
        try:
            return retry.call(lambda: checked_decision(model.decide(question, rows)))
        except retry.fail_safe as e:
            return {"answer": "", "abstain": True, "evidence_ids": [], "reason": f"failed: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = list(in_order((partial(decide, q, r) for q, r in zip(b.question, b.retrieved, strict=True)), width))
            yield pd.DataFrame(out, columns=["answer", "abstain", "evidence_ids", "reason"]).assign(id=b.id.values)[["id", "answer", "abstain", "evidence_ids", "reason"]]

    rows = tickets.select(F.col("id").cast("string").alias("id"), "question", "retrieved")
    return (rows.coalesce(calls // width) if calls else rows).mapInPandas(run, f"id string, {DECISION}")


def judgments(answers: DataFrame, model: Model, gold: bool = False, retry: Retry | Retries = Retry(), calls: int | None = None, width: int = 1) -> DataFrame:
    """``answers(id, answer, reference)`` judged; a judge that keeps failing fails the query.  Bounds are those of ``decisions``."""
    if calls is not None and calls < width:
        raise ValueError("calls in all are no fewer than those of a task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model.judge_gold if gold else model.judge

        def judge(answer: str, reference: str) -> dict:
            return retry.call(lambda: checked_judgment(ask(answer, reference)))

        for b in batches:
            out = list(in_order((partial(judge, x, y) for x, y in zip(b.answer, b.reference, strict=True)), width))
            yield pd.DataFrame(out, columns=["covered", "confidence", "reason"]).assign(id=b.id.values)[["id", "covered", "confidence", "reason"]]

    rows = answers.select(F.col("id").cast("string").alias("id"), "answer", "reference")
    return (rows.coalesce(calls // width) if calls else rows).mapInPandas(run, f"id string, {JUDGMENT}")
