"""A guided session as a fold of its events: a memory that ages, reliability with a gate, and who has authority.

Events are ``(session, n, action, agrees)`` in the order of ``n``.  ``save`` files a human resolution (once for each of
two chapters, in order) and observes agreement; ``reviews`` replays a dozen agreeing observations; ``toggle`` turns the
temporal weight on and off; ``auto`` lets the model decide where the gate is open and the weight is on; ``intervene``
takes authority back; ``escalate`` hands over once; ``reset`` starts afresh.  What does not apply changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Decay, starting numerator, denominator and observations, and the gate.
DECAY, NUMERATOR, DENOMINATOR, SEEN, LEAST, OPEN = 0.9, 8.6, 10.0, 18, 20, 0.8
REVIEWS, HUMAN_CHAPTERS, START = 12, 2, 2
STEP = "session string, n int, action string, applied boolean, memory int, fea double, observations int, gate_open boolean, temporal boolean, authority string, log int"


@dataclass
class Session:
    num: float = NUMERATOR
    den: float = DENOMINATOR
    seen: int = SEEN
    ages: list[int] = field(default_factory=lambda: list(range(START - 1, -1, -1)))
    saved: int = 0
    temporal: bool = True
    resolved: bool = False
    taken_back: bool = False
    escalated: bool = False
    log: int = 0

    @property
    def fea(self) -> float:
        return self.num / self.den

    @property
    def gate(self) -> bool:
        return self.seen >= LEAST and self.fea > OPEN

    @property
    def authority(self) -> str:
        return "human" if self.taken_back or not self.resolved else "model"

    def observe(self, agrees: bool) -> None:
        self.num, self.den, self.seen = DECAY * self.num + agrees, DECAY * self.den + 1, self.seen + 1

    def insert(self) -> None:
        self.ages = [a + 1 for a in self.ages] + [0]

    def apply(self, action: str, agrees: bool) -> bool:
        if action == "save" and self.saved < HUMAN_CHAPTERS:
            self.insert()
            self.saved += 1
            self.observe(agrees)
        elif action == "reviews" and not self.gate:
            for _ in range(REVIEWS):
                self.observe(True)
        elif action == "toggle":
            self.temporal = not self.temporal
        elif action == "auto" and self.gate and self.temporal and not self.taken_back and not self.resolved:
            self.resolved = True
            self.insert()
        elif action == "intervene" and self.resolved and not self.taken_back:
            self.taken_back = True
        elif action == "escalate" and not self.escalated:
            self.escalated = True
        elif action == "reset":
            self.__init__()
            return True
        else:
            return False
        self.log += 1
        return True


def fold(events: DataFrame) -> DataFrame:
    """The state after each event of every session."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s, out = Session(), []
        for r in rows.sort_values("n").itertuples():
            done = s.apply(r.action, bool(r.agrees))
            out.append((r.session, r.n, r.action, done, len(s.ages), s.fea, s.seen, s.gate, s.temporal, s.authority, s.log))
        return pd.DataFrame(out, columns=[x.split()[0] for x in STEP.split(", ")])

    return events.groupBy("session").applyInPandas(run, STEP)
