"""The commit epoch: all pending decisions of a session applied in one rewrite.

Decisions cost nothing while they wait; when a session's occupancy reaches the
upper target, marks are topped up, oldest first, until folding them would bring
it down to the lower target, adjacent small gaps are absorbed, and all are
applied at once, children before parents.  This is sequential within a session
and independent between sessions, so it is one grouped map over sessions, whose
rows the window's budget bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..policy import BYTES_PER_TOKEN, PLACEHOLDER_BYTES, RECLAIM_FLOOR, WEDGE_TOKENS, Policy

BRIEF = 80
STUB = PLACEHOLDER_BYTES + BRIEF


@dataclass
class Span:
    """A visible piece of a session: a row, or a fold over rows."""

    start: int
    end: int
    nbytes: int
    role: str = "fold"
    terminal: bool = False
    level: int = 0
    source: int = 0  # bytes below


@dataclass
class Session:
    policy: Policy
    spans: list[Span] = field(default_factory=list)
    commits: list[dict] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(s.nbytes for s in self.spans)

    @property
    def budget(self) -> int:
        return self.policy.budget_tokens * BYTES_PER_TOKEN

    def append(self, idx: int, role: str, nbytes: int, terminal: bool) -> None:
        self.spans.append(Span(idx, idx + 1, nbytes, role, terminal, 0, nbytes))

    # ---------------------------------------------------------------- planning
    def fresh_from(self) -> int:
        """The first visible piece of the fresh tail."""
        total = 0
        for i in range(len(self.spans) - 1, -1, -1):
            if total >= self.policy.zone_bytes(self.policy.fresh_tail):
                return i + 1
            total += self.spans[i].nbytes
        return 0

    def turns(self) -> list[tuple[int, int]]:
        """Complete turns among the visible rows, as ranges of pieces."""
        found, first = [], None
        for i, s in enumerate(self.spans + [Span(0, 0, 0, "user")]):
            if s.role == "user" or s.role == "fold":
                if first is not None:
                    last = i
                    while last > first and self.spans[last - 1].role == "custom":
                        last -= 1
                    if self.spans[last - 1].terminal:
                        found.append((first, last))
                first = i if s.role == "user" else None
        return found

    def consolidations(self) -> list[tuple[int, int]]:
        """Full groups of adjacent folds of one level."""
        out, run, width = [], [], self.policy.consolidate_after
        for i, s in enumerate(self.spans + [Span(0, 0, 0, "user")]):
            if s.role == "fold" and (not run or self.spans[run[-1]].level == s.level):
                run.append(i)
                if len(run) == width:
                    out.append((run[0], run[-1] + 1))
                    run = []
            else:
                run = [i] if s.role == "fold" else []
        return out

    def freed(self, a: int, b: int) -> int:
        return max(0, sum(s.nbytes for s in self.spans[a:b]) - STUB)

    def absorb(self, marks: list[tuple[int, int]], fresh: int) -> list[tuple[int, int]]:
        """A small gap of rows directly before a mark joins it."""
        out: list[tuple[int, int]] = []
        for a, b in marks:
            low = out[-1][1] if out else 0
            while a > low and self.spans[a - 1].role == "custom" and sum(s.nbytes for s in self.spans[a - 1 : a]) <= WEDGE_TOKENS * BYTES_PER_TOKEN:
                a -= 1
            out.append((a, b))
        return out

    # ------------------------------------------------------------------ commit
    def fold(self, a: int, b: int) -> None:
        own = self.spans[a:b]
        self.spans[a:b] = [Span(own[0].start, own[-1].end, STUB, "fold", False, max(s.level for s in own) + 1, sum(s.source for s in own))]

    def due(self) -> bool:
        return self.used >= self.policy.max_target * self.budget

    def commit(self, at: int) -> dict:
        """One epoch: consolidations, top-up to the lower target, absorption, floor, application, closing consolidations."""
        before, target = self.used, self.policy.min_target * self.budget
        groups = self.consolidations()
        fresh = self.fresh_from()
        marks = [g for g in groups if self.freed(*g)]
        freed = sum(self.freed(*g) for g in marks)
        for a, b in self.turns():
            if before - freed <= target:
                break
            if b <= fresh and self.freed(a, b):
                marks.append((a, b))
                freed += self.freed(a, b)
        marks = self.absorb(sorted(marks), fresh)
        reason = None
        if not marks:
            reason = "nothing-proposable"
        elif sum(self.freed(*m) for m in marks) < RECLAIM_FLOOR * self.budget:
            reason, marks = "below-reclaim-floor", []
        for a, b in reversed(marks):  # later pieces first, so that places hold
            self.fold(a, b)
        closing = 0
        while marks and (more := self.consolidations()):
            self.fold(*more[0])
            closing += 1
        done = {"at": at, "before": before, "after": self.used, "applied": len(marks), "closing": closing, "deferred": reason}
        self.commits.append(done)
        return done

    def step(self, idx: int, role: str, nbytes: int, terminal: bool) -> dict | None:
        self.append(idx, role, nbytes, terminal)
        return self.commit(idx) if terminal and self.due() else None

    # ------------------------------------------------------------------- state
    def pack(self) -> list[tuple]:
        return [(s.start, s.end, s.nbytes, s.role, s.terminal, s.level, s.source) for s in self.spans]

    @staticmethod
    def unpack(policy: Policy, rows) -> "Session":
        return Session(policy, [Span(*r) for r in rows])


SCHEMA = "session long, at long, before long, after long, applied long, closing long, deferred string, spans long, source long"


def row(session: int, done: dict, s: Session) -> tuple:
    return (session, done["at"], done["before"], done["after"], done["applied"], done["closing"], done["deferred"], len(s.spans), sum(x.source for x in s.spans))


def epochs(m: DataFrame, policy: Policy) -> DataFrame:
    """Every commit of every session, from messages (session, idx, role, nbytes, terminal)."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("idx", "role", "nbytes", "terminal"))))
        s, out = Session(policy), []
        for r in rows:
            done = s.step(*r)
            if done:
                out.append(row(key[0].as_py(), done, s))
        types = [pa.int64()] * 6 + [pa.string()] + [pa.int64()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return m.select("session", "idx", "role", "nbytes", "terminal").groupBy("session").applyInArrow(run, SCHEMA)
