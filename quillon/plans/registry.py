"""Which derived tables to rebuild now, in which order and why.

A table has a schedule of cron fields and prerequisites. It is due if its own schedule has the
slot, or if the schedule of a table that lists it as a prerequisite has it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from graphlib import CycleError, TopologicalSorter

RANGES = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "week": (0, 6)}
log = logging.getLogger(__name__)


class PlanError(ValueError):
    def __init__(self, kind: str, ids: list[str]):
        super().__init__(f"{kind}: {', '.join(ids)}")
        self.kind, self.ids = kind, ids


def _values(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        if not low <= a <= b <= high:
            raise ValueError(f"{part} is outside {low}-{high}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


@dataclass(frozen=True)
class Schedule:
    """Cron fields; one that isn't given is every value. week is the day of the week, 0 Sunday."""

    minute: str = "*"
    hour: str = "*"
    day: str = "*"
    month: str = "*"
    week: str = "*"

    def due(self, at: datetime) -> bool:
        own = {"minute": at.minute, "hour": at.hour, "day": at.day, "month": at.month, "week": (at.weekday() + 1) % 7}
        hit = {k: own[k] in _values(getattr(self, k), *r) for k, r in RANGES.items()}
        days = hit["day"] or hit["week"] if self.day != "*" and self.week != "*" else hit["day"] and hit["week"]
        return hit["minute"] and hit["hour"] and hit["month"] and days

    def next(self, after: datetime) -> datetime:
        at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(366 * 5 * 24 * 60):
            if self.due(at):
                return at
            wrong_hour = at.hour not in _values(self.hour, *RANGES["hour"])
            at = (at.replace(minute=0) + timedelta(hours=1)) if wrong_hour else at + timedelta(minutes=1)
        raise ValueError("the schedule never comes")


@dataclass(frozen=True)
class Derivable:
    id: str
    build: Callable[..., object]
    schedule: Schedule = Schedule()
    prerequisites: tuple[str, ...] = ()


@dataclass
class Plan:
    pending: list[Derivable]
    reasons: dict[str, set[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Status:
    id: str
    ok: bool
    error: str | None = None


class Registry:
    def __init__(self, derivables: Iterable[Derivable]):
        self.all = {d.id: d for d in derivables}

    def next_slot(self, after: datetime) -> datetime:
        return min(d.schedule.next(after) for d in self.all.values())

    def ordered(self, ids: Iterable[str]) -> list[Derivable]:
        """Prerequisites first; of tables that are ready together, those that others wait for."""
        wanted = set(ids)
        graph = {i: [p for p in self.all[i].prerequisites if p in wanted] for i in self.all if i in wanted}
        try:
            sorter = TopologicalSorter(graph)
            sorter.prepare()
        except CycleError as e:
            raise PlanError("circular-prerequisites", list(e.args[1])) from None
        out: list[Derivable] = []
        awaited = {p for i in graph for p in graph[i]}
        rank = {i: (i not in awaited, k) for k, i in enumerate(self.all)}
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=rank.__getitem__)
            out += [self.all[i] for i in ready]
            sorter.done(*ready)
        return out

    def _check(self) -> None:
        missing = sorted({p for d in self.all.values() for p in d.prerequisites} - set(self.all))
        if missing:
            raise PlanError("missing-prerequisite", missing)

    def plan(self, slot: datetime) -> Plan:
        """What is due at a slot."""
        self._check()
        reasons: dict[str, set[str]] = {}
        for d in self.all.values():
            if d.schedule.due(slot):
                reasons.setdefault(d.id, set()).add("schedule")
                for p in d.prerequisites:
                    reasons.setdefault(p, set()).add("dependency")
        return Plan(self.ordered(reasons), reasons)

    def plan_for(self, ids: Iterable[str]) -> Plan:
        """The given tables and all that they need."""
        self._check()
        reasons = {i: {"identifier"} for i in ids}
        queue = list(reasons)
        while queue:
            i = queue.pop()
            if i not in self.all:
                raise PlanError("missing-prerequisite", [i])
            for p in self.all[i].prerequisites:
                if p not in reasons:
                    queue.append(p)
                reasons.setdefault(p, set()).add("dependency")
        return Plan(self.ordered(reasons), reasons)

    def act(self, plan: Plan, *args) -> Iterator[Status]:
        """Build one after the other; one that fails doesn't stop those that follow."""
        for d in plan.pending:
            try:
                d.build(*args)
                yield Status(d.id, True)
            except Exception as e:  # reported to the caller, who decides
                log.exception("building %s failed", d.id)
                yield Status(d.id, False, f"{type(e).__name__}: {e}")


def standard(catalog) -> Registry:
    """The four derived tables over a catalog of parquet tables."""
    from .device import derived_device
    from .subject import derived_subject
    from .submission import derived_submission

    class Staging(dict):
        def __missing__(self, name):
            return catalog.read(f"staging.{name}")

    def seconds(now: datetime) -> int:
        return int(now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp())

    def meta(now):
        rows = catalog.sizes()
        catalog.overwrite("derived.meta_entity_stat", catalog.spark.createDataFrame(rows, "name string, pgsize long"))

    return Registry([
        Derivable("device", lambda now: catalog.overwrite("derived.device", derived_device(Staging(), catalog.read("derived.subject"))), Schedule(minute="0", hour="0"), ("subject",)),
        Derivable("subject", lambda now: catalog.overwrite("derived.subject", derived_subject(Staging(), seconds(now))), Schedule(minute="0")),
        Derivable("submission", lambda now: catalog.overwrite("derived.submission", derived_submission(Staging(), seconds(now))), Schedule(minute="0", hour="*/2")),
        Derivable("meta", meta, Schedule(minute="*/5")),
    ])
