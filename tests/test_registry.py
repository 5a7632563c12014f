from datetime import datetime, timezone

import pytest

from quillon.plans.registry import Derivable, PlanError, Registry, Schedule


def at(minute, hour=17):
    return datetime(2026, 3, 3, hour, minute, tzinfo=timezone.utc)


def registry(log=None, fail=()):
    def build(name):
        def run():
            if name in fail:
                raise ValueError(name)
            log.append(name)

        return run

    return Registry([Derivable("A", build("A")), Derivable("B", build("B"), Schedule(minute="30"), ("A",)), Derivable("C", build("C"), Schedule(), ("A",)), Derivable("D", build("D"), Schedule(minute="*/2"), ("C",))])


BOTH, OWN = {"schedule", "dependency"}, {"schedule"}


@pytest.mark.parametrize("minute,order,reasons", [
    (30, ["A", "C", "B", "D"], {"A": BOTH, "B": OWN, "C": BOTH, "D": OWN}), (31, ["A", "C"], {"A": BOTH, "C": OWN}),
    (32, ["A", "C", "D"], {"A": BOTH, "C": BOTH, "D": OWN}), (33, ["A", "C"], {"A": BOTH, "C": OWN}),
])
def test_plan_of_four_minutes(minute, order, reasons):
    r = registry([])
    slot = r.next_slot(at(minute - 1))
    plan = r.plan(slot)
    assert slot == at(minute) and [d.id for d in plan.pending] == order and plan.reasons == reasons


def test_plan_for_identifiers_takes_prerequisites():
    plan = registry([]).plan_for(["D"])
    assert [d.id for d in plan.pending] == ["A", "C", "D"] and plan.reasons["A"] == {"dependency"}


def test_missing_and_circular():
    with pytest.raises(PlanError) as e:
        Registry([Derivable("A", print, prerequisites=("Z",))]).plan(at(0))
    assert e.value.kind == "missing-prerequisite"
    with pytest.raises(PlanError) as e:
        Registry([Derivable("A", print, prerequisites=("B",)), Derivable("B", print, prerequisites=("A",))]).plan(at(0))
    assert e.value.kind == "circular-prerequisites"


def test_errors_do_not_stop_later_ones():
    log = []
    r = registry(log, fail=("C",))
    statuses = list(r.act(r.plan(at(30))))
    assert log == ["A", "B", "D"] and [(s.id, s.ok) for s in statuses] == [("A", True), ("C", False), ("B", True), ("D", True)]


def test_schedules():
    assert Schedule(minute="0", hour="0").next(at(1)) == datetime(2026, 3, 4, tzinfo=timezone.utc)
    assert Schedule(minute="5-10/5,50").next(at(11)) == at(50)
    assert Schedule(minute="0", hour="0", week="0").next(at(0)).strftime("%a %d") == "Sun 08"
    with pytest.raises(ValueError):
        Schedule(minute="61").due(at(0))
