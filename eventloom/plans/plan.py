"""A plan names steps, what each reads, and the function that makes it; ``run`` makes them in order of their needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    name: str
    make: Callable[..., DataFrame]
    reads: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


def lint(steps: list[Step], given: set[str]) -> list[str]:
    """What is wrong with a plan: names used twice, needs that nothing makes, needs in a circle."""
    wrong, names = [], [s.name for s in steps]
    wrong += [f"{n} is made twice" for n in sorted({n for n in names if names.count(n) > 1 or n in given})]
    wrong += [f"{s.name} reads {r}, which nothing makes" for s in steps for r in s.reads if r not in given and r not in names]
    try:
        TopologicalSorter({s.name: s.reads for s in steps}).prepare()
    except CycleError as e:
        wrong.append("a circle: " + " - ".join(e.args[1]))
    return wrong


def run(steps: list[Step], tables: dict[str, DataFrame], upto: str | None = None) -> dict[str, DataFrame]:
    """The tables and the steps made of them; with ``upto``, only what that step needs. Nothing is computed yet."""
    if wrong := lint(steps, set(tables)):
        raise ValueError("; ".join(wrong))
    by, need = {s.name: s for s in steps}, set()
    stack = [upto] if upto else [s.name for s in steps]
    while stack:
        if (n := stack.pop()) in by and n not in need:
            need.add(n)
            stack += by[n].reads
    made = dict(tables)
    for name in TopologicalSorter({s.name: s.reads for s in steps}).static_order():
        if name in need:
            made[name] = by[name].make(*(made[r] for r in by[name].reads), **by[name].options)
    return made
