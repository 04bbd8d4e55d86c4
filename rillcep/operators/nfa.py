"""The pattern automaton: an event-at-a-time matcher of one partition.

It serves where no window or join expression does, and as the reference that the tests hold those against. Times are
in microseconds. Events of the same partition must come in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from rillcep.errors import AnalysisError
from rillcep.functions.interpret import evaluate
from rillcep.lang import ast


@dataclass
class Step:
    """One element of a pattern: atoms that must occur, how often, or must not."""

    kind: str  # one, count, and, or, absent
    atoms: list[int]  # numbers of its atoms; of an absent step the first is the absent one
    low: int = 1
    high: int | None = 1
    wait: int | None = None


@dataclass
class Atom:
    ref: str
    stream: str
    conditions: tuple = ()  # those that refer to earlier captures; the rest was tested before


@dataclass
class Run:
    at: int = 0
    caps: dict = field(default_factory=dict)
    start: int = 0
    entered: int = 0
    count: int = 0
    fresh: bool = True  # hasn't consumed any event


class Matcher:
    """Emits (captures, us, seq): captures are lists of events by atom reference.

    every: "each" (an attempt at every first event), "group" (a new attempt after each match) or None (one match)."""

    def __init__(self, steps: list[Step], atoms: list[Atom], strict: bool, every: str | None, within: int | None):
        self.steps, self.atoms, self.strict, self.every, self.within = steps, atoms, strict, every, within
        self.runs: list[Run] = []
        self.done = False
        self.began = False
        self.last: tuple[int, int] = (0, 0)

    # -- helpers
    def _fits(self, k: int, event: dict, run: Run) -> bool:
        atom = self.atoms[k]
        if event["stream"] != atom.stream or not event["fits"][k]:
            return False

        def look(v: ast.Var):
            if v.stream in (None, atom.ref, atom.stream) and v.index is None and v.stream not in run.caps:
                return event["row"][v.name]
            held = run.caps.get(v.stream, [])
            if isinstance(v.index, tuple):
                i = len(held) - 1 - v.index[1]
            else:
                i = v.index or 0
            return held[i][v.name] if 0 <= i < len(held) else None

        return all(evaluate(c, look) is True for c in atom.conditions)

    @staticmethod
    def _copy(run: Run) -> Run:
        return Run(run.at, {k: list(v) for k, v in run.caps.items()}, run.start, run.entered, run.count, run.fresh)

    def _take(self, run: Run, k: int, event: dict) -> None:
        run.caps.setdefault(self.atoms[k].ref, []).append(event["row"])
        if run.fresh:
            run.start, run.fresh = event["us"], False

    def _next(self, run: Run, us: int) -> None:
        run.at, run.entered, run.count = run.at + 1, us, 0

    def _finish(self, run: Run, us: int, seq: int):
        return run.caps, us, seq

    # -- patterns
    def _advance(self, run: Run, event: dict) -> str:
        """stays, moved or dies; a counting step may pass the event to the step behind it."""
        step = self.steps[run.at]
        us = event["us"]
        if step.kind == "one":
            if self._fits(step.atoms[0], event, run):
                self._take(run, step.atoms[0], event)
                self._next(run, us)
                return "moved"
            return "stays"
        if step.kind == "count":
            if run.count >= step.low and run.at + 1 < len(self.steps):
                ahead = self._copy(run)
                self._next(ahead, us)
                if self._advance(ahead, event) == "moved":
                    run.__dict__.update(ahead.__dict__)
                    return "moved"
            if (step.high is None or run.count < step.high) and self._fits(step.atoms[0], event, run):
                self._take(run, step.atoms[0], event)
                run.count += 1
                if run.count == step.low and run.at == len(self.steps) - 1 or run.count == step.high and run.at < len(self.steps) - 1:
                    self._next(run, us)
                return "moved"
            return "stays"
        if step.kind in ("and", "or"):
            for k in step.atoms:
                if self.atoms[k].ref not in run.caps and self._fits(k, event, run):
                    self._take(run, k, event)
                    if step.kind == "or" or all(self.atoms[j].ref in run.caps for j in step.atoms):
                        self._next(run, us)
                    return "moved"
            return "stays"
        if self._fits(step.atoms[0], event, run):  # absent
            return "dies"
        if len(step.atoms) > 1 and self._fits(step.atoms[1], event, run):
            self._take(run, step.atoms[1], event)
            self._next(run, us)
            return "moved"
        return "stays"

    def _due(self, us: int | None):
        """Runs whose absence has lasted by `us` (None: for ever) go on."""
        out = []
        for run in list(self.runs):
            while run.at < len(self.steps):
                step = self.steps[run.at]
                if step.kind != "absent" or step.wait is None:
                    break
                deadline = run.entered + step.wait
                if us is not None and us < deadline:
                    break
                self._next(run, deadline)
                if run.fresh:
                    run.start = deadline
            if run.at == len(self.steps):
                self.runs.remove(run)
                if self.within is None or run.entered - run.start <= self.within:
                    out.append(self._finish(run, run.entered, self.last[1]))
        return out

    def _armed(self) -> bool:
        if self.done:
            return False
        if self.every == "each":
            return True
        return not self.runs

    def add(self, event: dict):
        us = event["us"]
        if self.strict:
            out = self._sequence(event)
            self.last = (us, event["seq"])
            return out
        absent_first = self.steps[0].kind == "absent" and self.steps[0].wait is not None
        if absent_first and not self.began:
            self.runs.append(Run(entered=us, start=us))
        self.began = True
        out = self._due(us)
        self.last = (us, event["seq"])
        live, grown = [], False
        for run in self.runs:
            if self.within is not None and not run.fresh and us - run.start > self.within:
                continue
            first = run.fresh
            result = self._advance(run, event)
            grown |= first and result == "moved"
            if result == "dies":
                if run.fresh and absent_first:
                    live.append(Run(entered=us, start=us))
                continue
            if run.at == len(self.steps):
                out.append(self._finish(run, us, event["seq"]))
            else:
                live.append(run)
        self.runs = live
        if out and self.every is None:
            self.done, self.runs = True, []
            return out[:1]
        if absent_first:
            if self.every and not any(r.fresh for r in self.runs):
                self.runs.append(Run(entered=us, start=us))
        elif self._armed() and not (self.every == "group" and out):
            run = Run(entered=us, start=us)
            # One open attempt of a counting or logical first step gathers; another would gather the same.
            gathering = self.steps[0].kind in ("count", "and") and any(r.at == 0 and not r.fresh for r in self.runs) or grown
            if not gathering and self._advance(run, event) == "moved":
                if run.at == len(self.steps):
                    out.append(self._finish(run, us, event["seq"]))
                    if self.every is None:
                        self.done = True
                else:
                    self.runs.append(run)
        return out

    # -- sequences
    def _optional_rest(self, at: int) -> bool:
        return all(s.low == 0 for s in self.steps[at:])

    def _complete(self, run: Run) -> bool:
        step = self.steps[run.at] if run.at < len(self.steps) else None
        return step is None or run.count >= step.low and self._optional_rest(run.at + 1)

    def _consume(self, run: Run, event: dict) -> bool:
        """Maximal munch: the current step again, else the next that fits."""
        at, count = run.at, run.count
        while at < len(self.steps):
            step = self.steps[at]
            if step.high is None or count < step.high:
                k = next((k for k in step.atoms if self._fits(k, event, run)), None)
                if k is not None:
                    self._take(run, k, event)
                    run.at, run.count = at, count + 1
                    return True
            if count < step.low:
                return False
            at, count = at + 1, 0
        return False

    def _closed(self, run: Run) -> bool:
        return run.at == len(self.steps) - 1 and run.count == self.steps[run.at].high

    def _sequence(self, event: dict):
        out, live, looped = [], [], False
        for run in self.runs:
            late = self.within is not None and event["us"] - run.start > self.within
            at = run.at
            if not late and self._consume(run, event):
                looped |= run.at == at == 0
                if self._closed(run):
                    out.append(self._finish(run, event["us"], event["seq"]))
                else:
                    live.append(run)
            elif self._complete(run):
                out.append(self._finish(run, *self.last))
        self.runs = live
        if self.every is None and out:
            self.done, self.runs = True, []
            return out[:1]
        if self._armed() and not looped:
            run = Run()
            if self._consume(run, event):
                if self._closed(run):
                    out.append(self._finish(run, event["us"], event["seq"]))
                    self.done = self.every is None
                else:
                    self.runs.append(run)
        return out

    def flush(self):
        """The end of input: the clock runs on, open maximal runs end."""
        if self.strict:
            out = [self._finish(r, *self.last) for r in self.runs if self._complete(r)]
        else:
            out = self._due(None)
        self.runs = []
        return out[:1] if self.every is None else out


def compiled(pattern: ast.Pattern) -> tuple[list[Step], list[ast.Atom], str | None]:
    """(steps, atoms, every) of a pattern; `every` must stand first."""
    elements, every = list(pattern.elements), None
    if isinstance(elements[0], ast.Group):
        group = elements.pop(0)
        every = "group" if group.every else None
        elements = [*group.elements, *elements]
        if group.every and len(group.elements) == 1:
            every = "each"
    elif elements[0].every:
        every = "each"
    atoms: list[ast.Atom] = []

    def number(a: ast.Atom) -> int:
        atoms.append(a)
        return len(atoms) - 1

    steps = []
    for i, e in enumerate(elements):
        if i and getattr(e, "every", False) or isinstance(e, ast.Group):
            raise AnalysisError("`every` and groups stand at the start of a pattern")
        if isinstance(e, ast.Atom):
            simple = (e.low, e.high) == (1, 1) and not e.counted
            if pattern.strict:
                steps.append(Step("count", [number(e)], e.low, e.high))
            else:
                steps.append(Step("one", [number(e)]) if simple else Step("count", [number(e)], e.low, e.high))
        elif isinstance(e, ast.Logical):
            if isinstance(e.left, ast.Absent) or isinstance(e.right, ast.Absent):
                raise AnalysisError("timed absence inside `and`/`or` isn't supported")
            kind = "count" if pattern.strict else e.op
            if pattern.strict and e.op == "and":
                raise AnalysisError("`and` isn't supported in sequences")
            steps.append(Step(kind, [number(e.left), number(e.right)]))
        else:
            if pattern.strict:
                raise AnalysisError("absence isn't supported in sequences")
            steps.append(Step("absent", [number(e.atom), *([number(e.partner)] if e.partner else [])], wait=e.wait))
    return steps, atoms, every
