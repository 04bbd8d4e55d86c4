"""A query as an event-at-a-time program: what streaming state runs, and what the tests hold the lowering against."""

from __future__ import annotations

import math
from collections import deque

from rillcep.errors import AnalysisError
from rillcep.functions.expressions import AGGREGATES, conjuncts, walk
from rillcep.functions.interpret import evaluate
from rillcep.lang import ast
from rillcep.operators import nfa
from rillcep.operators.patterns import _own
from rillcep.operators.select import item_name
from rillcep.operators.windows import count_of, micros
from rillcep.plans.lower import inputs_of


def aggregate(name: str, values: list):
    held = [v for v in values if v is not None]
    if name == "count":
        return len(values)
    if name in ("and", "or"):
        return (all if name == "and" else any)(held) if held else None
    if name == "distinctCount":
        return len(set(held))
    if not held:
        return None
    if name in ("min", "minForever"):
        return min(held)
    if name in ("max", "maxForever"):
        return max(held)
    if name == "sum":
        return sum(held)
    mean = sum(held) / len(held)
    if name == "avg":
        return mean
    if name == "stdDev":
        return math.sqrt(sum((v - mean) ** 2 for v in held) / len(held))
    raise AnalysisError(f"{name}() can't be streamed")


class SoFar:
    """A running aggregate: add(value) -> its value over all so far, in constant space (distinctCount: its values)."""

    def __init__(self, name: str):
        self.name, self.n, self.value, self.mean, self.spread, self.seen = name, 0, None, 0.0, 0.0, set()

    def add(self, v):
        if self.name == "count":
            self.n += 1
            return self.n
        if v is not None:
            self.n += 1
            if self.name == "sum":
                self.value = v if self.value is None else self.value + v
            elif self.name in ("min", "minForever", "max", "maxForever"):
                least = self.name.startswith("min")
                self.value = v if self.value is None else (min if least else max)(self.value, v)
            elif self.name in ("and", "or"):
                self.value = v if self.value is None else (self.value and v if self.name == "and" else self.value or v)
            elif self.name in ("avg", "stdDev"):
                away = v - self.mean
                self.mean += away / self.n
                self.spread += away * (v - self.mean)
                self.value = self.mean if self.name == "avg" else math.sqrt(self.spread / self.n)
            elif self.name == "distinctCount":
                self.seen.add(v)
            else:
                raise AnalysisError(f"{self.name}() can't be streamed")
        return len(self.seen) if self.name == "distinctCount" else self.value


class Program:
    """add(event) -> output rows (values in select order, with us). An event is {stream, us, seq, row}.

    Takes filters, projections, running aggregates, length and time windows, patterns and sequences."""

    def __init__(self, query: ast.Query):
        self.select = query.select
        self.input = query.input
        if query.rate is not None or query.output.events != "current":
            raise AnalysisError("output rates and expired events can't be streamed")
        if isinstance(query.input, ast.Pattern):
            steps, atoms, every = nfa.compiled(query.input)
            self.atoms = atoms
            self.refs = [a.ref or f"__e{i}" for i, a in enumerate(atoms)]
            parts = [[c for f in a.filters for c in conjuncts(f)] for a in atoms]
            self.own = [[c for c in p if _own(c, a)] for p, a in zip(parts, atoms)]
            made = [nfa.Atom(r, a.stream, tuple(c for c in p if not _own(c, a))) for r, a, p in zip(self.refs, atoms, parts)]
            self.matcher = nfa.Matcher(steps, made, query.input.strict, every, query.input.within)
        elif isinstance(query.input, ast.Single):
            self.window, self.filters = None, []
            for h in query.input.handlers:
                if isinstance(h, ast.Filter):
                    if self.window is not None:
                        raise AnalysisError("a filter behind a window can't be streamed")
                    self.filters.append(h.condition)
                elif isinstance(h, ast.Window) and h.call.full in ("length", "time"):
                    self.window = h.call
                else:
                    raise AnalysisError("only length and time windows can be streamed here")
            self.content: deque = deque()
        else:
            raise AnalysisError("joins have a program of their own")
        roots = [e for e, _ in self.select.items or ()] + [self.select.having]
        self.aggregates = list(dict.fromkeys(x for r in roots for x in walk(r) if isinstance(x, ast.Call) and not x.ns and x.name in AGGREGATES))
        self.groups: dict[tuple, dict] = {}

    def names(self, attributes: dict[str, str]) -> list[str]:
        if self.select.items is None:
            return list(attributes)
        return [item_name(e, a, i) for i, (e, a) in enumerate(self.select.items)]

    def add(self, event: dict) -> list[tuple]:
        if isinstance(self.input, ast.Pattern):
            fits = []
            for a, own in zip(self.atoms, self.own):
                fits.append(event["stream"] == a.stream and all(evaluate(c, lambda v: event["row"][v.name]) is True for c in own))
            if not self.input.strict and not any(fits):
                return self._matched(self.matcher._due(event["us"]))
            return self._matched(self.matcher.add(event | {"fits": fits}))
        if event["stream"] != self.input.key:
            return []
        row = event["row"]
        if not all(evaluate(f, lambda v: row[v.name]) is True for f in self.filters):
            return []
        return self._selected(row, event)

    def flush(self) -> list[tuple]:
        return self._matched(self.matcher.flush()) if isinstance(self.input, ast.Pattern) else []

    def _matched(self, found) -> list[tuple]:
        out = []
        for caps, us, _ in found:

            def look(v: ast.Var, caps=caps):
                held = caps.get(v.stream, [])
                i = len(held) - 1 - v.index[1] if isinstance(v.index, tuple) else v.index or 0
                return held[i][v.name] if 0 <= i < len(held) else None

            out.append((*(evaluate(e, look) for e, _ in self.select.items), us))
        return out

    def _selected(self, row: dict, event: dict) -> list[tuple]:
        look = lambda v: row[v.name]
        key = tuple(row[v.name] for v in self.select.group_by)
        values = {}
        if self.aggregates:
            arguments = tuple(evaluate(c.args[0], look) if c.args and c.args[0] != ast.Const(None, "all") else 1 for c in self.aggregates)
            running = self.groups.setdefault(key, {})
            if self.window is not None:
                self.content.append((event["us"], key, arguments))
                if self.window.full == "length":
                    while len(self.content) > count_of(self.window.args[0]):
                        self.content.popleft()
                else:
                    while self.content[0][0] <= event["us"] - micros(self.window.args[0]):
                        self.content.popleft()
                held = [a for _, k, a in self.content if k == key]
            for i, c in enumerate(self.aggregates):
                if self.window is None or c.name.endswith("Forever"):
                    values[c] = running.setdefault(i, SoFar(c.name)).add(arguments[i])
                else:
                    values[c] = aggregate(c.name, [a[i] for a in held])

        def value(e):
            if e in values:
                return values[e]
            if isinstance(e, ast.Binary):
                return evaluate(ast.Binary(e.op, _Value(value(e.left)).const, _Value(value(e.right)).const), look)
            return evaluate(e, look)

        if self.select.items is None:
            return [(*row.values(), event["us"])]
        out = [value(e) for e, _ in self.select.items]
        if self.select.having is not None:
            named = {item_name(e, a, i): v for i, ((e, a), v) in enumerate(zip(self.select.items, out))}
            if evaluate(self.select.having, lambda v: named.get(v.name, row.get(v.name))) is not True:
                return []
        return [(*out, event["us"])]


class Chain:
    """Queries that feed each other, as one program: add(event) -> rows of the output `out`."""

    def __init__(self, queries: list[ast.Query], out: str, attributes: dict[str, list[str]]):
        """attributes: names of those of the streams from outside."""
        self.out, self.programs, known = out, [], dict(attributes)
        todo = list(queries)
        while todo:
            made = {q.output.key for q in todo}
            ready = next((q for q in todo if not made & set(inputs_of(q.input))), None)
            if ready is None:
                raise AnalysisError("queries feed each other in a circle")
            todo.remove(ready)
            program = Program(ready)
            names = program.names(dict.fromkeys(known.get(inputs_of(ready.input)[0], ())))
            known[ready.output.key] = names
            self.programs.append((ready.output.key, set(inputs_of(ready.input)), program, names))

    def add(self, event: dict) -> list[tuple]:
        out, todo = [], deque([event])
        while todo:
            e = todo.popleft()
            for key, inputs, program, names in self.programs:
                for row in program.add(e) if e["stream"] in inputs else ():
                    if key == self.out:
                        out.append(row)
                    todo.append({"us": row[-1], "seq": e["seq"], "stream": key, "row": dict(zip(names, row[:-1]))})
        return out


class _Value:
    def __init__(self, value):
        kind = "double" if isinstance(value, float) else "bool" if isinstance(value, bool) else "long"
        self.const = ast.Const(value, kind)
