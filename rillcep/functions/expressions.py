"""Syntax-tree expressions as typed Spark Columns.

Division by zero and modulo zero are null; whole-number division truncates; arithmetic takes the wider type; a
comparison with null does not hold (filters treat null as false).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillcep.errors import AnalysisError
from rillcep.functions.extensions import Registry
from rillcep.lang import ast
from rillcep.types import SPARK, wider

Typed = tuple[Column, str]
AGGREGATES = ("sum", "avg", "count", "min", "max", "distinctCount", "stdDev", "maxForever", "minForever", "and", "or", "unionSet")


class Scope:
    """What names mean. resolve: Var -> typed Column; aggregate: Call -> typed Column, or None where not allowed."""

    def __init__(self, resolve: Callable[[ast.Var], Typed], extensions: Registry, us: Column | None = None, aggregate=None):
        self.resolve, self.extensions, self.us, self.aggregate = resolve, extensions, us, aggregate

    def with_(self, **changed) -> Scope:
        out = Scope(self.resolve, self.extensions, self.us, self.aggregate)
        out.__dict__.update(changed)
        return out


def is_aggregate(e, extensions: Registry) -> bool:
    return isinstance(e, ast.Call) and (not e.ns and e.name in AGGREGATES or extensions.find(e.full, "aggregator") is not None)


def children(e) -> list:
    if isinstance(e, ast.Call):
        return list(e.args)
    if isinstance(e, ast.Binary):
        return [e.left, e.right]
    if isinstance(e, ast.Unary):
        return [e.arg]
    if isinstance(e, ast.InTable):
        return [e.condition]
    return []


def walk(e):
    if e is not None:
        yield e
        for c in children(e):
            yield from walk(c)


def variables(e) -> list[ast.Var]:
    return [x for x in walk(e) if isinstance(x, ast.Var)]


def conjuncts(e) -> list:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, ast.Binary) and e.op == "and" else [e]


def truncated_division(a: Column, b: Column) -> Column:
    """Whole-number division toward zero, null on zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def compile_(e, scope: Scope) -> Typed:
    if isinstance(e, ast.Const):
        if e.type == "time":
            return F.lit(e.value // 1000).cast("long"), "long"
        return F.lit(e.value).cast(SPARK[e.type]), e.type
    if isinstance(e, ast.Var):
        return scope.resolve(e)
    if isinstance(e, ast.Unary):
        c, t = compile_(e.arg, scope)
        if e.op == "null":
            return c.isNull(), "bool"
        if e.op == "not":
            _boolean(t)
            return ~F.coalesce(c, F.lit(False)), "bool"
        wider(t, t)
        return -c, t
    if isinstance(e, ast.Binary):
        return _binary(e, scope)
    if isinstance(e, ast.InTable):
        raise AnalysisError("`in` a table stands only as a condition of its own in a filter")
    if isinstance(e, ast.Call):
        if is_aggregate(e, scope.extensions):
            if scope.aggregate is None:
                raise AnalysisError(f"{e.full}() can't stand here")
            return scope.aggregate(e)
        return _call(e, scope)
    raise AnalysisError(f"unknown expression {e}")


def _boolean(t: str) -> None:
    if t != "bool":
        raise AnalysisError(f"{t} where a condition is wanted")


def _binary(e: ast.Binary, scope: Scope) -> Typed:
    (a, ta), (b, tb) = compile_(e.left, scope), compile_(e.right, scope)
    if e.op in ("and", "or"):
        _boolean(ta), _boolean(tb)
        a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
        return (a & b if e.op == "and" else a | b), "bool"
    if e.op in ("==", "!=", "<", "<=", ">", ">="):
        if ta != tb and (ta not in ("int", "long", "float", "double") or tb not in ("int", "long", "float", "double")):
            raise AnalysisError(f"{ta} compared with {tb}")
        ops = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
        return ops[e.op], "bool"
    t = wider(ta, tb)
    a, b = a.cast(SPARK[t]), b.cast(SPARK[t])
    if e.op == "/":
        return (truncated_division(a, b) if t in ("int", "long") else F.try_divide(a, b)).cast(SPARK[t]), t
    if e.op == "%":
        return F.try_mod(a, b).cast(SPARK[t]), t
    return {"+": a + b, "-": a - b, "*": a * b}[e.op].cast(SPARK[t]), t


def _constant(e) -> str:
    if not isinstance(e, ast.Const) or e.type != "string":
        raise AnalysisError("a string constant is wanted")
    return e.value


def _call(e: ast.Call, scope: Scope) -> Typed:
    if (found := scope.extensions.find(e.full, "scalar")) is not None:
        args = [compile_(a, scope) for a in e.args]
        t = found.type_of([t for _, t in args])
        c = found.fn(*(c for c, _ in args))
        return (c.cast(SPARK[t]) if t in SPARK else c), t
    if e.ns:
        raise AnalysisError(f"no extension {e.full}")
    name = e.name
    if name in ("cast", "convert"):
        c, _ = compile_(e.args[0], scope)
        t = _constant(e.args[1]).lower()
        return c.try_cast(SPARK[t]), t
    args = [compile_(a, scope) for a in e.args]
    cols, types = [c for c, _ in args], [t for _, t in args]
    same = lambda ts: ts[0] if len(set(ts)) == 1 else _widest(ts)
    if name in ("coalesce", "default"):
        t = same(types)
        return F.coalesce(*(c.cast(SPARK[t]) if t in SPARK else c for c in cols)), t
    if name == "ifThenElse":
        _boolean(types[0])
        t = same(types[1:])
        a, b = (c.cast(SPARK[t]) if t in SPARK else c for c in cols[1:])
        return F.when(cols[0], a).otherwise(b), t
    if name in ("maximum", "minimum"):
        t = same(types)
        if len(cols) == 1:
            return cols[0], t
        return (F.greatest if name == "maximum" else F.least)(*(c.cast(SPARK[t]) for c in cols)), t
    if name == "UUID":
        return F.expr("uuid()"), "string"
    if name == "currentTimeMillis":
        return F.unix_millis(F.current_timestamp()), "long"
    if name == "eventTimestamp":
        if scope.us is None:
            raise AnalysisError("eventTimestamp() can't stand here")
        return F.floor(scope.us / 1000).cast("long"), "long"
    if name.startswith("instanceOf"):
        t = name.removeprefix("instanceOf").lower()
        want = {"boolean": "bool", "integer": "int"}.get(t, t)
        return (cols[0].isNotNull() if types[0] == want else F.lit(False)), "bool"
    if name == "createSet":
        return F.array(cols[0]), "object"
    if name == "sizeOfSet":
        return F.size(cols[0]), "int"
    raise AnalysisError(f"no function {name}")


def _widest(types: list[str]) -> str:
    out = types[0]
    for t in types[1:]:
        out = wider(out, t)
    return out


def result_type(name: str, types: list[str]) -> str:
    """Attribute type of a built-in aggregate."""
    if name in ("sum",):
        return "long" if types[0] in ("int", "long") else "double"
    if name in ("avg", "stdDev"):
        return "double"
    if name in ("count", "distinctCount"):
        return "long"
    if name in ("and", "or"):
        return "bool"
    if name == "unionSet":
        return "object"
    return types[0]


def over_frame(name: str, cols: list[Column], types: list[str], bind=lambda c: c) -> Column:
    """A built-in aggregate of a groupBy, or of a window where bind puts Spark's aggregate over one."""
    x = cols[0] if cols else None
    if name == "count":
        return bind(F.count(F.lit(1)))
    if x is None:
        raise AnalysisError(f"{name}() needs an argument")
    t = result_type(name, types)
    if name in ("sum", "avg", "stdDev"):
        wider(types[0], types[0])
        return bind({"sum": F.sum, "avg": F.avg, "stdDev": F.stddev_pop}[name](x.cast("double") if t == "double" else x)).cast(SPARK[t])
    if name == "distinctCount":
        return F.size(bind(F.collect_set(x))).cast("long")
    if name == "unionSet":
        return F.array_distinct(F.flatten(bind(F.collect_list(x))))
    plain = {"min": F.min, "minForever": F.min, "max": F.max, "maxForever": F.max, "and": F.bool_and, "or": F.bool_or}
    return bind(plain[name](x))


def over_parts(name: str, cols: list[Column], types: list[str], older, peers) -> Column:
    """A built-in aggregate of a window given in two disjoint parts, each bound by a function of its own."""
    if name == "count":
        return F.coalesce(older(F.count(F.lit(1))), F.lit(0)) + peers(F.count(F.lit(1)))
    if not cols:
        raise AnalysisError(f"{name}() needs an argument")
    x, t = cols[0], result_type(name, types)
    if name in ("sum", "avg", "stdDev"):
        wider(types[0], types[0])
        x = x.cast("double") if t == "double" else x
        sums, counts = [b(F.sum(x)) for b in (older, peers)], [F.coalesce(b(F.count(x)), F.lit(0)) for b in (older, peers)]
        total = F.coalesce(sums[0] + sums[1], *sums)
        if name == "sum":
            return total.cast(SPARK[t])
        n = counts[0] + counts[1]
        if name == "avg":
            return F.try_divide(total, n)
        spread = [F.coalesce(b(F.var_pop(x)), F.lit(0.0)) for b in (older, peers)]
        apart = F.coalesce(F.try_divide(sums[0], counts[0]) - F.try_divide(sums[1], counts[1]), F.lit(0.0))
        return F.sqrt(F.try_divide(spread[0] * counts[0] + spread[1] * counts[1] + apart * apart * F.try_divide(counts[0] * counts[1], n), n))
    if name == "distinctCount":
        return F.size(F.array_union(older(F.collect_set(x)), peers(F.collect_set(x)))).cast("long")
    if name == "unionSet":
        return F.array_distinct(F.flatten(F.concat(older(F.collect_list(x)), peers(F.collect_list(x)))))
    a, b = (over_frame(name, cols, types, bind) for bind in (older, peers))
    merge = {"min": F.least, "max": F.greatest, "and": lambda a, b: F.coalesce(a & b, a, b), "or": lambda a, b: F.coalesce(a | b, a, b)}[name]
    return merge(a, b)


def over_array(name: str, values: Column, types: list[str]) -> Column:
    """A built-in aggregate of an array of its argument's values."""
    held = F.filter(values, lambda v: v.isNotNull())
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")))
    if name == "count":
        return F.size(values).cast("long")
    if name == "sum":
        t = result_type(name, types)
        return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0).cast(SPARK[t]), lambda s, v: s + v.cast(SPARK[t])))
    if name == "avg":
        return F.try_divide(total(held), F.size(held))
    if name == "stdDev":
        mean = F.try_divide(total(held), F.size(held))
        return F.sqrt(F.try_divide(total(F.transform(held, lambda v: (v - mean) * (v - mean))), F.size(held)))
    if name == "min":
        return F.array_min(held)
    if name == "max":
        return F.array_max(held)
    if name == "distinctCount":
        return F.size(F.array_distinct(held)).cast("long")
    if name == "and":
        return F.forall(held, lambda v: v)
    if name == "or":
        return F.exists(held, lambda v: v)
    if name == "unionSet":
        return F.array_distinct(F.flatten(held))
    raise AnalysisError(f"{name}() can't be used with this window")
