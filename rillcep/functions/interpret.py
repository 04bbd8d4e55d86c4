"""Expressions over Python values: what the pattern automaton uses for conditions on earlier captures."""

from __future__ import annotations

import math
import operator

from rillcep.errors import AnalysisError
from rillcep.lang import ast

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def evaluate(e, look):
    """look: Var -> value. Nulls compare false; arithmetic with null, and division by zero, is null."""
    if isinstance(e, ast.Const):
        return e.value // 1000 if e.type == "time" else e.value
    if isinstance(e, ast.Var):
        return look(e)
    if isinstance(e, ast.Unary):
        v = evaluate(e.arg, look)
        if e.op == "null":
            return v is None
        return not v if e.op == "not" else None if v is None else -v
    if isinstance(e, ast.Binary):
        a, b = evaluate(e.left, look), evaluate(e.right, look)
        if e.op == "and":
            return bool(a) and bool(b)
        if e.op == "or":
            return bool(a) or bool(b)
        if e.op in COMPARE:
            return a is not None and b is not None and COMPARE[e.op](a, b)
        if a is None or b is None:
            return None
        if e.op in "/%":
            if not b:
                return None
            if e.op == "%":
                return math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else int(math.fmod(a, b))
            return a / b if isinstance(a, float) or isinstance(b, float) else int(a / b)
        return {"+": operator.add, "-": operator.sub, "*": operator.mul}[e.op](a, b)
    if isinstance(e, ast.Call) and not e.ns:
        args = [evaluate(a, look) for a in e.args]
        if e.name in ("coalesce", "default"):
            return next((a for a in args if a is not None), None)
        if e.name == "ifThenElse":
            return args[1] if args[0] else args[2]
        if e.name in ("maximum", "minimum"):
            held = [a for a in args if a is not None]
            return (max if e.name == "maximum" else min)(held) if held else None
    raise AnalysisError(f"{e} can't be used in a condition on earlier events")
