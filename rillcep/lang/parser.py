"""Lexer and recursive-descent parser."""

from __future__ import annotations

import re

from rillcep.errors import QuerySyntaxError
from rillcep.lang import ast

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>\d+\.\d+(?:[eE][-+]?\d+)?[fFdD]?|\d+[lLfFdD]?(?![A-Za-z_]))
    |(?P<string>'(?:[^'])*'|"(?:[^"])*")
    |(?P<name>[A-Za-z_]\w*|`[^`]+`)
    |(?P<symbol>->|==|!=|<=|>=|[-+*/%<>()\[\],;:.\#?@=])""",
    re.X | re.S,
)
#: Microseconds of each unit, by its names.
UNITS = {
    1_000: "ms millisec millisecond milliseconds",
    1_000_000: "sec second seconds",
    60_000_000: "min minute minutes",
    3_600_000_000: "hour hours",
    86_400_000_000: "day days",
    604_800_000_000: "week weeks",
    2_592_000_000_000: "month months",
    31_536_000_000_000: "year years",
}
UNIT = {name: us for us, names in UNITS.items() for name in names.split()}
TYPES = ("string", "int", "long", "float", "double", "bool", "object")
SPANS = ("sec", "min", "hour", "day", "week", "month", "year")


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QuerySyntaxError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    # -- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        kind, value, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind, value

    def fail(self, wanted: str):
        _, value, at = self.tokens[self.at]
        raise QuerySyntaxError(f"expected {wanted}, found {value or 'the end'!r} at {at}")

    def is_(self, *values: str, ahead: int = 0) -> bool:
        kind, value = self.peek(ahead)
        return kind in ("name", "symbol") and value.lower() in values

    def take(self, *values: str) -> str | None:
        if self.is_(*values):
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def words(self, *values: str) -> bool:
        """Takes all of these words, or none."""
        if all(self.is_(v, ahead=i) for i, v in enumerate(values)):
            self.at += len(values)
            return True
        return False

    def need(self, *values: str) -> str:
        return self.take(*values) or self.fail(" or ".join(values))

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            self.fail("a name")
        self.at += 1
        return value.strip("`")

    def integer(self) -> int:
        kind, value = self.peek()
        if kind != "number" or not value.isdigit():
            self.fail("a whole number")
        self.at += 1
        return int(value)

    def listed(self, item, until: str | None = None) -> tuple:
        out = [item()]
        while self.take(","):
            out.append(item())
        return tuple(out)

    # -- application
    def app(self) -> ast.App:
        annotations, definitions, elements = [], [], []
        while self.peek()[0] != "end":
            if self.take(";"):
                continue
            if self.is_("@"):
                annotations.append(self.annotation())
            elif self.is_("define"):
                definitions.append(self.definition())
            elif self.is_("partition"):
                elements.append(self.partition())
            else:
                elements.append(self.query())
            if self.peek()[0] != "end" and not self.is_(";", "@", "define", "partition", "from"):
                self.fail("; or the end")
        return ast.App(tuple(definitions), tuple(elements), tuple(annotations))

    def annotation(self) -> str:
        start = self.tokens[self.at][2]
        self.need("@"), self.name()
        while self.take(":"):
            self.name()
        if self.take("("):
            depth = 1
            while depth:
                if self.peek()[0] == "end":
                    self.fail(")")
                depth += self.is_("(") - self.is_(")")
                self.at += 1
        return self.text[start : self.tokens[self.at][2]].strip()

    def attributes(self) -> tuple:
        def one():
            name, kind = self.name(), self.name().lower()
            if kind not in TYPES:
                raise QuerySyntaxError(f"unknown type {kind}")
            return name, kind

        self.need("(")
        out = self.listed(one)
        self.need(")")
        return out

    def definition(self) -> ast.Definition:
        self.need("define")
        kind = self.need("stream", "table", "window", "trigger", "aggregation")
        name = self.name()
        if kind in ("stream", "table"):
            return ast.Definition(kind, name, self.attributes())
        if kind == "window":
            attributes = self.attributes()
            self.take("#") and (self.need("window"), self.need("."))
            return ast.Definition(kind, name, attributes, window=ast.Window(self.call()))
        if kind == "trigger":
            self.need("at")
            if self.take("every"):
                return ast.Definition(kind, name, every=self.duration())
            token, value = self.peek()
            if token != "string":
                self.fail("every or a string")
            self.at += 1
            return ast.Definition(kind, name, at=value[1:-1])
        self.need("from")
        source, select = self.single(), self.select()
        self.need("aggregate")
        by = self.name() if self.take("by") else None
        self.need("every")
        unit = lambda: next((u for u in SPANS if self.peek()[1].lower() in UNITS[UNIT[u]].split()), None) or self.fail("a unit")
        first = unit()
        self.at += 1
        if self.take("."):
            self.need("."), self.need(".")
            last = unit()
            self.at += 1
            units = SPANS[SPANS.index(first) : SPANS.index(last) + 1]
        else:
            units = [first]
            while self.take(","):
                units.append(unit())
                self.at += 1
        return ast.Definition(kind, name, source=source, select=select, by=by, units=tuple(u for u in units if u != "week" or u in (first,)))

    def partition(self) -> ast.Partition:
        self.need("partition"), self.need("with"), self.need("(")

        def key():
            value = self.expression()
            if self.take("as"):
                cases = [(value, self.expression().value)]
                while self.take("or"):
                    condition = self.conjunction()
                    self.need("as")
                    cases.append((condition, self.expression().value))
                value = tuple(cases)
            self.need("of")
            return self.name(), value

        self.in_label = True
        keys = self.listed(key)
        self.in_label = False
        self.need(")"), self.need("begin")
        queries = []
        while not self.take("end"):
            if self.take(";"):
                continue
            while self.is_("@"):
                self.annotation()
            queries.append(self.query())
        return ast.Partition(keys, tuple(queries))

    in_label = False

    # -- queries
    def query(self) -> ast.Query:
        self.need("from")
        source = self.input()
        select = self.select()
        rate = self.rate()
        return ast.Query(source, select, rate, self.output())

    def input(self):
        start = self.at
        depth, mark = 0, None
        for i in range(self.at, len(self.tokens)):  # what the input is shows in its first mark outside brackets
            kind, value, _ = self.tokens[i]
            if value in ("(", "["):
                depth += 1
            elif value in (")", "]"):
                depth -= 1
            elif kind == "end" or (depth == 0 and kind == "name" and value.lower() in ("select", "insert", "delete", "update", "output")):
                break
            elif depth <= 1 and value == "->":
                mark = "->"
                break
            elif depth == 0 and value == ",":
                mark = ","
                break
            elif depth == 0 and kind == "name" and value.lower() == "join":
                mark = "join"
                break
            elif depth == 0 and i == start and value.lower() in ("every", "not"):
                mark = mark or "->"
            elif depth == 0 and (value == "=" or kind == "name" and value.lower() in ("for", "and", "or")):
                mark = mark or "="
        self.at = start
        if mark == "join":
            return self.join()
        if mark == ",":
            return self.pattern(True)
        if mark in ("->", "="):
            return self.pattern(False)
        return self.single()

    def call(self) -> ast.Call:
        name, ns = self.name(), None
        if self.take(":"):
            ns, name = name, self.name()
        self.need("(")
        args = () if self.is_(")") else self.listed(lambda: ast.Const(None, "all") if self.take("*") else self.expression())
        self.need(")")
        return ast.Call(name, args, ns)

    def handlers(self) -> tuple:
        out = []
        while True:
            if self.take("["):
                out.append(ast.Filter(self.expression()))
                self.need("]")
            elif self.is_("#"):
                self.at += 1
                if self.is_("window") and self.is_(".", ahead=1):
                    self.at += 2
                    out.append(ast.Window(self.call()))
                elif self.take("["):
                    out.append(ast.Filter(self.expression()))
                    self.need("]")
                else:
                    out.append(ast.Handler(self.call()))
            else:
                return tuple(out)

    def single(self) -> ast.Single:
        inner = bool(self.take("#"))
        stream = self.name()
        handlers = self.handlers()
        alias = self.name() if self.take("as") else None
        return ast.Single(stream, handlers, alias, inner)

    def join(self) -> ast.Join:
        left = self.single()
        trigger = "left" if self.take("unidirectional") else None
        if self.take("join") or self.words("inner", "join"):
            kind = "inner"
        else:
            kind = self.need("left", "right", "full")
            self.need("outer"), self.need("join")
        right = self.single()
        if self.take("unidirectional"):
            trigger = "right"
        on = self.expression() if self.take("on") else None
        within, between, per = None, None, None
        if self.take("within"):
            at = self.at
            bounds = self.listed(self.expression)
            if len(bounds) == 2:
                between = bounds
            else:
                self.at = at
                within = self.duration()
        if self.take("per"):
            value = self.expression()
            name = value.value if isinstance(value, ast.Const) else getattr(value, "name", "")
            per = next((u for u in SPANS if name in UNITS[UNIT[u]].split()), None) or self.fail("a unit")
        return ast.Join(left, right, kind, trigger, on, within, between, per)

    def pattern(self, strict: bool) -> ast.Pattern:
        mark = "," if strict else "->"
        elements = [self.element(strict)]
        while self.take(mark):
            elements.append(self.element(strict))
        within = self.duration() if self.take("within") else None
        if len(elements) == 1 and isinstance(elements[0], ast.Group) and not elements[0].every:
            elements = list(elements[0].elements)
        return ast.Pattern(tuple(elements), strict, within)

    def element(self, strict: bool):
        every = bool(self.take("every"))
        if self.take("("):
            inner = [self.element(strict)]
            while self.take("," if strict else "->"):
                inner.append(self.element(strict))
            self.need(")")
            if len(inner) == 1 and not isinstance(inner[0], ast.Group):
                return _with_every(inner[0], every)
            return ast.Group(tuple(inner), every)
        if self.take("not"):
            atom = self.atom(strict, every)
            if self.take("for"):
                absent = ast.Absent(atom, self.duration(), None, every)
                if (op := self.take("and", "or")) is not None:
                    return ast.Logical(op, absent, self.atom(strict, False), every)
                return absent
            self.need("and")
            return ast.Absent(atom, None, self.atom(strict, False), every)
        atom = self.atom(strict, every)
        op = self.take("and", "or")
        if op and self.take("not"):
            absent = self.atom(strict, False)
            if self.take("for"):
                return ast.Logical(op, atom, ast.Absent(absent, self.duration()), every)
            return ast.Absent(absent, None, atom, every)
        return ast.Logical(op, atom, self.atom(strict, False), every) if op else atom

    def atom(self, strict: bool, every: bool) -> ast.Atom:
        ref = None
        if self.peek()[0] == "name" and self.is_("=", ahead=1):
            ref = self.name()
            self.need("=")
        stream, filters = ("#" if self.take("#") else "") + self.name(), []
        while self.take("["):
            filters.append(self.expression())
            self.need("]")
        low, high, counted = 1, 1, False
        if self.take("<"):
            low = self.integer() if self.peek()[0] == "number" else 0
            high = low
            if self.take(":"):
                high = self.integer() if self.peek()[0] == "number" else None
            self.need(">")
            counted = True
        elif strict and (mark := self.take("+", "*", "?")):
            low, high = {"+": (1, None), "*": (0, None), "?": (0, 1)}[mark]
            counted = mark != "?"
        return ast.Atom(ref, stream, tuple(filters), low, high, counted, every)

    def select(self) -> ast.Select:
        items = None
        if self.take("select"):
            if not self.take("*"):

                def item():
                    e = self.expression()
                    return e, self.name() if self.take("as") else None

                items = self.listed(item)
        group = self.listed(self.variable) if self.words("group", "by") else ()
        having = self.expression() if self.take("having") else None

        def ordered():
            v = self.variable()
            return v, self.take("asc", "desc") != "desc"

        order = self.listed(ordered) if self.words("order", "by") else ()
        limit = self.expression() if self.take("limit") else None
        offset = self.expression() if self.take("offset") else None
        return ast.Select(items, group, having, order, limit, offset)

    def rate(self) -> ast.Rate | None:
        if not self.take("output"):
            return None
        kind = self.take("all", "first", "last", "snapshot") or "all"
        self.need("every")
        if self.peek(1)[1].lower() == "events":
            n = self.integer()
            self.need("events")
            return ast.Rate(kind, n, None)
        return ast.Rate(kind, None, self.duration())

    def output(self) -> ast.Output:
        if self.take("insert"):
            events = self.take("all", "current", "expired") or "current"
            self.take("events")
            self.need("into")
            inner = bool(self.take("#"))
            return ast.Output("insert", self.name(), events, inner)
        if self.take("delete"):
            target = self.name()
            self.need("on")
            return ast.Output("delete", target, on=self.expression())
        if self.words("update", "or", "insert"):
            self.need("into")
            kind, target = "upsert", self.name()
        else:
            self.need("update")
            kind, target = "update", self.name()
        sets = ()
        if self.take("set"):

            def assign():
                v = self.variable()
                self.need("=")
                return v, self.expression()

            sets = self.listed(assign)
        self.need("on")
        return ast.Output(kind, target, on=self.expression(), sets=sets)

    # -- expressions
    def duration(self) -> int:
        total, found = 0, False
        while self.peek()[0] == "number" and self.peek(1)[1].lower() in UNIT:
            n = self.integer()
            total += n * UNIT[self.name().lower()]
            found = True
        return total if found else self.integer() * 1000

    def variable(self) -> ast.Var:
        e = self.primary()
        return e if isinstance(e, ast.Var) else self.fail("a variable")

    def expression(self):
        e = self.conjunction()
        while self.is_("or") and not self.in_label:
            self.at += 1
            e = ast.Binary("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.negation()
        while self.take("and"):
            e = ast.Binary("and", e, self.negation())
        return e

    def negation(self):
        return ast.Unary("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        e = self.sum()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">"):
                e = ast.Binary(op, e, self.sum())
            elif self.words("is", "null"):
                e = ast.Unary("null", e)
            elif self.take("in"):
                e = ast.InTable(e, self.name())
            else:
                return e

    def sum(self):
        e = self.product()
        while op := self.take("+", "-"):
            e = ast.Binary(op, e, self.product())
        return e

    def product(self):
        e = self.factor()
        while op := self.take("*", "/", "%"):
            e = ast.Binary(op, e, self.factor())
        return e

    def factor(self):
        return ast.Unary("-", self.factor()) if self.take("-") else self.primary()

    def primary(self):
        kind, value = self.peek()
        if kind == "string":
            self.at += 1
            return ast.Const(value[1:-1], "string")
        if kind == "number":
            if self.peek(1)[1].lower() in UNIT:
                return ast.Const(self.duration(), "time")
            self.at += 1
            tail = value[-1].lower()
            if tail == "l":
                return ast.Const(int(value[:-1]), "long")
            if tail in "fd":
                return ast.Const(float(value[:-1]), "float" if tail == "f" else "double")
            if value.isdigit():
                return ast.Const(int(value), "int" if int(value) < 1 << 31 else "long")
            return ast.Const(float(value), "double")
        if self.take("("):
            held, self.in_label = self.in_label, False
            e = self.expression()
            self.in_label = held
            self.need(")")
            return e
        if kind != "name":
            self.fail("an expression")
        if value.lower() in ("true", "false"):
            self.at += 1
            return ast.Const(value.lower() == "true", "bool")
        if self.is_("(", ahead=1) or self.is_(":", ahead=1) and self.is_("(", ahead=3):
            return self.call()
        stream, index, name = None, None, self.name()
        if self.is_("[") and (self.peek(1)[0] == "number" or self.is_("last", ahead=1)):
            self.at += 1
            if self.take("last"):
                index = ("last", self.integer() if self.take("-") else 0)
            else:
                index = self.integer()
            self.need("]"), self.need(".")
            stream, name = name, self.name()
        elif self.take("."):
            stream, name = name, self.name()
        return ast.Var(name, stream, index)


def parse(text: str) -> ast.App:
    """Parses an application: definitions, queries and partitions."""
    if text is None:
        raise ValueError("the query text is None")
    return Parser(text).app()
