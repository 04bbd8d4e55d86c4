"""Syntax tree of the query language. Durations are in microseconds."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Const:
    value: Any
    type: str  # an attribute type, or "time"


@dataclass(frozen=True)
class Var:
    name: str
    stream: str | None = None
    index: Any = None  # int, or ("last", k) for k before the last


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    ns: str | None = None

    @property
    def full(self) -> str:
        return f"{self.ns}:{self.name}" if self.ns else self.name


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str  # not, -, null
    arg: Any


@dataclass(frozen=True)
class InTable:
    condition: Any
    table: str


@dataclass(frozen=True)
class Filter:
    condition: Any


@dataclass(frozen=True)
class Window:
    call: Call


@dataclass(frozen=True)
class Handler:
    call: Call


@dataclass(frozen=True)
class Single:
    stream: str
    handlers: tuple = ()
    alias: str | None = None
    inner: bool = False

    @property
    def key(self) -> str:
        return f"#{self.stream}" if self.inner else self.stream

    @property
    def name(self) -> str:
        return self.alias or self.stream


@dataclass(frozen=True)
class Join:
    left: Single
    right: Single
    kind: str  # inner, left, right, full
    trigger: str | None  # None for both, else left or right
    on: Any
    within: int | None
    between: tuple | None = None  # times that bound an aggregation's rows
    per: str | None = None  # the aggregation's unit


@dataclass(frozen=True)
class Atom:
    ref: str | None
    stream: str
    filters: tuple
    low: int = 1
    high: int | None = 1
    counted: bool = False
    every: bool = False


@dataclass(frozen=True)
class Logical:
    op: str
    left: Any
    right: Any
    every: bool = False


@dataclass(frozen=True)
class Absent:
    atom: Atom
    wait: int | None
    partner: Any = None
    every: bool = False


@dataclass(frozen=True)
class Group:
    elements: tuple
    every: bool = False


@dataclass(frozen=True)
class Pattern:
    elements: tuple
    strict: bool  # a sequence
    within: int | None


@dataclass(frozen=True)
class Select:
    items: tuple | None = None  # (expression, alias); None for all
    group_by: tuple = ()
    having: Any = None
    order_by: tuple = ()  # (Var, ascending)
    limit: Any = None
    offset: Any = None


@dataclass(frozen=True)
class Rate:
    kind: str  # all, first, last, snapshot
    events: int | None
    time: int | None


@dataclass(frozen=True)
class Output:
    kind: str  # insert, delete, update, upsert
    target: str
    events: str = "current"
    inner: bool = False
    on: Any = None
    sets: tuple = ()  # (Var, expression)

    @property
    def key(self) -> str:
        return f"#{self.target}" if self.inner else self.target


@dataclass(frozen=True)
class Query:
    input: Any
    select: Select
    rate: Rate | None
    output: Output


@dataclass(frozen=True)
class Partition:
    keys: tuple  # (stream, expression) or (stream, ((condition, label), ...))
    queries: tuple


@dataclass(frozen=True)
class Definition:
    kind: str  # stream, table, window, trigger, aggregation
    name: str
    attributes: tuple = ()  # (name, type)
    window: Window | None = None
    every: int | None = None
    at: str | None = None
    source: Single | None = None
    select: Select | None = None
    by: str | None = None
    units: tuple = ()


@dataclass(frozen=True)
class App:
    definitions: tuple = ()
    elements: tuple = ()
    annotations: tuple = field(default=())
