"""Extension registry: scalar functions, aggregators, windows and stream functions by `namespace:name`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

KINDS = ("scalar", "aggregator", "window", "stream")


@dataclass(frozen=True)
class Extension:
    """fn builds Columns: scalar fn(*columns); aggregator fn(*columns) as an aggregate usable over a window.

    stream: fn(df, *constants) -> df with added columns. window: a class with add(event) -> the events retained,
    in order; it is built anew for each partition with the window's constants.
    return_type: an attribute type, or a function from argument types to one."""

    fn: Callable
    kind: str
    return_type: str | Callable[..., str] = "object"

    def type_of(self, types: list[str]) -> str:
        return self.return_type(types) if callable(self.return_type) else self.return_type


class Registry(dict):
    def register(self, name: str, fn: Callable, kind: str = "scalar", return_type="object") -> None:
        if name in self:
            raise ValueError(f"extension {name} is registered already")
        if kind not in KINDS:
            raise ValueError(f"unknown kind of extension: {kind}")
        if fn is None or not name:
            raise ValueError("an extension needs a name and a function")
        self[name] = Extension(fn, kind, return_type)

    def find(self, name: str, kind: str) -> Extension | None:
        e = self.get(name)
        return e if e is not None and e.kind == kind else None
