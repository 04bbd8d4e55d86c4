"""Windows that no SQL frame expresses, as event-at-a-time folds: add(event) -> retained events, or None to drop it."""

from __future__ import annotations

import bisect

from rillcep.errors import AnalysisError
from rillcep.lang import ast


class SortWindow:
    """Keeps the n first events by the sort attributes; nulls come first, ties by arrival."""

    def __init__(self, n: int, by: list[tuple[str, bool]]):
        self.n, self.by, self.held, self.count = n, by, [], 0

    def add(self, event: dict) -> list[dict]:
        self.count += 1
        key = [_Reversed((event[a] is not None, event[a])) if down else (event[a] is not None, event[a]) for a, down in self.by]
        bisect.insort(self.held, (key, self.count, event), key=lambda x: x[:2])
        del self.held[self.n :]
        return [e for _, _, e in sorted(self.held, key=lambda x: x[1])]


class _Reversed:
    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


class FrequentWindow:
    """The last event of each of the n most frequent keys (Misra & Gries, 1982)."""

    def __init__(self, n: int, by: list[str]):
        self.n, self.by, self.counts, self.latest = n, by, {}, {}

    def add(self, event: dict) -> list[dict] | None:
        key = tuple(event[a] for a in self.by)
        if key in self.counts or len(self.counts) < self.n:
            self.counts[key] = self.counts.get(key, 0) + 1
            self.latest[key] = event
            return list(self.latest.values())
        for k in list(self.counts):
            self.counts[k] -= 1
            if not self.counts[k]:
                del self.counts[k], self.latest[k]
        if len(self.counts) < self.n:
            self.counts[key], self.latest[key] = 1, event
            return list(self.latest.values())
        return None


class LossyWindow:
    """Events whose key has at least (support - error) of all so far (lossy counting: Manku & Motwani, VLDB 2002)."""

    def __init__(self, support: float, error: float, by: list[str]):
        self.support, self.error, self.by = support, error, by
        self.total, self.width, self.counts, self.latest = 0, max(1, round(1 / error)), {}, {}

    def add(self, event: dict) -> list[dict] | None:
        self.total += 1
        bucket = -(-self.total // self.width)
        key = tuple(event[a] for a in self.by)
        n, late = self.counts.get(key, (0, bucket - 1))
        self.counts[key], self.latest[key] = (n + 1, late), event
        if self.total % self.width == 0:
            for k, (n, late) in list(self.counts.items()):
                if n + late <= bucket:
                    del self.counts[k], self.latest[k]
        least = (self.support - self.error) * self.total
        if key not in self.counts or self.counts[key][0] < least:
            return None
        return [e for k, e in self.latest.items() if self.counts[k][0] >= least]


def _names(args, attributes) -> list[str]:
    return [a.name for a in args if isinstance(a, ast.Var)] or list(attributes)


def sort_keys(args) -> list[tuple[str, bool]]:
    """(attribute, descending) of the sort window's arguments."""
    by = []
    for a in args[1:]:
        if isinstance(a, ast.Var):
            by.append((a.name, False))
        elif isinstance(a, ast.Const) and a.type == "string" and a.value in ("asc", "desc") and by:
            by[-1] = (by[-1][0], a.value == "desc")
        else:
            raise AnalysisError("sort() takes a size, attributes and their directions")
    return by


def sort_of(args, attributes):
    n, by = args[0].value, sort_keys(args)
    return lambda: SortWindow(n, by)


def frequent_of(args, attributes):
    n, by = args[0].value, _names(args[1:], attributes)
    return lambda: FrequentWindow(n, by)


def lossy_of(args, attributes):
    numbers = [float(a.value) for a in args if isinstance(a, ast.Const)]
    support, error = numbers[0], numbers[1] if len(numbers) > 1 else numbers[0] / 10
    by = _names(args, attributes)
    return lambda: LossyWindow(support, error, by)
