"""The control plane: plans added, updated, deleted, enabled and disabled by events in time.

A plan reads what arrives while it is active. Adding starts it, enabled; an update starts it anew with empty state;
while disabled it drops its input but keeps its state. In batch replay each life of a plan is one query over the
events of its enabled intervals.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcep.errors import CEPError, UndefinedStreamError
from rillcep.lang import parse
from rillcep.schema import US

LOG = logging.getLogger(__name__)


class ControlError(CEPError):
    """A control event that can't be applied."""


@dataclass(frozen=True)
class ControlEvent:
    """created and expired are in microseconds of event time."""

    created: int = 0
    expired: int | None = None

    def expire(self, at: int) -> ControlEvent:
        return replace(self, expired=at)


@dataclass(frozen=True)
class MetadataEvent(ControlEvent):
    added: dict[str, str] = field(default_factory=dict)
    updated: dict[str, str] = field(default_factory=dict)
    deleted: tuple[str, ...] = ()


@dataclass(frozen=True)
class OperationEvent(ControlEvent):
    action: str = "enable"  # or disable
    plan: str = ""


class MetadataBuilder:
    def __init__(self, created: int = 0):
        self._event = MetadataEvent(created)

    def add(self, text: str, plan: str | None = None) -> str:
        """The id of the plan: a new one unless given."""
        plan = plan or str(uuid.uuid4())
        self._event = replace(self._event, added=self._event.added | {plan: text})
        return plan

    def update(self, plan: str, text: str) -> MetadataBuilder:
        self._event = replace(self._event, updated=self._event.updated | {plan: text})
        return self

    def delete(self, plan: str) -> MetadataBuilder:
        self._event = replace(self._event, deleted=(*self._event.deleted, plan))
        return self

    def build(self) -> MetadataEvent:
        return self._event


def encode(event: ControlEvent) -> str:
    if isinstance(event, MetadataEvent):
        payload = {"created": event.created, "added": event.added, "updated": event.updated, "deleted": list(event.deleted)}
        return json.dumps({"type": "metadata", "payload": payload})
    return json.dumps({"type": "operation", "payload": {"created": event.created, "action": event.action, "plan": event.plan}})


def decode(text: str) -> ControlEvent:
    """Only the two known types; a message never names a class."""
    message = json.loads(text)
    payload = message.get("payload", {})
    if message.get("type") == "metadata":
        return MetadataEvent(payload.get("created", 0), None, dict(payload.get("added", {})), dict(payload.get("updated", {})), tuple(payload.get("deleted", ())))
    if message.get("type") == "operation" and payload.get("action") in ("enable", "disable"):
        return OperationEvent(payload.get("created", 0), None, payload["action"], payload.get("plan", ""))
    raise ControlError(f"unknown control message {message.get('type')!r}")


@dataclass
class Life:
    """A plan from its start to an update or deletion: enabled intervals [from, to), to None for open."""

    text: str
    intervals: list[list[int | None]]


class PlanRegistry:
    def __init__(self, env, on_received: Callable | None = None, on_acked: Callable | None = None):
        self.env, self.on_received, self.on_acked = env, on_received, on_acked
        self.lives: dict[str, list[Life]] = {}
        self.active: set[str] = set()

    def apply(self, event: ControlEvent | None) -> None:
        """Deletions, then additions, then updates. A None event is ignored."""
        if event is None:
            return
        if self.on_received:
            self.on_received(event)
        at = event.created
        if isinstance(event, MetadataEvent):
            for plan in event.deleted:
                if plan in self.active:
                    self._stop(plan, at)
                    self.active.discard(plan)
            for plan, text in event.added.items():
                if plan in self.active:
                    raise ControlError(f"plan {plan} exists")
                parse(text)
                self.lives.setdefault(plan, []).append(Life(text, [[at, None]]))
                self.active.add(plan)
            for plan, text in event.updated.items():
                if plan not in self.active:
                    raise ControlError(f"no plan {plan}")
                parse(text)
                self._stop(plan, at)
                self.lives[plan].append(Life(text, [[at, None]]))
        elif isinstance(event, OperationEvent):
            if event.plan not in self.active:
                LOG.warning("no plan %s to %s", event.plan, event.action)
            else:
                spans = self.lives[event.plan][-1].intervals
                if event.action == "disable" and spans and spans[-1][1] is None:
                    spans[-1][1] = at
                elif event.action == "enable" and (not spans or spans[-1][1] is not None):
                    spans.append([at, None])
        else:
            raise ControlError(f"unknown control event {event!r}")
        if self.on_acked:
            self.on_acked(event)

    def replay(self, messages: DataFrame, column: str = "value") -> None:
        """Applies JSON messages in the order of their creation, ties in the order of their text. They are few: plans are
        written by people, and each message is a plan's change."""
        rows = messages.select(F.col(column).cast("string").alias("m")).where("m is not null").distinct().collect()
        for event in sorted((decode(r["m"]) for r in rows), key=lambda e: (e.created, encode(e))):
            self.apply(event)

    def _stop(self, plan: str, at: int) -> None:
        spans = self.lives[plan][-1].intervals
        if spans and spans[-1][1] is None:
            spans[-1][1] = at

    def enabled(self, plan: str) -> bool:
        return plan in self.active and self.lives[plan][-1].intervals[-1][1] is None

    def returns(self, stream_id: str) -> DataFrame:
        """All plans' output into a stream over the registered events, in one DataFrame; schemas must agree."""
        from rillcep.env import Execution
        from rillcep.plans.lower import Stream

        outs = []
        for lives in self.lives.values():
            for life in lives:
                spans = [(F.col(US) >= a) & (F.lit(True) if b is None else F.col(US) < b) for a, b in life.intervals if a != b]
                if not spans:
                    continue
                during = reduce(lambda x, y: x | y, spans)
                streams = {n: Stream(s.df.where(during), s.attributes, s.place) for n, s in self.env.streams.items()}
                run = Execution(self.env, parse(life.text), streams)
                if stream_id in run.outputs:
                    outs.append(run.returns(stream_id))
        if not outs:
            raise UndefinedStreamError(stream_id)
        return reduce(lambda a, b: a.unionByName(b), outs)
