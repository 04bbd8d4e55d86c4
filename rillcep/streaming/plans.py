"""The control plane over streaming inputs: every plan is a StreamingQuery of its own.

Adding starts it. Disabling stops it; enabling starts it again from its checkpoint, with a filter that drops the
events of the time between, so its state is kept and its input is not. An update starts anew with empty state; a
deletion stops for good.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcep.control import LOG, ControlError, ControlEvent, MetadataEvent, OperationEvent, PlanRegistry, decode
from rillcep.plans.lower import Stream
from rillcep.schema import US
from rillcep.streaming import execute


class StreamingPlans:
    """sink: (DataFrame, plan id, checkpoint folder) -> running StreamingQuery. folder: where checkpoints go."""

    def __init__(self, env, out: str, sink: Callable[[DataFrame, str, str], object], folder: str, **options):
        self.env, self.out, self.sink, self.folder, self.options = env, out, sink, folder, options
        self.registry, self.running = PlanRegistry(env), {}

    def apply(self, event: ControlEvent | None) -> None:
        if event is None:
            return
        self.registry.apply(event)
        if isinstance(event, MetadataEvent):
            for plan in (*event.deleted, *event.updated):
                self._stop(plan)
            for plan in (*event.added, *event.updated):
                self._start(plan)
        elif isinstance(event, OperationEvent) and event.plan in self.registry.active:
            if event.action == "disable":
                self._stop(event.plan)
            elif event.plan not in self.running:
                self._start(event.plan)

    def follow(self, messages: DataFrame, checkpoint: str, column: str = "value"):
        """Applies a stream of JSON control messages as they come, those of one micro-batch in the order of their creation;
        gives back the running query. Messages that can't be read are logged and passed over."""

        def batch(rows: DataFrame, _: int) -> None:
            events = []
            for r in rows.select(F.col(column).cast("string").alias("m")).where("m is not null").collect():
                try:
                    events.append(decode(r["m"]))
                except (ControlError, ValueError):
                    LOG.warning("unreadable control message %.200s", r["m"])
            for event in sorted(events, key=lambda e: e.created):
                self.apply(event)

        return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

    def stop(self) -> None:
        for plan in list(self.running):
            self._stop(plan)

    def process_all(self) -> None:
        """Waits until every running plan has read what its sources hold."""
        for q in self.running.values():
            q.processAllAvailable()

    def _stop(self, plan: str) -> None:
        query = self.running.pop(plan, None)
        if query is not None:
            query.processAllAvailable()
            query.stop()

    def _start(self, plan: str) -> None:
        life = self.registry.lives[plan][-1]
        spans = [(F.col(US) >= a) & (F.lit(True) if b is None else F.col(US) < b) for a, b in life.intervals]
        during = reduce(lambda x, y: x | y, spans)
        env = _View(self.env, {n: Stream(s.df.where(during), s.attributes, s.place) for n, s in self.env.streams.items()})
        checkpoint = f"{self.folder}/{plan}-{len(self.registry.lives[plan])}"
        self.running[plan] = self.sink(execute.stream(env, life.text, self.out, **self.options), plan, checkpoint)


class _View:
    """An environment with other streams."""

    def __init__(self, env, streams):
        self.spark, self.extensions, self.streams, self.check_defined = env.spark, env.extensions, streams, env.check_defined
