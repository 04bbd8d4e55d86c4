"""Windowed joins triggered by arrivals.

An arrival on one side meets what the other side's window holds then. Each side's half (its arrivals against the
kept events of the other) is one join: on the equality conjuncts where there are any, and on buckets of time where events
are kept for a span, so that a hot key meets the events of its span alone; else on places in the stream (kept by
count). No half is ever a product of both streams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillcep.errors import AnalysisError
from rillcep.operators.windows import accumulated
from rillcep.schema import SEQ, US, col


@dataclass
class Side:
    """One side: columns prefixed, order columns prefix+US and prefix+SEQ and its place among the inputs.

    keep: ("length", n), ("time", us), ("all", None) for a table or named-window content, or None: keeps nothing."""

    df: DataFrame
    prefix: str
    place: int
    keep: tuple | None
    keys: list[str]

    def c(self, name: str) -> Column:
        return col(f"{self.prefix}{name}")

    @property
    def order(self) -> Column:
        return F.struct(self.c(US).alias("a"), self.c(SEQ).alias("b"), F.lit(self.place).alias("c"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(col(c).alias(f"{prefix}{c}") for c in df.columns))


def with_end(side: Side) -> Side:
    """Adds the order at which each event leaves its window (null: never)."""
    df, keep = side.df, side.keep
    if keep and keep[0] == "length":
        p, keys = side.prefix, [f"{side.prefix}{k}" for k in side.keys]
        df = accumulated(df, F.lit(1), keys, f"{p}__rn", (f"{p}{US}", f"{p}{SEQ}"))
        if keys:
            spec = W.partitionBy(*map(col, keys)).orderBy(f"{p}__rn")
            df = df.withColumns({f"{p}__dead_us": F.lead(side.c(US), keep[1]).over(spec), f"{p}__dead_seq": F.lead(side.c(SEQ), keep[1]).over(spec)})
        else:
            gone = df.select((col(f"{p}__rn") - keep[1]).alias("__was"), side.c(US).alias(f"{p}__dead_us"), side.c(SEQ).alias(f"{p}__dead_seq"))
            df = df.join(gone, col(f"{p}__rn") == F.col("__was"), "left").drop("__was")
    return Side(df, side.prefix, side.place, keep, side.keys)


def _alive(kept: Side, trigger: Side) -> Column:
    """The kept event came before the trigger and hasn't left its window."""
    before = kept.order < trigger.order
    if kept.keep[0] == "time":
        return before & (trigger.c(US) < kept.c(US) + kept.keep[1])
    if kept.keep[0] == "length":
        dead = F.struct(kept.c("__dead_us").alias("a"), kept.c("__dead_seq").alias("b"), F.lit(kept.place).alias("c"))
        return before & (kept.c("__dead_us").isNull() | (trigger.order < dead))
    if kept.keep[0] == "versions":
        end = F.struct(kept.c("__to_us").alias("a"), kept.c("__to_seq").alias("b"), F.lit(kept.place).alias("c"))
        return before & (kept.c("__to_us").isNull() | (trigger.order < end))
    return before


#: Rows of a table that an arrival is compared with one by one, where no equality or time bounds the comparison.
SMALL = 50_000


def small(table: DataFrame) -> DataFrame:
    """The table for a comparison row by row, broadcast, its size checked."""
    if table.limit(SMALL + 1).count() > SMALL:
        raise AnalysisError(f"a table of over {SMALL} rows is joined on equality only")
    return F.broadcast(table)


def half(trigger: Side, kept: Side, equal: list[tuple[Column, Column]], rest: Column | None, outer: bool) -> DataFrame:
    """Arrivals of trigger with the events that kept holds; outer keeps arrivals without any."""
    how = "left" if outer else "inner"
    keys = [trigger.c(k).eqNullSafe(kept.c(k)) for k in trigger.keys]
    condition = _alive(kept, trigger)
    for a, b in equal:
        condition = condition & (a == b)
    for k in keys:
        condition = condition & k
    if rest is not None:
        condition = condition & rest
    if kept.keep[0] == "time":
        span = kept.keep[1]
        near = kept.df.withColumn("__bucket", F.explode(F.array(*(F.floor(kept.c(US) / span) + i for i in (0, 1)))))
        far = trigger.df.withColumn("__own", F.floor(trigger.c(US) / span))
        return far.join(near, (far["__own"] == near["__bucket"]) & condition, how).drop("__bucket", "__own")
    if equal or trigger.keys:
        return trigger.df.join(kept.df, condition, how)
    if kept.keep[0] in ("all", "versions"):
        return trigger.df.join(small(kept.df), condition, how)
    n = kept.keep[1]
    return _by_place(trigger, kept, n, rest, outer)


def _by_place(trigger: Side, kept: Side, n: int, rest: Column | None, outer: bool) -> DataFrame:
    """The kept side's last n places at each arrival."""
    marks = kept.df.select(kept.c(US).alias("__u"), kept.c(SEQ).alias("__s"), F.lit(kept.place).alias("__p"), F.lit(1).alias("__one"), F.lit(None).cast("struct<x:int>").alias("__row"))
    rows = trigger.df.select(trigger.c(US).alias("__u"), trigger.c(SEQ).alias("__s"), F.lit(trigger.place).alias("__p"), F.lit(0).alias("__one"), F.struct(*map(col, trigger.df.columns)).alias("__row"))
    both = marks.drop("__row").unionByName(rows, allowMissingColumns=True)
    probes = accumulated(both, F.col("__one"), [], "__count", ("__u", "__s", "__p")).where("__one = 0").select("__row.*", F.explode(F.sequence(F.col("__count") - n + 1, F.col("__count"))).alias("__at"))
    condition = (F.col("__at") == kept.c("__rn")) & (rest if rest is not None else F.lit(True))
    found = probes.join(kept.df, condition, "inner").drop("__at")
    if not outer:
        return found
    own = [trigger.c(US), trigger.c(SEQ)]
    alone = trigger.df.join(found.select(own[0].alias("__mu"), own[1].alias("__ms")).distinct(), (own[0] == F.col("__mu")) & (own[1] == F.col("__ms")), "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def join(left: Side, right: Side, kind: str, trigger: str | None, equal, rest: Column | None, within: int | None) -> DataFrame:
    """All pairs, each at its later event's time, with US and SEQ of that event."""
    left, right = with_end(left), with_end(right)
    if within is not None:
        near = F.abs(left.c(US) - right.c(US)) <= within
        rest = near if rest is None else rest & near
    out = []
    for own, other, pairs in ((left, right, equal), (right, left, [(b, a) for a, b in equal])):
        name = "left" if own is left else "right"
        if trigger not in (None, name) or own.keep and own.keep[0] in ("all", "versions"):
            continue
        outer = kind in (name, "full")
        if other.keep is None:
            if not outer:
                continue
            found = own.df
            for f in other.df.schema.fields:
                found = found.withColumn(f.name, F.lit(None).cast(f.dataType))
        else:
            found = half(own, other, pairs, rest, outer)
        out.append(found.withColumns({US: own.c(US), SEQ: own.c(SEQ), **{k: own.c(k) for k in own.keys}}))
    if not out:
        raise AnalysisError("neither side of the join keeps events for the other")
    columns = [*(c for c in left.df.columns if not c.endswith(("__dead_us", "__dead_seq", "__rn"))), *(c for c in right.df.columns if not c.endswith(("__dead_us", "__dead_seq", "__rn"))), US, SEQ, *left.keys]
    out = [o.select(*map(col, columns)) for o in out]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
