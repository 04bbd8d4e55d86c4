"""Windows of a single stream.

frame: sliding contents that a SQL frame expresses; array: contents carried as an array (bounded by the window's own
size); batch: events that leave together. `keys` are the partition columns: without any there is one global window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillcep.errors import AnalysisError
from rillcep.functions.extensions import Registry
from rillcep.lang import ast
from rillcep.operators import folds
from rillcep.schema import SEQ, US, col


@dataclass(frozen=True)
class Win:
    kind: str  # running, frame, time, array, batch, shift
    frame: Callable | None = None  # group columns -> WindowSpec
    parts: Callable | None = None  # group columns -> (WindowSpec of the older events, of those of the same time so far)
    sliced: Callable | None = None  # df -> df dealt to slices (SLICE) that hold their events' windows; copies are HALO
    content: str | None = None  # array column
    batch: str | None = None  # batch number column
    expire: Callable | None = None  # df -> df of expired events, at the time they leave


def ordered(keys: list[str]):
    return W.partitionBy(*map(col, keys)).orderBy(US, SEQ)


#: One order over all events is dealt to slices: by quantiles of the time for counting, by places or time for windows.
SLICES, SLICE_ROWS, SLICE_SPANS = 200, 1 << 16, 4
SLICE, HALO = "__slice", "__halo"


def whole(df: DataFrame, value: Column, keys: list[str]) -> Column:
    """An aggregate over the partition of each event; without keys one value, by a scalar subquery."""
    return value.over(W.partitionBy(*map(col, keys))) if keys else df.select(value).scalar()


def in_slices(df: DataFrame, time: str = US) -> DataFrame:
    """Adds SLICE: events dealt by quantiles of the time, in order."""
    bounds = df.select(F.percentile_approx(col(time), [i / SLICES for i in range(1, SLICES)], 2000)).scalar()
    return df.withColumn("__bounds", bounds).withColumn(SLICE, F.size(F.filter("__bounds", lambda b: b < col(time)))).drop("__bounds")


def with_before(df: DataFrame, parts: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """Adds for each name an aggregate over all slices before the event's own: (of a slice, how slices' values merge).

    What meets in one task for that is a row for each slice."""
    sums = df.groupBy(SLICE).agg(*(value.alias(n) for n, (value, _) in parts.items()))
    earlier = W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col(SLICE).alias("__of"), *(merge(F.col(n)).over(earlier).alias(n) for n, (_, merge) in parts.items()))
    return df.join(F.broadcast(before), F.col(SLICE) == F.col("__of")).drop("__of")


def accumulated(df: DataFrame, value: Column, keys: list[str], name: str, order: tuple[str, ...] = (US, SEQ)) -> DataFrame:
    """Adds the running sum (long) of value in order, the event itself included.

    Without keys the order is one for all events, but no task takes them all: events are summed in slices, and the sums
    of the slices before are added."""
    if keys:
        return df.withColumn(name, F.sum(value).over(W.partitionBy(*map(col, keys)).orderBy(*map(col, order)).rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    df = with_before(in_slices(df, order[0]), {"__before": (F.sum(value), F.sum)})
    inside = F.sum(value).over(W.partitionBy(SLICE).orderBy(*map(col, order)).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, (F.coalesce("__before", F.lit(0)) + inside).cast("long")).drop(SLICE, "__before")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds each event's place in the order, from 1."""
    return accumulated(df, F.lit(1), keys, name)


def _dealt(df: DataFrame, at: Column, reach: Column) -> DataFrame:
    """Events in their slice `at`, and once more as a copy in the next where they reach into it."""
    nth = F.explode(F.when(reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.withColumn(SLICE, at).withColumn("__copy", nth).withColumn(SLICE, F.col(SLICE) + F.col("__copy")).withColumn(HALO, F.col("__copy") > 0).drop("__copy")


def running(keys: list[str]) -> Win:
    return Win("running", lambda groups: W.partitionBy(*map(col, keys), *groups).orderBy(US, SEQ).rowsBetween(W.unboundedPreceding, 0))


def micros(arg) -> int:
    """A duration argument: `5 sec`, or whole milliseconds."""
    if isinstance(arg, ast.Const) and arg.type == "time":
        return arg.value
    if isinstance(arg, ast.Const) and arg.type in ("int", "long"):
        return arg.value * 1000
    raise AnalysisError("a duration is wanted")


def count_of(arg) -> int:
    if isinstance(arg, ast.Const) and arg.type in ("int", "long") and arg.value > 0:
        return arg.value
    raise AnalysisError("a positive whole number is wanted")


def attribute(arg) -> str:
    if isinstance(arg, ast.Var):
        return arg.name
    raise AnalysisError("an attribute is wanted")


def _sliding_time(df: DataFrame, time: Column, span: int, keys: list[str]) -> tuple[DataFrame, Win]:
    """Events no older than span, later ones of equal time excluded, however many share a time.

    `parts` says so in two frames over one sort: a range of time that ends before the event's own, and the events of
    its time so far. `frame` says it in one, for aggregates that can't be put together from parts: a decimal number
    holds the time and, behind the point, the place among ties."""
    df = df.withColumn("__time", time)
    by = lambda groups: W.partitionBy(*map(col, keys), *groups)

    def frame(groups):
        tie = F.row_number().over(by([]).orderBy("__time", US, SEQ)) - F.rank().over(by([]).orderBy("__time"))
        at = F.col("__time").cast("decimal(38,10)") * 2 + tie.cast("decimal(38,10)") / F.lit(10**10).cast("decimal(11,0)")
        return "__at", at.cast("decimal(38,10)"), by(groups).orderBy("__at").rangeBetween(1 - 2 * span, 0)

    def parts(groups):
        older = by(groups).orderBy("__time").rangeBetween(1 - span, -1)
        return older, by([*groups, F.col("__time")]).orderBy(US, SEQ).rowsBetween(W.unboundedPreceding, 0)

    def sliced(d):
        size = SLICE_SPANS * span
        return _dealt(d, F.floor(F.col("__time") / size), F.pmod(F.col("__time"), F.lit(size)) > size - span)

    return df, Win("time", frame, parts=parts, sliced=None if keys else sliced, expire=lambda d: d.withColumn(US, F.col(US) + span))


#: Names and numbers of cron's fields: seconds, minutes, hours, days of the month, months, days of the week (Sunday is 1).
CRON = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (1, 7))
CRON_NAMES = {n: i for names in ("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC", "SUN MON TUE WED THU FRI SAT") for i, n in enumerate(names.split(), 1)}
DAY = 86_400_000_000


def cron_fields(text: str) -> list[list[int]]:
    """The values of each field that a cron expression of six fields (or five, without seconds) allows."""
    fields = text.split()
    fields = ["0", *fields] if len(fields) == 5 else fields
    if len(fields) != 6:
        raise AnalysisError(f"cron expression {text!r} isn't supported")
    out = []
    for field, (low, high) in zip(fields, CRON):
        values: set[int] = set()
        for part in field.upper().split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            try:
                number = lambda x: CRON_NAMES[x] if x in CRON_NAMES else int(x)
                first, last = (low, high) if a in ("*", "?") else (number(a), number(b) if b else high if step else number(a))
                values |= set(range(first, last + 1, int(step or 1)))
            except ValueError:
                raise AnalysisError(f"cron expression {text!r} isn't supported") from None
        if not values or min(values) < low or max(values) > high:
            raise AnalysisError(f"cron expression {text!r} isn't supported")
        out.append(sorted(values))
    return out


def _cron_days(bounds: DataFrame, fields: list[list[int]]) -> DataFrame:
    """(day, fires) for each day from that of column a to some years after b of the one row of bounds."""
    day = F.explode(F.sequence(F.to_date(F.timestamp_micros("a")), F.date_add(F.to_date(F.timestamp_micros("b")), 3000))).alias("day")
    fires = F.dayofmonth("day").isin(fields[3]) & F.month("day").isin(fields[4]) & F.dayofweek("day").isin(fields[5])
    return bounds.select(day).select("day", fires.alias("fires"))


def cron_ticks(bounds: DataFrame, text: str) -> DataFrame:
    """US of every fire from column a to column b of the one row of bounds; the days are dealt out before their fires."""
    fields = cron_fields(text)
    days = _cron_days(bounds, fields).where("fires").select(F.unix_micros(F.col("day").cast("timestamp")).alias("day")).repartition("day")
    at = F.col("day")
    for name, values, unit in (("h", fields[2], 3600), ("m", fields[1], 60), ("s", fields[0], 1)):
        days = days.withColumn(name, F.explode(F.array(*(F.lit(v * unit * 1_000_000).cast("long") for v in values))))
        at = at + F.col(name)
    ticks = days.select(at.alias(US)).join(F.broadcast(bounds.select("a", "b")), F.col(US).between(F.col("a"), F.col("b")))
    return ticks.select(US)


def _with_next_fire(df: DataFrame, text: str) -> DataFrame:
    """Adds __end: the first fire after each event. The table of days has a row for each day of the stream."""
    seconds, minutes, hours, *_ = fields = cron_fields(text)
    days = _cron_days(df.agg(F.min(US).alias("a"), F.max(US).alias("b")).where("a is not null"), fields)
    later = F.min(F.when(F.col("fires"), F.col("day"))).over(W.orderBy("day").rowsBetween(1, W.unboundedFollowing))
    days = days.select(F.col("day").alias("__day"), "fires", later.alias("__then"))
    at = F.timestamp_micros(F.col(US))
    after = lambda values, now: F.array_min(F.filter(F.array(*map(F.lit, values)), lambda v: v > now))
    second = lambda h, m, s: h * 3600 + m * 60 + s
    h, m, s = F.hour(at), F.minute(at), F.second(at)
    # In this minute, else in this hour, else on this day, else on the next day that fires.
    today = F.coalesce(
        F.when(h.isin(hours) & m.isin(minutes), second(h, m, after(seconds, s))),
        F.when(h.isin(hours), second(h, after(minutes, m), F.lit(seconds[0]))),
        second(after(hours, h), F.lit(minutes[0]), F.lit(seconds[0])),
    )
    start = lambda d: F.unix_micros(d.cast("timestamp"))
    first = second(F.lit(hours[0]), F.lit(minutes[0]), F.lit(seconds[0]))
    df = df.withColumn("__day", F.to_date(at)).join(F.broadcast(days), "__day")
    end = F.when(F.col("fires") & today.isNotNull(), start(F.col("__day")) + today.cast("long") * 1_000_000).otherwise(start(F.col("__then")) + first.cast("long") * 1_000_000)
    return df.withColumn("__end", end.cast("long")).drop("__day", "fires", "__then")


def attach(df: DataFrame, call: ast.Call, keys: list[str], attributes: dict[str, str], extensions: Registry) -> tuple[DataFrame, Win]:
    """Adds what a window needs to the stream's events."""
    name, args = call.full, call.args
    if name == "length":
        n = count_of(args[0])

        def leave(d):
            d = numbered(d.drop("__rn"), keys, "__rn")
            later = d.select((F.col("__rn") - n).alias("__was"), *(col(k).alias(f"__was{k}") for k in keys), *(col(c).alias(f"__then{c}") for c in (US, SEQ)))
            on = F.col("__rn") == F.col("__was")
            for k in keys:
                on = on & col(k).eqNullSafe(col(f"__was{k}"))
            d = d.join(later, on)
            return d.select(*(col(c) for c in d.columns if c not in (US, SEQ) and not c.startswith(("__was", "__then"))), *(col(f"__then{c}").alias(c) for c in (US, SEQ)))

        def sliced(d):
            size = max(n, SLICE_ROWS)
            return _dealt(d, F.floor((F.col("__rn") - 1) / size), F.pmod(F.col("__rn") - 1, F.lit(size)) > size - n)

        df = numbered(df, keys, "__rn")
        frame = lambda groups: W.partitionBy(*map(col, keys), *groups).orderBy("__rn").rangeBetween(-(n - 1), 0)
        return df, Win("frame", frame, sliced=None if keys else sliced, expire=leave)
    if name == "time":
        return _sliding_time(df, F.col(US), micros(args[0]), keys)
    if name == "externalTime":
        return _sliding_time(df, col(attribute(args[0])).cast("long") * 1000, micros(args[1]), keys)
    if name == "timeLength":
        span, n = micros(args[0]), count_of(args[1])
        held = F.collect_list(F.struct(*(col(a) for a in attributes), F.col(US))).over(ordered(keys).rowsBetween(-(n - 1), 0))
        df = df.withColumn("__held", held).withColumn("__held", F.filter("__held", lambda e: e[US] > F.col(US) - span))
        return df, Win("array", content="__held")
    if name == "lengthBatch":
        n = count_of(args[0])
        df = numbered(df, keys, "__batch").withColumn("__batch", F.floor((F.col("__batch") - 1) / n))
        by = W.partitionBy(*map(col, keys), "__batch")
        df = df.withColumns({"__n": F.count(F.lit(1)).over(by), "__end": F.max(US).over(by)}).where(F.col("__n") == n)
        return df, Win("batch", batch="__batch")
    if name == "batch":  # a chunk of arrivals; in a replay every event is one of its own
        df = numbered(df, keys, "__batch")
        return df.withColumn("__end", F.col(US)), Win("batch", batch="__batch")
    if name in ("timeBatch", "externalTimeBatch"):
        external = name == "externalTimeBatch"
        time = col(attribute(args[0])).cast("long") * 1000 if external else F.col(US)
        rest = args[1:] if external else args
        span = micros(rest[0])
        # The first event sets the origin, unless a start is given.
        origin = F.lit(micros(rest[1])) if len(rest) > 1 else whole(df, F.min(time), keys)
        df = df.withColumn("__origin", origin).withColumn("__batch", F.floor((time - F.col("__origin")) / span))
        return df.withColumn("__end", F.col("__origin") + (F.col("__batch") + 1) * span), Win("batch", batch="__batch")
    if name == "session":
        gap = micros(args[0])
        by = [*keys, *([attribute(args[1])] if len(args) > 1 and isinstance(args[1], ast.Var) else [])]
        fresh = F.coalesce((F.col(US) - F.lag(US).over(ordered(by)) > gap).cast("int"), F.lit(1))
        df = df.withColumn("__fresh", fresh)
        df = df.withColumn("__n", F.sum("__fresh").over(ordered(by).rowsBetween(W.unboundedPreceding, 0)))
        batch = F.struct(*(col(b) for b in by[len(keys) :]), F.col("__n"))
        df = df.withColumn("__batch", batch)
        return df.withColumn("__end", F.max(US).over(W.partitionBy(*map(col, by), "__n")) + gap), Win("batch", batch="__batch")
    if name == "cron":
        df = _with_next_fire(df, args[0].value)
        return df.withColumn("__batch", F.col("__end")), Win("batch", batch="__batch")
    if name == "delay":
        return df.withColumn(US, F.col(US) + micros(args[0])), Win("shift", running(keys).frame)
    if name in ("sort", "frequent", "lossyFrequent"):
        make = {"sort": folds.sort_of, "frequent": folds.frequent_of, "lossyFrequent": folds.lossy_of}[name]
        if name == "sort" and not keys:
            return _sorted_in_slices(df, make(args, attributes), args[0].value, folds.sort_keys(args), attributes)
        return _folded(df, make(args, attributes), keys, attributes)
    if (found := extensions.find(name, "window")) is not None:
        constants = [a.value for a in args if isinstance(a, ast.Const)]
        fn = found.fn
        return _folded(df, lambda: fn(*constants), keys, attributes)
    raise AnalysisError(f"no window {name}")


#: Marks events of earlier slices that a fold begins with, and doesn't emit.
SEED = "__seed"


def _sorted_in_slices(df: DataFrame, make: Callable, n: int, by: list[tuple[str, bool]], attributes: dict[str, str]) -> tuple[DataFrame, Win]:
    """sort(n) over all events: each slice's fold begins with the n first of all slices before, which are among the n
    first of each (SLICES times n rows, copied to the slices behind)."""
    df = in_slices(df).withColumn(SEED, F.lit(False))
    order = [F.desc_nulls_last(f"`{a}`") if down else F.asc_nulls_first(f"`{a}`") for a, down in by] + [F.col(US), F.col(SEQ)]
    first = lambda d: d.withColumn("__nth", F.row_number().over(W.partitionBy(SLICE).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")
    behind = F.when(F.col(SLICE) < SLICES - 1, F.sequence(F.col(SLICE) + 1, F.lit(SLICES - 1)))
    seeds = first(first(df).withColumn(SLICE, F.explode(behind))).withColumn(SEED, F.lit(True))
    df, win = _folded(df.unionByName(seeds), make, [SLICE], attributes)
    return df.drop(SLICE, SEED), win


def _folded(df: DataFrame, make: Callable, keys: list[str], attributes: dict[str, str]) -> tuple[DataFrame, Win]:
    """Contents by a fold over each partition's events in order; the state is the window itself, never the partition."""
    schema = T.StructType([*df.schema.fields, T.StructField("__held", T.ArrayType(T.StructType([f for f in df.schema.fields if f.name in attributes])))])
    names = [f.name for f in df.schema.fields]

    def run(batches):
        last, window = None, None
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            kept, held = [], []
            for row in pdf.itertuples(index=False):
                event = dict(zip(names, row))
                key = tuple(event[k] for k in keys)
                if window is None or key != last:
                    last, window = key, make()
                content = window.add(event)
                if content is None or event.get(SEED):  # the event itself isn't taken
                    continue
                kept.append(row)
                held.append([{a: e[a] for a in attributes} for e in content])
            out = pd.DataFrame(kept, columns=names)
            out["__held"] = held
            yield out

    dealt = df.repartition(*map(col, keys)) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*map(col, keys), US, SEQ).mapInPandas(run, schema), Win("array", content="__held")
