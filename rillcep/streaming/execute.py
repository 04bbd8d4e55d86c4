"""Queries over streaming DataFrames.

Stateless queries lower as in batch. Running aggregates, length and time windows, patterns and sequences, alone or
feeding each other, keep one program for each partition key in the state store; time-windowed joins are stream-stream joins; aligned batch and
session windows are Spark's own.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillcep.errors import AnalysisError, UndefinedStreamError
from rillcep.functions.expressions import Scope, compile_, conjuncts
from rillcep.lang import ast, parse
from rillcep.operators import select, windows
from rillcep.plans.lower import Lowering, Stream, inputs_of
from rillcep.schema import SEQ, US, col
from rillcep.streaming.program import Chain


def stream(env, cql: str, out: str, delay: str = "0 seconds", reorder: bool = True) -> DataFrame:
    """A streaming DataFrame of an output of one query, or of one query in a partition.

    delay: how late events may come. reorder: stateful queries hold events until the watermark passes them and run
    them in order of time (late ones are dropped); without it each micro-batch runs at once, in its own order of time,
    and late events are kept."""
    app = parse(cql)
    found = [(e, None) for e in app.elements if isinstance(e, ast.Query)]
    found += [(q, p) for p in app.elements if isinstance(p, ast.Partition) for q in p.queries]
    query, partition = next(((q, p) for q, p in found if q.output.key == out), (None, None))
    if query is None:
        raise UndefinedStreamError(out)
    calls = [h.call for h in query.input.handlers if isinstance(h, ast.Window)] if isinstance(query.input, ast.Single) else []
    stateful = isinstance(query.input, ast.Pattern) or calls or select._aggregates(query.select, _names(env))
    if isinstance(query.input, ast.Join):
        return _joined(env, query, partition, delay)
    if not stateful and partition is None:
        lowered = Lowering(env.streams, env.extensions).lower(app)
        return lowered.outputs[out].df.select(*map(col, lowered.outputs[out].attributes))
    queries, made = [], {out}
    while fresh := [q for q, _ in found if q.output.key in made and q not in queries]:  # those that lead to the output
        queries += fresh
        made |= {n for q in fresh for n in inputs_of(q.input)}
    if len(queries) == 1 and calls and calls[0].full in ("session", "timeBatch"):
        return _windowed(env, query, partition, calls[0], delay)
    if any(p is not partition for q, p in found if q in queries):
        raise AnalysisError("queries that feed each other are streamed in one partition, or in none")
    return _programmed(env, queries, out, partition, delay, reorder)


def _names(env):
    class Any:
        scope = Scope(None, env.extensions)

    return Any


def _keyed(env, name: str, partition) -> tuple[Stream, list[str]]:
    env.check_defined(name)
    return Lowering(env.streams, env.extensions)._keyed(name, env.streams[name], partition)


def _time(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("__time", F.timestamp_micros(F.col(US))).withWatermark("__time", delay)


def _programmed(env, queries: list[ast.Query], out: str, partition, delay: str, reorder: bool) -> DataFrame:
    made = {q.output.key for q in queries}
    names = list(dict.fromkeys(n for q in queries for n in inputs_of(q.input) if n not in made))
    tagged, attributes, keys = None, {}, []
    for n in names:
        s, keys = _keyed(env, n, partition)
        attributes[n] = list(s.attributes)
        one = s.df.select(US, SEQ, F.lit(n).alias("__stream"), *(col(k).cast("string").alias(k) for k in keys), F.to_json(F.struct(*map(col, s.attributes)), {"ignoreNullFields": "false"}).alias("__row"))
        tagged = one if tagged is None else tagged.unionByName(one)
    schema = _output_schema(env, queries, out, partition)
    Chain(queries, out, attributes)  # what can't be streamed shows here
    program, columns = pickle.dumps((queries, out, attributes)), [f.name for f in schema.fields]
    by = keys or ["__all"]
    if not keys:
        tagged = tagged.withColumn("__all", F.lit("all"))
    place = {n: i for i, n in enumerate(names)}

    def run(key, frames, state: GroupState):
        import json

        held, pending = pickle.loads(state.get[0]) if state.exists else (Chain(*pickle.loads(program)), [])
        for pdf in frames:
            pending += [(u, s, place[n], n, r) for u, s, n, r in zip(pdf[US].tolist(), pdf[SEQ].tolist(), pdf["__stream"], pdf["__row"])]
        pending.sort(key=lambda e: e[:3])
        if reorder:
            limit = state.getCurrentWatermarkMs() * 1000
            ready, pending = [e for e in pending if e[0] < limit], [e for e in pending if e[0] >= limit]
        else:
            ready, pending = pending, []
        rows = [row for u, s, _, n, r in ready for row in held.add({"us": u, "seq": s, "stream": n, "row": json.loads(r)})]
        state.update((pickle.dumps((held, pending)),))
        if reorder and pending:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, pending[0][0] // 1000 + 1))
        yield pd.DataFrame([row[:-1] for row in rows], columns=columns).astype(object)

    timeout = GroupStateTimeout.EventTimeTimeout if reorder else GroupStateTimeout.NoTimeout
    return _time(tagged, delay).groupBy(*map(col, by)).applyInPandasWithState(run, schema, T.StructType([T.StructField("state", T.BinaryType())]), "append", timeout)


def _output_schema(env, queries: list[ast.Query], out: str, partition) -> T.StructType:
    """By lowering the queries over empty batch streams of the same schemas."""
    empty = {}
    for n, s in env.streams.items():
        empty[n] = Stream(env.spark.createDataFrame([], s.df.schema), s.attributes, s.place)
    app = ast.App(elements=tuple(queries) if partition is None else (ast.Partition(partition.keys, tuple(queries)),))
    made = Lowering(empty, env.extensions).lower(app).outputs[out]
    return made.df.select(*map(col, made.attributes)).schema


def _windowed(env, query: ast.Query, partition, call: ast.Call, delay: str) -> DataFrame:
    """timeBatch with a start, and session: rows leave when the watermark passes the window's end."""
    s, keys = _keyed(env, query.input.stream, partition)
    lowering = Lowering(env.streams, env.extensions)
    bare = ast.Single(query.input.stream, tuple(h for h in query.input.handlers if not isinstance(h, ast.Window)), query.input.alias)
    rel = lowering._single(s, bare, keys)
    df = _time(rel.df, delay)
    by = list(keys)
    if call.full == "session":
        frame = F.session_window("__time", f"{windows.micros(call.args[0])} microseconds")
        by += [windows.attribute(a) for a in call.args[1:2] if isinstance(a, ast.Var)]
    else:
        if len(call.args) < 2:
            raise AnalysisError("a streaming timeBatch needs its start")
        frame = F.window("__time", f"{windows.micros(call.args[0])} microseconds", startTime=f"{windows.micros(call.args[1])} microseconds")
    groups = [v.name for v in query.select.group_by]
    if not by and not groups:  # a session window needs a key
        df, by = df.withColumn("__all", F.lit("all")), ["__all"]
    made = {c: (f"__a{i}", select._aggregate(c, rel)[0]) for i, c in enumerate(select._aggregates(query.select, rel))}
    done = df.groupBy(*map(col, dict.fromkeys([*by, *groups])), frame.alias("__window")).agg(*(c.alias(n) for n, c in made.values()))
    scope = rel.scope.with_(aggregate=lambda c: (F.col(made[c][0]), select._aggregate(c, rel)[1]))
    items = [(compile_(e, scope)[0], select.item_name(e, a, i)) for i, (e, a) in enumerate(query.select.items)]
    return done.select(*(c.alias(n) for c, n in items))


def _joined(env, query: ast.Query, partition, delay: str) -> DataFrame:
    """Both sides with time windows, equal on a key: an interval join, state bounded by the watermarks."""
    j: ast.Join = query.input
    if j.kind != "inner" or j.trigger or partition is not None:
        raise AnalysisError("only inner joins can be streamed")
    sides, names = [], {}
    for single, prefix in ((j.left, "__l_"), (j.right, "__r_")):
        env.check_defined(single.stream)
        s = env.streams[single.stream]
        calls = [h.call for h in single.handlers if isinstance(h, ast.Window)]
        if len(calls) != 1 or calls[0].full != "time":
            raise AnalysisError("both sides of a streaming join need a time window")
        df, scope = s.df, Scope(Lowering(env.streams, env.extensions)._resolver(s.attributes, {single.stream, single.name}), env.extensions, F.col(US))
        for h in single.handlers:
            if isinstance(h, ast.Filter):
                df = df.where(compile_(h.condition, scope)[0])
        df = df.select(*(col(c).alias(f"{prefix}{c}") for c in df.columns), F.timestamp_micros(F.col(US)).alias(f"{prefix}__time")).withWatermark(f"{prefix}__time", delay)
        names[single.name] = names[single.stream] = (prefix, s.attributes)
        sides.append((df, windows.micros(calls[0].args[0])))

    def resolve(v: ast.Var):
        prefix, attributes = names[v.stream] if v.stream else next(n for n in names.values() if v.name in n[1])
        return col(f"{prefix}{v.name}"), attributes[v.name]

    (left, keep_left), (right, keep_right) = sides
    scope = Scope(resolve, env.extensions)
    on = [compile_(c, scope)[0] for c in conjuncts(j.on)]
    lt, rt = F.col("__l___time"), F.col("__r___time")
    interval = lambda us: F.expr(f"INTERVAL '{us / 1e6:f}' SECOND")
    on += [rt < lt + interval(keep_left), rt > lt - interval(keep_right)]
    if j.within is not None:
        on += [rt <= lt + interval(j.within), rt >= lt - interval(j.within)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    items = [(compile_(e, scope)[0], select.item_name(e, a, i)) for i, (e, a) in enumerate(query.select.items)]
    return left.join(right, condition).select(*(c.alias(n) for c, n in items))
