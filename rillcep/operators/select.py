"""Projection, aggregation, having, per-chunk order and limit, and output rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillcep.errors import AnalysisError
from rillcep.functions.expressions import Scope, compile_, is_aggregate, over_array, over_frame, over_parts, result_type, variables, walk
from rillcep.lang import ast
from rillcep.operators.windows import HALO, SLICE, Win, in_slices, numbered, running, whole, with_before
from rillcep.schema import SEQ, US, col
from rillcep.types import SPARK


@dataclass
class Rel:
    """Events ready for select: hidden US, SEQ and partition columns `keys`; names resolve through `scope`."""

    df: DataFrame
    attributes: dict[str, str]  # name -> type, what `select *` yields
    scope: Scope
    keys: list[str]
    win: Win | None = None
    columns: dict[str, Column] | None = None  # where select * isn't the columns of the same name


def item_name(e, alias: str | None, at: int) -> str:
    if alias:
        return alias
    if isinstance(e, (ast.Var, ast.Call)):
        return e.name
    raise AnalysisError(f"select item {at + 1} needs an alias")


def _items(select: ast.Select, rel: Rel) -> list[tuple[object, str]]:
    if select.items is None:
        return [(None, n) for n in rel.attributes]
    out = [(e, item_name(e, alias, i)) for i, (e, alias) in enumerate(select.items)]
    if len({n for _, n in out}) != len(out):
        raise AnalysisError("two select items of one name")
    return out


def _typed(e, name: str, rel: Rel, scope: Scope) -> tuple[Column, str]:
    if e is None:
        return (rel.columns[name] if rel.columns else col(name)), rel.attributes[name]
    return compile_(e, scope)


def _aggregates(select: ast.Select, rel: Rel) -> list[ast.Call]:
    roots = [e for e, _ in select.items or ()] + [select.having]
    return list(dict.fromkeys(x for r in roots for x in walk(r) if is_aggregate(x, rel.scope.extensions)))


def _arguments(call: ast.Call, scope: Scope) -> tuple[list[Column], list[str]]:
    args = [compile_(a, scope) for a in call.args if not (isinstance(a, ast.Const) and a.type == "all")]
    return [c for c, _ in args], [t for _, t in args]


def _aggregate(call: ast.Call, rel: Rel, bind=lambda c: c) -> tuple[Column, str]:
    """A built-in or extension aggregate; bind puts it over a window."""
    cols, types = _arguments(call, rel.scope)
    if (found := rel.scope.extensions.find(call.full, "aggregator")) is not None:
        return bind(found.fn(*cols)), found.type_of(types)
    return over_frame(call.name, cols, types, bind), result_type(call.name, types) if types else "long"


def apply(select: ast.Select, rel: Rel, kind: str = "current") -> tuple[DataFrame, dict[str, str], str | None, list[str]]:
    """(output with US, SEQ and keys; types of its attributes; chunk column or None; hidden group columns)."""
    aggregates = _aggregates(select, rel)
    groups = [compile_(v, rel.scope)[0] for v in select.group_by]
    if kind == "all":
        current, expired = apply(select, rel, "current"), apply(select, rel, "expired")
        return current[0].unionByName(expired[0]), current[1], current[2], current[3]
    if kind == "expired":
        if aggregates or rel.win is None or rel.win.expire is None:
            raise AnalysisError("expired events need a sliding window and no aggregates")
        rel = Rel(rel.win.expire(rel.df), rel.attributes, rel.scope, rel.keys, None, rel.columns)
    win = rel.win or running(rel.keys)
    if win.kind == "batch":
        return _batched(select, rel, win, aggregates, groups)
    df = rel.df
    sliced = win.sliced is not None and aggregates and not groups and not any(a.name.endswith("Forever") for a in aggregates)
    df, inside = (win.sliced(df), [F.col(SLICE)]) if sliced else (df, groups)
    spec = win.frame(inside) if win.frame and win.kind != "time" else None
    if win.kind == "time" and any(rel.scope.extensions.find(a.full, "aggregator") for a in aggregates):
        name, place, spec = win.frame(inside)
        df = df.withColumn(name, place)
    forever = running(rel.keys).frame(groups)
    firsts: dict[ast.Call, str] = {}
    if win.kind == "running":  # what is distinct so far are the first occurrences so far, not a set of all for each row
        for call in aggregates:
            if (value := _distinct(call, rel)) is not None:
                firsts[call] = f"__first{len(firsts)}"
                nth = F.row_number().over(W.partitionBy(*map(col, rel.keys), *groups, value).orderBy(US, SEQ))
                df = df.withColumn(firsts[call], F.when((nth == 1) & value.isNotNull(), value))
    global_: dict[ast.Call, Column] = {}
    if win.kind == "running" and aggregates and not groups and not rel.keys and all(a.name in MERGED and rel.scope.extensions.find(a.full, "aggregator") is None for a in aggregates):
        df, global_ = _running_globally(df, aggregates, rel, firsts)
        forever = W.partitionBy(SLICE).orderBy(US, SEQ).rowsBetween(W.unboundedPreceding, 0)
    names = [f"__g{i}" for i in range(len(groups))]

    def bound(call: ast.Call):
        if win.kind == "array" and call.name not in ("maxForever", "minForever"):
            return _over_content(call, rel, win, select.group_by)
        if call in global_:
            return global_[call], _aggregate(call, rel)[1]
        if call in firsts:
            return (F.count if call.name == "distinctCount" else F.collect_list)(firsts[call]).over(spec), _aggregate(call, rel)[1]
        if win.kind == "time" and not call.name.endswith("Forever") and rel.scope.extensions.find(call.full, "aggregator") is None:
            cols, types = _arguments(call, rel.scope)
            older, peers = win.parts(inside)
            made = over_parts(call.name, cols, types, lambda c: c.over(older), lambda c: c.over(peers))
            return made, result_type(call.name, types) if types else "long"
        frame = forever if call.name.endswith("Forever") else spec
        return _aggregate(call, rel, lambda c: c.over(frame))

    scope = rel.scope.with_(aggregate=bound)
    items = [(_typed(e, n, rel, scope), n) for e, n in _items(select, rel)]
    types = {n: t for (_, t), n in items}
    having = _having(select, scope, types)
    out = df.select(*(c.alias(n) for (c, _), n in items), US, SEQ, *rel.keys, *(g.alias(n) for g, n in zip(groups, names)), *([having.alias("__having")] if having is not None else []), *([HALO] if sliced else []))
    if sliced:
        out = out.where(f"not {HALO}").drop(HALO)
    if having is not None:
        out = out.where("__having").drop("__having")
    if select.limit is not None or select.offset is not None:  # every event is a chunk of its own
        limit, offset = (x.value if x is not None else d for x, d in ((select.limit, 1), (select.offset, 0)))
        if limit < 1 or offset > 0:
            out = out.where(F.lit(False))
    return out, types, None, names


#: Running aggregates that are put together from those of slices, and how.
MERGED = {"count": F.sum, "sum": F.sum, "avg": F.sum, "distinctCount": F.sum, "min": F.min, "minForever": F.min, "max": F.max, "maxForever": F.max, "and": F.bool_and, "or": F.bool_or}


def _distinct(call: ast.Call, rel: Rel) -> Column | None:
    """What a distinctCount, or a unionSet of single values, collects."""
    if rel.scope.extensions.find(call.full, "aggregator") is not None or not call.args:
        return None
    if call.name == "distinctCount":
        return _arguments(call, rel.scope)[0][0]
    inner = call.args[0]
    if call.name == "unionSet" and isinstance(inner, ast.Call) and inner.full == "createSet" and len(inner.args) == 1:
        return compile_(inner.args[0], rel.scope)[0]
    return None


def _running_globally(df: DataFrame, aggregates: list[ast.Call], rel: Rel, firsts: dict[ast.Call, str]) -> tuple[DataFrame, dict[ast.Call, Column]]:
    """Running aggregates over one order of all events: those of the slices before, merged with the event's slice so far."""
    parts, made = {}, {}
    so_far = W.partitionBy(SLICE).orderBy(US, SEQ).rowsBetween(W.unboundedPreceding, 0)

    def both(made_by, merge) -> Column:
        name = f"__before{len(parts)}"
        parts[name] = (made_by(lambda c: c), merge)
        a, b = F.col(name), made_by(lambda c: c.over(so_far))
        if merge is F.sum:
            return F.coalesce(a + b, a, b)
        return {F.min: F.least, F.max: F.greatest}[merge](a, b) if merge in (F.min, F.max) else F.coalesce(a & b if merge is F.bool_and else a | b, a, b)

    for call in aggregates:
        cols, types = _arguments(call, rel.scope)
        if call in firsts:
            made[call] = both(lambda bind, c=firsts[call]: bind(F.count(c)), F.sum)
        elif call.name == "avg":
            x = cols[0].cast("double")
            made[call] = F.try_divide(both(lambda bind, x=x: bind(F.sum(x)), F.sum), both(lambda bind, x=x: bind(F.count(x)), F.sum))
        else:
            made[call] = both(lambda bind, c=call.name, a=cols, t=types: over_frame(c, a, t, bind), MERGED[call.name])
    return with_before(in_slices(df), parts), made


def _having(select: ast.Select, scope: Scope, types: dict[str, str], outputs: dict[str, Column] | None = None) -> Column | None:
    if select.having is None:
        return None
    by_alias = {alias or (e.name if isinstance(e, (ast.Var, ast.Call)) else None): e for e, alias in select.items or ()}

    def resolve(v: ast.Var):
        if v.stream is None and v.name in by_alias and by_alias[v.name] != v:
            return (outputs[v.name], types[v.name]) if outputs else compile_(by_alias[v.name], scope)
        return scope.resolve(v)

    return F.coalesce(compile_(select.having, scope.with_(resolve=resolve))[0], F.lit(False))


def _over_content(call: ast.Call, rel: Rel, win: Win, group_by) -> tuple[Column, str]:
    cols, types = _arguments(call, rel.scope)
    content = F.col(win.content)
    for v in group_by:
        content = F.filter(content, _same(v.name))
    if any(not isinstance(a, (ast.Var, ast.Const)) for a in call.args):
        raise AnalysisError("aggregates over this window take plain attributes")
    name = next((a.name for a in call.args if isinstance(a, ast.Var)), None)
    values = F.transform(content, lambda e: e[name]) if name else content
    if (found := rel.scope.extensions.find(call.full, "aggregator")) is not None:
        raise AnalysisError(f"{call.full} ({found.kind}) can't be used with this window")
    return over_array(call.name, values, types), result_type(call.name, types) if types else "long"


def _same(name: str):
    return lambda e: e[name].eqNullSafe(col(name))


def _batched(select: ast.Select, rel: Rel, win: Win, aggregates, groups):
    """Events leave at the end of their batch: with aggregates one row for each batch and group, holding the last
    event's attributes; without, every event."""
    df, names = rel.df, [f"__g{i}" for i in range(len(groups))]
    if not aggregates:
        items = [(_typed(e, n, rel, rel.scope), n) for e, n in _items(select, rel)]
        having = _having(select, rel.scope, {n: t for (_, t), n in items})
        df = df if having is None else df.where(having)
        out = df.select(*(c.alias(n) for (c, _), n in items), F.col("__end").alias(US), SEQ, *rel.keys, F.col(win.batch).alias("__chunk"), *(g.alias(n) for g, n in zip(groups, names)))
        types = {n: t for (_, t), n in items}
    else:
        used = list(dict.fromkeys(v.name for e, _ in _items(select, rel) if e is not None for v in variables(e)))
        bound = {call: (f"__a{i}", _aggregate(call, rel)) for i, call in enumerate(aggregates)}
        last = F.max_by(F.struct(*(F.struct(col(c).alias("v")).alias(c) for c in dict.fromkeys(used) if c in df.columns), F.col(SEQ)), F.struct(US, SEQ))
        done = df.groupBy(*map(col, rel.keys), F.col(win.batch).alias("__chunk"), *(g.alias(n) for g, n in zip(groups, names)))
        done = done.agg(*(c.alias(n) for n, (c, _) in bound.values()), last.alias("__last"), F.max("__end").alias(US))
        resolve = lambda v: (F.col("__last")[v.name]["v"], rel.scope.resolve(v)[1])
        scope = rel.scope.with_(resolve=resolve, aggregate=lambda call: (F.col(bound[call][0]), bound[call][1][1]))
        items = [(_typed(e, n, rel, scope), n) for e, n in _items(select, rel)]
        types = {n: t for (_, t), n in items}
        having = _having(select, scope, types)
        done = done if having is None else done.where(having)
        out = done.select(*(c.alias(n) for (c, _), n in items), US, F.col("__last")[SEQ].alias(SEQ), *rel.keys, "__chunk", *names)
    if select.order_by or select.limit is not None or select.offset is not None:
        order = [F.asc_nulls_first(f"`{v.name}`") if up else F.desc_nulls_last(f"`{v.name}`") for v, up in select.order_by]
        place = F.row_number().over(W.partitionBy(*map(col, rel.keys), "__chunk").orderBy(*order, US, SEQ))
        first = select.offset.value if select.offset is not None else 0
        out = _kept(out, place, first, select.limit)
    return out, types, "__chunk", names


def _kept(out: DataFrame, place: Column, first: int, limit) -> DataFrame:
    out = out.withColumn("__place", place).where(F.col("__place") > first)
    out = out if limit is None else out.where(F.col("__place") <= first + limit.value)
    # The order of a chunk shows in SEQ.
    return out.withColumn(SEQ, F.col("__place").cast("long")).drop("__place")


def limited(df: DataFrame, rate: ast.Rate, keys: list[str], groups: list[str]) -> DataFrame:
    """Output rates. first and last are per group; all and snapshot hold rows back to the end of their n or bucket.

    A count that isn't filled at the end never leaves; time buckets start at the first output."""
    by = [*keys, *groups]
    part = W.partitionBy(*map(col, by))
    if rate.events:
        df = numbered(df, keys if rate.kind == "all" else by, "__nth").withColumn("__nth", F.col("__nth") - 1)
        df = df.withColumn("__slot", F.floor(F.col("__nth") / rate.events))
        if rate.kind == "first":
            return df.where(F.col("__nth") % rate.events == 0).drop("__nth", "__slot")
        if rate.kind in ("last", "snapshot"):
            return df.where(F.col("__nth") % rate.events == rate.events - 1).drop("__nth", "__slot")
        slot = W.partitionBy(*map(col, keys), "__slot")
        df = df.withColumns({"__n": F.count(F.lit(1)).over(slot), "__at": F.max(US).over(slot)}).where(F.col("__n") == rate.events)
        return df.withColumn(US, F.col("__at")).drop("__nth", "__slot", "__n", "__at")
    df = df.withColumn("__from", whole(df, F.min(US), keys))
    df = df.withColumn("__slot", F.floor((F.col(US) - F.col("__from")) / rate.time))
    end = F.col("__from") + (F.col("__slot") + 1) * rate.time
    if rate.kind == "all":
        return df.withColumn(US, end).drop("__slot", "__from")
    slot = W.partitionBy(*map(col, by), "__slot")
    if rate.kind == "first":
        df = df.withColumn("__nth", F.row_number().over(slot.orderBy(US, SEQ))).where(F.col("__nth") == 1)
        return df.drop("__nth", "__slot", "__from")
    df = df.withColumn("__nth", F.row_number().over(slot.orderBy(F.desc(US), F.desc(SEQ)))).where(F.col("__nth") == 1).drop("__nth")
    if rate.kind == "last":
        return df.withColumn(US, end).drop("__slot", "__from")
    final = whole(df, F.max("__slot"), keys)
    until = F.coalesce(F.lead("__slot").over(part.orderBy("__slot")) - 1, F.col("__final"))
    df = df.withColumn("__final", final)
    df = df.withColumn("__until", until).withColumn("__slot", F.explode(F.sequence("__slot", "__until"))).drop("__until")
    return df.withColumn(US, F.col("__from") + (F.col("__slot") + 1) * rate.time).drop("__slot", "__from", "__final")


def cast_to(df: DataFrame, types: dict[str, str], wanted: dict[str, str]) -> DataFrame:
    """Outputs into a defined stream: by position, in its names and types."""
    if len(types) != len(wanted):
        raise AnalysisError(f"{len(types)} attributes for {len(wanted)} defined ones")
    hidden = [c for c in df.columns if c not in types]
    return df.select(*(col(a).cast(SPARK[t]).alias(b) if t in SPARK else col(a).alias(b) for a, (b, t) in zip(types, wanted.items())), *hidden)
