"""From a parsed application to DataFrames: queries in the order of their data flow, each by its operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcep.errors import AnalysisError, UndefinedStreamError
from rillcep.functions.expressions import Scope, compile_, conjuncts, variables
from rillcep.functions.extensions import Registry
from rillcep.lang import ast
from rillcep.operators import joins, patterns, select, tables, windows
from rillcep.operators.select import Rel
from rillcep.schema import SEQ, US, col
from rillcep.types import SPARK, attribute_type


@dataclass
class Stream:
    """Events with hidden US and SEQ; inside a partition also its key columns."""

    df: DataFrame
    attributes: dict[str, str]
    place: int = 0
    window: ast.Call | None = None  # of a named window


@dataclass
class App:
    """A lowered application. outputs: what `insert into` made, by name."""

    outputs: dict[str, Stream] = field(default_factory=dict)
    aggregations: dict[str, dict[str, DataFrame]] = field(default_factory=dict)


def inputs_of(source) -> list[str]:
    if isinstance(source, ast.Single):
        return [source.key]
    if isinstance(source, ast.Join):
        return [source.left.key, source.right.key]

    def atoms(e):
        if isinstance(e, ast.Atom):
            return [e.stream]
        if isinstance(e, ast.Logical):
            return atoms(e.left) + atoms(e.right)
        if isinstance(e, ast.Absent):
            return [e.atom.stream, *(atoms(e.partner) if e.partner else [])]
        return [s for x in e.elements for s in atoms(x)]

    return list(dict.fromkeys(s for e in source.elements for s in atoms(e)))


def tables_in(q: ast.Query) -> list[str]:
    sides = [q.input] if isinstance(q.input, ast.Single) else [q.input.left, q.input.right] if isinstance(q.input, ast.Join) else []
    return [c.table for s in sides for h in s.handlers if isinstance(h, ast.Filter) for c in _in_tables(h.condition)]


def _in_tables(e):
    if isinstance(e, ast.InTable):
        return [e]
    if isinstance(e, ast.Unary):
        return _in_tables(e.arg)
    if isinstance(e, ast.Binary):
        return _in_tables(e.left) + _in_tables(e.right)
    return []


class Lowering:
    def __init__(self, streams: dict[str, Stream], extensions: Registry):
        self.streams, self.extensions = dict(streams), extensions
        self.defined: dict[str, ast.Definition] = {}
        self.changes: dict[str, list] = {}
        self.app = App()

    # -- application
    def lower(self, app: ast.App) -> App:
        for d in app.definitions:
            if d.name in self.defined:
                raise AnalysisError(f"{d.name} is defined twice")
            self.defined[d.name] = d
            if d.kind == "trigger":
                self.streams[d.name] = self._trigger(d)
        todo = [(q, None) for q in app.elements if isinstance(q, ast.Query)]
        todo += [(q, p) for p in app.elements if isinstance(p, ast.Partition) for q in p.queries]
        inner: dict[int, dict[str, Stream]] = {}
        while todo:
            made = lambda q, p: (id(p) if q.output.inner else None, q.output.key)
            pending = {made(q, p) for q, p in todo}
            reads = lambda q, p: {(id(p) if n.startswith("#") else None, n) for n in [*inputs_of(q.input), *tables_in(q)]}
            ready = next(((q, p) for q, p in todo if not reads(q, p) & (pending - {made(q, p)} if q.output.kind != "insert" else pending)), None)
            if ready is None:
                raise AnalysisError("queries feed each other in a circle")
            todo.remove(ready)
            self._query(*ready, inner.setdefault(id(ready[1]), {}))
        for d in app.definitions:
            if d.kind == "aggregation":
                self.app.aggregations[d.name] = self._aggregation(d)
        return self.app

    def _trigger(self, d: ast.Definition) -> Stream:
        """Events at a fixed interval, or once, over the time that the registered streams span."""
        spans = None
        for s in self.streams.values():
            one = s.df.select(F.min(US).alias("a"), F.max(US).alias("b"))
            spans = one if spans is None else spans.unionByName(one)
        if spans is None:
            raise AnalysisError("a trigger needs registered streams")
        spans = spans.agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a is not null")
        if d.every:
            # In two steps, so that the ticks of a long time are made by many tasks and never in one row.
            spans = spans.select(F.explode(F.sequence("a", "b", F.lit(d.every * 1000))).alias("a"), "b").repartition("a")
            ticks = F.explode(F.sequence("a", F.least(F.col("a") + d.every * 999, "b"), F.lit(d.every)))
        elif d.at == "start":
            ticks = F.col("a")
        else:
            spans, ticks = windows.cron_ticks(spans, d.at), F.col(US)
        df = spans.select(ticks.alias(US)).select(F.floor(F.col(US) / 1000).cast("long").alias("triggered_time"), US, F.lit(0).cast("long").alias(SEQ))
        return Stream(df, {"triggered_time": "long"}, len(self.streams))

    def _aggregation(self, d: ast.Definition) -> dict[str, DataFrame]:
        rel = self._single(self._stream(d.source, {}), d.source, [])
        keys = [(compile_(v, rel.scope)[0], v.name) for v in d.select.group_by]
        items, named = [], {v.name for v in d.select.group_by}
        for i, (e, alias) in enumerate(d.select.items or ()):
            if isinstance(e, ast.Var) and e.name in named:
                continue
            items.append((select._aggregate(e, rel)[0], select.item_name(e, alias, i)))
        return {u: tables.increments(rel.df, u, d.by, keys, items) for u in d.units}

    # -- streams
    def _stream(self, single: ast.Single, inner: dict[str, Stream]) -> Stream:
        return self._named(single.key, inner)

    def _named(self, key: str, inner: dict[str, Stream]) -> Stream:
        if key.startswith("#"):
            if key in inner:
                return inner[key]
        elif key in self.defined and self.defined[key].kind == "table":
            return self._table(key)
        else:
            d = self.defined.get(key)
            found = self.app.outputs.get(key) or self.streams.get(key)
            if found is not None:
                return Stream(found.df, found.attributes, found.place, d.window.call if d is not None and d.window else None)
        raise UndefinedStreamError(key)

    def _table(self, name: str) -> Stream:
        attributes = dict(self.defined[name].attributes)
        if name not in self.changes:
            raise AnalysisError(f"nothing is inserted into table {name}")
        return Stream(tables.versions(attributes, self.changes[name]), attributes)

    def _keyed(self, name: str, stream: Stream, partition: ast.Partition | None) -> tuple[Stream, list[str]]:
        """The stream with its partition's key columns."""
        if partition is None:
            return stream, []
        own = [v for n, v in partition.keys if n == name]
        every = [f"__p{i}" for i in range(max(1, len(own)))]
        if not own:
            have = [c for c in stream.df.columns if c.startswith("__p")]
            if not have:
                raise AnalysisError(f"the partition has no key for {name}")
            return stream, have
        scope = Scope(self._resolver(stream.attributes, {name}), self.extensions, F.col(US))
        df = stream.df
        for k, value in zip(every, own):
            if isinstance(value, tuple):
                c = None
                for condition, label in value:
                    test = compile_(condition, scope)[0]
                    c = F.when(test, label) if c is None else c.when(test, label)
                df = df.withColumn(k, c).where(F.col(k).isNotNull())
            else:
                df = df.withColumn(k, compile_(value, scope)[0])
        return Stream(df, stream.attributes, stream.place, stream.window), every

    def _resolver(self, attributes: dict[str, str], names: set[str]):
        def resolve(v: ast.Var):
            if v.stream is not None and v.stream not in names:
                raise AnalysisError(f"unknown stream {v.stream}")
            if v.name not in attributes:
                raise AnalysisError(f"unknown attribute {v.name}")
            return col(v.name), attributes[v.name]

        return resolve

    def _filtered(self, df: DataFrame, condition, scope: Scope) -> DataFrame:
        for c in conjuncts(condition):
            negative, test = (True, c.arg) if isinstance(c, ast.Unary) and c.op == "not" and isinstance(c.arg, ast.InTable) else (False, c)
            if isinstance(test, ast.InTable):
                df = self._in_table(df, test, scope, negative)
            else:
                df = df.where(compile_(c, scope)[0])
        return df

    def _in_table(self, df: DataFrame, test: ast.InTable, scope: Scope, negative: bool) -> DataFrame:
        """Events for which the table holds a matching row at that time."""
        table = self._table(test.table)
        rows = joins.prefixed(table.df, "__t_")

        def resolve(v: ast.Var):
            if v.stream == test.table:
                return col(f"__t_{v.name}"), table.attributes[v.name]
            return scope.resolve(v)

        order = F.struct(col(US).alias("a"), col(SEQ).alias("b"))
        start = F.struct(col(f"__t_{US}").alias("a"), col(f"__t_{SEQ}").alias("b"))
        end = F.struct(col("__t___to_us").alias("a"), col("__t___to_seq").alias("b"))
        on = compile_(test.condition, scope.with_(resolve=resolve))[0] & (start < order) & (col("__t___to_us").isNull() | (order < end))
        of_table = lambda e: {v.stream == test.table for v in variables(e)}
        equal = any(isinstance(c, ast.Binary) and c.op == "==" and {frozenset(of_table(c.left)), frozenset(of_table(c.right))} == {frozenset({True}), frozenset({False})} for c in conjuncts(test.condition))
        return df.join(rows if equal else joins.small(rows), on, "left_anti" if negative else "left_semi")

    def _single(self, stream: Stream, single: ast.Single, keys: list[str]) -> Rel:
        df, attributes, win = stream.df, dict(stream.attributes), None
        names = {single.stream, single.name}
        if stream.window is not None:
            df, win = windows.attach(df, stream.window, keys, attributes, self.extensions)
        for h in single.handlers:
            scope = Scope(self._resolver(attributes, names), self.extensions, F.col(US))
            if isinstance(h, ast.Filter):
                df = self._filtered(df, h.condition, scope)
            elif isinstance(h, ast.Window):
                if win is not None:
                    raise AnalysisError("two windows on one stream")
                df, win = windows.attach(df, h.call, keys, attributes, self.extensions)
            else:
                df, attributes = self._handled(df, h.call, attributes, scope)
        return Rel(df, attributes, Scope(self._resolver(attributes, names), self.extensions, F.col(US)), keys, win)

    def _handled(self, df: DataFrame, call: ast.Call, attributes: dict[str, str], scope: Scope):
        if call.full == "log":
            return df, attributes
        if call.full == "pol2Cart":
            theta, rho = (compile_(a, scope)[0] for a in call.args[:2])
            made = {"x": rho * F.cos(F.radians(theta)), "y": rho * F.sin(F.radians(theta))}
            if len(call.args) > 2:
                made["z"] = compile_(call.args[2], scope)[0].cast("double")
            return df.withColumns(made), attributes | dict.fromkeys(made, "double")
        found = self.extensions.find(call.full, "stream")
        if found is None:
            raise AnalysisError(f"no stream function {call.full}")
        out = found.fn(df, *(a.value if isinstance(a, ast.Const) else compile_(a, scope)[0] for a in call.args))
        new = {f.name: attribute_type(f.dataType) for f in out.schema.fields if f.name not in df.columns}
        return out, attributes | new

    # -- queries
    def _query(self, q: ast.Query, partition: ast.Partition | None, inner: dict[str, Stream]) -> None:
        if isinstance(q.input, ast.Single):
            stream, keys = self._keyed(q.input.key, self._stream(q.input, inner), partition)
            rel = self._single(stream, q.input, keys)
        elif isinstance(q.input, ast.Join):
            rel = self._join(q.input, partition, inner)
        else:
            rel = self._pattern(q.input, partition, inner)
        out, types, chunk, groups = select.apply(q.select, rel, q.output.events if q.output.kind == "insert" else "current")
        if q.rate is not None:
            out = select.limited(out, q.rate, rel.keys, groups)
        out = out.drop(*groups, *([chunk] if chunk else []))
        if not q.output.inner:
            out = out.drop(*rel.keys)
        self._put(q.output, out, types, inner)

    def _put(self, output: ast.Output, out: DataFrame, types: dict[str, str], inner: dict[str, Stream]) -> None:
        d = self.defined.get(output.target) if not output.inner else None
        if output.kind != "insert" or d is not None and d.kind == "table":
            if d is None or d.kind != "table":
                raise UndefinedStreamError(output.target)
            self._change(output, out, types, dict(d.attributes))
            return
        if d is not None and d.kind == "trigger":
            raise AnalysisError(f"{output.target} is a trigger")
        if d is not None:
            out, types = select.cast_to(out, types, dict(d.attributes)), dict(d.attributes)
        home = inner if output.inner else self.app.outputs
        if output.key in home:
            old = home[output.key]
            out = old.df.unionByName(select.cast_to(out, types, old.attributes))
            types = old.attributes
        home[output.key] = Stream(out, types, home[output.key].place if output.key in home else len(self.streams) + len(self.app.outputs))

    def _change(self, output: ast.Output, out: DataFrame, types: dict[str, str], attributes: dict[str, str]) -> None:
        table = output.target
        if output.kind == "insert":
            self.changes.setdefault(table, []).append(("insert", select.cast_to(out, types, attributes), (), ()))
            return
        key, resolve = {}, self._resolver(types, {table})
        scope = Scope(resolve, self.extensions, F.col(US))
        for c in conjuncts(output.on):
            sides = (c.left, c.right) if isinstance(c, ast.Binary) and c.op == "==" else ()
            own = [i for i, s in enumerate(sides) if isinstance(s, ast.Var) and s.stream == table]
            if len(own) != 1:
                raise AnalysisError("`on` must compare the table's attributes for equality")
            key[sides[own[0]].name] = compile_(sides[1 - own[0]], scope)[0]
        sets = {v.name: compile_(e, scope)[0] for v, e in output.sets} if output.sets else {n: col(n) for n in attributes if n in types}
        made = {n: (sets[n] if n in sets else key[n] if n in key else F.lit(None)).cast(SPARK[t]) for n, t in attributes.items()}
        rows = out.select(*(c.alias(n) for n, c in made.items()), US, SEQ)
        given = tuple(sets) + tuple(k for k in key if k not in sets)
        self.changes.setdefault(table, []).append((output.kind, rows, tuple(sorted(key)), given))

    def _pattern(self, p: ast.Pattern, partition, inner) -> Rel:
        sources, keys = {}, []
        for name in inputs_of(p):
            stream, keys = self._keyed(name, self._named(name, inner), partition)
            sources[name] = patterns.Source(stream.df, stream.attributes, stream.place)
        found = patterns.match(p, sources, keys, self.extensions)

        def resolve(v: ast.Var):
            ref = v.stream
            if ref is None:
                near = [r for r, (_, a, _) in found.refs.items() if v.name in a]
                if len(near) != 1:
                    raise AnalysisError(f"{v.name} isn't of one event of the pattern")
                ref = near[0]
            elif ref not in found.refs:
                raise AnalysisError(f"unknown event {ref}")
            column, attributes, many = found.refs[ref]
            if v.name not in attributes:
                raise AnalysisError(f"{ref} has no attribute {v.name}")
            c = col(column)
            if many or v.index is not None:
                if not many:
                    c = F.when(F.lit(v.index in (0, ("last", 0))), c)
                elif isinstance(v.index, tuple):
                    c = F.get(c, F.size(c) - 1 - v.index[1])
                else:
                    c = F.get(c, F.lit(v.index or 0))
            return c[v.name], attributes[v.name]

        columns, types = {}, {}
        for ref, (_, attributes, _) in found.refs.items():
            for a in attributes:
                if not ref.startswith("__"):
                    columns[f"{ref}_{a}"], types[f"{ref}_{a}"] = resolve(ast.Var(a, ref))
        return Rel(found.df, types, Scope(resolve, self.extensions, F.col(US)), keys, None, columns)

    def _join(self, j: ast.Join, partition, inner) -> Rel:
        sides, names, keys = [], {}, []
        for place, (single, prefix) in enumerate(((j.left, "__l_"), (j.right, "__r_"))):
            rolled = single.key in self.defined and self.defined[single.key].kind == "aggregation"
            table = rolled or single.key in self.defined and self.defined[single.key].kind == "table"
            stream = self._rolled(single.key, j) if rolled else self._stream(single, inner)
            own: list[str] = []
            if not table:
                stream, own = self._keyed(single.key, stream, partition)
            side, attributes = self._side(stream, single, own, prefix, place, table)
            keys = keys or own
            if single.name in names:
                raise AnalysisError(f"both sides of the join are {single.name}")
            names[single.name] = (prefix, attributes)
            names.setdefault(single.stream, (prefix, attributes))
            sides.append(side)

        def side_of(v: ast.Var):
            near = [names[v.stream]] if v.stream in names else [n for k, n in names.items() if v.stream is None and v.name in n[1]]
            near = list({n[0]: n for n in near}.values())
            if len(near) != 1 or v.name not in near[0][1]:
                raise AnalysisError(f"{v.stream + '.' if v.stream else ''}{v.name} isn't of one side of the join")
            return near[0]

        def resolve(v: ast.Var):
            prefix, attributes = side_of(v)
            return col(f"{prefix}{v.name}"), attributes[v.name]

        scope = Scope(resolve, self.extensions, F.col(US))
        equal, rest = [], None
        for c in conjuncts(j.on):
            pair = self._equality(c, side_of, scope)
            if pair is not None:
                equal.append(pair)
            else:
                test = F.coalesce(compile_(c, scope)[0], F.lit(False))
                rest = test if rest is None else rest & test
        for s in sides:
            s.keys = keys if s.keys else []
        df = joins.join(sides[0], sides[1], j.kind, j.trigger, equal, rest, j.within)
        # Order among the pairs of one arrival.
        columns, types = {}, {}
        shared = set(names[j.left.name][1]) & set(names[j.right.name][1])
        for single in (j.left, j.right):
            prefix, attributes = names[single.name]
            for a, t in attributes.items():
                n = f"{single.name}_{a}" if a in shared else a
                columns[n], types[n] = col(f"{prefix}{a}"), t
        return Rel(df, types, scope, keys, None, columns)

    def _rolled(self, name: str, j: ast.Join) -> Stream:
        """An aggregation as the static side of a join: its rows of the unit, with AGG_TIMESTAMP in the bounds."""
        units = self._aggregation(self.defined[name])
        if j.per not in units:
            raise AnalysisError(f"{name} isn't kept per {j.per}")
        df = units[j.per]
        if j.between is not None:
            a, b = (compile_(e, Scope(self._resolver({}, set()), self.extensions))[0] for e in j.between)
            df = df.where((F.col("AGG_TIMESTAMP") >= a) & (F.col("AGG_TIMESTAMP") < b))
        attributes = {f.name: attribute_type(f.dataType) for f in df.schema.fields}
        always = {US: F.lit(-(1 << 62)), SEQ: F.lit(0).cast("long"), **{c: F.lit(None).cast("long") for c in tables.FROM_TO}}
        return Stream(df.withColumns(always), attributes)

    def _equality(self, c, side_of, scope: Scope) -> tuple[Column, Column] | None:
        if not (isinstance(c, ast.Binary) and c.op == "=="):
            return None
        places = []
        for side in (c.left, c.right):
            own = {side_of(v)[0] for v in variables(side)}
            if len(own) != 1:
                return None
            places.append(own.pop())
        if places[0] == places[1]:
            return None
        a, b = compile_(c.left, scope)[0], compile_(c.right, scope)[0]
        return (a, b) if places[0] == "__l_" else (b, a)

    def _side(self, stream: Stream, single: ast.Single, keys: list[str], prefix: str, place: int, table: bool):
        df, attributes, keep = stream.df, dict(stream.attributes), None
        if table:
            keep = ("versions",)
        calls = [stream.window] if stream.window is not None else []
        for h in single.handlers:
            if isinstance(h, ast.Window):
                calls.append(h.call)
                continue
            scope = Scope(self._resolver(attributes, {single.stream, single.name}), self.extensions, F.col(US))
            if isinstance(h, ast.Filter):
                if calls:
                    raise AnalysisError("a filter behind a window isn't supported in joins")
                df = self._filtered(df, h.condition, scope)
            else:
                df, attributes = self._handled(df, h.call, attributes, scope)
        for call in calls:
            if call.full == "length":
                keep = ("length", windows.count_of(call.args[0]))
            elif call.full == "time":
                keep = ("time", windows.micros(call.args[0]))
            else:
                raise AnalysisError(f"window {call.full} can't be joined")
        extra = [US, SEQ, *keys, *(tables.FROM_TO if table else ())]
        return joins.Side(joins.prefixed(df.select(*map(col, attributes), *map(col, extra)), prefix), prefix, place, keep, list(keys)), attributes
