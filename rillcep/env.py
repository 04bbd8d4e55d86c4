"""The environment: registered streams, extensions, and queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillcep.control import PlanRegistry
from rillcep.errors import AnalysisError, DuplicatedStreamError, UndefinedStreamError
from rillcep.functions.extensions import Registry
from rillcep.lang import ast, parse
from rillcep.plans.lower import App, Lowering, Stream
from rillcep.schema import SEQ, US, StreamSchema, col, projected

#: Columns of the widest tuple that `returns_tuple` gives.
MAX_TUPLE = 25


class CEPEnvironment:
    """A new, empty environment; several share nothing."""

    def __init__(self, spark: SparkSession):
        if spark is None:
            raise ValueError("a SparkSession is needed")
        self.spark = spark
        self.streams: dict[str, Stream] = {}
        self.schemas: dict[str, StreamSchema] = {}
        self.extensions = Registry()

    @classmethod
    def define(cls, stream_id: str, df: DataFrame, *fields: str, **options) -> SingleStream:
        """A new environment with one stream."""
        return cls(df.sparkSession).from_(stream_id, df, *fields, **options)

    def register_stream(self, stream_id: str, df: DataFrame, *fields: str, positional: bool = False, ts: str | Column | None = None, seq: str | Column | None = None) -> CEPEnvironment:
        """Names a DataFrame; see schema.projected for fields, ts and seq."""
        if stream_id in self.streams:
            raise DuplicatedStreamError(stream_id)
        schema, events = projected(stream_id, df, fields, positional, ts, seq)
        self.schemas[stream_id] = schema
        self.streams[stream_id] = Stream(events, dict(schema.attributes), len(self.streams))
        return self

    def register_extension(self, name: str, fn, kind: str = "scalar", return_type="object") -> CEPEnvironment:
        self.extensions.register(name, fn, kind, return_type)
        return self

    def is_defined(self, stream_id: str) -> bool:
        return stream_id in self.streams

    def check_defined(self, stream_id: str) -> None:
        if stream_id is None:
            raise ValueError("a stream id is needed")
        if stream_id not in self.streams:
            raise UndefinedStreamError(stream_id)

    def stream(self, stream_id: str) -> DataFrame:
        self.check_defined(stream_id)
        return self.streams[stream_id].df.drop(US, SEQ)

    def schema(self, stream_id: str) -> StreamSchema:
        self.check_defined(stream_id)
        return self.schemas[stream_id]

    def from_(self, stream_id: str, df: DataFrame | None = None, *fields: str, **options) -> SingleStream:
        """Registers a stream, or takes a registered one."""
        if df is not None:
            self.register_stream(stream_id, df, *fields, **options)
        return SingleStream(self, (stream_id,))

    def union(self, first: str, *others: str) -> UnionStream:
        return SingleStream(self, (first,)).union(*others)


class ExecutableStream:
    """Streams that a query may read."""

    def __init__(self, env: CEPEnvironment, ids: tuple[str, ...]):
        for i in ids:
            env.check_defined(i)
        self.env, self.ids = env, ids

    def union(self, *ids: str, df: DataFrame | None = None, fields: tuple[str, ...] = (), **options) -> UnionStream:
        """More streams; with df, registers the one named. Streams keep their names and schemas."""
        if df is not None:
            self.env.register_stream(ids[0], df, *fields, **options)
        return UnionStream(self.env, (*self.ids, *ids))

    def cql(self, query: str) -> Execution:
        """Parses, checks and lowers a query; errors show here."""
        return Execution(self.env, parse(query))

    def dynamic(self) -> PlanRegistry:
        """A registry of plans that control events add, update, delete, enable and disable."""
        return PlanRegistry(self.env)


class SingleStream(ExecutableStream):
    pass


class UnionStream(ExecutableStream):
    pass


class Execution:
    """A lowered query; every `returns` reads one of its outputs."""

    def __init__(self, env: CEPEnvironment, app: ast.App, streams: dict[str, Stream] | None = None):
        self.env = env
        self.app: App = Lowering(streams if streams is not None else env.streams, env.extensions).lower(app)

    @property
    def outputs(self) -> list[str]:
        return list(self.app.outputs)

    def events(self, stream_id: str) -> DataFrame:
        """An output with its hidden time and order."""
        if stream_id not in self.app.outputs:
            raise UndefinedStreamError(stream_id)
        return self.app.outputs[stream_id].df

    def schema(self, stream_id: str) -> StreamSchema:
        self.events(stream_id)
        return StreamSchema(stream_id, tuple(self.app.outputs[stream_id].attributes.items()))

    def returns(self, *ids: str) -> DataFrame | dict[str, DataFrame]:
        """The output as a DataFrame in select order; several ids give a dict."""
        if not ids:
            raise ValueError("an output id is needed")
        made = {i: self.events(i).select(*map(col, self.app.outputs[i].attributes)) for i in ids}
        return made[ids[0]] if len(ids) == 1 else made

    returns_row = returns

    def returns_tagged(self, *ids: str) -> DataFrame:
        """(stream_id, payload): the outputs in one DataFrame, their attributes as a map of strings."""
        out = None
        for i in ids:
            one = self.returns_map(i).select(F.lit(i).alias("stream_id"), F.transform_values("record", lambda _, v: v.cast("string")).alias("payload"))
            out = one if out is None else out.unionByName(one)
        return out

    def returns_tuple(self, stream_id: str, *types: T.DataType | str) -> DataFrame:
        """Positional output of MAX_TUPLE columns at most; types, if given, must be as many as there are columns."""
        df = self.returns(stream_id)
        if len(df.columns) > MAX_TUPLE:
            raise AnalysisError(f"a tuple has {MAX_TUPLE} columns at most")
        if any(t == "object" for t in self.app.outputs[stream_id].attributes.values()):
            raise AnalysisError("an attribute of type object has no tuple type")
        if types and len(types) != len(df.columns):
            raise AnalysisError(f"{len(types)} types for {len(df.columns)} attributes")
        return df.select(*(col(c).cast(t).alias(c) for c, t in zip(df.columns, types))) if types else df

    def returns_as(self, stream_id: str, schema: T.StructType) -> DataFrame:
        """By name into a schema: missing attributes are null, others dropped, values cast."""
        df = self.returns(stream_id)
        return df.select(*((col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))

    def returns_map(self, *ids: str) -> DataFrame | dict[str, DataFrame]:
        """One column `record`: a map with its keys in alphabetical order; values as strings where types differ."""
        made = {}
        for i in ids:
            df = self.returns(i)
            types = {f.dataType.simpleString() for f in df.schema.fields}
            pairs = [x for c in sorted(df.columns) for x in (F.lit(c), col(c) if len(types) == 1 else col(c).cast("string"))]
            made[i] = df.select(F.create_map(*pairs).alias("record"))
        return made[ids[0]] if len(ids) == 1 else made

    def aggregation(self, name: str, unit: str) -> DataFrame:
        """A defined aggregation at one of its units."""
        if name not in self.app.aggregations or unit not in self.app.aggregations[name]:
            raise UndefinedStreamError(f"{name} per {unit}")
        return self.app.aggregations[name][unit]
