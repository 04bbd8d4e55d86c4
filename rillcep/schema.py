"""Stream schemas: registration of DataFrames as streams and their DDL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcep.errors import AnalysisError
from rillcep.types import attribute_type

#: Hidden columns of every stream: event time in microseconds, and what orders events of equal time.
US, SEQ = "__us", "__seq"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class StreamSchema:
    name: str
    attributes: tuple[tuple[str, str], ...]

    def to_ddl(self) -> str:
        return f"define stream {self.name} ({','.join(f'{n} {t}' for n, t in self.attributes)});"

    def index_of(self, name: str) -> int:
        for i, (n, _) in enumerate(self.attributes):
            if n == name:
                return i
        raise AnalysisError(f"{self.name} has no attribute {name}")


def projected(name: str, df: DataFrame, fields: tuple[str, ...], positional: bool, ts, seq) -> tuple[StreamSchema, DataFrame]:
    """The stream of a DataFrame: named fields only (all, if none is named), event time in US, order in SEQ.

    positional renames the first columns to the fields; else fields are found by name, an unknown one is an error.
    ts: a column of a timestamp type, or of long milliseconds; None for the time of reading. seq: a column that orders
    events of equal time; None for the order of the DataFrame's rows (in a streaming DataFrame: none)."""
    if name is None or df is None:
        raise ValueError("a stream needs a name and a DataFrame")
    if positional:
        if not fields:
            raise ValueError("positional registration needs field names")
        if len(fields) > len(df.columns):
            raise AnalysisError(f"{len(fields)} fields for {len(df.columns)} columns")
        source = dict(zip(fields, df.columns))
    else:
        fields = fields or tuple(df.columns)
        if len(df.columns) == 1 and len(fields) == 1:
            source = {fields[0]: df.columns[0]}
        else:
            unknown = [f for f in fields if f not in df.columns]
            if unknown:
                raise AnalysisError(f"{name}: no column {', '.join(unknown)}")
            source = {f: f for f in fields}
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    if ts is None:
        us = F.unix_micros(F.current_timestamp())
    else:
        c = ts if isinstance(ts, Column) else col(ts)
        kind = df.select(c.alias("t")).schema[0].dataType.typeName()
        us = F.unix_micros(c.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else c.cast("long") * 1000
    row = F.lit(0).cast("long") if df.isStreaming else F.monotonically_increasing_id()
    order = row if seq is None else (seq if isinstance(seq, Column) else col(seq)).cast("long")
    out = df.select(*(col(c).alias(f) for f, c in source.items()), us.alias(US), order.alias(SEQ))
    return StreamSchema(name, tuple((f, attribute_type(types[c])) for f, c in source.items())), out
