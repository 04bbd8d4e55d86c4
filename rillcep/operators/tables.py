"""Event tables as change logs: a table is the versions of its rows, each with the order it begins and ends at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillcep.errors import AnalysisError
from rillcep.schema import SEQ, US, col

FROM_TO = ("__to_us", "__to_seq")


def versions(attributes: dict[str, str], changes: list[tuple[str, DataFrame, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """changes (kind, rows, key attributes, set attributes) -> attributes, US, SEQ and the end of each version.

    rows hold US, SEQ and the attributes that the change gives. A table with inserts only keeps every row for good.
    A table that is updated or deleted from has one row for each key: all its changes must use the same key."""
    if all(kind == "insert" for kind, *_ in changes):
        out = None
        for _, rows, _, _ in changes:
            rows = rows.select(*map(col, attributes), US, SEQ)
            out = rows if out is None else out.unionByName(rows)
        return out.withColumns({c: F.lit(None).cast("long") for c in FROM_TO})
    keys = {k for kind, _, k, _ in changes if kind != "insert"}
    if len(keys) != 1:
        raise AnalysisError("all updates and deletions of a table must use the same key")
    key = keys.pop()
    log = None
    for kind, rows, _, sets in changes:
        given = tuple(attributes) if kind == "insert" else sets
        kinds = dict(rows.dtypes)
        cols = [F.struct(col(a).alias("v")).alias(a) if a in given or a in key else F.lit(None).cast(f"struct<v:{kinds.get(a, 'string')}>").alias(a) for a in attributes]
        rows = rows.select(*(col(k).alias(f"__k{i}") for i, k in enumerate(key)), *cols, US, SEQ, F.lit(kind).alias("__kind"))
        log = rows if log is None else log.unionByName(rows)
    by = W.partitionBy(*(f"__k{i}" for i in range(len(key)))).orderBy(US, SEQ)
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    log = log.withColumn("__life", F.sum((F.col("__kind") == "delete").cast("int")).over(so_far))
    life = W.partitionBy(*(f"__k{i}" for i in range(len(key))), "__life").orderBy(US, SEQ).rowsBetween(W.unboundedPreceding, 0)
    log = log.withColumn("__born", F.max(F.col("__kind").isin("insert", "upsert")).over(life))
    values = {a: F.last(F.when(F.col("__kind") != "delete", F.col(f"`{a}`")), ignorenulls=True).over(life) for a in attributes}
    log = log.withColumns({"__to_us": F.lead(US).over(by), "__to_seq": F.lead(SEQ).over(by), **{f"__v{i}": v for i, v in enumerate(values.values())}})
    log = log.where((F.col("__kind") != "delete") & F.col("__born"))
    return log.select(*(F.col(f"__v{i}")["v"].alias(a) for i, a in enumerate(attributes)), US, SEQ, *FROM_TO)


def increments(df: DataFrame, unit: str, by: str | None, keys: list, aggregates: list) -> DataFrame:
    """A rollup: AGG_TIMESTAMP (start of the unit, in milliseconds), the keys and the aggregates.

    keys and aggregates are (column, name)."""
    at = F.timestamp_micros(col(by).cast("long") * 1000 if by else F.col(US))
    name = {"sec": "second", "min": "minute"}.get(unit, unit)
    start = F.unix_millis(F.date_trunc(name, at)).alias("AGG_TIMESTAMP")
    return df.groupBy(start, *(c.alias(n) for c, n in keys)).agg(*(c.alias(n) for c, n in aggregates))
