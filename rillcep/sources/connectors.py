"""Sources and sinks around queries: Kafka JSON in and out, files, console, memory, and synthetic streams."""

from __future__ import annotations

import logging
import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = logging.getLogger(__name__)


def kafka_json(spark: SparkSession, servers: str, topic: str, schema: T.StructType | str, streaming: bool = True, **options) -> DataFrame:
    """Typed rows of JSON messages; a message that doesn't parse gives nulls. Needs Spark's Kafka package."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    rows = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return from_json_column(rows, schema)


def from_json_column(rows: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    return rows.select(F.from_json(F.col(column).cast("string"), schema).alias("r")).select("r.*")


def to_json_column(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(column))


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Every row as a JSON message; streaming DataFrames give back their running query."""
    rows = to_json_column(df)
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if df.isStreaming:
        return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").options(**options).save()


def write_text(df: DataFrame, path: str) -> None:
    """One line of JSON for each row; replaces what is there."""
    to_json_column(df).write.mode("overwrite").text(path)


def write_parquet_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a streaming DataFrame over all that its sources hold now."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def to_console(df: DataFrame, checkpoint: str | None = None):
    """Prints rows; streaming DataFrames give back their running query."""
    if not df.isStreaming:
        return df.show(truncate=False)
    writer = df.writeStream.format("console")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def to_memory(df: DataFrame, name: str):
    """A streaming DataFrame into the in-memory table `name`; gives back its running query."""
    return df.writeStream.format("memory").queryName(name).outputMode("append").start()


def synthetic_events(spark: SparkSession, n: int, name: str = "test_event", start_ms: int = 0) -> DataFrame:
    """id (cycling through 50), name, price, timestamp (a second apart)."""
    i = F.col("id")
    return spark.range(n).select((i % 50).cast("int").alias("id"), F.lit(name).alias("name"), (i / 10.0).alias("price"), (F.lit(start_ms) + i * 1000).alias("timestamp"))


def synthetic_tuples(spark: SparkSession, n: int, name: str = "test_tuple", start_ms: int = 0) -> DataFrame:
    """The same as unnamed columns: _1 to _4."""
    return synthetic_events(spark, n, name, start_ms).toDF("_1", "_2", "_3", "_4")


def synthetic_words(spark: SparkSession, n: int, vocabulary: list[str], start_ms: int = 0) -> DataFrame:
    """word (drawn from a vocabulary by a hash of its place), timestamp (a second apart)."""
    i = F.col("id")
    word = F.element_at(F.array(*map(F.lit, vocabulary)), (F.pmod(F.xxhash64(i), F.lit(len(vocabulary))) + 1).cast("int"))
    return spark.range(n).select(word.alias("word"), (F.lit(start_ms) + i * 1000).alias("timestamp"))


def rate_events(spark: SparkSession, per_second: int = 5, name: str = "test_event") -> DataFrame:
    """The same as an endless stream."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select((F.col("value") % 50).cast("int").alias("id"), F.lit(name).alias("name"), F.rand(7).alias("price"), F.unix_millis("timestamp").alias("timestamp"))


def supervised(start, attempts: int = 4, delay: float = 10.0):
    """Runs start() -> a running query to its end, and anew from its checkpoint when it fails, after `delay` seconds and
    `attempts` times at most; then the last failure is raised."""
    for left in range(attempts, -1, -1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if not left:
                raise
            LOG.warning("query %s failed; %d attempts left", query.id, left, exc_info=True)
            time.sleep(delay)
