"""Streaming replays in several micro-batches, with out-of-order events."""

import pytest

from rillcep.env import CEPEnvironment
from rillcep.errors import AnalysisError
from rillcep.sources import connectors
from rillcep.streaming import execute


def streamed(spark, tmp_path, batches, query, **options):
    schema = "t long, k string, v double, i long"
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b{n}"))
    env = CEPEnvironment(spark)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    env.register_stream("S", df, "k", "v", ts="t", seq="i")
    out = execute.stream(env, query, "O", **options)
    connectors.write_parquet_once(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())


def test_pattern_across_batches(spark, tmp_path):
    batches = [[(1000, "A", 1.0, 0), (2000, "A", 2.0, 1)], [(3000, "B", 3.0, 2), (9000, "C", 9.0, 3)]]
    q = "from every a=S[k=='A'] -> b=S[k=='B'] select a.v as a, b.v as b insert into O"
    assert streamed(spark, tmp_path, batches, q, reorder=False) == [(1.0, 3.0), (2.0, 3.0)]


def test_reordering(spark, tmp_path):
    """The event at 2 s comes last, yet counts second; what the watermark hasn't passed waits."""
    batches = [[(1000, "A", 1.0, 0), (3000, "A", 3.0, 2), (2000, "A", 2.0, 1)], [(60_000, "A", 9.0, 3)]]
    got = streamed(spark, tmp_path, batches, "from S#window.length(2) select v, sum(v) as s insert into O", delay="5 seconds")
    assert got == [(1.0, 1.0), (2.0, 3.0), (3.0, 5.0)]


def test_session(spark, tmp_path):
    batches = [[(1000, "A", 1.0, 0), (2000, "A", 2.0, 1)], [(30_000, "A", 5.0, 2)], [(90_000, "A", 7.0, 3)]]
    got = streamed(spark, tmp_path, batches, "from S#window.session(5 sec) select count() as n, sum(v) as s insert into O")
    assert got[-1] == (2, 3.0)


def test_unsupported(spark, tmp_path):
    with pytest.raises(AnalysisError):
        streamed(spark, tmp_path, [[(1, "A", 1.0, 0)]], "from S#window.lengthBatch(2) select sum(v) as s insert into O")


def test_kafka_json_codec(spark):
    df = spark.createDataFrame([("x", 1.5)], "name string, value double")
    assert connectors.from_json_column(connectors.to_json_column(df), "name string, value double").collect() == df.collect()


def test_streaming_plans(spark, tmp_path):
    """Disabled plans drop their input and keep their state; updates start anew."""
    from rillcep.control import MetadataEvent, OperationEvent
    from rillcep.streaming.plans import StreamingPlans

    schema, source = "t long, k string, v double, i long", tmp_path / "in"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(source))

    arrive((1000, "A", 1.0, 0))
    env = CEPEnvironment(spark)
    env.register_stream("S", spark.readStream.schema(schema).parquet(str(source)), "k", "v", ts="t", seq="i")
    sink = lambda df, plan, at: df.writeStream.format("parquet").option("checkpointLocation", at).start(f"{tmp_path}/{plan}")
    plans = StreamingPlans(env, "O", sink, str(tmp_path / "checkpoints"), reorder=False)
    text = "from S select v, sum(v) as s insert into O"
    plans.apply(MetadataEvent(0, added={"p": text}))
    plans.process_all()
    plans.apply(OperationEvent(2_000_000, action="disable", plan="p"))
    arrive((3000, "A", 9.0, 1))
    plans.apply(OperationEvent(4_000_000, action="enable", plan="p"))
    arrive((5000, "A", 1.0, 2))
    plans.process_all()
    plans.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/p").select("v", "s").collect()) == [(1.0, 1.0), (1.0, 2.0)]


def test_running_state_is_small():
    """What a running aggregate keeps doesn't grow with the events."""
    import pickle

    from rillcep.lang import parse
    from rillcep.streaming.program import Chain

    text = "from S select k, sum(v) as s, avg(v) as m, stdDev(v) as d, min(v) as a, max(v) as b, count() as n group by k insert into O"
    chain, sizes = Chain(list(parse(text).elements), "O", {"S": ["k", "v"]}), []
    for i in range(1, 2001):
        row = chain.add({"us": i, "seq": i, "stream": "S", "row": {"k": "x", "v": float(i % 7)}})[0]
        sizes.append(len(pickle.dumps(chain)))
    values = [i % 7 for i in range(1, 2001)]
    mean = sum(values) / 2000
    assert row[1:-1] == pytest.approx((sum(values), mean, (sum((v - mean) ** 2 for v in values) / 2000) ** 0.5, 0, 6, 2000))
    assert max(sizes[100:]) < sizes[100] + 100


def test_control_stream(spark, tmp_path):
    """Plans come and go by a stream of messages; one that can't be read stops nothing."""
    from rillcep.control import MetadataEvent, encode
    from rillcep.streaming.plans import StreamingPlans

    schema, source, told = "t long, k string, v double, i long", tmp_path / "in", tmp_path / "told"
    spark.createDataFrame([(1000, "A", 1.0, 0), (2000, "A", 2.0, 1)], schema).write.parquet(str(source))
    say = lambda *m: spark.createDataFrame([(x,) for x in m], "value string").coalesce(1).write.mode("append").text(str(told))
    say("{no json", encode(MetadataEvent(0, added={"p": "from S select v insert into O"})))
    env = CEPEnvironment(spark)
    env.register_stream("S", spark.readStream.schema(schema).parquet(str(source)), "k", "v", ts="t", seq="i")
    sink = lambda df, plan, at: df.writeStream.format("parquet").option("checkpointLocation", at).start(f"{tmp_path}/{plan}")
    plans = StreamingPlans(env, "O", sink, str(tmp_path / "checkpoints"), reorder=False)
    control = plans.follow(spark.readStream.text(str(told)), str(tmp_path / "control"))
    control.processAllAvailable()
    plans.process_all()
    say(encode(MetadataEvent(1, deleted=("p",))))
    control.processAllAvailable()
    assert not plans.running and sorted(r.v for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1.0, 2.0]
    control.stop()


def test_supervised(spark, tmp_path):
    """A query that fails twice is started again from its checkpoint, and no more often than allowed."""
    from pyspark.errors import StreamingQueryException

    spark.createDataFrame([(1,), (2,)], "v int").write.parquet(str(tmp_path / "in"))
    failures, seen = [2], []

    def start():
        def batch(df, _):
            if failures[0]:
                failures[0] -= 1
                raise RuntimeError("lost")
            seen.extend(r.v for r in df.collect())

        rows = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    connectors.supervised(start, attempts=2, delay=0)
    assert sorted(seen) == [1, 2]
    failures[0] = 9
    spark.createDataFrame([(3,)], "v int").write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        connectors.supervised(start, attempts=1, delay=0)
    assert failures[0] == 7


def test_generators(spark):
    words = connectors.synthetic_words(spark, 100, ["a", "b", "c"]).collect()
    assert {r.word for r in words} == {"a", "b", "c"} and words[-1].timestamp == 99_000
    assert connectors.synthetic_tuples(spark, 3).columns == ["_1", "_2", "_3", "_4"]
