"""Small streams written as `A1 B2`: key A at millisecond 1 with value 1."""

from rillcep.env import CEPEnvironment


def events(text: str) -> list[tuple]:
    return [(int(x[1:]), x[0], float(x[1:])) for x in text.split()]


def environment(spark, **streams) -> CEPEnvironment:
    env = CEPEnvironment(spark)
    for name, rows in streams.items():
        rows = events(rows) if isinstance(rows, str) else rows
        df = spark.createDataFrame([(t, k, None if v is None else float(v), i) for i, (t, k, v) in enumerate(rows)], "t long, k string, v double, i long")
        env.register_stream(name, df, "k", "v", ts="t", seq="i")
    return env


def run(spark, query: str, out: str = "O", **streams) -> list[tuple]:
    e = environment(spark, **streams).from_(next(iter(streams))).cql(query)
    return [tuple(r) for r in e.events(out).orderBy("__us", "__seq").drop("__us", "__seq").collect()]
