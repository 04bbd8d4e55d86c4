"""Windows whose ties, slices and hot keys matter: compared with sums over plain lists."""

import pytest

from rillcep.operators import windows
from tests.helpers import environment, run


def events(n, ties=1, step=1):
    return [(1000 + (i // ties) * step, "ab"[i % 2], i % 7) for i in range(n)]


def held(rows, i, span=None, length=None, key=None):
    out = [r for r in rows[: i + 1] if key is None or r[1] == key]
    return out[-length:] if length else [r for r in out if r[0] > rows[i][0] - span]


@pytest.mark.parametrize("keyed", [False, True])
def test_ties_beyond_any_room(spark, keyed):
    """3000 events of one millisecond leave the window all at once, and each sees those before it only."""
    rows = [(1000, "a", 1)] * 3000 + [(11_000, "a", 1)]
    query = "from S#window.time(10 sec) select count() as n, sum(v) as s, max(v) as m insert into O"
    got = run(spark, f"partition with (k of S) begin {query}; end" if keyed else query, S=rows)
    assert got == [(i + 1, i + 1, 1) for i in range(3000)] + [(1, 1, 1)]


AGGREGATES = {
    "count()": len,
    "sum(v)": lambda v: sum(v),
    "avg(v)": lambda v: sum(v) / len(v),
    "min(v)": min,
    "max(v)": max,
    "distinctCount(v)": lambda v: len(set(v)),
    "stdDev(v)": lambda v: (sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) ** 0.5,
}


@pytest.mark.parametrize("window", ["time", "length", "externalTime"])
@pytest.mark.parametrize("group", [False, True])
def test_slices(spark, monkeypatch, window, group):
    """A global window over many slices holds just what it would hold in one."""
    monkeypatch.setattr(windows, "SLICE_ROWS", 16)
    monkeypatch.setattr(windows, "SLICES", 5)
    rows = events(160, ties=3, step=2)
    call = {"time": "time(9 ms)", "length": "length(5)", "externalTime": "externalTime(at, 9 ms)"}[window]
    items = ", ".join(f"{a} as x{i}" for i, a in enumerate(AGGREGATES))
    streams = {"S": rows}
    query = f"from S#window.{call} select {items}{' group by k' if group else ''} insert into O"
    if window == "externalTime":
        e = environment(spark, S=rows)
        df = spark.createDataFrame([(t, k, float(v), i) for i, (t, k, v) in enumerate(rows)], "at long, k string, v double, i long")
        e.register_stream("T", df, "at", "k", "v", ts="at", seq="i")
        out = e.from_("T").cql(query.replace("from S", "from T")).events("O")
        got = [tuple(r) for r in out.orderBy("__us", "__seq").drop("__us", "__seq").collect()]
    else:
        got = run(spark, query, **streams)
    for i, found in enumerate(got):
        content = held(rows, i, 9, 5 if window == "length" else None)
        values = [float(r[2]) for r in content if not group or r[1] == rows[i][1]]
        assert found == pytest.approx(tuple(f(values) for f in AGGREGATES.values())), i
    assert len(got) == len(rows)


def test_expired_and_batches_over_slices(spark, monkeypatch):
    monkeypatch.setattr(windows, "SLICES", 4)
    rows = events(40, ties=2)
    got = run(spark, "from S#window.length(3) select v insert expired events into O", S=rows)
    assert got == [(float(r[2]),) for r in rows[:-3]]
    got = run(spark, "from S#window.lengthBatch(7) select sum(v) as s, count() as n insert into O", S=rows)
    assert got == [(float(sum(r[2] for r in rows[i : i + 7])), 7) for i in range(0, 35, 7)]
    got = run(spark, "from S select v output last every 4 events insert into O", S=rows)
    assert got == [(float(r[2]),) for r in rows[3::4]]


def test_no_single_partition(spark):
    """No exchange takes all events to one task; what meets in one has a row for each slice at most."""
    rows = events(20)
    for query in ("#window.length(3) select sum(v) as s", "#window.time(5 ms) select sum(v) as s", "#window.lengthBatch(3) select sum(v) as s", "#window.timeBatch(3 ms) select sum(v) as s"):
        df = environment(spark, S=rows).from_("S").cql(f"from S{query} insert into O").events("O")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        alone = [line for line in plan.splitlines() if "Window [" in line and line.count("windowspecdefinition(") and "windowspecdefinition(__" in line and "windowspecdefinition(__slice" not in line and "windowspecdefinition(__batch" not in line]
        assert not alone, alone


def test_running_aggregates_over_slices(spark, monkeypatch):
    """A running aggregate over all events is that of the slices before and of the own so far."""
    monkeypatch.setattr(windows, "SLICES", 6)
    rows = [(t, k, None if v == 3 else v) for t, k, v in events(50, ties=4)]
    items = {**{k: v for k, v in AGGREGATES.items() if k not in ("count()", "stdDev(v)")}, "maxForever(v)": max, "or(v > 4.0)": lambda v: any(x > 4 for x in v), "and(v < 6.0)": lambda v: all(x < 6 for x in v)}
    query = f"from S select count() as n, {', '.join(f'{a} as x{i}' for i, a in enumerate(items))} insert into O"
    got = run(spark, query, S=rows)
    for i, found in enumerate(got):
        values = [float(r[2]) for r in rows[: i + 1] if r[2] is not None]
        assert found == pytest.approx((i + 1, *(f(values) for f in items.values()))), i
    df = environment(spark, S=rows).from_("S").cql(query).events("O")
    assert "windowspecdefinition(__us" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_running_union_set(spark):
    rows = [(1, "a", 2), (2, "b", 1), (3, "a", 2), (4, "a", None), (5, "c", 1)]
    got = run(spark, "from S select unionSet(createSet(k)) as s insert into O", S=rows)
    assert [list(r[0]) for r in got] == [["a"], ["a", "b"], ["a", "b"], ["a", "b"], ["a", "b", "c"]]


def test_running_distinct(spark):
    rows = [(1, "a", 1), (2, "a", None), (3, "a", 1), (4, "b", 1), (5, "a", 2)]
    got = run(spark, "from S select k, distinctCount(v) as n group by k insert into O", S=rows)
    assert got == [("a", 1), ("a", 1), ("a", 1), ("b", 1), ("a", 2)]


def test_hot_key_join_meets_its_span_alone(spark):
    """Pairs of a key are looked for within the span: the join has the time bucket beside the key."""
    left, right = [(10 * i, "a", i) for i in range(50)], [(10 * i + 5, "a", i) for i in range(50)]
    query = "from L#window.time(12 ms) join R#window.time(12 ms) on L.k == R.k select L.v as l, R.v as r insert into O"
    df = environment(spark, L=left, R=right).from_("L").cql(query).events("O")
    assert "__bucket" in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(run(spark, query, L=left, R=right))
    assert got == sorted((float(a[2]), float(b[2])) for a in left for b in right if abs(a[0] - b[0]) < 12)


def test_tables_without_equality(spark, monkeypatch):
    """A small table is broadcast and compared row by row; a larger one is refused, and joined on equality as ever."""
    from rillcep.errors import AnalysisError
    from rillcep.operators import joins

    rows, limits = [(i, "a", i) for i in range(10, 20)], [(i, "a", 13 + i) for i in range(3)]
    define = "define table T (k string, price double); from L select k, v as price insert into T; "
    theta = define + "from S join T on S.v < T.price select S.v as v, T.price as price insert into O"
    held = define + "from S[(T.price == v) in T] select v insert into O"
    some = define + "from S[(T.price > v) in T] select v insert into O"
    want = sorted((float(r[2]), float(t[2])) for r in rows for t in limits if r[2] < t[2])
    assert sorted(run(spark, theta, S=rows, L=limits)) == want
    assert run(spark, some, S=rows, L=limits) == [(10.0,), (11.0,), (12.0,), (13.0,), (14.0,)]
    monkeypatch.setattr(joins, "SMALL", 2)
    assert run(spark, held, S=rows, L=limits) == [(13.0,), (14.0,), (15.0,)]
    for query in (theta, some):
        with pytest.raises(AnalysisError):
            run(spark, query, S=rows, L=limits)


def next_fire(ms, fields):
    """The first whole second after ms that all fields allow, hour by hour and minute by minute."""
    from datetime import UTC, datetime, timedelta

    t = datetime.fromtimestamp(ms // 1000 + 1, UTC)
    while True:
        weekday = t.isoweekday() % 7 + 1
        if not (t.day in fields[3] and t.month in fields[4] and weekday in fields[5] and t.hour in fields[2]):
            t = t.replace(minute=0, second=0) + timedelta(hours=1)
        elif t.minute not in fields[1]:
            t = t.replace(second=0) + timedelta(minutes=1)
        elif t.second not in fields[0]:
            t += timedelta(seconds=1)
        else:
            return int(t.timestamp()) * 1000


@pytest.mark.parametrize("cron", ["0 0 * * * ?", "*/7 * * * * ?", "30 15,45 9-17 ? * MON-FRI", "0 0 0 1 1/3 ?", "5 5 5 29 2 ?", "10 0/20 * * * SUN"])
def test_cron_windows(spark, cron):
    import random
    from collections import defaultdict

    rng = random.Random(cron)
    rows = sorted({(1_700_000_000_000 + rng.randrange(0, 200 * 86_400_000), "a", i % 5) for i in range(60)})
    rows = [*rows[:30], *((rows[30][0] + 1000 * i, "a", i) for i in range(40) if rows[30][0] + 1000 * i < rows[31][0]), *rows[31:]]
    got = run(spark, f"from S#window.cron('{cron}') select count() as n, sum(v) as s insert into O", S=rows)
    fields, want = windows.cron_fields(cron), defaultdict(list)
    for t, _, v in rows:
        want[next_fire(t, fields)].append(float(v))
    assert got == [(len(v), sum(v)) for _, v in sorted(want.items())]


def test_cron_trigger(spark):
    rows = [(1_700_000_000_000, "a", 1), (1_700_000_000_000 + 3 * 86_400_000, "a", 1)]
    got = run(spark, "define trigger T at '0 30 */5 * * ?'; from T select triggered_time insert into O", S=rows)
    fields, t, want = windows.cron_fields("0 30 */5 * * ?"), rows[0][0] - 1000, []
    while (t := next_fire(t, fields)) <= rows[1][0]:
        want.append((t,))
    assert got == want and len(want) == 15


def test_cron_refused():
    from rillcep.errors import AnalysisError

    for text in ("* *", "0 0 0 32 1 ?", "x * * * * ?", "0 61 * * * ?"):
        with pytest.raises(AnalysisError):
            windows.cron_fields(text)


def test_sort_window_over_slices(spark, monkeypatch):
    """The n first of all so far, with ties by arrival and nulls first, whatever the slices."""
    monkeypatch.setattr(windows, "SLICES", 5)
    values = [3, 1, None, 2, 2, 5, 0, 1, 1, 4, None, 2, 0, 3, 3, 1, 2, 0, 5, 4]
    rows = [(1000 + i // 2, "a", v) for i, v in enumerate(values)]
    for direction, key in (("asc", lambda v: (v is not None, v or 0)), ("desc", lambda v: (v is None, -(v or 0)))):
        got = run(spark, f"from S#window.sort(3, v, '{direction}') select count() as n, sum(v) as s insert into O", S=rows)
        for i, found in enumerate(got):
            held = sorted(values[: i + 1], key=key)[:3]
            known = [v for v in held if v is not None]
            assert found == (len(held), float(sum(known)) if known else None), (direction, i)
        assert len(got) == len(rows)
