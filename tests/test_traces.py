"""Worked traces of the semantics."""

import pytest

from tests.helpers import run

A = [(1, "a", 1), (2, "a", 2), (3, "a", 3)]
B = [(1, "a", 1), (2, "b", 2), (3, "a", 3)]
L, R = [(1, "a", 1), (4, "a", 4)], [(2, "a", 2), (3, "a", 3)]
SUM = "select k, sum(v) as s group by k insert into O"
PAIR = "select L.v as l, R.v as r insert into O"
AB = "a=S[k=='A'] -> b=S[k=='B']"
SEL = "select a.v as a, b.v as b insert into O"

CASES = [
    ("from S#window.length(2) select sum(v) as s insert into O", {"S": A}, [(1,), (3,), (5,)]),
    (f"from S#window.length(2) {SUM}", {"S": B}, [("a", 1), ("b", 2), ("a", 3)]),
    (f"partition with (k of S) begin from S#window.length(2) {SUM}; end", {"S": B}, [("a", 1), ("b", 2), ("a", 4)]),
    (f"from S {SUM}", {"S": B}, [("a", 1), ("b", 2), ("a", 4)]),
    ("from S#window.lengthBatch(2) select sum(v) as s insert into O", {"S": A}, [(3,)]),
    ("from S#window.time(10 ms) select count() as c insert into O", {"S": [(0, "a", 1), (5, "a", 1), (10, "a", 1), (21, "a", 1)]}, [(1,), (2,), (2,), (1,)]),
    ("from S#window.timeBatch(10 ms) select count() as c insert into O", {"S": [(3, "a", 1), (5, "a", 1), (14, "a", 1)]}, [(2,), (1,)]),
    (f"from L#window.length(1) join R#window.length(1) on L.k==R.k {PAIR}", {"L": L, "R": R}, [(1, 2), (1, 3), (4, 3)]),
    (f"from L#window.length(1) left outer join R#window.length(1) on L.k==R.k {PAIR}", {"L": L[:1], "R": R[:1]}, [(1, None), (1, 2)]),
    (f"from L#window.length(1) unidirectional join R#window.length(1) on L.k==R.k {PAIR}", {"L": L, "R": R}, [(4, 3)]),
    (f"from every {AB} {SEL}", {"S": "A1 A2 B3 B4"}, [(1, 3), (2, 3)]),
    (f"from {AB} {SEL}", {"S": "A1 A2 B3 A4 B5"}, [(1, 3)]),
    (f"from every ({AB}) {SEL}", {"S": "A1 A2 B3 A4 B5"}, [(1, 3), (4, 5)]),
    (f"from every {AB} within 2 ms {SEL}", {"S": "A1 A3 B4"}, [(3, 4)]),
    (f"from every a=S[k=='A'], b=S[k=='B'] {SEL}", {"S": "A1 A2 B3 A4 C5 B6"}, [(2, 3)]),
    ("from every a=S[k=='A']+, b=S[k=='B']? select a[0].v as x, a[1].v as y, b.v as z insert into O", {"S": "A1 A2 B3 A4 C5"}, [(1, 2, 3), (4, None, None)]),
    # Ties in time: later peers aren't seen, whatever the window.
    ("from S#window.time(10 ms) select count() as c insert into O", {"S": [(1, "a", 1), (1, "a", 1), (11, "a", 1), (11, "a", 1)]}, [(1,), (2,), (1,), (2,)]),
    (f"from every {AB} {SEL}", {"S": [(1, "A", 1), (1, "B", 2), (1, "A", 3)]}, [(1, 2)]),
    # Nulls: comparisons don't hold, aggregates skip them.
    ("from S[v > 1.0] select v insert into O", {"S": [(1, "a", None), (2, "a", 2)]}, [(2,)]),
    ("from S select sum(v) as s, count() as c insert into O", {"S": [(1, "a", None), (2, "a", 2)]}, [(None, 1), (2, 2)]),
    (f"from S {SUM}", {"S": [(1, None, 1), (2, None, 2)]}, [(None, 1), (None, 3)]),
    ("from every a=S[k=='A'] -> b=S[k=='B' and v > a.v] select a.v as a, b.v as b insert into O", {"S": [(1, "A", 5), (2, "B", 2), (3, "B", 6)]}, [(5, 6)]),
    ("from every a=S[k=='A'] -> not S[k=='B'] for 3 ms select a.v as a insert into O", {"S": "A1 B2 A4 C9 A10"}, [(4,), (10,)]),
    ("from every a=S[k=='A'] -> b=S[k=='B'] and c=S[k=='C'] select a.v as a, b.v as b, c.v as c insert into O", {"S": "A1 C2 B3 A4 B5 C6"}, [(1, 3, 2), (4, 5, 6)]),
    ("from every a=S[k=='A']<2:3> -> b=S[k=='B'] select a[0].v as f, a[last].v as l, b.v as b insert into O", {"S": "A1 A2 B3 A4 B5 A6 B7"}, [(1, 2, 3), (4, 6, 7)]),
    ("from S#window.sort(2, v, 'desc') select sum(v) as s insert into O", {"S": A}, [(1,), (3,), (5,)]),
    ("from S#window.session(5 ms) select count() as c insert into O", {"S": [(1, "a", 1), (5, "a", 1), (11, "a", 1)]}, [(2,), (1,)]),
    ("from L#window.time(2 ms) join R#window.time(2 ms) on L.v < R.v " + PAIR, {"L": L, "R": R}, [(1, 2)]),
    ("from L#window.length(2) join R#window.length(2) on L.v < R.v " + PAIR, {"L": L, "R": R}, [(1, 2), (1, 3)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_trace(spark, case):
    query, streams, want = CASES[case]
    got = run(spark, query, **streams)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len(got) == len(want)
