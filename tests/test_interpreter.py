"""The lowering against the event-at-a-time program, on random small streams with ties and nulls."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rillcep.lang import parse
from rillcep.streaming.program import Program
from tests.helpers import environment

QUERIES = [
    "from S select k, sum(v) as s, count() as n group by k insert into O",
    "from S#window.length(3) select k, sum(v) as s, max(v) as hi group by k insert into O",
    "from S#window.time(3 ms) select count() as n, min(v) as lo insert into O",
    "from S[v > 1.0] select k, v insert into O",
    "from every a=S[k=='A'] -> b=S[k=='B'] select a.v as x, b.v as y insert into O",
    "from every a=S[k=='A'] -> b=S[k=='B'] -> c=S[k=='C'] within 4 ms select a.v as x, b.v as y, c.v as z insert into O",
    "from every a=S[k=='A'], b=S[k=='B'] select a.v as x, b.v as y insert into O",
    "from a=S[k=='A'] -> b=S[k=='B'] select a.v as x, b.v as y insert into O",
    "from every a=S[k=='A']+, b=S[k=='B']? select a[0].v as x, a[last].v as y, b.v as z insert into O",
]
ROWS = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["A", "B", "C", None]), st.sampled_from([1.0, 2.0, 3.0, None])), max_size=8)


@pytest.mark.parametrize("query", QUERIES)
def test_lowering_agrees(spark, query):
    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
    @given(ROWS)
    def check(steps):
        at, rows = 0, []
        for gap, k, v in steps:
            at += gap
            rows.append((at, k, v))
        e = environment(spark, S=rows).from_("S").cql(query)
        got = [tuple(r) for r in e.returns("O").collect()]
        program = Program(parse(query).elements[0])
        want = []
        for i, (t, k, v) in enumerate(rows):
            want += program.add({"stream": "S", "us": t * 1000, "seq": i, "row": {"k": k, "v": v}})
        want = [r[:-1] for r in want + program.flush()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))

    check()
