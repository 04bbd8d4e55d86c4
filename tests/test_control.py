import pytest

from rillcep import control
from rillcep.control import MetadataBuilder, MetadataEvent, OperationEvent
from tests.helpers import environment

SUM = "from S select sum(v) as s insert into O"


def registry(spark, rows):
    return control.PlanRegistry(environment(spark, S=rows))


def sums(r):
    return [x[0] for x in r.returns("O").collect()]


def test_disable_keeps_state(spark):
    r = registry(spark, [(1, "a", 1), (3, "a", 9), (5, "a", 1)])
    r.apply(MetadataEvent(0, added={"p": SUM}))
    r.apply(OperationEvent(2000, action="disable", plan="p"))
    assert not r.enabled("p")
    r.apply(OperationEvent(4000, action="enable", plan="p"))
    assert sorted(sums(r)) == [1, 2]


def test_update_resets_state(spark):
    r = registry(spark, [(1, "a", 1), (3, "a", 1)])
    r.apply(MetadataEvent(0, added={"p": SUM}))
    r.apply(MetadataEvent(2000, updated={"p": SUM}))
    assert sums(r) == [1, 1]


def test_several_plans(spark):
    r = registry(spark, [(1, "a", 1)])
    b = MetadataBuilder()
    ids = [b.add(SUM) for _ in range(4)]
    r.apply(b.build())
    for i in ids:
        r.apply(OperationEvent(0, action="enable", plan=i))
    assert sums(r) == [1, 1, 1, 1]


def test_errors_and_codec(spark):
    r = registry(spark, [(1, "a", 1)])
    r.apply(None)
    r.apply(OperationEvent(0, action="disable", plan="unknown"))
    r.apply(MetadataEvent(0, added={"p": SUM}))
    with pytest.raises(control.ControlError):
        r.apply(MetadataEvent(0, added={"p": SUM}))
    with pytest.raises(control.ControlError):
        r.apply(MetadataEvent(0, updated={"q": SUM}))
    r.apply(MetadataEvent(500, deleted=("p",)))
    assert sums(r) == []
    e = MetadataEvent(7, added={"p": SUM}, deleted=("x",))
    assert control.decode(control.encode(e)) == e
    assert control.decode(control.encode(OperationEvent(3, action="enable", plan="p"))) == OperationEvent(3, action="enable", plan="p")
    with pytest.raises(control.ControlError):
        control.decode('{"type": "os.system", "payload": {}}')
