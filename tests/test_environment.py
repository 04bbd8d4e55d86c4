"""The environment, schemas, results, extensions and errors."""

import pytest
from pyspark.sql import types as T

from rillcep.env import CEPEnvironment
from rillcep.errors import AnalysisError, DuplicatedStreamError, QuerySyntaxError, UndefinedStreamError
from rillcep.lang import parse
from rillcep.schema import StreamSchema
from rillcep.sources import connectors
from rillcep.types import TypeRegistry

ROWS = [(1, "start", 1.0), (2, "middle", 2.0), (3, "end", 3.0), (4, "start", 4.0), (5, "middle", 5.0), (6, "end", 6.0)]


def six(spark):
    return spark.createDataFrame(ROWS, "id int, name string, price double")


def test_pass_through_and_text_sink(spark, tmp_path):
    e = CEPEnvironment.define("s", six(spark), "id", "name", "price").cql("from s insert into  outputStream")
    assert e.returns("outputStream").count() == 6
    connectors.write_text(e.returns("outputStream"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 6


def test_ddl(spark):
    df = connectors.synthetic_events(spark, 5)
    env = CEPEnvironment(spark).register_stream("test_stream", df, "id", "timestamp", "name", "price")
    assert env.schema("test_stream").to_ddl() == "define stream test_stream (id int,timestamp long,name string,price double);"
    assert env.schema("test_stream").index_of("name") == 2
    with pytest.raises(AnalysisError):
        env.schema("test_stream").index_of("nothing")
    assert StreamSchema("x", ()).to_ddl() == "define stream x ();"


def test_registration(spark):
    env = CEPEnvironment(spark).register_stream("a", six(spark), "x", "y", positional=True)
    assert env.stream("a").columns == ["x", "y"]
    with pytest.raises(DuplicatedStreamError):
        env.register_stream("a", six(spark))
    with pytest.raises(UndefinedStreamError):
        env.from_("b")
    with pytest.raises(UndefinedStreamError):
        env.from_("a").union("b")
    with pytest.raises(AnalysisError):
        env.register_stream("c", six(spark), "id", "unknown")
    with pytest.raises(ValueError):
        env.register_stream("d", None)
    env.register_stream("words", spark.createDataFrame([("hello",)], "w string"), "word")
    assert env.stream("words").columns == ["word"]
    assert env.is_defined("words") and not env.is_defined("b")


def test_results(spark):
    e = CEPEnvironment.define("s", six(spark)).cql("from s select id, name, price insert into o")
    assert e.returns("o").columns == ["id", "name", "price"]
    assert e.returns_tuple("o", "long", "string", "double").dtypes[0] == ("id", "bigint")
    with pytest.raises(AnalysisError):
        e.returns_tuple("o", "int", "string", "double", "long", "int")
    with pytest.raises(UndefinedStreamError):
        e.returns("unknown")
    wanted = T.StructType([T.StructField("price", T.StringType()), T.StructField("extra", T.IntegerType())])
    assert e.returns_as("o", wanted).first() == ("1.0", None)
    assert e.returns_map("o").selectExpr("map_keys(record)").first()[0] == ["id", "name", "price"]
    assert [r[0] for r in e.returns_tagged("o").select("stream_id").distinct().collect()] == ["o"]


def test_union_of_three(spark):
    env = CEPEnvironment(spark)
    for i in (1, 2, 3):
        env.register_stream(f"in{i}", connectors.synthetic_events(spark, 10), ts="timestamp")
    q = " ".join(f"from in{i} select timestamp, id, name, price insert into o;" for i in (1, 2, 3))
    assert env.union("in1", "in2", "in3").cql(q).returns("o").count() == 30


def test_wide_rows_chain(spark):
    extra = ", ".join(f"id as s{i}" for i in range(1, 26))
    e = CEPEnvironment.define("s", connectors.synthetic_events(spark, 5)).cql(f"from s select timestamp, id, name, price, {extra} insert into o")
    wide = e.returns("o")
    assert len(wide.columns) == 29
    with pytest.raises(AnalysisError):
        e.returns_tuple("o")
    again = CEPEnvironment.define("w", wide).cql("from w select timestamp, id, name, price insert into o")
    assert again.returns("o").count() == 5


def test_golden_join(spark):
    env = CEPEnvironment(spark)
    for n in ("in1", "in2"):
        env.register_stream(n, connectors.synthetic_events(spark, 5), ts="timestamp", seq="id")
    q = "from in1#window.length(5) as s1 join in2#window.time(500) as s2 on s1.id == s2.id select s1.timestamp as t, s1.name as n, s1.price as p1, s2.price as p2 insert into joined;"
    assert env.union("in1", "in2").cql(q).returns("joined").count() == 5


def test_golden_pattern(spark):
    env = CEPEnvironment(spark)
    for n in ("in1", "in2"):
        env.register_stream(n, connectors.synthetic_events(spark, 50), ts="timestamp", seq="id")
    q = "from every s1 = in1[id == 2] -> s2 = in2[id == 3] select s1.id as id_1, s1.name as name_1, s2.id as id_2, s2.name as name_2 insert into o"
    rows = env.union("in1", "in2").cql(q).returns_map("o").collect()
    assert [r.record for r in rows] == [{"id_1": "2", "id_2": "3", "name_1": "test_event", "name_2": "test_event"}]


def test_golden_sequence(spark):
    env = CEPEnvironment(spark)
    for n in ("in1", "in2"):
        env.register_stream(n, connectors.synthetic_events(spark, 5), ts="timestamp", seq="id")
    q = "from every s1 = in1[id == 2]+, s2 = in2[id == 3]? within 1000 second select s1[0].name as n1, s2.name as n2 insert into o"
    assert env.union("in1", "in2").cql(q).returns("o").count() == 1


def test_extension(spark):
    env = CEPEnvironment(spark).register_stream("s", connectors.synthetic_events(spark, 5))
    env.register_extension("custom:plus", lambda a, b: a + b, return_type=lambda t: "double" if "double" in t else "long")
    with pytest.raises(ValueError):
        env.register_extension("custom:plus", lambda a: a)
    e = env.from_("s").cql("from s select timestamp, custom:plus(price, price) as twice insert into o")
    assert e.returns("o").count() == 5
    assert dict(e.schema("o").attributes)["twice"] == "double"


def test_types():
    registry = TypeRegistry()
    assert registry.name_of(T.IntegerType()) == "int" and registry.name_of(T.DateType()) == "object"
    registry.register(T.DateType(), "string")
    with pytest.raises(ValueError):
        registry.register(T.DateType(), "string")


@pytest.mark.parametrize("text", ["from", "from s select insert into o", "from s select a b c", "from s[", "define stream s (a decimal)", "from s select a ~ b insert into o"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["from s select nothing insert into o", "from s select id + name as x insert into o", "from s#window.nothing(1) select id insert into o", "from s select no:such(id) as x insert into o", "from s select id, id insert into o", "from every a=s -> every b=s select a.id as x insert into o"])
def test_analysis_errors(spark, text):
    with pytest.raises(AnalysisError):
        CEPEnvironment.define("s", six(spark)).cql(text)


def test_unknown_streams_in_queries(spark):
    with pytest.raises(UndefinedStreamError):
        CEPEnvironment.define("s", six(spark)).cql("from unknown insert into o")


def test_prefix_free_syntax():
    app = parse("@app:name('x') define stream a (b int); @info(name = 'q') FROM a SELECT b INSERT INTO c;")
    assert len(app.definitions) == 1 and len(app.elements) == 1


def test_table_changes_with_nulls(spark):
    t = spark.createDataFrame([(1, "a", 1.0, "u"), (2, "a", None, "u"), (3, "a", 0.0, "p"), (4, None, 5.0, "p")], "t long, k string, v double, kind string")
    env = CEPEnvironment(spark)
    for kind in "up":
        env.register_stream(kind, t.where(f"kind = '{kind}'"), "k", "v", ts="t", seq="t")
    q = "define table T (k string, v double); from u select k, v update or insert into T on T.k == k; from p join T on p.k == T.k select p.v as p, T.v as v insert into o"
    assert [tuple(r) for r in env.union("u", "p").cql(q).returns("o").collect()] == [(0.0, None)]


def test_empty_streams(spark):
    empty = spark.createDataFrame([], "id int, name string, price double")
    env = CEPEnvironment(spark).register_stream("s", empty)
    for q in ("from s select sum(price) as x insert into o", "from s#window.length(2) select id insert into o", "from every a=s -> b=s select a.id as x insert into o", "from every a=s+, b=s? select b.id as x insert into o", "from s#window.timeBatch(1 sec) select count() as n insert into o"):
        assert env.from_("s").cql(q).returns("o").count() == 0
