import pytest
from pyspark.sql import functions as F

from slotwise.operators import outcomes
from slotwise.sources import parsed, versions, writers


def found(spark, *rows):
    """Outcomes: (source, name) rows and (source, severity, code) problems."""
    good = [(r[0], "row", (r[1],), None) for r in rows if len(r) == 2]
    bad = [(r[0], "problem", None, (r[1], r[2], None, "said")) for r in rows if len(r) == 3]
    return spark.createDataFrame(good + bad, f"source string, kind string, row struct<raw_name: string>, problem {outcomes.PROBLEM}")


def named(spark, *sources):
    return spark.createDataFrame([(s,) for s in sources], "source string")


def test_sources_that_fail_keep_what_they_had_and_emptied_ones_are_empty(spark, tmp_path):
    at = str(tmp_path / "store")
    assert parsed.control(spark, at).count() == 0
    first = parsed.write_outcomes(found(spark, ("a", "1"), ("b", "2"), ("c", "3")), named(spark, "a", "b", "c"), at)
    assert {(r.source, r.rows, r.status) for r in first.collect()} == {(s, 1, "parsed") for s in "abc"}
    second = parsed.write_outcomes(found(spark, ("a", "new"), ("b", "half"), ("b", "error", "BAD"), ("a", "warn", "ODD")), named(spark, "a", "b", "c", "d"), at)
    assert {(r.source, r.rows, r.errors, r.warnings, r.status) for r in second.collect()} == {("a", 1, 0, 1, "parsed"), ("b", 1, 1, 0, "failed"), ("c", 0, 0, 0, "parsed"), ("d", 0, 0, 0, "parsed")}
    assert {tuple(r) for r in parsed.rows(spark, at).collect()} == {("a", "new"), ("b", "2")}
    assert {(r.source, r.code) for r in parsed.diagnostics(spark, at).collect()} == {("a", "ODD"), ("b", "BAD")}
    third = parsed.write_outcomes(found(spark, ("b", "well")), named(spark, "b"), at)
    assert [r.source for r in third.collect()] == ["b"]
    assert {tuple(r) for r in parsed.rows(spark, at).collect()} == {("a", "new"), ("b", "well")}
    assert parsed.vacuum(spark, at) == 1
    assert {tuple(r) for r in parsed.rows(spark, at).collect()} == {("a", "new"), ("b", "well")}


def test_a_run_that_breaks_changes_nothing(spark, tmp_path):
    at = str(tmp_path / "store")
    parsed.write_outcomes(found(spark, ("a", "1")), named(spark, "a"), at)
    broken = found(spark, ("a", "2")).withColumn("row", F.struct(F.when(F.col("source") == "a", F.raise_error(F.lit("no"))).cast("string").alias("raw_name")))
    with pytest.raises(Exception, match="no"):
        parsed.write_outcomes(broken, named(spark, "a"), at)
    assert [tuple(r) for r in parsed.rows(spark, at).collect()] == [("a", "1")]
    assert parsed.vacuum(spark, at) == 0


def test_builds_are_published_whole(spark, tmp_path):
    at = str(tmp_path / "db")
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert versions.current(spark, at) is None and versions.tables(spark, at) == []
    versions.publish(spark, at, {"t": one(1), "u": one(2)})
    before = versions.read(spark, at, "t")
    versions.publish(spark, at, {"t": one(3), "w": lambda: one(4)})
    assert versions.tables(spark, at) == ["t", "w"]  # u is gone with the build that had it
    assert [r.v for r in versions.read(spark, at, "t").collect()] == [3]
    assert [r.v for r in before.collect()] == [1]  # a reader at work
    broken = one(5).select(F.raise_error(F.lit("broken")).cast("int").alias("v"))
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark, at, {"t": one(6), "w": broken})
    assert versions.tables(spark, at) == ["t", "w"] and [r.v for r in versions.read(spark, at, "t").collect()] == [3]
    assert len(versions._names(spark, f"{at}/builds")) == 2
    versions.publish(spark, at, {"t": one(7)}, keep=0)
    assert versions.tables(spark, at) == ["t"] and len(versions._names(spark, f"{at}/builds")) == 1
    with pytest.raises(ValueError, match="no table w"):
        versions.read(spark, at, "w")


def test_parents_come_first():
    refs = {"sessions": ["courses", "rooms"], "courses": ["programmes"], "exams": ["courses"], "courses_self": ["courses_self"]}
    order = writers.parents_first(["exams", "sessions", "rooms", "courses", "courses_self", "programmes"], refs)
    assert all(order.index(p) < order.index(c) for c, ps in refs.items() for p in ps if p != c)
    with pytest.raises(ValueError, match="ring: a, b"):
        writers.parents_first(["a", "b", "c"], {"a": ["b"], "b": ["a"]})


def test_a_database_is_mirrored_in_one_transaction(spark, tmp_path):
    url, jvm = f"jdbc:derby:{tmp_path}/db;create=true", spark._jvm
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jvm.java.lang.Class.forName(props["driver"])
    link = jvm.java.sql.DriverManager.getConnection(url)
    for ddl in ('create table programmes ("code" varchar(9) primary key)', 'create table courses ("id" int primary key, "programme" varchar(9) not null references programmes ("code"))', "insert into programmes values ('old')", "insert into courses values (1, 'old')"):
        link.createStatement().executeUpdate(ddl)
    link.close()
    tables = {"courses": spark.createDataFrame([(1, "A"), (2, "B")], "id int, programme string"), "programmes": spark.createDataFrame([("A",), ("B",)], "code string")}
    read = lambda t: sorted(tuple(r) for r in spark.read.jdbc(url, t, properties=props).collect())
    assert writers.mirror(tables, {"courses": ["programmes"]}, url, props) == ["programmes", "courses"]
    assert read("programmes") == [("A",), ("B",)] and read("courses") == [(1, "A"), (2, "B")]
    dangling = tables | {"courses": spark.createDataFrame([(3, "nowhere")], "id int, programme string")}
    with pytest.raises(Exception, match="(?i)constraint|foreign"):
        writers.mirror(dangling, {"courses": ["programmes"]}, url, props)
    assert read("programmes") == [("A",), ("B",)] and read("courses") == [(1, "A"), (2, "B")]
    writers.mirror({k: v.limit(0) for k, v in tables.items()}, {"courses": ["programmes"]}, url, props)
    assert read("courses") == []
