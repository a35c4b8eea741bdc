import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from slotwise.functions import times
from slotwise.operators import exports, geometry, lists, pages, parsers
from slotwise.sources import readers, sqlite, writers

RUN, RECT = "array<struct<y: double, x: double, w: double, text: string>>", "array<struct<x: double, y: double, w: double, h: double, fill: string>>"


def test_builds_fail_on_problems(spark):
    df = spark.createDataFrame([("stale one",), ("another",)], "subject string")
    exports.require_none(df.limit(0), "subject", "fine")
    with pytest.raises(ValueError, match="another\n  stale one"):
        exports.require_none(df, "subject", "stale mappings")


def test_names_sort_as_people_do(spark, tmp_path):
    courses = spark.createDataFrame([("a", n) for n in ("Zeta", "alpha", "Álgebra", "beta")], "key string, name string")
    writers.write_bundle(courses, str(tmp_path / "b"), "now")
    doc = json.loads(next((tmp_path / "b").glob("part-*.json")).read_text())
    assert [c["name"] for c in doc["courses"]] == ["Álgebra", "alpha", "beta", "Zeta"] or [c["name"] for c in doc["courses"]] == ["alpha", "Álgebra", "beta", "Zeta"]


def test_large_bundles_and_guides_are_several_documents_in_order(spark, tmp_path):
    names = [f"n{k:03d}" for k in range(200)]
    writers.write_bundle(spark.createDataFrame([(n, n) for n in reversed(names)], "key string, name string").repartition(4), str(tmp_path / "b"), "now", size=30)
    docs = [json.loads(x) for f in sorted((tmp_path / "b").glob("part-*.json")) for x in f.read_text().splitlines()]
    assert len(docs) > 3 and [c["name"] for d in docs for c in d["courses"]] == names and {d["builtAt"] for d in docs} == {"now"}
    writers.write_guides(spark.createDataFrame([(n,) for n in names], "url string"), spark.createDataFrame([("p", n, "EN") for n in names[:50]], "plan string, code string, lang string"), "y", str(tmp_path / "g"), size=30)
    docs = [json.loads(x) for f in sorted((tmp_path / "g").glob("part-*.json")) for x in f.read_text().splitlines()]
    assert [u for d in docs for u in d["verified"]] == names and [k for d in docs for k in d["languages"]] == [f"p|{n}" for n in names[:50]]


def test_sqlite_tables_and_queries(spark, tmp_path):
    path = str(tmp_path / "a b.db")
    with sqlite3.connect(path) as db:
        db.execute("create table exam (id integer primary key, name text, start_min int)")
        db.executemany("insert into exam values (?, ?, ?)", [(3 * k, f"e{k}", None if k == 5 else 30 * k) for k in range(100)])
        db.execute("create table none (id integer)")
    rows = sqlite.read_sqlite(spark, path, "name string, start_min int", table="exam", partitions=7)
    assert rows.rdd.getNumPartitions() == 7 and rows.count() == 100 and rows.where("start_min is null").count() == 1
    found = sqlite.read_sqlite(spark, path, "name string", query="select name from exam where start_min > ? and name <> ? order by id", params=(2900, "e98"))
    assert [r.name for r in found.collect()] == ["e97", "e99"]
    assert sqlite.read_sqlite(spark, path, "id int", table="none").count() == 0
    with pytest.raises(Exception, match="unable to open"):
        sqlite.read_sqlite(spark, str(tmp_path / "gone.db"), "id int", table="exam", partitions=1).collect()


def test_plans_in_links_and_storage(spark):
    link = spark.range(1).select(readers.read_plan_link(F.lit("#p=a,%20b,,a&c=")).alias("p")).first().p
    assert link["keys"] == ["a", "b"] and link.lessons == []
    lesson = F.array(F.struct(F.lit("X~1").alias("name"), F.lit(2).alias("day"), F.lit(600).alias("start"), F.lit(660).alias("end"), F.lit(None).cast("string").alias("room")))
    none = F.array().cast("array<struct<name: string, day: int, start: int, end: int, room: string>>")
    made = spark.range(1).select(writers.plan_link(F.array(F.lit("a"), F.lit("b")), lesson).alias("l"), writers.plan_link(F.array().cast("array<string>"), none).alias("empty")).first()
    assert (made.l, made.empty) == ("#p=a,b&c=X%7E1|2|600|660|", "")
    stored = ['{"version":1,"selected":["a"],"days":[2]}', '{"version":2,"selected":["a"]}', "{broken", None]
    rows = spark.createDataFrame(list(enumerate(stored)), "k int, s string").select("k", readers.read_plan(F.col("s")).alias("p")).orderBy("k").collect()
    assert [(r.p.selected, r.p.days, r.p.custom) for r in rows] == [(["a"], [2], []), ([], [], []), ([], [], []), ([], [], [])]


def test_env_files_and_sources_in_scope(spark, tmp_path):
    (tmp_path / "e").write_text("A_KEY=x=1 \n# note\nlower=no\nB2=\n")
    assert {(r.key, r.value) for r in readers.read_env(spark, str(tmp_path / "e")).collect()} == {("A_KEY", "x=1"), ("B2", "")}
    assert readers.in_scope(spark.createDataFrame([("primary",), ("out-of-scope",), ("crosscheck",)], "role string")).count() == 1


def test_ordered_tables(spark, tmp_path):
    import glob

    names = [f"{a}{b}{k % 7}" for k in range(60) for a in ("Zeta", "ábaco", "abacus", "zebra", "Écija", "efe") for b in ("", " b")]
    path = str(tmp_path / "o")
    writers.write_ordered(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, k int").repartition(5), "name", path, 8)
    files = sorted(glob.glob(f"{path}/part-*"))
    got = [r.name for f in files for r in spark.read.parquet(f).collect()]
    assert len(files) > 3 and sorted(got) == sorted(names)
    want = [r.name for r in spark.createDataFrame([(n,) for n in names], "name string").orderBy(F.collate("name", "UNICODE"), "name").collect()]
    assert got == want and got[0].startswith("ábaco") and got[-1].startswith("Zeta")


def test_only_changed_documents_are_written(spark, tmp_path):
    path = str(tmp_path / "d")
    docs = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    none = spark.createDataFrame([], "k string, sha256 string")
    assert writers.write_changed(docs(("a", 1), ("b", 2)), none, "k", path).count() == 2
    old = writers.manifest(docs(("a", 1), ("b", 2), ("z", 0)), "k")
    got = writers.write_changed(docs(("a", 1), ("b", 3)), old, "k", path)
    assert {(r.k, r.change) for r in got.collect()} == {("b", "changed"), ("z", "removed")}
    assert {(r.k, r.v) for r in spark.read.json(path).collect()} == {("a", 1), ("b", 3)}


def test_guides_are_written_with_their_languages(spark, tmp_path):
    links = spark.createDataFrame([("u2",), ("u1",), ("u1",)], "url string")
    languages = spark.createDataFrame([("10A", "1", "ES"), ("10A", "1", "EN")], "plan string, code string, lang string")
    writers.write_guides(links, languages, "2026-27", str(tmp_path / "g"))
    doc = json.loads(next((tmp_path / "g").glob("part-*.json")).read_text())
    assert doc == {"year": "2026-27", "verified": ["u1", "u2"], "languages": {"10A|1": ["EN", "ES"]}}


def test_extractions_are_read_and_counted(spark, tmp_path):
    doc = {"source": {"path": "a.pdf", "sha256": "s", "bytes": 9}, "runs": [{"x": 1, "y": 5, "w": 2, "h": 1, "text": "A"}, {"x": 9, "y": 5, "w": 2, "h": 1, "text": "B"}, {"x": 1, "y": 5, "w": 2, "h": 1, "text": " "}], "rects": [{"x": 0, "y": 0, "w": 1, "h": 1, "fill": None}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    (tmp_path / "_m.json").write_text(json.dumps({"files": {}}))
    runs, rects = readers.read_extractions(spark, str(tmp_path / "x.json"))
    assert (runs.count(), rects.count()) == (2, 1)
    from slotwise.sources import schemas

    made = writers.extraction_manifest(readers.read_documents(spark, str(tmp_path / "x.json"), schemas.EXTRACTION)).first()
    assert (made.path, made.bytes, made.runs, made.rects, made.imageOnly) == ("a.pdf", 9, 3, 1, False)
    shown = writers.page_lines(spark.createDataFrame([("a", [(5.0, 1.0, 2.0, "A"), (5.5, 9.0, 2.0, "B")])], f"source string, runs {RUN}"), gap=4.0).collect()
    assert [(r.line, r.segment, r.x0, r.text) for r in shown] == [(0, 0, 1.0, "A"), (0, 1, 9.0, "B")]
    files = readers.read_files(spark, str(tmp_path), "*.json").collect()
    assert [(r.length, len(r.sha256)) for r in files] == [((tmp_path / "x.json").stat().st_size, 64)]  # names with an underscore are hidden


def test_curation_maps_and_masters(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"extraMatches": {"$why": ["no"], "a": ["b", "c"]}}))
    rows = readers.read_map(spark, str(tmp_path / "m.json"), "extraMatches map<string, array<string>>", "extraMatches").collect()
    assert [(r.key, r.value) for r in rows] == [("a", ["b", "c"])]
    assert readers.masters(spark.createDataFrame([("Master",), ("bachelor",)], "level string")).count() == 1


def test_boxes_of_nested_states_against_a_loop(spark):
    import random

    r, pages_ = random.Random(2), []
    for k in range(30):
        ops = []
        for _ in range(r.choice([0, 5, 40, 700])):
            op = r.choice(["save", "restore", "transform", "box", "box", "fill"])
            n = {"transform": 6, "box": 4}.get(op, 0)
            ops.append((op, [float(r.randint(-2, 2)) for _ in range(n - (r.random() < 0.05 and n > 0))]))
        pages_.append((k, ops))
    df = spark.createDataFrame(pages_, f"k int, ops array<{geometry.DRAWING}>").select("k", geometry.drawn_boxes(F.col("ops")).alias("b"))
    got = {x.k: [tuple(b) for b in x.b] for x in df.collect()}
    for k, ops in pages_:
        m, stack, want = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
        for op, a in ops:
            if op == "save":
                stack.append(m)
            elif op == "restore" and stack:
                m = stack.pop()
            elif op == "transform" and len(a) == 6:
                m = (m[0] * a[0] + m[2] * a[1], m[1] * a[0] + m[3] * a[1], m[0] * a[2] + m[2] * a[3], m[1] * a[2] + m[3] * a[3], m[0] * a[4] + m[2] * a[5] + m[4], m[1] * a[4] + m[3] * a[5] + m[5])
            elif op == "box" and len(a) == 4:
                corners = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (a[0], a[0] + a[2]) for y in (a[1], a[1] + a[3])]
                xs, ys = zip(*corners, strict=True)
                want.append((min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)))
        assert got[k] == want


def test_boxes_and_fills(spark):
    half, lit = [F.lit(v) for v in (0.0, 2.0, -1.0, 0.0, 5.0, 7.0)], F.lit
    both = geometry.compose(half, [lit(v) for v in (1.0, 0.0, 0.0, 1.0, 3.0, 4.0)])
    r = spark.range(1).select(geometry.transform_box(half, lit(1.0), lit(2.0), lit(3.0), lit(4.0)).alias("a"), geometry.transform_box(both, lit(-2.0), lit(-2.0), lit(3.0), lit(4.0)).alias("b"), geometry.is_white(lit("#FFFFFF")).alias("w"), geometry.is_white(lit("#000000")).alias("n")).first()
    assert tuple(r.a) == tuple(r.b) == (-1.0, 9.0, 4.0, 6.0) and (r.w, r.n) == (True, False)


def test_words_and_wraps(spark):
    runs = [(5.0, 0.0, 10.0, "A7:"), (5.0, 12.0, 10.0, "Web"), (5.0, 21.0, 10.0, "site "), (5.0, 40.0, 5.0, "x")]
    lines = [(9.0, "NEW in 2023- "), (8.0, " 24"), (7.0, "next")]
    r = spark.createDataFrame([(runs, lines)], f"runs {RUN}, lines array<struct<y: double, text: string>>").select(geometry.spaced_text(F.col("runs")).alias("t"), geometry.unwrap_hyphens(F.col("lines")).alias("l")).first()
    assert r.t == "A7: Website x" and [tuple(x) for x in r.l] == [(9.0, "NEW in 2023-24"), (7.0, "next")]


def test_free_columns(spark):
    cases = [([1], (2, 5)), ([2, 3], (0, 1)), ([0, 1, 2, 3, 4, 5], (0, 5)), ([], (0, 5))]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c array<int>").select("k", geometry.free_span(F.lit(6), F.col("c")).alias("s")).orderBy("k")
    assert [tuple(r.s) for r in df.collect()] == [w for _, w in cases]


def test_headers_overridden(spark):
    line = [(5.0, 0.0, 40.0, "11:00-12:00"), (5.0, 50.0, 40.0, "11:00-12:00")]
    df = spark.createDataFrame([(1, line, None), (2, line, ["10:00-11:00", "11:00-12:00"]), (3, line, ["10:00-11:00"]), (4, line, ["10:00-11:00", "noon"])], f"k int, runs {RUN}, o array<string>")
    grid = geometry.header_grid(geometry.group_lines(F.col("runs")), F.lit(0.0), F.lit(90.0), override=F.col("o"))
    got = {r.k: r.g for r in df.select("k", grid.alias("g")).collect()}
    assert [got[k].error for k in (1, 2, 3, 4)] == ["a label stands twice", None, "1 labels for 2 cells", "a label given is no range"]
    assert got[2].edges == got[1].edges and [c.start_min for c in got[2].cols] == [600, 660]


def test_grids_that_cannot_be_read_are_reported(spark):
    runs = [(90.0, 100.0, 40.0, "9:00 - 10:00"), (90.0, 150.0, 40.0, "10:00 - 11:00"), (50.0, 10.0, 40.0, "MONDAY"), (30.0, 10.0, 40.0, "TUESDAY"), (50.0, 110.0, 20.0, "Big Data")]
    frame = [(100.0, 85.0, 100.0, 15.0, "#cccccc"), (0.0, 20.0, 90.0, 50.0, "#eeeeee"), (100.0, 0.0, 100.0, 10.0, None)]
    rows = [("good", runs, frame, "labelTexts"), ("few", runs, frame, "labelRects"), ("none", runs[2:], frame, "labelTexts"), ("bare", runs[:2], frame, "labelTexts")]
    df = spark.createDataFrame([(*r, 95.0, None) for r in rows], f"source string, runs {RUN}, rects {RECT}, rows_from string, label_max_x double, sub_grids array<{pages.SUB_GRID}>")
    assert [(r.source, r.label, r.raw_name, r.weekday, r.start_min, r.end_min) for r in pages.parse_grids(df).collect()] == [("good", "Day", "Big Data", 1, 540, 600)]
    assert {(r.source, r.code) for r in pages.grid_problems(pages.sub_grids(df)).collect()} == {("few", "LABEL_RECTS"), ("none", "HEADER_GRID"), ("bare", "NO_WEEKDAY_LABELS")}


def test_pages_without_weekdays_give_nothing(spark):
    df = spark.createDataFrame([("a", [(1.0, 1.0, 1.0, "x")], "R"), ("b", None, None)], f"source string, runs {RUN}, room string")
    assert lists.parse_weekly_lists(df).count() == lists.parse_day_grids(df).count() == lists.parse_month_calendars(df).count() == 0


def test_transcribed_exams(spark):
    exams = [("Big Data *", "2027-01-11", "9:00", "11:00", "1"), ("Nets", "2027-01-12", "18h", None, None)]
    df = spark.createDataFrame([("s", exams)], "source string, exams array<struct<name: string, date: string, start: string, end: string, room: string>>")
    got = parsers.vision_exams(df).collect()
    assert sorted((r.raw_name, r.start_min, r.end_min, r.duration_source) for r in got) == [("Big Data", 540, 660, "explicit_range"), ("Nets", 1080, 1200, "vision_default2h")]


def test_times_off_the_grid_fail(spark):
    assert spark.range(1).select(times.assert_granularity(F.lit(570), F.lit("a"))).first()[0] == 570
    with pytest.raises(Exception, match="a: 09:10 is not on a 30-minute boundary"):
        spark.range(1).select(times.assert_granularity(F.lit(550), F.lit("a"))).collect()
