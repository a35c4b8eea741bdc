import bisect
import json
import random
import re
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.functions import catalogue, fuzzy, lessons, text, times
from slotwise.operators import geometry, intervals, outcomes, parsers, relational
from slotwise.plans import catalog
from slotwise.sources import readers, writers
from slotwise.streaming import collisions


def one(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").select("k", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


def test_times(spark):
    assert one(spark, ["7:00 PM", "7.00 pm", "9:00 h.", "18h", "12:15 am", "x", None], times.parse_time) == [1140, 1140, 540, 1080, 15, None, None]
    assert one(spark, ["15:00 - 16:00", "10-12h.", "10:00 to 9:00", "3pm-5pm"], times.parse_time_range) == [(900, 960), (600, 720), None, None]
    assert one(spark, ["12-January", "MONDAY 11", "TUESDAY 11", "30 febrero"], times.parse_exam_date) == [date(2027, 1, 12), date(2027, 1, 11), None, None]
    assert one(spark, ["Weeks 1-7", "sep-oct", "Weeks 10-30", "x"], times.resolve_validity) == [(date(2026, 9, 7), date(2026, 10, 25)), (date(2026, 9, 1), date(2026, 10, 31)), (date(2026, 11, 9), date(2027, 1, 8)), None]
    assert one(spark, ["9:30", "24:00", "9:5"], times.parse_time_input) == [570, None, None]


def test_names(spark):
    got = one(spark, ["I&E Basics: Foo-Bar", "Diseño de Máster – ﬁn", "e-Health & Care (elective)"], text.normalise)
    assert [(r.key, list(r.candidates)) for r in got] == [("i-and-e-basics-foo-bar", ["foo bar"]), ("diseno-de-master-fin", []), ("ehealth-and-care", [])]
    kinds = one(spark, ["Big Data (10:00 to 12:00) (elective) *", "Y (25-3)", "a /// b"], text.strip_annotations)
    assert [(r.name, [a.kind for a in r.annotations]) for r in kinds] == [("Big Data", ["explicitRange", "elective", "star"]), ("Y (25-3)", []), ("a b", ["placeholder"])]
    lines = spark.createDataFrame([([(5.0, 0.0, "Aula 6202"), (10.0, 0.0, "Big"), (10.0, 9.0, "Data")],)], "l array<struct<y: double, x: double, text: string>>")
    assert lines.select(text.assemble_name(F.col("l"))).first()[0] == "Big Data"


def plain_score(a, b):
    """The score, told by loops."""
    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    ta, tb = (list(dict.fromkeys(t for t in x.split() if t not in text.STOPWORDS)) for x in (a, b))
    free, n = list(tb), 0
    for t in ta:
        if t in free:
            free.remove(t)
            n += 1
    if n < min(len(ta), len(tb)):
        for t in ta:
            hit = next((u for u in free if u == t or (min(len(t), len(u)) >= 5 and abs(len(t) - len(u)) <= 1 and lev(t, u) <= 1)), None)
            if hit:
                free.remove(hit)
                n += 1
    union, least = len(ta) + len(tb) - n, min(len(ta), len(tb))
    return 0.45 * (1 - lev(a, b) / max(len(a), len(b), 1)) + 0.25 * (n / union if union else 0) + 0.25 * (n / least if least else 0)


def test_fuzzy_scores(spark):
    r = random.Random(1)
    words = ["statistical", "statisical", "data", "analysis", "analisys", "big", "visualization", "systems", "system", "the", "networks"]
    pairs = [(" ".join(r.sample(words, r.randint(1, 4))), " ".join(r.sample(words, r.randint(1, 4)))) for _ in range(60)]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", fuzzy.score(text.normalise(F.col("a")), text.normalise(F.col("b")))["total"].alias("t")).collect()
    assert {x.k: round(x.t, 9) for x in got} == {k: round(plain_score(*p), 9) for k, p in enumerate(pairs)}


def test_outcomes(spark):
    rows = [(0.95, 0.1, 1.0), (0.95, 0.01, 1.0), (0.85, None, 0.9), (0.85, 0.2, 0.9), (0.85, 0.2, 0.5), (0.5, None, 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t double, m double, c double")
    got = {r.k: r.o for r in df.select("k", fuzzy.outcome(F.col("t"), F.col("m"), F.col("c")).alias("o")).collect()}
    assert [got[k] for k in range(6)] == ["accept-high", "ambiguous", "accept-low", "accept-low", "none", "none"]


def test_lessons_round_trip(spark):
    df = spark.createDataFrame([([("Ñ (a)!~|b", 1, 540, 600, "R~1"), ("x", 6, 540, 600, None), ("y", 5, 600, 615, None), ("z", 5, 600, 630, None)],)], "l array<struct<name: string, day: int, start: int, end: int, room: string>>")
    got = df.select(lessons.decode(lessons.encode(F.col("l")))).first()[0]
    assert [tuple(x) for x in got] == [("shared-0", "Ñ (a)!~|b", 1, 540, 600, "R~1"), ("shared-3", "z", 5, 600, 630, None)]
    assert one(spark, ["%zz|1|540|600|", "", "a|b"], lessons.decode) == [[], [], []]


def test_overlaps_against_all_pairs(spark):
    r = random.Random(3)
    rows = [(k, r.randint(0, 5), r.randint(1, 3), s := r.randint(540, 700), s + r.choice([0, 20, 60, 200]), r.random() < 0.5) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, key int, date int, s int, e int, assumed boolean")
    want = set()
    for a in rows:
        for b in rows:
            if a[2] == b[2] and (a[3], a[0]) < (b[3], b[0]) and b[3] < a[4] and a[3] < b[4] and a[1] != b[1] and b[3] < b[4]:
                hard = [x[3] + 1 if x[5] else x[4] for x in (a, b)]
                want.add((a[0], b[0], "certain" if b[3] < hard[0] and a[3] < hard[1] else "possible"))
    got = intervals.exam_collisions(df, ["id"]).collect()
    assert len(got) == len(want) and {(x.a_id, x.b_id, x.severity) for x in got} == want


def test_overlaps_of_one_crowded_day_are_dealt_evenly(spark):
    r = random.Random(5)
    # one day has nearly all rows, and one start a third of those
    rows = [(k, 1 if k % 10 else 2, s := 600 if k % 3 == 0 else r.randint(540, 900), s + r.choice([30, 60, 240])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, date int, s int, e int")
    cells = 24
    spread, starts = intervals._dealt(df, "date", ["id"], cells)
    on = ["date", "_range", "_a", "_b"]
    work = [x["n"] * x["m"] for x in spread.groupBy(*on).agg(F.count("*").alias("n")).join(starts.groupBy(*on).agg(F.count("*").alias("m")), on).collect()]
    assert len(work) >= cells / 2 and max(work) <= 4 * sorted(work)[len(work) // 2]
    assert max(work) <= 4 * sum(work) / cells
    got = intervals.overlap_pairs(df, "date", ["id"], cells=cells).groupBy("a_id").count().collect()
    want = {}
    for day in (1, 2):
        mine = sorted((s, k, e) for k, d, s, e in rows if d == day)
        starts_ = [x[:2] for x in mine]
        for n, (s, k, e) in enumerate(mine):
            want[k] = bisect.bisect_left(starts_, (e, -1)) - n - 1
    assert {x.a_id: x["count"] for x in got} == {k: n for k, n in want.items() if n}


def test_lanes_of_one_crowded_slot(spark):
    rows = [(k, 1, 600, 660) if k % 2 else (k, 1, 540 + 30 * (k % 7), 630 + 30 * (k % 5) + 30 * (k % 7)) for k in range(2000)]
    df = intervals.clusters(spark.createDataFrame(rows, "id int, d int, s int, e int"), "d")
    ranked, parts = intervals.slot_ranks(df, ["d", "cluster", "s", "e"], ["id"], parts=16)
    assert ranked.where("s = 600 and e = 660").groupBy("_part").count().agg(F.max("count")).first()[0] <= 1000 / 12
    assert parts.where("s = 600 and e = 660").count() == 16
    ends, want = [], {}
    for k, _, s, e in sorted(rows, key=lambda x: (x[2], x[3], x[0])):
        lane = next((i for i, end in enumerate(ends) if end <= s), len(ends))
        ends[lane : lane + 1] = [e]
        want[k] = lane
    assert {x.id: x.lane for x in intervals.assign_lanes(df, "d", ["id"]).collect()} == want
    named = df.withColumn("name", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")))
    assert {int(x.name[1:]): x.lane for x in intervals.assign_lanes(named, "d", ["name"]).collect()} == want


def test_lanes_against_a_loop(spark):
    r = random.Random(4)
    rows = [(k, 1, s := r.randint(0, 400), s + r.randint(1, 60)) for k in range(60)]
    df = intervals.clusters(spark.createDataFrame(rows, "id int, d int, s int, e int"), "d")
    got = {x.id: (x.lane, x.cluster) for x in intervals.assign_lanes(df, "d", ["id"]).collect()}
    ends, cluster_end, want, n, lanes = [], None, {}, 0, {}
    for k, _, s, e in sorted(rows, key=lambda x: (x[2], x[3], x[0])):
        if cluster_end is None or s >= cluster_end:
            ends, cluster_end, n = [], 0, n + 1
        lane = next((i for i, x in enumerate(ends) if x <= s), len(ends))
        ends[lane : lane + 1] = [e]
        cluster_end = max(cluster_end, e)
        want[k], lanes[n] = (lane, n), len(ends)
    assert got == want
    assert {x.cluster: x.lanes for x in intervals.lane_counts(df, "d").collect()} == lanes


def test_page_folds_against_loops(spark):
    r, pages = random.Random(8), []
    for k in range(40):
        runs = [(round(r.uniform(0, 60), 1), round(r.uniform(0, 300), 1), round(r.uniform(1, 30), 1), f"t{i}") for i in range(r.randint(0, 90))]
        rects = [(0.0, round(r.uniform(0, 90), 1), 9.0, round(r.choice([0.0, 4.0, 20.0]) + r.uniform(0, 9), 1)) for _ in range(r.randint(0, 30))]
        pages.append((k, runs, rects))
    df = spark.createDataFrame(pages, "k int, runs array<struct<y: double, x: double, w: double, text: string>>, rects array<struct<x: double, y: double, w: double, h: double>>")
    got = df.select("k", geometry.group_lines(F.col("runs")).alias("lines"), geometry.bands_from_rects(F.col("rects")).alias("bands")).withColumn("parts", F.transform("lines", lambda x: geometry.split_by_gaps(x["runs"], 12.0))).collect()
    for (_, runs, rects), x in zip(pages, sorted(got, key=lambda x: x.k), strict=True):
        lines = []
        for run in sorted(runs, key=lambda t: (-t[0], t[1])):
            if lines and abs(run[0] - lines[-1][0][0]) <= 2.0:
                lines[-1].append(run)
            else:
                lines.append([run])
        want = [(line[0][0], sorted(line, key=lambda t: t[1])) for line in lines]
        assert [(y, [t[3] for t in rs]) for y, rs in want] == [(v.y, [t.text for t in v.runs]) for v in x.lines]
        for (_, rs), parts in zip(want, x.parts, strict=True):
            cut = [[rs[0]]]
            for a, b in zip(rs, rs[1:], strict=False):
                cut += [[b]] if b[1] - (a[1] + a[2]) > 12.0 else []
                cut[-1] += [b] if cut[-1][-1] is not b else []
            assert [[t[3] for t in c] for c in cut] == [[t.text for t in c] for c in parts]
        bands = []
        for y1, y0 in sorted(((q[1] + q[3], q[1]) for q in rects), key=lambda t: (-t[0], -t[1])):
            least = min(bands[-1][1] - bands[-1][0], y1 - y0) if bands else 0
            if bands and least > 0 and (min(bands[-1][1], y1) - max(bands[-1][0], y0)) / least > 0.8:
                bands[-1] = (min(bands[-1][0], y0), max(bands[-1][1], y1))
            else:
                bands.append((y0, y1))
        assert [tuple(b) for b in x.bands] == bands


def test_folds_of_a_large_page_take_time_in_proportion(spark):
    import time

    def took(n):
        runs = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((k % (n / 4)).cast("double").alias("y"), (k % 997).cast("double").alias("x"), F.lit(3.0).alias("w"), F.lit("t").alias("text")))
        rects = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(F.lit(0.0).alias("x"), (k * 10).cast("double").alias("y"), F.lit(9.0).alias("w"), F.lit(7.0).alias("h")))
        df = spark.range(1).repartition(1).select(F.size(geometry.group_lines(runs)).alias("a"), F.size(geometry.bands_from_rects(rects)).alias("b"), F.size(geometry.split_by_gaps(F.transform(runs, lambda r: r), 1.0)).alias("c"))
        start = time.time()
        row = df.first()
        assert row.b == n
        return time.time() - start

    took(1000)
    few, many = took(25_000), took(100_000)
    assert many < 8 * few + 1, (few, many)


def test_lines_and_blocks(spark):
    runs = [(100.0, 10.0, 20.0, "Big "), (99.0, 30.0, 20.0, "Data"), (97.5, 90.0, 20.0, "Other"), (80.0, 12.0, 30.0, "Room 5001")]
    df = spark.createDataFrame([(runs,)], "runs array<struct<y: double, x: double, w: double, text: string>>")
    lines = geometry.group_lines(F.col("runs"))
    assert [[r.text for r in x.runs] for x in df.select(lines).first()[0]] == [["Big ", "Data"], ["Other"], ["Room 5001"]]
    blocks = df.select(geometry.blocks_in_band(lines, F.lit(70.0), F.lit(110.0), 8.0)).first()[0]
    assert [(b.name, b.room) for b in blocks] == [("Big Data", "5001"), ("Other", None)]
    header = spark.createDataFrame([([(50.0, 10.0, 30.0, "15:00 - "), (50.0, 60.0, 30.0, "16:00 - 17:00"), (49.0, 110.0, 30.0, "18:00 - 19:00"), (40.0, 12.0, 26.0, "16:00")],)], "runs array<struct<y: double, x: double, w: double, text: string>>")
    g = header.select(geometry.header_grid(lines, F.lit(0.0), F.lit(160.0)).alias("g")).first().g
    assert (list(g.edges), [c.start_min for c in g.cols], list(g.gaps), g.error) == ([0.0, 50.0, 100.0, 160.0], [900, 960, 1080], [1], None)


def test_parsers(spark):
    cells = spark.createDataFrame([("Big Data (10:00 to 12:00) *", "R1", 1, 540, 600), ("Actividades de evaluación", None, 2, 540, 600), ("X (sep-oct)", None, 3, 540, 660)], "name string, room string, weekday int, col_start int, col_end int")
    cells = outcomes.start(cells.withColumns({"source": F.lit("s"), "drawn": F.lit("rect"), "span_margin": F.lit(None).cast("double")}))
    got = {x.raw_name: x for x in outcomes.rows_of(parsers.session_outcomes(cells, None, ["source"])).collect()}
    assert set(got) == {"Big Data", "X"} and (got["Big Data"].start_min, got["Big Data"].elective, got["X"].validity_label) == (600, True, "sep-oct")
    cell = outcomes.start(spark.createDataFrame([("s", "A //// B 12:00 h.", "2027-01-11", 540, 720)], "source string, name string, date string, slot_start int, slot_end int"))
    exams = outcomes.rows_of(parsers.exam_cell_outcomes(cell, None, ["source"])).collect()
    assert sorted((x.raw_name, x.start_min, x.end_min, x.duration_source) for x in exams) == [("A", 540, 660, "slot_default2h"), ("B", 720, 840, "start_override_default2h")]
    assert one(spark, ["MONDAY 11TUESDAY 12"], parsers.split_glued_dates) == [["MONDAY 11", "TUESDAY 12"]]


def test_vision(spark, tmp_path):
    from slotwise.sources import schemas

    (tmp_path / "t.json").write_text(json.dumps({"kind": "vision-timetable", "source": "a", "grids": [{"semester": "1S", "columns": [], "rows": [{"weekday": "Lunes", "blocks": [{"name": "Big Data *", "start": "9:00", "room": "R"}, {"name": "X", "start": "12:00", "end": "13:00"}]}]}]}))
    got = parsers.vision_sessions(readers.read_documents(spark, str(tmp_path / "t.json"), schemas.VISION_TIMETABLE)).orderBy("start_min").collect()
    assert [(x.weekday, x.raw_name, x.start_min, x.end_min) for x in got] == [(1, "Big Data", 540, 720), (1, "X", 720, 780)]


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes('﻿Plans;Codes; Name ;English name;Credits;Level;\r\n10A;103;"Uno ""dos""\nlinea";One;4,5;Master;\r\n;;;;;;\r\n10B;#REF!; x ;;3;Bachelor;y\r\n'.encode())
    rows = readers.read_catalogue(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.plans, r.codes, r.name, r.credits, r.quota) for r in rows] == [("10A", "103", 'Uno "dos"\nlinea', "4,5", ""), ("10B", "", "x", "3", "")]


def test_parsed_artefacts_and_bundle(spark, tmp_path):
    session = {"rawName": "A", "weekday": 1, "startMin": 540, "endMin": 600, "room": "R"}
    for name, extra in (("1", []), ("2", [session])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"kind": "timetable", "sourcePath": "s", "programme": "P", "semester": "1S", "sessions": [session, *extra], "diagnostics": [{"severity": "warn", "code": "C", "subject": "A", "detail": "d"}]}))
    sessions, exams, diagnostics = readers.read_parsed(spark, str(tmp_path))
    assert (sessions.count(), exams.count(), diagnostics.count()) == (2, 0, 1)  # the later file of a source counts
    assert [r.note for r in relational.notes(diagnostics, ["C"]).collect()] == ["A: d"]
    assert "1 warn" in writers.report(diagnostics, "Report")
    courses = spark.createDataFrame([("a", "B"), ("b", "a"), ("c", "none")], "key string, name string")
    made = writers.bundle(courses, spark.createDataFrame([("a", 1, 540, 600)], "key string, d int, s int, e int"), spark.createDataFrame([("b", "2027-01-11", 540, 660, True)], "key string, date string, s int, e int, assumed boolean"))
    writers.write_bundle(made, str(tmp_path / "bundle"), "2026-09-01T00:00:00Z")
    assert [(r.key, len(r.sessions), len(r.exams)) for r in readers.read_bundle(spark, str(tmp_path / "bundle")).collect()] == [("b", 0, 1), ("a", 1, 0)]
    assert writers.changes(writers.manifest(made, "key"), writers.manifest(made.where("key = 'a'"), "key"), "key").collect()[0].change == "added"


def test_offerings_and_credits(spark):
    rows = spark.createDataFrame([("a", "4,5", "Uno", "One"), ("a", "3", "dos", "Two"), ("b", "3", "x", "X"), ("b", "4", "X", "x"), ("c", "-", "", "")], "key string, credits string, name string, english string")
    assert {r.key: r.credits for r in relational.credit_sums(rows, "key", "credits", "name", "english").collect()} == {"a": 7.5, "b": None, "c": None}
    assert one(spark, ["4,5", " 6 ECTS", "x"], catalogue.credit_value) == [4.5, 6.0, None]


def test_streamed_conflicts(spark, tmp_path):
    plan = spark.createDataFrame([("p", "2027-01-11", 540, 660, False)], "key string, date string, s int, e int, assumed boolean")
    spark.createDataFrame([("a", "2027-01-11", 600, 720, True, "2027-01-01 10:00:00"), ("b", "2027-01-12", 600, 720, True, "2027-01-01 11:00:00")], "key string, date string, s int, e int, assumed boolean, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("key string, date string, s int, e int, assumed boolean, ts timestamp").parquet(str(tmp_path / "in"))
    q = collisions.conflicts_by_window(collisions.stream_conflicts(arriving, plan)).writeStream.outputMode("update").format("memory").queryName("conflicts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.severity, r["count"]) for r in spark.table("conflicts").collect()] == [("certain", 1)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import math

    import duckdb

    from .conftest import SF

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())


def test_common_tokens_are_met_in_many_places(spark):
    # nearly all names share one token, so under its key meet nearly all pairs
    names = [f"systems design n{k:03d}" if k % 10 else f"lone k{k:03d}" for k in range(120)]
    rows = spark.createDataFrame([(n,) for n in names], "item string").select("item", text.normalise(F.col("item")).alias("b"))
    targets = rows.select(F.col("item").alias("target"), F.col("b").alias("a"))
    t, i = fuzzy._keyed(targets, "target", "a"), fuzzy._keyed(rows, "item", "b")
    heavy = {x._key: x.a_parts * x.b_parts for x in fuzzy.heavy_keys(t, i, 32).collect()}
    assert len(heavy) < 32 and heavy["systems"] >= 2 and heavy["design"] == heavy["systems"]
    pairs = fuzzy.candidate_names(targets, rows, 32)
    count, tokens = pairs.count(), [set(n.split()) for n in names]
    near = lambda a, b: any(x == y or (min(len(x), len(y)) >= 5 and abs(len(x) - len(y)) <= 1 and one_edit(x, y)) for x in a for y in b)
    assert count == pairs.distinct().count() == sum(near(a, b) for a in tokens for b in tokens)


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def test_matches_among_candidates_are_those_among_all_pairs(spark):
    names = ["Human Computer Interaction", "Human-Computer Interactions", "Big Data", "Big Date", "Operating Systems", "Oparating Systems Design", "Health Informatics", "eHealth", "E-Health Systems", "a", "Networks", "Netwrks"]
    rows = spark.createDataFrame([(n,) for n in names], "item string").select("item", text.normalise(F.col("item")).alias("b"))
    targets = rows.select(F.col("item").alias("target"), F.col("b").alias("a"))
    score = lambda pairs: pairs.where("target <> item").select("target", "item", fuzzy.score(F.col("a"), F.col("b")).alias("score"))
    best = lambda pairs: {r.target: (r.item, r.outcome) for r in fuzzy.best_match(score(pairs), "target", "item", "item").collect()}
    some, every = best(fuzzy.candidates(targets, rows)), best(targets.crossJoin(rows))
    assert {k: v for k, v in every.items() if v[1] != "none"} == {k: v for k, v in some.items() if v[1] != "none"}
    assert len({v[1] for v in every.values()}) > 1


def test_forms_of_one_pass_are_those_of_built_in_functions(spark):
    r = random.Random(12)
    parts = [*"aZé ß№ﬁ&-:/*().9h", "HCI", "HCI basics: ", "i and e basics :", "(10:00 to 12:00)", "(12:00-10:00)", "(9-10 h.)", "(7:00 PM - 9:00)", "(9:00-10:00", " 12:00 h.", "12:00h", "(Weeks 1-7)", "(sep - oct)", "(elective)", "( * )", "///", "////", "*", "e-mail", "E Health", "the", "of", "\u00a0", "\u3000", "\n", "\t", "–", "‘", "Ⅱ", "e\u0301", "İ", "Ω", "ñ", "漢字", "_", "'", "x"]
    texts = ["".join(r.choice(parts) + r.choice(["", "", " "]) for _ in range(r.randint(0, 9))) for _ in range(1500)] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", text.normalise(F.col("t")).alias("a"), text.normalise_inline(F.col("t")).alias("b"))
    wrong = [(x.t, x.a, x.b) for x in df.collect() if x.a != x.b]
    assert not wrong, wrong[:3]
    assert df.where("a.full is null").count() == 1 and df.where("size(a.candidates) > 0").count() > 5


def test_forms_hold_the_words_of_a_few_texts_at_a_time(spark, monkeypatch):
    real = text.canonical_forms

    def counted(equivalences):
        made, live = real(equivalences), [0]

        class Words(list):
            def __init__(self, words):
                super().__init__(words)
                live[0] += len(words)

            def __del__(self):
                live[0] -= len(self)

        def one(t):
            full, tokens, _, candidates = made(t)
            tokens = Words(tokens)
            return full, tokens, str(live[0]), candidates

        return one

    monkeypatch.setattr(text, "canonical_forms", counted)
    n = 60  # texts of 100 kB, in one Arrow batch
    df = spark.range(0, n, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit(" aa bb cc"), 11_000)).alias("t"))
    got = df.select("id", text.normalise(F.col("t")).alias("n")).selectExpr("id", "n.full", "size(n.tokens) words", "n.tokens[0] first", "cast(n.key as long) live").collect()
    assert [(x.id, x.words, x.first, x.full.split(" ", 1)[0]) for x in got] == [(k, 33_001, str(k), str(k)) for k in range(n)]
    assert max(x.live for x in got) < n * 33_001 / 2


def test_blocks_of_texts_are_the_batch(spark):
    texts = [None, "", "a", "é" * 2_000_000, None, "", *["b" * 300_000] * 9, ""]
    for batch in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1), pa.array([None, None], pa.string()), pa.array([], pa.string())):
        cut = list(text.blocks(batch))
        assert [t for x in cut for t in x.to_pylist()] == batch.to_pylist() and all(len(x) for x in cut)
        assert all(sum(sorted(len((t or "").encode()) for t in x.to_pylist())[:-1]) <= text.BLOCK_BYTES for x in cut)
    long = spark.createDataFrame([(k, t) for k, t in enumerate(["á B", None, "a b " * 400_000, ""])], "k int, t string").coalesce(1)
    got = {x.k: x for x in long.select("k", text.normalise(F.col("t")).alias("n")).selectExpr("k", "n.key", "coalesce(size(n.tokens), -1) words", "n.full is null none").collect()}
    assert [(got[k].key if k != 2 else len(got[k].key), got[k].words, got[k].none) for k in range(4)] == [("a-b", 1, False), (None, -1, True), (1_599_999, 400_000, False), ("", 0, False)]


def test_spaces_and_letters_beyond_ascii(spark):
    row = spark.range(1).select(
        times.parse_time(F.lit("\t9:00\n")).alias("time"), times.resolve_validity(F.lit("\tWeeks 1-7\u00a0"))["from"].cast("string").alias("window"), text.collapse(F.lit("a\u00a0\u2003b\u3000")).alias("line"),
        text.slug(F.lit("Tiếng Việt.pdf")).alias("slug"), text.normalise(F.lit("Álgebra Ⅱ №3 (10:00-12:00)")).alias("n"), text.composed(F.lit("Ma\u0301ster")).alias("path"), times.parse_weekday(F.lit(" Mie\u0301rcoles\u2009")).alias("day"), text.classify_block(F.lit("\u00a0")).alias("kind"),
    ).first()
    assert (row.time, row.window, row.line, row.slug, row.n.key, row.path, row.day, row.kind) == (540, "2026-09-07", "a b", "tieng-viet", "algebra-ii-no3", "Máster", 3, "filler")


def test_lanes_against_a_plain_version(spark):
    r = random.Random(4)
    rows = [(k, 1, s := 30 * r.randint(18, 30), s + 30 * r.randint(1, 5)) for k in range(300)]
    df = intervals.clusters(spark.createDataFrame(rows, "id int, d int, s int, e int"), "d")
    ends, want = [], {}
    for k, _, s, e in sorted(rows, key=lambda x: (x[2], x[3], x[0])):
        free = [i for i, end in enumerate(ends) if end <= s]
        lane = free[0] if free else len(ends)
        ends[lane : lane + 1] = [e]
        want[k] = lane
    got = {x.id: (x.cluster, x.lane) for x in intervals.assign_lanes(df, "d", ["id"]).collect()}
    assert len({c for c, _ in got.values()}) == 1 and {k: lane for k, (_, lane) in got.items()} == want


def test_reduced_collisions_are_those_of_the_pairs(spark):
    r = random.Random(9)
    rows = [(k, r.randint(0, 3), r.randint(0, 2), s := 30 * r.randint(18, 26), s + 30 * r.randint(0, 4), r.random() < 0.5) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, key int, d int, s int, e int, assumed boolean").withColumn("date", F.date_add(F.lit("2027-01-11").cast("date"), F.col("d")))
    pairs = intervals.exam_collisions(df, ["id"]).collect()
    worst = {}
    for p in pairs:
        for k in (p.a_id, p.b_id):
            worst[k] = "certain" if p.severity == "certain" else worst.get(k, "possible")
    assert {x.id: x.worst for x in intervals.worst_severity(df).collect()} == worst
    counts = {x.date: (x.certain, x.possible) for x in intervals.collision_counts(df).collect()}
    assert counts == {d: tuple(sum(p.a_date == d and p.severity == k for p in pairs) for k in ("certain", "possible")) for d in {p.a_date for p in pairs}}
    assert {x.key for x in intervals.blocking_keys(df, df, "date").collect()} == {k for p in pairs for k in (p.a_key, p.b_key)}


def test_overlaps_try_few_pairs_in_vain(spark):
    rows = [(k, "x", k // 480, 30 * (k // 10 % 48), 30 * (k // 10 % 48) + 60) for k in range(4800)]
    df = spark.createDataFrame(rows, "id int, key string, date int, s int, e int")
    cells = intervals.CELLS_A_TASK * intervals._tasks(df)
    a, b = intervals._dealt(df, "date", ["id"], cells)
    cell = ["date", "_range", "_a", "_b"]
    tried = a.groupBy(*cell).agg(F.count("*").alias("x")).join(b.groupBy(*cell).agg(F.count("*").alias("y")), cell).agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    found = intervals.overlap_pairs(df, "date", ["id"]).count()
    assert found == sum(1 for x in rows[:480] for y in rows[:480] if (x[3], x[0]) < (y[3], y[0]) and y[3] < x[4]) * 10
    assert tried < 2 * found + len(rows)


def test_session_counts_are_those_of_the_pairs(spark, monkeypatch):
    rng = random.Random(5)
    day = lambda: date(2027, 1, rng.randint(1, 28)) if rng.random() < 0.6 else None
    rows = [(k, rng.choice("abcdefg") if rng.random() < 0.95 else None, rng.randint(1, 7), 30 * rng.randint(0, 20), 30 * rng.randint(0, 24), day(), day()) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, key string, d int, s int, e int, v_from date, v_to date")
    pairs = intervals.session_collisions(df, ["id"])
    want = {tuple(r) for r in pairs.groupBy("a_d", "a_key").agg(F.count("*"), F.countDistinct("b_key")).collect()}
    for rows_a_cell in (100_000, 20):  # one cell a weekday, and several
        monkeypatch.setattr(intervals, "COUNTED", rows_a_cell)
        assert {tuple(r) for r in intervals.session_counts(df, ["id"]).collect()} == want
    assert intervals.session_counts(df.limit(0), ["id"]).count() == 0


def test_bands_are_those_of_whole_brands(spark, tmp_path):
    spark.range(4000).selectExpr("id as p_partkey", "concat('Brand#', id % 2) as p_brand", "cast(id % 50 + 1 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["rect_bands"](spark, str(tmp_path))
    assert got.columns == ["p_brand", "bands", "widest"] and got.count() == 2


def test_spans_of_a_batch_are_those_of_the_fold(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        columns = rng.choice((3, 7))
        edges = [0.0]
        for _ in range(columns):
            edges.append(edges[-1] + rng.choice((20.0, 40.0)))
        first = rng.randrange(columns)
        blocks = [(float(rng.randrange(int(edges[-1]))), float(rng.randrange(5, 60))) for _ in range(rng.randrange(6))]
        rows.append((k, sorted(blocks), edges, sorted(rng.sample(range(columns), rng.randrange(2))), first, rng.randrange(first, columns)))
    df = spark.createDataFrame(rows, "k int, blocks array<struct<centre: double, width: double>>, edges array<double>, gaps array<int>, first int, last int")
    fold = geometry.disjoint_spans(F.transform("blocks", lambda b: geometry.span_candidates(b["centre"], b["width"], F.col("edges"), F.col("gaps"), F.col("first"), F.col("last"))))
    got = df.select("k", geometry.block_spans(*[F.col(c) for c in df.columns[1:]]).alias("s")).collect()
    assert sorted(got) == sorted(df.select("k", fold.alias("s")).collect())


def test_spans_are_not_folded_by_interpreted_steps(spark):
    plan = catalog.QUERIES["band_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


@pytest.mark.parametrize("name", ["slot_rows", "span_inference"])
def test_parts_are_dealt_to_all_tasks(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == intervals._tasks(spark.range(1))


def test_overlaps_are_dealt_to_more_tasks_than_there_are_cores(spark):
    rows = [(k, k // 400, 30 * (k // 10 % 40)) for k in range(4000)]
    df = spark.createDataFrame(rows, "id int, date int, s int").withColumn("e", F.col("s") + 120)
    made = [x["count"] for x in intervals.overlap_pairs(df, "date", ["id"]).groupBy(F.spark_partition_id()).count().collect()]
    assert max(made) * 8 < sum(made) and len(made) > 4 * intervals._tasks(df)


def test_pairs_of_short_lists_and_uncut_days_against_all_pairs(spark, monkeypatch):
    r = random.Random(11)
    some = lambda n: r.randrange(n) if r.random() < 0.9 else None
    places = [(x, y) for x in (None, *range(20)) for y in (None, *range(20))]
    r.shuffle(places)
    # one crowded day, a few of some rows, and days of a row; places hold nulls, which come first
    rows = [(*places[k], 0 if k < 150 else some(6) if k < 250 else k, s := some(10), None if s is None else s + r.randrange(4)) for k in range(300)]
    df = spark.createDataFrame(rows, "x int, y int, d int, s int, e int")
    first = lambda v: (v is not None, v or 0)
    sound = [(d, s, e, (first(x), first(y))) for x, y, d, s, e in rows if d is not None and s is not None and s < e]
    want = {(a[3], b[3]) for a in sound for b in sound if a[0] == b[0] and (a[1], a[3]) < (b[1], b[3]) and b[1] < a[2]}
    for listed, cells in ((500, None), (3, 1), (7, 3), (1, 60)):
        monkeypatch.setattr(intervals, "LISTED", listed)
        got = [tuple((first(p[f"{c}_x"]), first(p[f"{c}_y"])) for c in "ab") for p in intervals.overlap_pairs(df, "d", ["x", "y"], cells=cells).collect()]
        assert len(got) == len(want) and set(got) == want


def test_only_days_of_several_cells_are_looked_up(spark):
    # two hundred days of one row beside a crowded one: their rows are not moved to learn their cells
    df = spark.range(1000).selectExpr("cast(id as int) as id", "cast(if(id < 800, 0, id) as int) as d", "cast(id % 50 as int) as s", "cast(id % 50 + 5 as int) as e")
    a, b = intervals._dealt(df, "d", ["id"], 8)
    for side in (a, b):
        tree = side._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Join LeftOuter.*strategy=broadcast", tree) and side.where("d > 0").selectExpr("max(_range)", "max(_a)", "max(_b)").first() == (0, 0, 0)
    assert a.where("d = 0").select("_range", "_a", "_b").distinct().count() > 4
