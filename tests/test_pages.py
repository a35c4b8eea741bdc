import random
from datetime import date

from pyspark.sql import functions as F

from slotwise.operators import lists, outcomes, pages

RUN, RECT = "array<struct<y: double, x: double, w: double, text: string>>", "array<struct<x: double, y: double, w: double, h: double, fill: string>>"


def test_timetable_page(spark):
    runs = [
        (200.0, 110.0, 60.0, "15:00 - 16:00"), (200.0, 210.0, 60.0, "16:00 - 17:00"), (199.0, 310.0, 60.0, "17:00 - 18:00"),
        (150.0, 10.0, 40.0, "MONDAY"), (100.0, 10.0, 40.0, "Martes"),
        (155.0, 150.0, 100.0, "Big Data *"), (145.0, 160.0, 60.0, "Room 5001"), (150.0, 320.0, 50.0, "Networks (sep-oct)"),
        (102.0, 115.0, 60.0, "Systems (15:30-16:30)"), (100.0, 310.0, 60.0, "Uso extraordinario"), (100.0, 222.0, 30.0, "Holiday"),
    ]
    rects = [(90.0, 135.0, 200.0, 30.0, "#ffcc00"), (90.0, 190.0, 300.0, 20.0, None), (0.0, 0.0, 400.0, 3.0, "#cccccc")]
    df = spark.createDataFrame([("a", runs, rects, "labelTexts", 80.0, None)], f"source string, runs {RUN}, rects {RECT}, rows_from string, label_max_x double, sub_grids array<{pages.SUB_GRID}>")
    got = {r.raw_name: r for r in pages.parse_grids(df, ["^holiday$"]).collect()}
    assert set(got) == {"Big Data", "Networks", "Systems"}
    assert "Holiday" in {r.raw_name for r in pages.parse_grids(df).collect()}
    big, net, sys_ = got["Big Data"], got["Networks"], got["Systems"]
    assert (big.weekday, big.start_min, big.end_min, big.room, big.elective, big.span_source) == (1, 900, 1020, "5001", True, "rect")
    assert (net.start_min, net.end_min, net.span_source, net.validity["from"]) == (1020, 1080, "inferred", date(2026, 9, 1))
    assert (sys_.weekday, sys_.start_min, sys_.end_min, sys_.span_source) == (2, 930, 990, "explicit")


def test_bands_of_many_loose_blocks_get_disjoint_spans(spark):
    edges, r = [float(x) for x in range(0, 70, 10)], random.Random(3)
    rows, want = [], {}
    for page in range(30):
        n, gaps = r.randint(1, 6), r.choice([[], [2]])
        blocks = sorted((float(r.randint(3, 57)) + k / 8, float(r.randint(2, 12 if n > 4 else 24))) for k in range(n))
        cands = []
        for centre, width in blocks:
            spans = [(a, b) for a in range(6) for b in range(a, 6) if not any(a <= g < b for g in gaps) and (b + 1 - a) * 10 >= width * 0.82]
            cands.append(sorted((abs(centre - (a + b + 1) * 5) + max(0.0, width - (b + 1 - a) * 10), a, b) for a, b in spans))
        ways = sorted(disjoint(cands))
        want[str(page)] = (ways[0][1], round(ways[1][0] - ways[0][0], 6) if len(ways) > 1 else None) if ways else ([c[0][1:] for c in cands], 0.0)
        rows += [(str(page), 0, f"n{k}", centre, width, centre, 0.0, 1.0, [], edges, gaps) for k, (centre, width) in enumerate(blocks)]
    df = spark.createDataFrame(rows, f"source string, band int, name string, centre double, width double, x_min double, y_top double, y_bottom double, rects {RECT}, edges array<double>, gaps array<int>")
    got = {}
    for x in sorted(pages.place_blocks(df).collect(), key=lambda x: x.centre):
        got.setdefault(x.source, ([], x.span_margin if x.span_margin is None else round(x.span_margin, 6)))[0].append((x.a, x.b))
    assert got == want
    assert sum(len(s) > 4 and m != 0.0 for s, m in got.values()) > 3


def disjoint(cands, end=-1):
    if not cands:
        return [(0.0, [])]
    return [(c + cost, [(a, b), *rest]) for c, a, b in cands[0] if a > end for cost, rest in disjoint(cands[1:], b)]


EXAM = f"source string, runs {RUN}, rects {RECT}, label_max_x double, slots_from string"


def test_exam_page(spark):
    runs = [
        (200.0, 120.0, 60.0, "MONDAY 11"), (200.0, 220.0, 60.0, "TUESDAY 12"), (150.0, 10.0, 60.0, "9:00 - 12:00"), (100.0, 10.0, 60.0, "15:00 - 18:00"),
        (155.0, 120.0, 60.0, "Big"), (145.0, 120.0, 60.0, "Data"), (150.0, 220.0, 60.0, "A //// B 10:00 h."), (100.0, 125.0, 60.0, "C (15:00-17:00)"),
    ]
    df = spark.createDataFrame([("e", runs, None, 90.0, None)], EXAM)
    got = sorted((r.raw_name, str(r.date), r.start_min, r.end_min, r.duration_source) for r in pages.parse_exam_calendars(df).collect())
    assert got == [("A", "2027-01-12", 540, 660, "slot_default2h"), ("B", "2027-01-12", 600, 720, "start_override_default2h"), ("Big Data", "2027-01-11", 540, 660, "slot_default2h"), ("C", "2027-01-11", 900, 1020, "explicit_range")]


def test_exam_slots_by_rectangles(spark):
    runs = [(200.0, 120.0, 60.0, "MONDAY 11"), (200.0, 220.0, 60.0, "TUESDAY 12"), (150.0, 10.0, 60.0, "9:00 to"), (140.0, 10.0, 60.0, "12:00"), (100.0, 10.0, 60.0, "15:00 - 18:00"), (165.0, 120.0, 60.0, "Big Data"), (125.0, 220.0, 60.0, "Low"), (10.0, 120.0, 60.0, "A legend")]
    rects = [(100.0, 120.0, 100.0, 60.0, "#ffcc00"), (100.0, 80.0, 200.0, 30.0, "#ffcc00"), (5.0, 121.0, 80.0, 58.0, None), (5.0, 81.0, 80.0, 28.0, None)]
    for how in ("contentRects", "labelRects"):
        df = spark.createDataFrame([("e", runs, rects, 90.0, how)], EXAM)
        got = sorted((r.raw_name, str(r.date), r.start_min, r.semester) for r in pages.parse_exam_calendars(df, legend={"#ffcc00": "1S"}).collect())
        assert got == [("Big Data", "2027-01-11", 540, "1S"), ("Low", "2027-01-12", 540, None)]


def test_exam_columns_end_where_the_grid_does(spark):
    # left of the first date less 20 points are labels, however near they stand; the header's rectangle ends the last column
    runs = [(200.0, 120.0, 60.0, "MONDAY 11"), (200.0, 220.0, 60.0, "TUESDAY 12"), (150.0, 10.0, 60.0, "9:00 - 12:00"), (150.0, 92.0, 10.0, "note"), (150.0, 120.0, 60.0, "Big Data"), (150.0, 420.0, 60.0, "Far")]
    df = spark.createDataFrame([("e", runs, [(100.0, 190.0, 400.0, 20.0, "#dddddd")], 90.0, None)], EXAM)
    assert sorted((r.raw_name, str(r.date)) for r in pages.parse_exam_calendars(df).collect()) == [("Big Data", "2027-01-11"), ("Far", "2027-01-12")]
    assert {r.raw_name for r in pages.parse_exam_calendars(df, ["^far$"]).collect()} == {"Big Data"}
    one = spark.createDataFrame([("e", [r for r in runs if r[3] != "TUESDAY 12"], None, 90.0, None)], EXAM)
    assert [(r.kind, r.problem.code) for r in pages.exam_outcomes(one).collect()] == [("problem", "NO_DATE_HEADER")]


def test_pages_without_a_grid_are_problems(spark):
    few = [(1.0, 1.0, 1.0, "x")]
    grids = spark.createDataFrame([("a", few, [], None, 80.0, None), ("b", None, None, None, None, None)], f"source string, runs {RUN}, rects {RECT}, rows_from string, label_max_x double, sub_grids array<{pages.SUB_GRID}>")
    exams = spark.createDataFrame([("a", few, [], 80.0, None), ("b", None, None, None, None)], EXAM)
    bare = grids.withColumn("room", F.lit("R"))
    makers = ((pages.grid_outcomes, grids, "HEADER_GRID"), (pages.exam_outcomes, exams, "NO_DATE_HEADER"), (lists.list_outcomes, bare, "NO_WEEKDAY_HEADER"), (lists.day_grid_outcomes, bare, "NO_WEEKDAY_HEADER"), (lists.calendar_outcomes, bare, "NO_WEEKDAY_HEADER"))
    for outcome, df, code in makers:
        assert sorted((r.source, r.kind, r.problem.code, r.problem.severity) for r in outcome(df).collect()) == [(s, "problem", code, "error") for s in "ab"]


def test_branches_and_notes(spark):
    df = outcomes.start(spark.createDataFrame([("a", [1, 2], None), ("b", [], "odd"), ("c", None, None), ("d", [3], "odd")], "source string, xs array<int>, note string"))
    df = outcomes.halt(df, F.when(F.col("source") == "d", outcomes.problem("error", "BAD", F.col("source"), F.lit("no"))))
    note = F.array_compact(F.array(F.when(F.col("note").isNotNull(), outcomes.problem("info", "ODD", None, F.col("note")))))
    got = outcomes.branch(df, "x", F.col("xs"), note).collect()
    assert sorted(((r.source, r.x or 0, r._problem.code if r._problem else "") for r in got)) == [("a", 1, ""), ("a", 2, ""), ("b", 0, "ODD"), ("d", 0, "BAD"), ("d", 0, "ODD")]
    out = outcomes.emit(df, ["source"], F.when(F.col("source") != "c", F.struct(F.size("xs").alias("n"))), note)
    assert sorted(map(tuple, outcomes.rows_of(out).collect())) == [("a", 2), ("b", 0)]
    assert sorted((r.source, r.code) for r in outcomes.problems_of(out).collect()) == [("b", "ODD"), ("d", "BAD"), ("d", "ODD")]


def test_every_case_is_one_page_read_once(spark):
    # one family's plan scans its pages once, for rows and diagnostics alike
    from slotwise.plans.outcomes import CASES, LAYOUT, PARSERS

    pages_ = spark.createDataFrame([(k, *page) for k, (page, _, _) in enumerate(CASES)], LAYOUT).withColumn("source", F.col("case").cast("string"))
    for family, parse in PARSERS.items():
        plan = parse(pages_.where(F.col("family") == family))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
