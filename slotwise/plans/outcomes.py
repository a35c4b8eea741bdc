"""Rows and diagnostics of pages of every family: one page for each part, laid out by one of the cases below, each of which has one thing wrong, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import lists, outcomes, pages
from slotwise.plans import common

RUNS, RECTS = "array<struct<y: double, x: double, w: double, text: string>>", "array<struct<x: double, y: double, w: double, h: double, fill: string>>"
LAYOUT = f"case int, family string, runs {RUNS}, rects {RECTS}, label_max_x double, rows_from string, slots_from string, room string, sub_grids array<{pages.SUB_GRID}>"

Run = tuple[float, float, float, str]
_HOURS: list[Run] = [(900.0, 105.0 + 100 * c, 90.0, f"{9 + c}:00 - {10 + c}:00") for c in range(3)]
_FRAME = [(100.0, 890.0, 300.0, 30.0, "#dddddd"), (100.0, 680.0, 300.0, 10.0, "#ffffff")]
_MONDAY: Run = (800.0, 5.0, 60.0, "MONDAY")
_CELL = (200.0, 785.0, 100.0, 40.0, "#ffcc00")
_DATES: list[Run] = [(200.0, 120.0, 60.0, "MONDAY 11"), (200.0, 220.0, 60.0, "TUESDAY 12")]
_SLOT: Run = (150.0, 10.0, 60.0, "9:00 - 12:00")
_DAYS: list[Run] = [(1000.0, 180.0 + 200 * c, 40.0, d) for c, d in enumerate(("MONDAY", "Martes", "Miércoles", "THURSDAY", "Viernes"))]
_MONTH: list[Run] = [(1000.0, 100.0 * c + 30, 40.0, d) for c, d in enumerate(("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"))]
_NUMBERS: list[Run] = [(900.0, 100.0 * c + 40, 10.0, f"{c + 1}") for c in range(7)]


def _at(y: float, x: float, text: str = "{}", w: float = 60.0) -> Run:
    return float(y), float(x), w, text


def _grid(*runs: Run, rects: tuple = (_CELL,), head: bool = True, day: bool = True, sub: list | None = None, rows_from: str = "labelTexts") -> tuple:
    return "grid", [*(_HOURS if head else []), *([_MONDAY] if day else []), *runs], [*_FRAME, *rects], 95.0, rows_from, None, None, sub


def _exam(*runs: Run, head: int = 2, slots: bool = True, rects: tuple = ()) -> tuple:
    return "exam", [*_DATES[:head], *([_SLOT] if slots else []), *runs], list(rects), 90.0, None, "labelTexts", None, None


def _other(family: str, *runs: Run) -> tuple:
    return family, list(runs), [], None, None, None, "R1", None


#: Each case's page, and what it gives: rows (raw_name, start_min, end_min, weekday, date, semester) and problems (severity, code, subject, detail), with {} for the part's name.
CASES: list[tuple[tuple, list[tuple], list[tuple]]] = [
    (_grid(_at(800, 220)), [("{}", 600, 660, 1, None, None)], []),
    (_grid(_at(800, 220), day=False), [], [("warn", "NO_WEEKDAY_LABELS", "Day", "no weekday labels found beside the grid")]),
    (_grid(_at(800, 170), rects=((140.0, 785.0, 120.0, 40.0, "#ffcc00"),)), [("{}", 540, 660, 1, None, None)], [("warn", "RECT_SNAP_FAILED", "{}", "the rectangle's edges snap to no column; falling back to column inference")]),
    (_grid(_at(800, 145, "{} A"), _at(800, 320, "{} B"), rects=((100.0, 785.0, 300.0, 40.0, "#ffcc00"),)), [("{} A", 540, 600, 1, None, None), ("{} B", 660, 720, 1, None, None)], [("warn", "AMBIGUOUS_SPAN", "{} A | {} B", "runner-up span assignment is only 0.0pt worse")]),
    (_grid(_at(800, 145, "{} A"), _at(800, 320, "{} B"), rects=()), [("{} A", 540, 600, 1, None, None), ("{} B", 660, 720, 1, None, None)], [("warn", "AMBIGUOUS_SPAN", "{} A | {} B", "unfilled cell(s); runner-up span assignment is only 0.0pt worse")]),
    (_grid(_at(800, 220), sub=[("Day", "Morning", None, None, None, None, None)]), [("{}", 600, 660, 1, None, None)], [("warn", "BANNER_NOT_FOUND", "Morning", "sub-grid banner text not found; falling back to header order")]),
    (_grid(_at(800, 220, "{} (abc-xyz)")), [("{}", 600, 660, 1, None, None)], [("warn", "UNRESOLVED_VALIDITY", "{}", 'cannot anchor validity label "abc-xyz"')]),
    (_grid(_at(800, 220, "{} (9:10-10:00)")), [], [("error", "GRANULARITY", "{}", "09:10–10:00 is not on 30-minute boundaries")]),
    (_grid(_at(800, 220), head=False), [], [("error", "HEADER_GRID", "Day", "no header line")]),
    (_grid(_at(800, 220), rows_from="labelRects"), [], [("error", "LABEL_RECTS", "Day", "0 bands for 1 weekdays")]),
    (_exam(_at(150, 120), rects=((100.0, 130.0, 100.0, 40.0, "#ffcc00"),)), [("{}", 540, 660, None, "2027-01-11", "1S")], []),
    (_exam(_at(150, 220, "A {} //// B {}")), [("A {}", 540, 660, None, "2027-01-12", None), ("B {}", 540, 660, None, "2027-01-12", None)], [("info", "CELL_SPLIT_ON_PLACEHOLDER", "A {} //// B {}", "split into 2 entries on the printed //// divider")]),
    (_exam(_at(150, 120, "{} (8:00-10:00)")), [("{}", 480, 600, None, "2027-01-11", None)], [("warn", "EXPLICIT_OUTSIDE_SLOT", "{}", "printed range 08:00–10:00 is not inside slot 09:00–12:00")]),
    (_exam(_at(150, 120), head=1), [], [("error", "NO_DATE_HEADER", None, "no line with two exam dates")]),
    (_exam(_at(150, 120), slots=False), [], [("error", "NO_SLOT_ROWS", None, "no slot rows found")]),
    (_exam(_at(150, 120), _at(150, 92, "left of it", 5.0)), [("{}", 540, 660, None, "2027-01-11", None)], []),
    (_other("list", *_DAYS, _at(950, 150, "9:00 - 10:00"), _at(940, 150)), [("{}", 540, 600, 1, None, None)], []),
    (_other("list", *_DAYS, _at(960, 150, 'Stray "{}"'), _at(950, 150, "9:00 - 10:00"), _at(940, 150)), [("{}", 540, 600, 1, None, None)], [("warn", "ENTRY_WITHOUT_TIME", "weekday 1", 'stray line with no entry started: "Stray \\"{}\\""')]),
    (_other("list", *_DAYS, _at(950, 350, "9:00 - 10:00"), _at(940, 350), _at(900, 350, "Prose"), _at(890, 350, "9:00 - 10:00")), [("{}", 540, 600, 2, None, None)], [("info", "TABLE_JUNK_IGNORED", "weekday 2", "2 non-entry line(s) below the table left out")]),
    (_other("list", _at(950, 150, "9:00 - 10:00"), _at(940, 150)), [], [("error", "NO_WEEKDAY_HEADER", None, "no line names two weekdays")]),
    (_other("days", *_DAYS, _at(900, 150, "9:00 - 11:00"), _at(890, 150)), [("{}", 540, 660, 1, None, None)], []),
    (_other("days", *_DAYS, _at(900, 550, "9:00 - 11:00"), _at(890, 550), _at(860, 350, "12:00 -", 30.0), _at(860, 381, "13:00", 30.0), _at(850, 350, "{} lost")), [("{}", 540, 660, 3, None, None)], [("warn", "ROW_WITHOUT_LABEL", "weekday 2", 'time line matches no slot row: "12:00 - 13:00"')]),
    (_other("days", *_DAYS, _at(890, 150)), [], [("error", "NO_TIME_LABELS", None, "no time-row labels found")]),
    (_other("month", *_MONTH, *_NUMBERS, _at(880, 105), _at(879, 170, "15:00", 25.0)), [("{}", 900, 1020, None, "2027-01-02", None)], []),
    (_other("month", *_MONTH, *_NUMBERS, _at(880, 5)), [], [("warn", "CALENDAR_NO_TIME", "{}", "no start time printed in the 2027-01-01 cell")]),
    (_other("month", *_MONTH, _at(880, 5)), [], [("error", "NO_DAY_ROWS", None, "no line has five day numbers")]),
    (_other("poster", _at(880, 5)), [], [("error", "UNKNOWN_FAMILY", "poster", "no parser reads pages of this family")]),
]

#: The parser of each family.
PARSERS = {
    "grid": lambda p: pages.grid_outcomes(p, ["^holiday$"]), "exam": lambda p: pages.exam_outcomes(p, ["^holiday$"], legend={"#ffcc00": "1S"}),
    "list": lambda p: lists.list_outcomes(p, ["^holiday$"]), "days": lambda p: lists.day_grid_outcomes(p, ["^holiday$"]), "month": lambda p: lists.calendar_outcomes(p, ["^holiday$"]),
}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = spark.createDataFrame([(k, *page) for k, (page, _, _) in enumerate(CASES)], LAYOUT)
    parts = common.parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("source"), "p_name", (F.col("p_partkey") % len(CASES)).cast("int").alias("case"))
    named = F.transform("runs", lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["w"].alias("w"), F.replace(r["text"], F.lit("{}"), F.col("p_name")).alias("text")))
    return parts.join(F.broadcast(layouts), "case").withColumn("runs", named)  # a row a case


def _flat(found: DataFrame, *more: Column) -> DataFrame:
    row = lambda n: F.col(f"row.{n}")
    return found.select(F.col("source").cast("bigint").alias("p_partkey"), "family", "kind", "problem.severity", "problem.code", "problem.subject", "problem.detail", row("raw_name"), row("start_min"), row("end_min"), row("weekday"), row("date").cast("string").alias("date"), row("semester"), *more)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows and diagnostics of every page, by the parser of its family."""
    return _flat(outcomes.dispatch(_pages(spark, sf_dir), "family", PARSERS))


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page fared: numbers of rows, errors and warnings, and whether it counts as parsed."""
    found = outcomes.failed_sources(outcomes.dispatch(_pages(spark, sf_dir), "family", PARSERS))
    return found.select(F.col("source").cast("bigint").alias("p_partkey"), "rows", "errors", "warnings", "status")


QUERIES = {f.__name__: f for f in (page_outcomes, source_status)}


def _sql() -> str:
    quote = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = []
    for k, (page, good, bad) in enumerate(CASES):
        rows += [(k, page[0], "row", None, None, None, None, *r) for r in good] + [(k, page[0], "problem", *p, None, None, None, None, None, None) for p in bad]
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    named = lambda c: f"replace({c}, '{{}}', p_name) as {c}"
    return f"""select p_partkey, family, kind, severity, code, {named('subject')}, {named('detail')}, {named('raw_name')}, start_min::int as start_min, end_min::int as end_min, weekday::int as weekday, date, semester
 from part join (values {values}) e(k, family, kind, severity, code, subject, detail, raw_name, start_min, end_min, weekday, date, semester) on p_partkey % {len(CASES)} = k"""


ORACLE_SQL = {
    "page_outcomes": _sql(),
    "source_status": f"select p_partkey, count(*) filter (where kind = 'row') as rows, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warn') as warnings, case when count(*) filter (where severity = 'error') > 0 then 'failed' else 'parsed' end as status from ({_sql()}) group by p_partkey",
}
