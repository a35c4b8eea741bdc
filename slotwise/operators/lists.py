"""Pages whose columns are weekdays or whose cells are days: weekly lists, day-column grids and month calendars.

A page is one row (source, runs and what its layout hints at). Headers are found within the row; each column's
lines are then rows, and what starts and ends an entry is told by windows over a column from top to bottom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.functions.binding import let, pin, strip
from slotwise.functions.catalogue import DEFAULT_EXAM_MINUTES
from slotwise.operators import geometry as geo
from slotwise.operators.outcomes import branch, emit, halt, problem, rows_of, start
from slotwise.operators.parsers import off_grid

#: Points below a line at which what follows is no longer part of its entry.
BODY_GAP = 20.0
_HEADER = "struct<y: double, days: array<struct<x: double, weekday: int>>>"


def _named_days(line: Column) -> Column:
    """array<struct(x, weekday)> of a line's runs that name a weekday, from left to right."""
    days = F.transform(line["runs"], lambda r: F.struct((r["x"] + r["w"] / 2).alias("x"), times.parse_weekday(r["text"]).alias("weekday")))
    return F.array_sort(F.filter(days, lambda d: d["weekday"].isNotNull()))


def weekday_header(lines: Column) -> Column:
    """struct(y, days) of the line (struct(y, runs)) that names most weekdays, the first of equals; null if none names two."""
    found = F.transform(lines, lambda x, k: F.struct((-F.size(_named_days(x))).alias("n"), k.alias("k"), F.struct(x["y"].alias("y"), _named_days(x).alias("days")).cast(_HEADER).alias("h")))
    return let(F.try_element_at(F.array_sort(found), F.lit(1)), lambda b: F.when(b["n"] <= -2, b["h"]))


def _columns(days: Column) -> Column:
    """array<struct(weekday, x0, x1)>: columns to the midpoints between names, the outer ones as wide outward as inward."""
    at = lambda k: F.get(days, k)["x"]
    n = F.size(days)
    left = lambda k: F.when(k == 0, at(k) - (at(k + 1) - at(k)) / 2).otherwise((at(k - 1) + at(k)) / 2)
    right = lambda k: F.when(k == n - 1, at(k) + (at(k) - at(k - 1)) / 2).otherwise((at(k) + at(k + 1)) / 2)
    return F.transform(days, lambda d, k: F.struct(d["weekday"].alias("weekday"), left(k).alias("x0"), right(k).alias("x1")))


def _column_lines(pages: DataFrame, floor: Column) -> DataFrame:
    """(the pages' columns, weekday, at, y, text) under way: the lines of each weekday's column below the header and above ``floor``, words re-spaced and wraps undone."""
    mine = lambda x, c: F.filter(x["runs"], lambda r: (r["x"] + r["w"] / 2 >= c["x0"]) & (r["x"] + r["w"] / 2 < c["x1"]))
    below = F.filter("_lines", lambda x: (x["y"] < F.col("_header.y") - 1) & (x["y"] > floor))
    columns = branch(pages.withColumn("_below", below), "_c", _columns(F.col("_header.days")))
    lines = F.filter(F.transform("_below", lambda x: F.struct(x["y"].alias("y"), mine(x, F.col("_c")).alias("runs"))), lambda x: F.size(x["runs"]) > 0)
    made = geo.unwrap_hyphens(F.transform(lines, lambda x: F.struct(x["y"].alias("y"), geo.spaced_text(x["runs"]).alias("text"))))
    rows = branch(columns, "_l", F.transform(made, lambda x, k: F.struct(k.alias("at"), x["y"].alias("y"), x["text"].alias("text"))))
    return rows.select(*[c for c in pages.columns if not c.startswith("_") and c not in ("runs", "rects")], F.col("_c.weekday").alias("weekday"), "_l.at", "_l.y", "_l.text", "_problem")


def _with_header(pages: DataFrame) -> DataFrame:
    page = start(pages.withColumn("_lines", geo.group_lines(F.col("runs")))).withColumn("_header", weekday_header(F.col("_lines")))
    return halt(page, F.when(F.col("_header").isNull(), problem("error", "NO_WEEKDAY_HEADER", None, F.lit("no line names two weekdays"))))


def _entry_outcomes(entries: DataFrame, keys: list[str], how: str, extra_filler: list[str] | None, room: Column | None = None) -> DataFrame:
    """Outcomes of entries under way (source, ``keys``, _r with start_min and end_min, _text: their lines, _notes); filler is left out, times off the half hour are an error."""
    named = text.strip_annotations(text.collapse(F.array_join(text.name_lines(F.col("_text")), " ")))["name"]
    found = text.extract_room(F.col("_text"))
    rows = pin(entries, _name=named)
    rows = halt(rows, F.when(text.classify_block(F.col("_name"), extra_filler) == "course", off_grid(F.col("_name"), F.col("_r.start_min"), F.col("_r.end_min"))))
    row = F.struct(*keys, F.col("_name").alias("raw_name"), F.col("_r.start_min").alias("start_min"), F.col("_r.end_min").alias("end_min"), (found if room is None else F.coalesce(found, room)).alias("room"), F.lit(how).alias("span_source"))
    return emit(rows, ["source"], F.when((F.size("_text") > 0) & (text.classify_block(F.col("_name"), extra_filler) == "course"), row), F.col("_notes"))


def _quoted(t: Column) -> Column:
    """The text as JSON writes it."""
    whole = F.to_json(F.struct(t.alias("t")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _lines_of(when: Column) -> Column:
    """The texts of a group's lines, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", "text")))), lambda x: x["text"])


def _stopped() -> Column:
    return F.array_compact(F.collect_list("_problem"))


def list_outcomes(pages: DataFrame, extra_filler: list[str] | None = None) -> DataFrame:
    """(source, kind, row, problem): the sessions of pages (source, runs) that list entries under weekdays, and all that went wrong, of one pass.

    An entry starts at a line that is a time range; lines below belong to it. A step of more than ``BODY_GAP`` ends
    the column: what follows is prose, and its lines are counted. A second weekday header ends the page. Lines above the first entry are
    problems. Entries without further lines and filler give nothing. A session: weekday, raw_name, start_min, end_min, room, span_source.
    """
    page = _with_header(pages)
    more = F.filter("_lines", lambda x: (x["y"] < F.col("_header.y") - 3) & (F.size(_named_days(x)) >= 2))
    floor = F.coalesce(F.array_max(F.transform(more, lambda x: x["y"])), F.lit(0.0))
    by = Window.partitionBy("source", "weekday").orderBy("at")
    rows = _column_lines(page, floor).withColumn("_range", times.parse_time_range(F.col("text"))).withColumn("_entry", F.count("_range").over(by))
    ends = F.col("_range").isNull() & (F.col("_entry") > 0) & (F.lag("y").over(by) - F.col("y") > BODY_GAP)
    rows = rows.withColumn("_ends", ends.cast("int")).withColumn("_below", F.coalesce(F.sum("_ends").over(by), F.lit(0)) > 0)
    rows = rows.withColumn("_entry", F.when(F.col("_problem").isNotNull(), -2).when(F.col("_below"), -1).otherwise(F.col("_entry")))
    groups = rows.groupBy("source", "weekday", "_entry").agg(F.max("_range").alias("_r"), F.count("*").alias("_n"), _lines_of(F.col("_range").isNull()).alias("_all"), _stopped().alias("_wrong"))
    stray = F.transform("_all", lambda t: problem("warn", "ENTRY_WITHOUT_TIME", F.concat(F.lit("weekday "), F.col("weekday").cast("string")), F.concat(F.lit("stray line with no entry started: "), _quoted(t))))
    junk = F.array(problem("info", "TABLE_JUNK_IGNORED", F.concat(F.lit("weekday "), F.col("weekday").cast("string")), F.concat(F.col("_n").cast("string"), F.lit(" non-entry line(s) below the table left out"))))
    notes = F.when(F.col("_entry") == -2, F.col("_wrong")).when(F.col("_entry") == -1, junk).when(F.col("_entry") == 0, stray)
    entries = start(groups.withColumn("_notes", notes)).withColumn("_text", F.when(F.col("_entry") > 0, F.col("_all")))
    return _entry_outcomes(entries, ["weekday"], "explicit", extra_filler)


def parse_weekly_lists(pages: DataFrame, extra_filler: list[str] | None = None) -> DataFrame:
    """The sessions of ``list_outcomes``, by source."""
    return rows_of(list_outcomes(pages, extra_filler))


def day_grid_outcomes(pages: DataFrame, extra_filler: list[str] | None = None) -> DataFrame:
    """(source, kind, row, problem): the sessions of pages (source, runs, room) whose weekdays are columns and whose times are printed in each, and all that went wrong.

    A time line gives its slot if it stands within 3 points of a row's label (a run that is a time range), else it is a problem; the lines
    below it, down to the next, are one course. The first line may stand anywhere; a later step of more than
    ``BODY_GAP`` ends the column. Text from the first run with ``concentrated`` on is a note. ``room`` stands where none is printed. A session
    as in ``list_outcomes``.
    """
    page = _with_header(pages)
    labels = F.transform(F.filter("runs", lambda r: (r["y"] < F.col("_header.y") - 1) & r["text"].rlike(r"\d{1,2}:\d{2}")), lambda r: F.struct((-r["y"]).cast("double").alias("k"), times.parse_time_range(r["text"]).alias("r")))
    page = page.withColumn("labels", F.array_sort(F.filter(labels, lambda v: v["r"].isNotNull())))
    page = halt(page, F.when(F.coalesce(F.size("labels"), F.lit(0)) <= 0, problem("error", "NO_TIME_LABELS", None, F.lit("no time-row labels found"))))
    notes = F.filter("runs", lambda r: r["text"].rlike("(?i)concentrated"))
    floor = F.coalesce(F.get(notes, F.lit(0))["y"], F.lit(0.0)) + 2
    by = Window.partitionBy("source", "weekday").orderBy("at")
    rows = _column_lines(page, floor).withColumn("_range", times.parse_time_range(F.col("text"))).withColumn("_entry", F.count("_range").over(by))
    slot = F.get(F.filter("labels", lambda v: F.abs(-v["k"] - F.col("y")) < 3), F.lit(0))["r"]
    within = Window.partitionBy("source", "weekday", "_entry").orderBy("at")
    rows = rows.withColumn("_slot", F.first(F.when(F.col("_range").isNotNull(), slot)).over(within)).withColumn("_k", F.row_number().over(within))
    owned = (F.col("_entry") > 0) & F.col("_slot").isNotNull() & F.col("_range").isNull()
    rows = rows.withColumn("_ends", (owned & (F.col("_k") > 2) & (F.lag("y").over(by) - F.col("y") > BODY_GAP)).cast("int"))
    kept = rows.withColumn("_below", F.coalesce(F.sum("_ends").over(by), F.lit(0))).where("_below = 0").withColumn("_entry", F.when(F.col("_problem").isNotNull(), -2).otherwise(F.col("_entry")))
    groups = kept.groupBy("source", "weekday", "room", "_entry").agg(F.first("_slot").alias("_r"), _lines_of(F.col("_range").isNull()).alias("_all"), F.max(F.when(F.col("_range").isNotNull(), F.col("text"))).alias("_head"), _stopped().alias("_wrong"))
    lost = F.array(problem("warn", "ROW_WITHOUT_LABEL", F.concat(F.lit("weekday "), F.col("weekday").cast("string")), F.concat(F.lit("time line matches no slot row: "), _quoted(F.col("_head")))))
    noted = F.when(F.col("_entry") == -2, F.col("_wrong")).when((F.col("_entry") > 0) & F.col("_r").isNull(), lost)
    entries = start(groups.withColumn("_notes", noted)).withColumn("_text", F.when((F.col("_entry") > 0) & F.col("_r").isNotNull(), F.col("_all")))
    return _entry_outcomes(entries.withColumnRenamed("room", "_room"), ["weekday"], "inferred", extra_filler, F.col("_room"))


def parse_day_grids(pages: DataFrame, extra_filler: list[str] | None = None) -> DataFrame:
    """The sessions of ``day_grid_outcomes``, by source."""
    return rows_of(day_grid_outcomes(pages, extra_filler))


def _calendar_cells(pages: DataFrame, month: int, year: int, extra_filler: list[str] | None) -> DataFrame:
    """Cells of calendars under way: source, date, start_min (null: none is printed), raw_name."""
    weekend = lambda r: strip(r["text"]).rlike("(?i)^(SATURDAY|SUNDAY)$")
    page = start(pages.withColumn("_lines", geo.group_lines(F.col("runs")))).withColumn("_head", F.get(F.filter("_lines", lambda x: F.size(_named_days(x)) >= 5), F.lit(0)))
    page = halt(page, F.when(F.col("_head").isNull(), problem("error", "NO_WEEKDAY_HEADER", None, F.lit("no line names five weekdays"))))
    centres = F.array_sort(F.transform(F.filter("_head.runs", lambda r: times.parse_weekday(r["text"]).isNotNull() | weekend(r)), lambda r: r["x"] + r["w"] / 2))
    middles = F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda k: (F.get("_c", k - 1) + F.get("_c", k)) / 2)
    edges = F.concat(F.array(F.array_min(F.transform("runs", lambda r: r["x"]))), middles, F.array(F.array_max(F.transform("runs", lambda r: r["x"] + r["w"]))))
    page = page.withColumn("_c", F.when(F.col("_head").isNotNull(), centres)).withColumn("_edges", edges.cast("array<double>"))
    column = lambda r: geo.column_of(r["x"] + r["w"] / 2, F.col("_edges"))
    numbers = lambda x: F.transform(F.filter(x["runs"], lambda r: strip(r["text"]).rlike(r"^\d{1,2}$")), lambda r: F.struct(column(r).alias("col"), strip(r["text"]).cast("int").alias("day")))
    weeks = F.filter(F.transform(F.filter("_lines", lambda x: x["y"] < F.col("_head.y")), lambda x: F.struct(x["y"].alias("y"), numbers(x).alias("days"))), lambda w: F.size(w["days"]) >= 5)
    bottom = F.array_min(F.transform("runs", lambda r: r["y"])) - 1
    page = pin(page, _weeks=F.when(F.col("_problem").isNull(), weeks))
    page = halt(page, F.when(F.coalesce(F.size("_weeks"), F.lit(0)) <= 0, problem("error", "NO_DAY_ROWS", None, F.lit("no line has five day numbers"))))
    rows = branch(page, "_week", F.transform("_weeks", lambda w, k: F.struct(w["y"].alias("top"), w["days"].alias("days"), F.coalesce(F.get("_weeks", k + 1)["y"] + 1, bottom).alias("y0"))))
    rows = branch(rows, "_d", F.col("_week.days"))
    inside = F.filter("_lines", lambda x: (x["y"] >= F.col("_week.y0")) & (x["y"] < F.col("_week.top") - 1))
    cell = F.filter(F.transform(inside, lambda x: F.filter(x["runs"], lambda r: column(r) == F.col("_d.col"))), lambda x: F.size(x) > 0)
    rows = rows.withColumn("_cell", F.when(F.col("_problem").isNull(), cell))
    timed = F.filter(F.transform(F.flatten("_cell"), lambda r: times.parse_time(r["text"])), lambda t: t.isNotNull())
    words = F.filter(F.transform("_cell", lambda x: geo.line_text(F.filter(x, lambda r: times.parse_time(r["text"]).isNull()))), lambda t: t != "")
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", F.lit(year), F.lit(month), F.col("_d.day")), "yyyy-MM-dd")
    named = rows.select("source", day.alias("date"), F.get(timed, F.lit(0)).alias("start_min"), text.strip_annotations(text.collapse(F.array_join(text.name_lines(words), " ")))["name"].alias("raw_name"), "_problem")
    return named.where(F.col("_problem").isNotNull() | (text.classify_block(F.col("raw_name"), extra_filler) == "course"))


def _calendar_exam() -> Column:
    return F.struct("date", "raw_name", "start_min", (F.col("start_min") + DEFAULT_EXAM_MINUTES).alias("end_min"), F.lit("slot_default2h").alias("duration_source"))


def calendar_outcomes(pages: DataFrame, extra_filler: list[str] | None = None, *, month: int = times.EXAM_MONTH, year: int = times.EXAM_YEAR) -> DataFrame:
    """(source, kind, row, problem): the exams of calendar pages (source, runs) and all that went wrong, of one pass.

    The first line with five weekdays or more heads seven columns; a line with five numbers or more is a week,
    down to the next. A cell holds one exam: its first time is the start, its other runs the name, its end is assumed.
    Cells without a name are left out; those without a time are problems. An exam: date, raw_name, start_min, end_min, duration_source.
    """
    rows = _calendar_cells(pages, month, year, extra_filler)
    late = F.col("start_min").isNull()
    rows = halt(rows, F.when(late, problem("warn", "CALENDAR_NO_TIME", F.col("raw_name"), F.concat(F.lit("no start time printed in the "), F.coalesce(F.col("date").cast("string"), F.lit("?")), F.lit(" cell")))))
    return emit(halt(rows, off_grid(F.col("raw_name"), F.col("start_min"), F.col("start_min"))), ["source"], _calendar_exam())


def parse_month_calendars(pages: DataFrame, month: int = times.EXAM_MONTH, year: int = times.EXAM_YEAR, extra_filler: list[str] | None = None) -> DataFrame:
    """The exams of ``calendar_outcomes``, by source, and beside them those without a printed time, with null times."""
    return _calendar_cells(pages, month, year, extra_filler).where("_problem is null").select("source", _calendar_exam().alias("x")).select("source", "x.*")
