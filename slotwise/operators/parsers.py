"""From lines of a page to exam slots, dates, semesters and sessions; and transcribed timetables to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import catalogue, text, times
from slotwise.functions.binding import let, pin, spaced
from slotwise.operators import geometry as geo
from slotwise.operators.outcomes import branch, emit, halt, problem

SLOT_MINUTES = 180


def split_glued_dates(cell: Column) -> Column:
    """A header cell that holds several dates (``MONDAY 11TUESDAY 12``) as an array: cut where a digit meets a capital and a small letter."""
    return F.transform(F.split(cell, r"(?<=\d)(?=\p{Lu}\p{L})"), text.collapse)


def date_cells(line: Column) -> Column:
    """array<struct(x0, x1, date)> of a line's cells (struct(y, cells: array<struct(x, w, text)>)) that are exam dates. A glued cell's dates share its width by their letters."""

    def parts(c: Column) -> Column:
        names = split_glued_dates(c["text"])
        total = F.greatest(F.aggregate(names, F.lit(0), lambda a, n: a + F.length(n)), F.lit(1))
        before = lambda k: F.aggregate(F.slice(names, F.lit(1), k), F.lit(0), lambda a, n: a + F.length(n))
        at = lambda n: (c["x"] + c["w"] * n / total).cast("double")
        return F.transform(names, lambda n, k: F.struct(at(before(k)).alias("x0"), at(before(k) + F.length(n)).alias("x1"), times.parse_exam_date(n).alias("date")))

    return F.filter(F.flatten(F.transform(line["cells"], parts)), lambda d: d["date"].isNotNull())


def date_header(lines: Column) -> Column:
    """array<struct(x, date)> of the line (as ``date_cells`` takes it) with most exam dates, by their middles; of equals the first."""
    found = F.transform(lines, lambda line: F.transform(date_cells(line), lambda d: F.struct(((d["x0"] + d["x1"]) / 2).alias("x"), d["date"].alias("date"))))
    best = F.array_sort(F.transform(found, lambda d, k: F.struct((-F.size(d)).alias("n"), k.alias("k"))))
    return let(found, lambda f: F.get(f, F.try_element_at(best, F.lit(1))["k"]))


#: Slot labels closer than this are one label, however its times are split over runs.
LABEL_GAP = 30.0
_SLOT = "struct<y: double, start_min: int, end_min: int>"


def _times_in(label: Column) -> Column:
    return F.transform(F.regexp_extract_all(label, F.lit(r"(\d{1,2}:\d{2})"), F.lit(1)), times.parse_time)


def slot_labels(runs: Column, right: Column, top: Column) -> Column:
    """array<struct(y, start_min, end_min)> of the labels left of ``right`` and below ``top``, from top to bottom.

    Runs with a time (or a bare ``to`` or dash) within ``LABEL_GAP`` of the one before are one label: its first and
    last time, at the middle of its first and last run. Labels of one time are none.
    """
    mine = F.filter(runs, lambda r: (r["x"] < right) & (r["y"] < top) & r["text"].rlike(spaced(r"(?i)\d{1,2}:\d{2}|^\s*(?:to|-|–)\s*$")))
    ordered = F.array_sort(F.transform(mine, lambda r, k: F.struct((-r["y"]).cast("double").alias("k1"), k.alias("k2"), r["text"].alias("t"))))
    zero = F.array().cast("array<struct<top: double, low: double, t: string>>")

    def step(groups: Column, r: Column) -> Column:
        last, y = F.try_element_at(groups, F.lit(-1)), -r["k1"]
        joins = F.coalesce(last["low"] - y <= LABEL_GAP, F.lit(False))
        grown = F.struct(last["top"].alias("top"), y.alias("low"), F.concat(last["t"], F.lit(" "), r["t"]).alias("t"))
        fresh = F.struct(y.alias("top"), y.alias("low"), r["t"].alias("t"))
        return F.when(joins, F.concat(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(groups, F.array(fresh)))

    found = F.transform(F.aggregate(ordered, zero, step), lambda g: let(_times_in(g["t"]), lambda t: F.when(F.size(t) >= 2, F.struct(((g["top"] + g["low"]) / 2).alias("y"), F.get(t, F.lit(0)).alias("start_min"), F.element_at(t, -1).alias("end_min")).cast(_SLOT))))
    return F.filter(found, lambda s: s.isNotNull())


def slots_from_text(runs: Column, right: Column, top: Column) -> Column:
    """array<struct(y0, y1, start_min, end_min)>: each label's slot, to the midpoints between labels."""
    labels = slot_labels(runs, right, top)
    floor = F.least(F.array_min(F.transform(runs, lambda r: r["y"])), F.lit(0.0))
    bands = geo.bands_from_labels(F.transform(labels, lambda s: s["y"]), top - 5, floor)
    return F.zip_with(bands, labels, lambda b, s: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"), s["start_min"].alias("start_min"), s["end_min"].alias("end_min")))


def slots_from_content(runs: Column, rects: Column, right: Column, top: Column) -> Column:
    """As ``slots_from_text``, but a slot is as high as the rectangles of its content: each band of those has the nearest label, and neighbours of one label are one slot.

    Without rectangles, or where labels and bands do not fit one another, there are none.
    """
    content = F.filter(rects, lambda r: geo.is_structural(r["fill"], r["w"], r["h"]) & (r["h"] > 20) & (r["y"] + r["h"] <= top + 2) & (r["x"] + r["w"] > right))

    def made(bands: Column) -> Column:
        floor = F.array_min(F.transform(bands, lambda b: b["y0"]))
        labels = F.transform(F.filter(slot_labels(runs, right, top), lambda s: s["y"] >= floor - 2), lambda s: F.struct(s["y"].alias("y"), F.struct(s["start_min"].alias("start_min"), s["end_min"].alias("end_min")).alias("value")))
        named = F.zip_with(bands, geo.labels_of_bands(bands, labels)["values"], lambda b, v: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"), v["start_min"].alias("start_min"), v["end_min"].alias("end_min")))
        return F.aggregate(F.filter(named, lambda s: s["start_min"].isNotNull()), F.array().cast("array<struct<y0: double, y1: double, start_min: int, end_min: int>>"), joined)

    def joined(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        same = F.coalesce((last["start_min"] == s["start_min"]) & (last["end_min"] == s["end_min"]), F.lit(False))
        grown = F.struct(F.least(last["y0"], s["y0"]).alias("y0"), F.greatest(last["y1"], s["y1"]).alias("y1"), last["start_min"].alias("start_min"), last["end_min"].alias("end_min"))
        return F.when(same, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(s)))

    return let(geo.bands_from_rects(content), made)


def slots_from_label_rects(runs: Column, rects: Column, right: Column, top: Column) -> Column:
    """As ``slots_from_text``, but a slot is as high as the rectangle that its label stands in; rectangles without two times are none."""
    column = F.filter(rects, lambda r: geo.is_structural(r["fill"], r["w"], r["h"]) & (r["x"] + r["w"] <= right + 2) & (r["y"] + r["h"] < top) & (r["h"] > 20))

    def named(b: Column) -> Column:
        inside = F.array_sort(F.transform(F.filter(runs, lambda r: (r["x"] < right) & (r["y"] >= b["y0"]) & (r["y"] < b["y1"])), lambda r, k: F.struct((-r["y"]).alias("k1"), k.alias("k2"), r["text"].alias("t"))))
        found = _times_in(F.array_join(F.transform(inside, lambda r: r["t"]), " "))
        return let(found, lambda t: F.when(F.size(t) >= 2, F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"), F.get(t, F.lit(0)).alias("start_min"), F.element_at(t, -1).alias("end_min"))))

    return F.filter(F.transform(geo.bands_from_rects(column), named), lambda s: s.isNotNull())


def semester_from_fill(rects: Column, x: Column, y0: Column, y1: Column, legend: dict[str, str]) -> Column:
    """The semester whose colour fills the first rectangle that has x within 2 points of its width and meets the band by more than a point; null without one in the legend."""
    named = F.create_map(*[F.lit(v) for kv in legend.items() for v in kv])
    meeting = F.filter(rects, lambda r: F.coalesce(F.map_contains_key(named, r["fill"]), F.lit(False)) & (x >= r["x"] - 2) & (x <= r["x"] + r["w"] + 2) & (r["y"] + r["h"] > y0 + 1) & (r["y"] < y1 - 1))
    return F.element_at(named, F.get(meeting, F.lit(0))["fill"])


def off_grid(name: Column, start: Column, end: Column) -> Column:
    """The problem of times that are not on the half hour; null where they are, or are null."""
    off = ~(times.on_grid(start) & times.on_grid(end))
    return F.when(off, problem("error", "GRANULARITY", name, F.concat(times.fmt_min(start), F.lit("–"), times.fmt_min(end), F.lit(" is not on 30-minute boundaries"))))


def session_outcomes(blocks: DataFrame, extra_filler: list[str] | None, keys: list[str]) -> DataFrame:
    """Outcomes of named blocks under way (name, room, weekday, col_start, col_end, drawn, span_margin, ``keys`` and others): annotations give way to values.

    A printed range stands for the columns' times; a validity label for its window, and one that has none is a problem. Filler is left out.
    Times off the half hour are an error.
    """
    others = [c for c in blocks.columns if c not in ("name", "col_start", "col_end", "drawn", "span_margin", "_problem", *keys)]
    rows = pin(blocks, _x=text.strip_annotations(F.col("name")))
    rows = rows.where(F.col("_problem").isNotNull() | (text.classify_block(F.col("_x.name"), extra_filler) == "course"))
    first = lambda kinds: F.try_element_at(F.filter("_x.annotations", lambda a: a["kind"].isin(kinds)), F.lit(1))
    printed, label = first(["explicitRange"]), first(["weekRange", "dateRange"])["label"]
    rows = pin(rows, _s=F.coalesce(printed["start_min"], F.col("col_start")), _e=F.coalesce(printed["end_min"], F.col("col_end")), _label=label, _valid=times.resolve_validity(label), _how=F.when(printed.isNotNull(), "explicit").otherwise(F.col("drawn")))
    rows = halt(rows, off_grid(F.col("_x.name"), F.col("_s"), F.col("_e")))
    lost = F.col("_problem").isNull() & F.col("_label").isNotNull() & F.col("_valid").isNull()
    note = problem("warn", "UNRESOLVED_VALIDITY", F.col("_x.name"), F.concat(F.lit("cannot anchor validity label "), F.to_json(F.struct(F.col("_label").alias("l"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("_label").alias("l")))) - 6)))
    row = F.struct(*others, F.col("_x.name").alias("raw_name"), F.col("_s").alias("start_min"), F.col("_e").alias("end_min"), first(["elective", "star"]).isNotNull().alias("elective"), F.col("_label").alias("validity_label"), F.col("_valid").alias("validity"), F.col("_how").alias("span_source"), "span_margin")
    return emit(rows, keys, row, F.array_compact(F.array(F.when(lost, note))))


def exam_cell_outcomes(blocks: DataFrame, extra_filler: list[str] | None, keys: list[str]) -> DataFrame:
    """Outcomes of cells under way (name, date, slot_start, slot_end, ``keys`` and others): a cell with a run of slashes holds several exams, and says so; times by what is printed.

    A printed range outside its slot is a problem; times off the half hour are an error.
    """
    others = [c for c in blocks.columns if c not in ("name", "_problem", *keys)]
    rows = pin(blocks, _parts=F.filter(F.transform(F.split("name", r"/{3,}"), text.collapse), lambda n: n != ""))
    split = problem("info", "CELL_SPLIT_ON_PLACEHOLDER", F.col("name"), F.concat(F.lit("split into "), F.size("_parts").cast("string"), F.lit(" entries on the printed //// divider")))
    rows = branch(rows, "_n", F.col("_parts"), F.array_compact(F.array(F.when(F.col("_problem").isNull() & (F.size("_parts") > 1), split))))
    rows = pin(rows, _x=text.strip_annotations(F.col("_n")))
    rows = rows.where(F.col("_problem").isNotNull() | (text.classify_block(F.col("_x.name"), extra_filler) == "course"))
    rows = pin(rows, _t=catalogue.derive_exam_time(F.col("_x.annotations"), F.col("slot_start"), F.col("slot_end")))
    rows = halt(rows, off_grid(F.col("_x.name"), F.col("_t.start_min"), F.col("_t.end_min")))
    span = lambda a, b: F.concat(times.fmt_min(a), F.lit("–"), times.fmt_min(b))
    outside = problem("warn", "EXPLICIT_OUTSIDE_SLOT", F.col("_x.name"), F.concat(F.lit("printed range "), span(F.col("_t.start_min"), F.col("_t.end_min")), F.lit(" is not inside slot "), span(F.col("slot_start"), F.col("slot_end"))))
    row = F.struct(*others, F.col("_x.name").alias("raw_name"), F.col("_t.start_min").alias("start_min"), F.col("_t.end_min").alias("end_min"), F.col("_t.duration_source").alias("duration_source"), F.col("_t.outside_slot").alias("outside_slot"))
    return emit(rows, keys, row, F.array_compact(F.array(F.when(F.col("_problem").isNull() & F.col("_t.outside_slot"), outside))))


def vision_sessions(docs: DataFrame) -> DataFrame:
    """Sessions of transcribed timetables (grids of rows of blocks); a block without an end runs ``SLOT_MINUTES``; days that are none are left out."""
    grids = docs.select("source", F.inline("grids"))
    rows = grids.select("source", "semester", F.inline("rows"))
    blocks = rows.select("source", "semester", times.parse_weekday(F.col("weekday")).alias("weekday"), F.inline("blocks"))
    start = times.parse_time(F.col("start"))
    return blocks.where("weekday is not null").select("source", "semester", "weekday", text.strip_annotations(F.col("name"))["name"].alias("raw_name"), start.alias("start_min"), F.coalesce(times.parse_time(F.col("end")), start + SLOT_MINUTES).alias("end_min"), "room", F.coalesce("elective", F.lit(False)).alias("elective"))


def vision_exams(docs: DataFrame) -> DataFrame:
    """Exams of transcriptions: a printed end is explicit, a missing one is two hours on."""
    rows = docs.select("source", F.inline("exams"))
    named = rows.withColumn("_x", text.strip_annotations(F.col("name"))).withColumn("_s", times.parse_time(F.col("start"))).withColumn("_e", times.parse_time(F.col("end")))
    timed = named.withColumn("_t", catalogue.derive_exam_time(F.col("_x.annotations"), F.col("_s"), F.col("_s") + SLOT_MINUTES, F.col("_s"), F.col("_e")))
    return timed.select("source", F.col("_x.name").alias("raw_name"), F.to_date("date").alias("date"), "_t.start_min", "_t.end_min", "_t.duration_source", "room")
