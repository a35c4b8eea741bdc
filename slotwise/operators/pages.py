"""Whole pages to rows: timetables drawn as a grid of weekdays by hours, and exam calendars of dates by slots.

A page is one row: source, runs, rects and the hints of its layout. Steps that fold stay within the row;
blocks are exploded and meet their columns again as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.binding import let, pin, strip
from slotwise.functions.times import parse_weekday
from slotwise.operators import geometry as geo
from slotwise.operators.outcomes import branch, halt, nothing, problem, rows_of, start
from slotwise.operators.parsers import date_cells, exam_cell_outcomes, semester_from_fill, session_outcomes, slots_from_content, slots_from_label_rects, slots_from_text


SUB_GRID = "struct<label: string, banner: string, x_from: double, x_to: double, label_x0: double, label_x1: double, header: array<string>>"
_TIME = r"\d{1,2}:\d{2}"


def sub_grids(pages: DataFrame) -> DataFrame:
    """(source, label, error, notes, left, right, top, bottom, label_x0, label_x1, _lines, _rects, _runs, rows_from, edges, cols, gaps): the grids that pages hold.

    Pages are (source, runs, rects, label_max_x, rows_from, sub_grids: array of ``SUB_GRID``). With ``x_from`` grids stand
    side by side and share header lines; else each takes the highest header line below its banner (without banners,
    the header lines in order) and reaches down to the next banner. A header line has two printed times or more. Without
    ``sub_grids`` a page is one grid. A grid without a header, or with one that draws none, has an error; a banner
    that is not on the page is a note, and its grid goes by the order of headers.
    """
    one = F.array(F.struct(F.lit("Day").alias("label"), *[F.lit(None).alias(n) for n in ("banner", "x_from", "x_to", "label_x0", "label_x1", "header")]).cast(SUB_GRID))
    page = pin(pages, _lines=geo.group_lines(F.col("runs")), _rects=F.filter("rects", lambda r: geo.is_structural(r["fill"], r["w"], r["h"])))
    banner = lambda g: F.coalesce(F.get(F.filter("runs", lambda r: strip(r["text"]) == strip(g["banner"])), F.lit(0))["y"], F.lit(float("inf")))
    numbered = F.transform(F.coalesce("sub_grids", one), lambda g, k: F.struct((-banner(g)).alias("k1"), k.alias("k2"), g.alias("g")))
    page = pin(page, _headers=F.filter("_lines", lambda x: F.size(F.filter(x["runs"], lambda r: r["text"].rlike(_TIME))) >= 2), _all=F.array_sort(numbered))
    side = F.exists("_all", lambda x: x["g"]["x_from"].isNotNull())
    following = -F.get("_all", F.col("_at") + 1)["k1"]
    rows = page.select("*", side.alias("_side"), F.posexplode("_all").alias("_at", "_s"))
    rows = rows.select(*page.columns, "_side", "_at", (-F.col("_s.k1")).alias("_by"), following.alias("_next"), *[F.col(f"_s.g.{n}").alias(f"_{n}") for n in ("label", "banner", "x_from", "x_to", "label_x0", "label_x1", "header")]).drop("_all")
    within = lambda x: F.struct(x["y"].alias("y"), F.filter(x["runs"], lambda r: (r["x"] >= F.col("_x_from") - 2) & (r["x"] <= F.col("_x_to") + 2)).alias("runs"))
    beside = F.filter(F.transform("_headers", within), lambda x: F.size(x["runs"]) > 0)
    under = F.filter("_headers", lambda x: x["y"] < F.col("_by"))
    own = F.when(F.col("_by") == float("inf"), F.get("_headers", F.col("_at"))).otherwise(F.get(under, F.lit(0)))
    rows = pin(rows, _own=F.when(F.col("_side"), beside).otherwise(F.filter(F.array(own), lambda x: x.isNotNull())))
    printed = F.flatten(F.transform("_own", lambda x: x["runs"]))
    base = F.when(F.col("_side"), F.array_min(F.transform(printed, lambda r: r["y"]))).otherwise(F.get("_own", F.lit(0))["y"])
    rows = pin(rows, _base=base, _min=F.array_min(F.transform(printed, lambda r: r["x"])), _max=F.array_max(F.transform(printed, lambda r: r["x"] + r["w"])))
    band = let(F.when(~F.col("_side"), geo.widest_rect(F.col("_rects"), F.col("_base"))), lambda r: F.struct(F.coalesce("_x_from", r["x"], "_min").alias("x"), F.coalesce("_x_to", r["x"] + r["w"], "_max").alias("to"), F.coalesce(r["y"], F.col("_base") - 3).alias("y")))
    rows = pin(rows, _band=F.array(band["x"], band["to"], band["y"]))
    rows = pin(rows, left=F.get("_band", F.lit(0)), right=F.get("_band", F.lit(1)), top=F.get("_band", F.lit(2)))
    below = F.filter("_rects", lambda r: F.when(F.col("_side"), (r["x"] + r["w"] > F.col("left")) & (r["x"] < F.col("right"))).otherwise(r["y"] < F.col("_base")))
    lowest = F.array_min(F.transform(below, lambda r: r["y"]))
    bottom = F.when(F.col("_side"), F.coalesce(lowest, F.lit(0.0))).when(F.col("_next") < float("inf"), F.col("_next") + 2).otherwise(F.least(lowest, F.lit(0.0)))
    rows = pin(rows, bottom=bottom, _grid=geo.header_grid(F.col("_own"), F.col("left"), F.col("right"), override=F.col("_header")))
    lost = ~F.col("_side") & F.col("_banner").isNotNull() & (F.col("_by") == float("inf"))
    note = problem("warn", "BANNER_NOT_FOUND", F.col("_banner"), F.lit("sub-grid banner text not found; falling back to header order"))
    return rows.select(
        "source", F.col("_label").alias("label"), F.when(F.coalesce(F.size("_own"), F.lit(0)) <= 0, "no header line").otherwise(F.col("_grid.error")).alias("error"), F.array_compact(F.array(F.when(lost, note))).alias("notes"), "left", "right", "top", "bottom",
        F.coalesce("_label_x0", F.lit(0.0)).alias("label_x0"), F.coalesce("_label_x1", F.when(F.col("_side"), F.col("left")).otherwise(F.coalesce("label_max_x", "left"))).alias("label_x1"),
        "_lines", "_rects", F.col("runs").alias("_runs"), "rows_from", F.col("_grid.edges").alias("edges"), F.col("_grid.cols").alias("cols"), F.col("_grid.gaps").alias("gaps"),
    )


def _banded(grids: DataFrame) -> DataFrame:
    """Grids under way, with their row bands (_b) and the weekdays of these (_days)."""
    sound = F.col("error").isNull()
    names = F.filter(F.transform(F.filter("_runs", lambda r: (r["x"] >= F.col("label_x0") - 2) & (r["x"] < F.col("label_x1")) & (r["y"] > F.col("bottom") - 2) & (r["y"] < F.col("top"))), lambda r: F.struct(r["y"].cast("double").alias("y"), parse_weekday(r["text"]).alias("value"))), lambda v: v["value"].isNotNull())
    rows = pin(start(grids, F.when(~sound, problem("error", "HEADER_GRID", F.col("label"), F.col("error")))), _labels=F.when(sound, names))
    bare = F.concat(F.lit("no weekday labels found beside the grid"))
    rows = halt(rows, F.when(F.size("_labels") <= 0, problem("warn", "NO_WEEKDAY_LABELS", F.col("label"), bare)))
    rows = rows.withColumn("_labels", F.when(F.col("_problem").isNull(), F.col("_labels")))
    column = F.filter("_rects", lambda r: (r["x"] >= F.col("label_x0") - 2) & (r["x"] + r["w"] <= F.col("label_x1") + 2) & (r["y"] >= F.col("bottom") - 2) & (r["y"] + r["h"] <= F.col("top") + 2))
    by_text = geo.bands_from_labels(F.transform("_labels", lambda v: v["y"]), F.col("top"), F.col("bottom"))
    ordered = F.transform(F.array_sort(F.transform("_labels", lambda v: F.struct((-v["y"]).alias("k"), v["value"].alias("value")))), lambda s: s["value"])
    rows = rows.withColumn("_by_rect", F.coalesce(F.col("rows_from") == "labelRects", F.lit(False)))
    rows = pin(rows, _b=F.when(F.col("_problem").isNull(), F.when(F.col("_by_rect"), geo.bands_from_rects(column)).otherwise(by_text)))
    named = geo.labels_of_bands(F.col("_b"), F.col("_labels"))
    rows = pin(rows, _named=F.when(F.col("_by_rect") & F.col("_problem").isNull(), F.struct(named["error"].alias("error"), named["values"].alias("values"))))
    wrong = F.when(F.size("_b") < F.size("_labels"), F.concat(F.size("_b").cast("string"), F.lit(" bands for "), F.size("_labels").cast("string"), F.lit(" weekdays"))).otherwise(F.col("_named.error"))
    rows = halt(rows, F.when(F.col("_by_rect") & wrong.isNotNull(), problem("error", "LABEL_RECTS", F.col("label"), wrong)))
    return rows.withColumn("_days", F.when(F.col("_by_rect"), F.col("_named.values")).otherwise(ordered))


_BLOCK = ("source", "label", "band", "weekday", "rects", "edges", "cols", "gaps")


def _grid_blocks(grids: DataFrame) -> DataFrame:
    """The text blocks of grids, under way."""
    rows = _banded(grids)
    narrow = F.array_min(geo.column_widths(F.col("edges")))
    inside = F.filter(F.transform("_lines", lambda x: F.struct(x["y"].alias("y"), F.filter(x["runs"], lambda r: (r["x"] >= F.col("left") - 2) & (r["x"] <= F.col("right") + 2)).alias("runs"))), lambda x: F.size(x["runs"]) > 0)
    sound = F.col("_problem").isNull()
    rows = pin(rows, _inside=F.when(sound, inside), _narrow=F.when(sound, narrow))
    rows = branch(rows, "_band", F.transform("_b", lambda b, k: F.struct(k.alias("k"), b["y0"].alias("y0"), b["y1"].alias("y1"))), F.col("notes"))
    y0, y1 = F.col("_band.y0"), F.col("_band.y1")
    drawn = F.filter("_rects", lambda r: ~geo.is_white(r["fill"]) & (r["y"] + r["h"] > y0 + 1) & (r["y"] < y1 - 1) & (r["x"] + r["w"] > F.col("left") - 2) & (r["x"] < F.col("right") + 2) & (r["w"] > 0.4 * F.col("_narrow")))
    blocks = branch(rows, "x", geo.blocks_in_band(F.col("_inside"), y0, y1, 0.45 * F.col("_narrow")))
    return blocks.select("source", "label", F.col("_band.k").alias("band"), F.get("_days", F.col("_band.k")).alias("weekday"), drawn.alias("rects"), "edges", "cols", "gaps", "x.name", "x.room", "x.centre", "x.width", "x.x_min", "x.y_top", "x.y_bottom", "_problem")


def grid_problems(grids: DataFrame) -> DataFrame:
    """Diagnostics (source, severity, code, subject, detail) of ``sub_grids`` that cannot be read, or have no weekday, or no banner: the other grids are read all the same."""
    return branch(_banded(grids), "_x", F.array().cast("array<int>"), F.col("notes")).select("source", "_problem.*")


def grid_blocks(grids: DataFrame) -> DataFrame:
    """(source, label, weekday, band, name, room, centre, width, x_min, y_top, y_bottom, rects, edges, cols, gaps): the text blocks of ``sub_grids``. Grids that ``grid_problems`` names give none.

    Rows come from the weekday names left of the grid, or (``rows_from`` = ``labelRects``) from the rectangles in their
    column, each with the nearest name; fewer rectangles than names, or names out of order, are an error.
    """
    return _grid_blocks(grids).where("_problem is null").drop("_problem")


def place_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (of bands, told by source, band and label if there is one, with the band's ``rects``) with a, b (columns), span_source and span_margin.

    The first rectangle that has a block's centre within 2 points of its width is the block's. A block alone in its
    rectangle takes the columns that this covers. Several in one take the cheapest ordered, disjoint spans within those
    columns; blocks without a rectangle, or whose rectangle does not snap to columns, those within the widest run of
    columns that nobody has taken (all columns if none is free). How many blocks there are does not matter; where no
    disjoint spans exist each takes its own cheapest, with margin 0.
    """
    return _placed(start(blocks)).where("_problem is null").drop("_problem")


#: Margins below this say that another assignment was nearly as good.
CLEAR_MARGIN = 8.0


def _placed(blocks: DataFrame) -> DataFrame:
    """``place_blocks`` under way: with problems for rectangles that snap to no column and for spans that are nearly a tie."""
    band = [c for c in ("source", "label", "band") if c in blocks.columns]
    around = F.filter(F.transform("rects", lambda r, k: F.struct(k.alias("k"), r["x"].alias("x"), r["w"].alias("w"))), lambda r: (F.col("centre") >= r["x"] - 2) & (F.col("centre") <= r["x"] + r["w"] + 2))
    rows = blocks.withColumn("_k", F.row_number().over(Window.partitionBy(*band).orderBy("centre", "x_min", "name"))).withColumn("_in", F.get(around, F.lit(0)))
    rows = rows.withColumn("_extent", F.when(F.col("_in").isNotNull(), geo.span_of_rect(F.col("_in.x"), F.col("_in.w"), F.col("edges"))))
    group = F.when(F.col("_problem").isNotNull(), -2).when(F.col("_extent").isNotNull(), F.col("_in.k")).otherwise(-1)
    rows = rows.withColumn("_group", group).withColumn("_off", F.when(F.col("_extent").isNull(), F.col("_in.k")))
    others = [c for c in blocks.columns if c not in band]
    members = F.array_sort(F.collect_list(F.struct("_k", "centre", "width", "_off", F.struct(*others).alias("own"))))
    groups = rows.groupBy(*band, "_group").agg(members.alias("m"), F.first("_extent").alias("e"), F.first("edges").alias("edges"), F.first("gaps").alias("gaps"))
    several = (F.col("_group") >= 0) & (F.size("m") > 1)
    groups = groups.withColumn("p", geo.block_spans(F.when(several, F.col("m")), F.col("edges"), F.col("gaps"), F.col("e.a"), F.col("e.b")))
    bands = groups.groupBy(*band).agg(F.array_sort(F.collect_list(F.struct("_group", "m", "e", "p"))).alias("_g"), F.first("edges").alias("_edges"), F.first("gaps").alias("_gaps"))

    def tied(m: Column, p: Column, how: str) -> Column:
        said = F.concat(F.lit(how), F.format_string("%.1f", p["margin"]), F.lit("pt worse"))
        return F.when(p["margin"] < CLEAR_MARGIN, problem("warn", "AMBIGUOUS_SPAN", F.array_join(F.transform(m, lambda x: x["own"]["name"]), " | "), said))

    def placed(m: Column, p: Column, how: str, note: Column) -> Column:
        at = lambda k: F.get(p["spans"], k)
        mine = F.transform(m, lambda x, k: F.struct(x["own"].alias("own"), at(k)["a"].cast("int").alias("a"), at(k)["b"].cast("int").alias("b"), F.lit(how).alias("how"), p["margin"].cast("double").alias("margin")))
        return F.struct(mine.alias("m"), note.alias("note"))

    def drawn(g: Column) -> Column:
        alone = F.struct(F.array(g["e"]).alias("spans"), F.lit(None).cast("double").alias("margin"))
        several = lambda p: placed(g["m"], p, "inferred", tied(g["m"], p, "runner-up span assignment is only "))
        return F.when(F.size(g["m"]) == 1, placed(g["m"], alone, "rect", nothing())).otherwise(several(g["p"]))

    # a band's rectangles first, then what has none in the columns that are left: all within the band's row
    bands = pin(bands, _drawn=F.transform(F.filter("_g", lambda g: g["_group"] >= 0), drawn))
    taken = F.flatten(F.transform(F.flatten(F.transform("_drawn", lambda d: d["m"])), lambda x: F.sequence(x["a"], x["b"])))
    loose = F.flatten(F.transform(F.filter("_g", lambda g: g["_group"] == -1), lambda g: g["m"]))
    bands = pin(bands, _loose=loose, _free=geo.free_span(F.size("_edges") - 1, taken))
    others_said = "unfilled cell(s); runner-up span assignment is only "
    bands = bands.withColumn("_p", geo.block_spans(F.col("_loose"), F.col("_edges"), F.col("_gaps"), F.col("_free.a"), F.col("_free.b")))
    bands = pin(bands, _rest=placed(F.col("_loose"), F.col("_p"), "inferred", tied(F.col("_loose"), F.col("_p"), others_said)))
    off = F.array_sort(F.array_compact(F.array_distinct(F.transform("_loose", lambda x: x["_off"]))))
    snapped = F.transform(off, lambda k: problem("warn", "RECT_SNAP_FAILED", F.array_join(F.transform(F.filter("_loose", lambda x: x["_off"] == k), lambda x: x["own"]["name"]), " | "), F.lit("the rectangle's edges snap to no column; falling back to column inference")))
    stopped = F.flatten(F.transform(F.filter("_g", lambda g: g["_group"] == -2), lambda g: F.transform(g["m"], lambda x: x["own"]["_problem"])))
    notes = F.concat(snapped, F.array_compact(F.transform("_drawn", lambda d: d["note"])), F.array_compact(F.array(F.col("_rest.note"))), stopped)
    out = branch(start(bands), "_x", F.concat(F.flatten(F.transform("_drawn", lambda d: d["m"])), F.col("_rest.m")), notes)
    own = [c for c in blocks.columns if c != "_problem"]
    return out.select(*[c if c in band else F.col(f"_x.own.{c}").alias(c) for c in own], F.col("_x.a").alias("a"), F.col("_x.b").alias("b"), F.col("_x.how").alias("span_source"), F.col("_x.margin").alias("span_margin"), "_problem")


def grid_outcomes(pages: DataFrame, extra_filler: list[str] | None = None) -> DataFrame:
    """(source, kind, row, problem): the sessions of pages of one or more grids (``sub_grids``) and all that went wrong, of one pass.

    A session: label, weekday, room, raw_name, start_min, end_min, elective, validity_label, validity, span_source, span_margin. A printed range stands for the columns' times.
    """
    rows = _placed(_grid_blocks(sub_grids(pages)))
    rows = rows.select("source", "label", "weekday", "room", "name", F.get("cols", F.col("a"))["start_min"].alias("col_start"), F.get("cols", F.col("b"))["end_min"].alias("col_end"), F.col("span_source").alias("drawn"), "span_margin", "_problem")
    return session_outcomes(rows, extra_filler, ["source"])


def parse_grids(pages: DataFrame, extra_filler: list[str] | None = None) -> DataFrame:
    """The sessions of ``grid_outcomes``, by source."""
    return rows_of(grid_outcomes(pages, extra_filler))


def exam_outcomes(pages: DataFrame, extra_filler: list[str] | None = None, *, legend: dict[str, str] | None = None, factor: float = 1.6) -> DataFrame:
    """(source, kind, row, problem): the exams of calendar pages (source, runs, rects, label_max_x, slots_from) and all that went wrong, of one pass.

    The line with most exam dates, two at least, heads the columns: from the later of label_max_x and 20 points left of the first date to the end of the
    header's rectangle (without one, 20 points right of the last date), with the midpoints between dates inside. Runs left of that are labels.
    Times left of label_max_x make the slots: each up to the next (slots_from ``labelTexts``), as high as its content's
    rectangles (``contentRects``), or as the rectangle around its label (``labelRects``). A cell's text is cut where its lines step apart by
    ``factor``; runs of slashes part exams of one cell. ``legend`` gives the semester of a fill. An exam: date, raw_name, start_min, end_min,
    duration_source, slot_start, slot_end, room, semester.
    """
    rows = start(pages.select("source", "runs", "rects", F.coalesce("label_max_x", F.lit(0.0)).alias("label_max_x"), "slots_from"))
    rows = pin(rows, _lines=geo.group_lines(F.col("runs")))
    cells = F.transform("_lines", lambda x: F.struct(x["y"].alias("y"), F.transform(geo.split_by_gaps(x["runs"], 3.0), lambda s: F.struct(geo.line_left(s).alias("x"), (geo.line_right(s) - geo.line_left(s)).alias("w"), geo.line_text(s).alias("text"))).alias("cells")))
    rows = pin(rows, _heads=F.transform(cells, lambda x: F.struct(x["y"].alias("y"), date_cells(x).alias("dates"))))
    best = F.get(F.array_sort(F.transform("_heads", lambda h, k: F.struct((-F.size(h["dates"])).alias("n"), k.alias("k"), h.alias("h")))), F.lit(0))["h"]
    rows = pin(rows, _head=best)
    rows = halt(rows, F.when(F.coalesce(F.size("_head.dates"), F.lit(0)) < 2, problem("error", "NO_DATE_HEADER", None, F.lit("no line with two exam dates"))))
    sound = F.col("_problem").isNull()
    rows = pin(rows, _dates=F.when(sound, F.array_sort(F.transform("_head.dates", lambda d: F.struct(((d["x0"] + d["x1"]) / 2).alias("x"), d["x0"].alias("x0"), d["x1"].alias("x1"), d["date"].alias("date"))))), _top=F.when(sound, F.col("_head.y")))
    structural = F.filter("rects", lambda r: geo.is_structural(r["fill"], r["w"], r["h"]))
    around = geo.widest_rect(structural, F.col("_top"))
    left = F.greatest("label_max_x", F.get("_dates", F.lit(0))["x0"] - 20)
    right = let(around, lambda r: F.coalesce(r["x"] + r["w"], F.element_at("_dates", -1)["x1"] + 20))
    middles = F.transform(F.sequence(F.lit(1), F.size("_dates") - 1), lambda k: (F.get("_dates", k - 1)["x"] + F.get("_dates", k)["x"]) / 2)
    rows = pin(rows, _edges=F.when(sound, F.concat(F.array(left), middles, F.array(right)).cast("array<double>")))
    args = F.col("runs"), F.coalesce("rects", F.array().cast("array<struct<x: double, y: double, w: double, h: double, fill: string>>")), F.col("label_max_x"), F.col("_top")
    how = F.coalesce("slots_from", F.lit("labelTexts"))
    slots = F.when(how == "labelRects", slots_from_label_rects(*args)).when(how == "contentRects", slots_from_content(*args)).otherwise(slots_from_text(args[0], args[2], args[3]))
    rows = pin(rows, _slots=F.when(sound, slots))
    rows = halt(rows, F.when(F.coalesce(F.size("_slots"), F.lit(0)) <= 0, problem("error", "NO_SLOT_ROWS", None, F.lit("no slot rows found"))))
    rows = branch(rows, "_slot", F.col("_slots"))
    rows = branch(rows, "_d", F.transform("_dates", lambda d, k: F.struct(k.alias("k"), d["date"].alias("date"))))
    middle = lambda r: r["x"] + r["w"] / 2
    mine = F.filter(F.transform("_lines", lambda x: F.struct(x["y"].alias("y"), F.filter(x["runs"], lambda r: (middle(r) >= F.get("_edges", F.lit(0))) & (geo.column_of(middle(r), F.col("_edges")) == F.col("_d.k"))).alias("runs"))), lambda x: F.size(x["runs"]) > 0)
    rows = branch(rows, "x", geo.blocks_in_band(mine, F.col("_slot.y0"), F.col("_slot.y1"), 8.0, factor=factor, single=True))
    semester = semester_from_fill(F.col("rects"), F.col("x.centre"), F.col("_slot.y0"), F.col("_slot.y1"), legend) if legend else F.lit(None).cast("string")
    blocks = rows.select("source", F.col("_d.date").alias("date"), F.col("_slot.start_min").alias("slot_start"), F.col("_slot.end_min").alias("slot_end"), F.col("x.room").alias("room"), semester.alias("semester"), F.col("x.name").alias("name"), "_problem")
    return exam_cell_outcomes(blocks, extra_filler, ["source"])


def parse_exam_calendars(pages: DataFrame, extra_filler: list[str] | None = None, *, legend: dict[str, str] | None = None, factor: float = 1.6) -> DataFrame:
    """The exams of ``exam_outcomes``, by source."""
    return rows_of(exam_outcomes(pages, extra_filler, legend=legend, factor=factor))
