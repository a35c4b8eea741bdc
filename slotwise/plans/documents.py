"""Queries that read whole pages. The pages are drawn from the parts, ten or some more to a page, so that SQL can tell what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import geometry, lists, pages, parsers
from slotwise.plans.common import parts, table

RUN = "struct<y: double, x: double, w: double, text: string>"
RECT = "struct<x: double, y: double, w: double, h: double, fill: string>"
DAYS = ("MONDAY", "Martes", "Miércoles", "THURSDAY", "Viernes", "SATURDAY", "SUNDAY")


def _run(y: Column, x: Column, w: float, text: Column) -> Column:
    return F.struct(y.cast("double").alias("y"), x.cast("double").alias("x"), F.lit(w).alias("w"), text.alias("text")).cast(RUN)


def _fixed(rows: list[tuple[float, float, float, str]]) -> Column:
    return F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(w).alias("w"), F.lit(t).alias("text")) for y, x, w, t in rows]).cast(f"array<{RUN}>")


def _only(when: Column, *runs: Column) -> Column:
    return F.when(when, F.array(*runs)).otherwise(F.array().cast(f"array<{RUN}>"))


def _pages(rows: DataFrame, runs: Column, header: Column) -> DataFrame:
    """(page, runs): each page's header and what its parts print."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks as asked for: few bytes of a page are long to read
    return rows.withColumn("_r", runs).repartition(tasks, "page").groupBy("page").agg(F.concat(header, F.flatten(F.collect_list("_r"))).alias("runs"))


def _ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, ten to a page: a weekday's column and a place in it, upper or lower."""
    k = F.col("p_partkey") % 10
    return table(spark, sf_dir, "part").select("p_name", "p_size", F.floor(F.col("p_partkey") / 10).alias("page"), (k % 5).alias("col"), F.floor(k / 5).alias("i"), F.split("p_name", " ").alias("w"))


def _clock(m: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))


_REST = "array_join(slice(w, 2, size(w)), ' ')"
WEEKDAY_HEADER = [(1000.0, 180.0 + 200 * c, 40.0, DAYS[c]) for c in range(5)]


def weekly_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists under weekdays: words in runs of their own, wrapped names, prose and a ghost entry below the table, filler."""
    p = _ten(spark, sf_dir)
    x, y, size = F.lit(150) + 200 * F.col("col"), F.lit(950) - 70 * F.col("i"), F.col("p_size")
    start = F.lit(540) + 30 * (size % 10)
    name = F.when(size % 11 == 0, "Uso").otherwise(F.col("w")[0]), F.when(size % 11 == 0, "extraordinario").otherwise(F.expr(_REST))
    wrapped = (size % 4 == 0) & (size % 11 != 0)
    runs = F.concat(
        F.array(_run(y, x, 60.0, F.concat(_clock(start), F.lit(" - "), _clock(start + 60))), _run(y - 10, x, 30.0, name[0]), _run(y - 10, x + 31, 60.0, name[1])),
        _only(wrapped, _run(y - 20, x, 30.0, F.lit("tail- ")), _run(y - 30, x, 30.0, F.lit("24"))),
        _only(size % 3 != 0, _run(y - F.when(wrapped, 40).otherwise(20), x, 40.0, F.concat(F.lit("Room "), size.cast("string")))),
        _only(F.col("i") == 1, _run(y - 80, x, 90.0, F.lit("Prose that shares the column")), _run(y - 90, x, 60.0, F.lit("9:00 - 10:00")), _run(y - 100, x, 60.0, F.lit("Ghost"))),
    )
    made = _pages(p, runs, _fixed(WEEKDAY_HEADER)).withColumn("source", F.col("page").cast("string"))
    return lists.parse_weekly_lists(made).select(F.col("source").cast("bigint").alias("page"), "weekday", "raw_name", "start_min", "end_min", "room")


def day_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids whose weekdays are columns: times printed in each, one room for all, a note below."""
    p = _ten(spark, sf_dir)
    x, y, size = F.lit(150) + 200 * F.col("col"), F.lit(900) - 100 * F.col("i"), F.col("p_size")
    first = y - F.when(size % 2 == 0, 30).otherwise(10)
    label = F.when(F.col("i") == 0, "9:00 - 11:00").otherwise("7:00 PM - 9:00 PM")
    runs = F.concat(F.array(_run(y, x, 60.0, label), _run(first, x, 30.0, F.col("w")[0]), _run(first - 10, x, 60.0, F.expr(_REST))), _only(size % 3 == 0, _run(first - 20, x, 40.0, F.concat(F.lit("Aula "), size.cast("string")))))
    notes = _fixed([*WEEKDAY_HEADER, (600.0, 160.0, 90.0, "In concentrated form:"), (590.0, 160.0, 60.0, "9:00 - 10:00"), (580.0, 160.0, 60.0, "Ghost")])
    made = _pages(p, runs, notes).select(F.col("page").cast("string").alias("source"), "runs", F.concat(F.lit("R"), F.col("page").cast("string")).alias("room"))
    return lists.parse_day_grids(made).select(F.col("source").cast("bigint").alias("page"), "weekday", "raw_name", "start_min", "end_min", "room")


def month_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendars of 28 days, each with the exam of a part: the time beside the name's first word, or none."""
    d = F.col("p_partkey") % 28
    p = table(spark, sf_dir, "part").select("p_size", F.floor(F.col("p_partkey") / 28).alias("page"), d.alias("d"), F.split("p_name", " ").alias("w"))
    x, y = F.lit(0) + 100 * (F.col("d") % 7), F.lit(880) - 100 * F.floor(F.col("d") / 7)
    start = F.lit(540) + 30 * (F.col("p_size") % 10)
    runs = F.concat(F.array(_run(y, x + 5, 40.0, F.col("w")[0]), _run(y - 10, x + 5, 70.0, F.expr(_REST))), _only(F.col("p_size") % 5 != 0, _run(y - 1, x + 60, 30.0, _clock(start))))
    head = _fixed([(1000.0, 100.0 * c + 30, 40.0, DAYS[c]) for c in range(7)] + [(900.0 - 100 * (k // 7), 100.0 * (k % 7) + 40, 10.0, f" {k + 1}") for k in range(28)])
    made = _pages(p, runs, head).withColumn("source", F.col("page").cast("string"))
    return lists.parse_month_calendars(made).select(F.col("source").cast("bigint").alias("page"), "date", "raw_name", "start_min", "end_min")


def slot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of two labels, told by their text, by the rectangles of their content (of which one is cut in two) and by those around the labels; and a fill's semester."""
    up = (F.col("p_size") * 1.0).alias("up")
    label = lambda y, t: _run(F.lit(y) + F.col("up"), F.lit(20), 40.0, F.lit(t))
    rect = lambda x, y, w, h, fill=None: F.struct(F.lit(x).alias("x"), (F.lit(y) + F.col("up")).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(fill).cast("string").alias("fill")).cast(RECT)
    split = F.when(F.col("p_partkey") % 3 == 0, F.array(label(400.0, "10:00 - 13:00"))).when(F.col("p_partkey") % 3 == 1, F.array(label(405.0, "10:00 to"), label(395.0, "13:00"))).otherwise(F.array(label(410.0, "10:00"), label(400.0, "to"), label(390.0, "13:00")))
    p = parts(spark, sf_dir).select("p_partkey", up).withColumn("p_partkey", F.col("p_partkey"))
    p = p.withColumn("runs", F.concat(split, F.array(label(200.0, "15:00 - 18:00"), _run(F.lit(0.0), F.lit(300), 9.0, F.lit("legend")))))
    p = p.withColumn("rects", F.array(rect(100.0, 350.0, 300.0, 100.0, "#ffcc00"), rect(100.0, 200.0, 300.0, 50.0, "#00ccff"), rect(100.0, 150.0, 300.0, 50.0), rect(0.0, 340.0, 80.0, 120.0), rect(0.0, 140.0, 80.0, 120.0)))
    args = F.col("runs"), F.col("rects"), F.lit(90.0), F.lit(470.0) + F.col("up")
    shown = lambda slots: F.array_join(F.transform(slots, lambda s: F.format_string("%.1f-%.1f %d-%d", s["y0"], s["y1"], s["start_min"], s["end_min"])), ";")
    sem = parsers.semester_from_fill(F.col("rects"), F.lit(399.0) + F.col("p_partkey") % 5, F.lit(230.0) + F.col("up"), F.lit(300.0) + F.col("up"), {"#ffcc00": "1S", "#00ccff": "3S"})
    return p.select("p_partkey", shown(parsers.slots_from_text(args[0], args[2], args[3])).alias("by_text"), shown(parsers.slots_from_content(*args)).alias("by_content"), shown(parsers.slots_from_label_rects(*args)).alias("by_label"), sem.alias("semester"))


def _grid_page(spark: SparkSession, sf_dir: str, side: bool) -> DataFrame:
    """A page for each part with two grids of three hours, a course in each, side by side or one above the other."""
    p, left = parts(spark, sf_dir), F.lit(0.0)
    k = (F.col("p_partkey") % 3).cast("int")
    runs, rects, subs = [], [], []
    for g, (name, first) in enumerate((("Morning", 9), ("Evening", 15))):
        x0, y0 = (100.0 + 500 * g, 0.0) if side else (100.0, -300.0 * g)
        corrupt = [f"{first + (0 if g else min(c, 1))}:00 - {first + (1 if g else min(c, 1) + 1)}:00" for c in range(3)]
        labels = [f"{first + c}:00 - {first + c + 1}:00" for c in range(3)]
        runs += [_run(F.lit(900.0 + y0), F.lit(x0 + 5 + 100 * c), 90.0, F.lit(corrupt[c])) for c in range(3)]
        runs += [_run(F.lit(800.0 + y0 - 50 * d), F.lit(x0 - 95), 60.0, F.lit(DAYS[d])) for d in range(3)]
        runs += [_run(F.lit(950.0 + y0), F.lit(x0), 60.0, F.lit(name + " "))] if not side else []
        runs += [_run(F.lit(800.0 + y0) - 50 * k, F.lit(x0 + 20) + 100 * k, 60.0, F.concat("p_name", F.lit(f" {name}")))]
        rects += [F.struct(F.lit(x0).alias("x"), F.lit(890.0 + y0).alias("y"), F.lit(300.0).alias("w"), F.lit(30.0).alias("h"), F.lit("#dddddd").alias("fill"))]
        rects += [F.struct(F.lit(x0 - 98).alias("x"), F.lit(780.0 + y0 - 50 * d).alias("y"), F.lit(70.0).alias("w"), F.lit(48.0).alias("h"), F.lit("#eeeeee").alias("fill")) for d in range(3)]
        rects += [F.struct(F.lit(x0).alias("x"), F.lit(680.0 + y0).alias("y"), F.lit(300.0).alias("w"), F.lit(10.0).alias("h"), F.lit("#ffffff").alias("fill"))]
        wide = F.when(F.col("p_size") % 2 == 0, F.least(k, F.lit(1))).otherwise(k)  # every other course is drawn over two hours
        rects += [F.struct((F.lit(x0) + 100 * wide).alias("x"), (F.lit(785.0 + y0) - 50 * k).alias("y"), F.when(F.col("p_size") % 2 == 0, 200.0).otherwise(100.0).alias("w"), F.lit(40.0).alias("h"), F.lit("#ffcc00").alias("fill"))]
        window = (F.lit(x0), F.lit(x0 + 300.0), F.lit(x0 - 100), F.lit(x0)) if side else (F.lit(None),) * 4
        subs += [F.struct(F.lit(name).alias("label"), F.lit(None if side else name).alias("banner"), *[v.cast("double").alias(n) for v, n in zip(window, ("x_from", "x_to", "label_x0", "label_x1"), strict=True)], F.array(*map(F.lit, labels)).alias("header")).cast(pages.SUB_GRID)]
    return p.select(F.col("p_partkey").cast("string").alias("source"), F.array(*runs).alias("runs"), F.array(*[r.cast(RECT) for r in rects]).alias("rects"), left.cast("double").alias("label_max_x") if side else F.lit(100.0).alias("label_max_x"), F.lit("labelRects" if side else "labelTexts").alias("rows_from"), F.array(*subs).alias("sub_grids"))


def sub_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two grids with corrupt headers that are overridden: side by side, with rows by rectangles, and stacked under banners."""
    out = None
    for side in (True, False):
        rows = pages.parse_grids(_grid_page(spark, sf_dir, side)).select(F.lit(side).alias("side"), F.col("source").cast("bigint").alias("p_partkey"), "label", "weekday", "raw_name", "start_min", "end_min", "span_source")
        out = rows if out is None else out.union(rows)
    return out


def nested_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of pages that save and restore their matrix: doubled and moved, turned by a quarter within that, and as before behind it."""
    size = F.col("p_size").cast("double")
    op = lambda name, *args: F.struct(F.lit(name).alias("op"), F.array(*[(a if isinstance(a, Column) else F.lit(float(a))) for a in args]).cast("array<double>").alias("args"))
    ops = [op("transform", 1, 0, 0, 1, 10, 20), op("save"), op("transform", 2, 0, 0, 2, size, 0), op("box", 1, 2, 3, 4), op("save"), op("transform", 0, 1, -1, 0, 0, 0), op("box", 1, 0, 2, 1), op("restore"), op("box", 0, 0, 1, 1), op("restore"), op("restore"), op("stroke"), op("box", 5, size, 1, 1)]
    drawn = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(geometry.drawn_boxes(F.array(*ops))).alias("n", "b"))
    return drawn.select("p_partkey", F.col("n").cast("int").alias("n"), "b.x", "b.y", "b.w", "b.h")


BAND_COLUMNS = 11


def band_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of two blocks in one rectangle, one in its own, and three to six loose ones that get the free columns."""
    p, size, key = parts(spark, sf_dir), F.col("p_size"), F.col("p_partkey")
    loose = lambda k: F.lit(165) + (key * 37 + k * 61) % 270
    centres = [F.lit(10) + size * 3 % 40, F.lit(60) + size * 7 % 50, F.lit(140)] + [loose(k) for k in range(6)]
    block = lambda k, c: F.struct(F.lit(f"n{k}").alias("name"), c.cast("double").alias("centre"), (F.lit(10) + size * (k + 1) % 30).cast("double").alias("width"))
    blocks = F.slice(F.array(*[block(k, c) for k, c in enumerate(centres)]), F.lit(1), (6 + key % 4).cast("int"))
    rects = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(w).alias("w"), F.lit(30.0).alias("h"), F.lit("#ffcc00").alias("fill")) for x, w in ((1.0, 118.0), (121.0, 38.0))])
    rows = p.select(key.cast("string").alias("source"), F.lit(0).alias("band"), rects.alias("rects"), F.array(*[F.lit(40.0 * k) for k in range(BAND_COLUMNS + 1)]).alias("edges"), F.array(F.lit(6)).alias("gaps"), F.explode(blocks).alias("b"))
    placed = pages.place_blocks(rows.select("source", "band", "rects", "edges", "gaps", "b.*", F.col("b.centre").alias("x_min"), F.lit(1.0).alias("y_top"), F.lit(0.0).alias("y_bottom")))
    return placed.select(F.col("source").cast("bigint").alias("p_partkey"), "name", "a", "b", "span_source", F.round("span_margin", 6).alias("margin"))


QUERIES = {f.__name__: f for f in (weekly_lists, day_grids, month_calendars, slot_rows, sub_grids, band_spans, nested_boxes)}
_TEN = "with p as (select p_name, p_size, p_partkey // 10 as page, cast(p_partkey % 10 % 5 + 1 as int) as weekday, (p_partkey % 10) // 5 as i from part)"
_GRID = """select {side} as side, p_partkey, label, cast(k + 1 as int) as weekday, p_name || ' ' || label as raw_name,
 cast(first * 60 + 60 * a as int) as start_min, cast(first * 60 + 60 * (b + 1) as int) as end_min, 'rect' as span_source
 from (select p_partkey, p_name, k, case when p_size % 2 = 0 then least(k, 1) else k end as a, case when p_size % 2 = 0 then least(k, 1) + 1 else k end as b from (select *, p_partkey % 3 as k from part)), (values ('Morning', 9), ('Evening', 15)) v(label, first)"""
_SPANS = """b as (select p_partkey, k, case k when 0 then 10 + p_size * 3 % 40 when 1 then 60 + p_size * 7 % 50 when 2 then 140 else 165 + (p_partkey * 37 + (k - 3) * 61) % 270 end::double as centre, (10 + p_size * (k + 1) % 30)::double as width, case when k < 2 then 0 when k = 2 then 1 else 2 end as g from part, range(9) t(k) where k < 6 + p_partkey % 4),
 o as (select *, row_number() over (partition by p_partkey, g order by centre, k) as i, count(*) over (partition by p_partkey, g) as n from b where g <> 1),
 s as (select g, a.k as a, b.k as b, (a.k + b.k + 1) * 20.0 as mid, (b.k + 1 - a.k) * 40.0 as w from (values (0, 0, 2), (2, 4, 10)) e(g, lo, hi), range(11) a(k), range(11) b(k) where a.k between lo and hi and b.k between a.k and hi and not (a.k <= 6 and b.k > 6)),
 c as (select p_partkey, o.g, i, n, o.k, a, b, abs(centre - mid) + greatest(0, width - w) as cost from o join s using (g) where w >= width * 0.82),
 walk as (select p_partkey, g, i, n, b as last, cost, [struct_pack(k := k, a := a, b := b)] as spans, lpad(a::varchar, 2, '0') || lpad(b::varchar, 2, '0') as t from c where i = 1 union all select c.p_partkey, c.g, c.i, c.n, c.b, walk.cost + c.cost, list_append(spans, struct_pack(k := k, a := a, b := b)), t || lpad(a::varchar, 2, '0') || lpad(b::varchar, 2, '0') from walk join c on c.p_partkey = walk.p_partkey and c.g = walk.g and c.i = walk.i + 1 and c.a > last),
 r as (select *, row_number() over w as place, lead(cost) over w - cost as margin from walk where i = n window w as (partition by p_partkey, g order by cost, t))"""
ORACLE_SQL = {
    "weekly_lists": f"{_TEN} select page, weekday, p_name || case when p_size % 4 = 0 then ' tail-24' else '' end as raw_name, cast(540 + 30 * (p_size % 10) as int) as start_min, cast(600 + 30 * (p_size % 10) as int) as end_min, case when p_size % 3 <> 0 then p_size::varchar end as room from p where p_size % 11 <> 0",
    "day_grids": f"{_TEN} select page, weekday, p_name as raw_name, case when i = 0 then 540 else 1140 end as start_min, case when i = 0 then 660 else 1260 end as end_min, case when p_size % 3 = 0 then p_size::varchar else 'R' || page end as room from p",
    "month_calendars": "select p_partkey // 28 as page, date '2027-01-01' + cast(p_partkey % 28 as int) as date, p_name as raw_name, case when p_size % 5 <> 0 then cast(540 + 30 * (p_size % 10) as int) end as start_min, case when p_size % 5 <> 0 then cast(660 + 30 * (p_size % 10) as int) end as end_min from part",
    "slot_rows": "select p_partkey, printf('%.1f-%.1f 600-780;%.1f-%.1f 900-1080', 300.0 + p_size, 465.0 + p_size, 0.0, 300.0 + p_size) as by_text, printf('%.1f-%.1f 600-780;%.1f-%.1f 900-1080', 350.0 + p_size, 450.0 + p_size, 150.0 + p_size, 250.0 + p_size) as by_content, printf('%.1f-%.1f 600-780;%.1f-%.1f 900-1080', 340.0 + p_size, 460.0 + p_size, 140.0 + p_size, 260.0 + p_size) as by_label, case when p_partkey % 5 < 4 then '3S' end as semester from part",
    "nested_boxes": "select p_partkey, n::int as n, x::double as x, y::double as y, w::double as w, h::double as h from part, lateral (values (0, 12.0 + p_size, 24.0, 6.0, 8.0), (1, 8.0 + p_size, 22.0, 2.0, 4.0), (2, 10.0 + p_size, 20.0, 2.0, 2.0), (3, 15.0, 20.0 + p_size, 1.0, 1.0)) v(n, x, y, w, h)",
    "sub_grids": _GRID.format(side="true") + " union all " + _GRID.format(side="false"),
    "band_spans": f"with recursive {_SPANS} select p_partkey, 'n' || x.k as name, cast(x.a as int) as a, cast(x.b as int) as b, 'inferred' as span_source, round(margin, 6) as margin from (select p_partkey, unnest(spans) as x, margin from r where place = 1) union all select p_partkey, 'n2', 3, 3, 'rect', null from part",
}
