"""From positioned text and rectangles to tables: lines, bands, grids, spans and blocks.

A page's runs (x, y, w, text) and rectangles (x, y, w, h, fill) are arrays of one row, so an order-dependent
rule is a fold over a sorted array; where a rule only looks at neighbours it is a window over rows.
The y axis points up; bands are struct(y0, y1).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.binding import let, spaced
from slotwise.functions.text import collapse, extract_room, name_lines
from slotwise.functions.times import parse_time_range

BAND = "struct<y0: double, y1: double>"
Y_TOLERANCE, OVERLAP, WIDTH_TOLERANCE = 2.0, 0.8, 0.18


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def is_structural(fill: Column, w: Column, h: Column) -> Column:
    """A rectangle that is part of the table: not black, no hairline."""
    return ~(F.coalesce(fill == "#000000", F.lit(False)) | (w < 6) | (h < 6))


def is_white(fill: Column) -> Column:
    return fill.isNull() | (F.lower(fill) == "#ffffff")


def transform_box(m: list[Column], x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y, w, h): a box under the matrix (a, b, c, d, e, f), as the box around its corners."""
    a, b, c, d, e, f = m
    xs = [a * px + c * py + e for px in (x, x + w) for py in (y, y + h)]
    ys = [b * px + d * py + f for px in (x, x + w) for py in (y, y + h)]
    return F.struct(F.least(*xs).alias("x"), F.least(*ys).alias("y"), (F.greatest(*xs) - F.least(*xs)).alias("w"), (F.greatest(*ys) - F.least(*ys)).alias("h"))


def compose(m: list[Column], n: list[Column]) -> list[Column]:
    """The matrix that applies ``n`` and then ``m``."""
    return [m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5]]


DRAWING = "struct<op: string, args: array<double>>"
BOX = "struct<x: double, y: double, w: double, h: double>"
_DRAWN = f"struct<m: array<double>, stack: array<array<double>>, out: array<{BOX}>>"


def drawn_boxes(ops: Column) -> Column:
    """array<struct(x, y, w, h)>: the boxes that a page's drawing operators (``DRAWING``, in order) put on it, each under the matrix of its time.

    ``save`` keeps the matrix on a stack, ``restore`` takes it back (with nothing kept it does nothing), ``transform`` (six numbers) applies before
    what holds, ``box`` (x, y, w, h) draws. Other operators, and those with too few numbers, are passed over.
    """
    arg = lambda o, k: F.get(o["args"], F.lit(k))

    def step(acc: Column, o: Column) -> Column:
        m = [F.get(acc["m"], F.lit(k)) for k in range(6)]
        state = lambda now, stack, out: F.struct(now.alias("m"), stack.alias("stack"), out.alias("out")).cast(_DRAWN)
        n = F.size(o["args"])
        moved = state(F.array(*compose(m, [arg(o, k) for k in range(6)])), acc["stack"], acc["out"])
        kept = state(acc["m"], F.concat(acc["stack"], F.array(acc["m"])), acc["out"])
        back = state(F.element_at(acc["stack"], -1), _but_last(acc["stack"]), acc["out"])
        box = state(acc["m"], acc["stack"], F.concat(acc["out"], F.array(transform_box(m, *[arg(o, k) for k in range(4)]).cast(BOX))))
        return F.when(o["op"] == "save", kept).when((o["op"] == "restore") & (F.size(acc["stack"]) > 0), back).when((o["op"] == "transform") & (n >= 6), moved).when((o["op"] == "box") & (n >= 4), box).otherwise(acc)

    def block(acc: Column, some: Column) -> Column:
        zero = F.struct(acc["m"].alias("m"), acc["stack"].alias("stack"), F.array().cast(f"array<{BOX}>").alias("out")).cast(_DRAWN)
        return let(F.aggregate(some, zero, step), lambda x: F.struct(x["m"].alias("m"), x["stack"].alias("stack"), F.concat(acc["out"], x["out"]).alias("out")).cast(_DRAWN))

    start = F.struct(F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]).alias("m"), F.array().cast("array<array<double>>").alias("stack"), F.array().cast(f"array<{BOX}>").alias("out")).cast(_DRAWN)
    return F.aggregate(_blocks(ops), start, block, lambda x: x["out"])


RUN = "struct<y: double, x: double, w: double, text: string>"
LINE = f"struct<y: double, runs: array<{RUN}>>"


def _run(r: Column) -> Column:
    return F.struct(r["y"].cast("double").alias("y"), r["x"].cast("double").alias("x"), r["w"].cast("double").alias("w"), r["text"].cast("string").alias("text"))


def _by_x(runs: Column) -> Column:
    return F.transform(F.array_sort(F.transform(runs, lambda r, k: F.struct(r["x"].alias("k1"), k.alias("k2"), _run(r).alias("r")))), lambda s: s["r"])


#: Values that one fold goes over: a fold copies all that it has gathered at each step, so a long array is folded by blocks.
FOLDED = 256


def _blocks(v: Column) -> Column:
    """The array in arrays of ``FOLDED`` values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / FOLDED).cast("int")), lambda k: F.slice(v, k * FOLDED + 1, FOLDED))


def _starts(values: Column, state: str, fresh: Callable[[Column, Column], Column], grown: Callable[[Column, Column], Column], begun: Callable[[Column], Column]) -> Column:
    """The places (from 0, in order) at which a new group begins: where ``fresh`` of the open group's state and the value; the state is ``begun`` by that value, else ``grown``.

    ``state`` is the state's type; before the first value it is null, and that is a beginning.
    """
    inner = f"struct<s: {state}, k: int, at: array<int>>"

    def step(acc: Column, v: Column) -> Column:
        new = acc["s"].isNull() | F.coalesce(fresh(acc["s"], v), F.lit(True))
        moved = lambda at, s: F.struct(s.alias("s"), (acc["k"] + 1).alias("k"), at.alias("at")).cast(inner)
        return F.when(new, moved(F.concat(acc["at"], F.array(acc["k"])), begun(v))).otherwise(moved(acc["at"], grown(acc["s"], v)))

    def block(acc: Column, some: Column) -> Column:
        zero = F.struct(acc["s"].alias("s"), acc["k"].alias("k"), F.array().cast("array<int>").alias("at")).cast(inner)
        return let(F.aggregate(some, zero, step), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.concat(acc["at"], x["at"]).alias("at")).cast(inner))

    def blocks(v: Column) -> Column:
        return F.aggregate(_blocks(v), F.struct(F.lit(None).cast(state).alias("s"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("at")).cast(inner), block, lambda x: x["at"])

    return F.when(values.isNotNull(), let(values, blocks))


def _cut(values: Column, starts: Column) -> Column:
    """The array in parts that begin at ``starts`` (from 0, in order, the first 0)."""
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(values))
    return F.transform(starts, lambda a, k: F.slice(values, a + 1, end(k) - a))


def group_lines(runs: Column, tolerance: float = Y_TOLERANCE) -> Column:
    """array<struct(y, runs)>: runs from top to bottom; a run joins the line whose first run is at most ``tolerance`` away."""
    ordered = F.transform(F.array_sort(F.transform(runs, lambda r: F.struct((-r["y"]).cast("double").alias("k1"), r["x"].cast("double").alias("k2"), _run(r).alias("r")))), lambda s: s["r"])

    def lines(v: Column) -> Column:
        starts = _starts(v, "double", lambda y, r: F.abs(r["y"] - y) > tolerance, lambda y, r: y, lambda r: r["y"])
        return let(starts, lambda at: F.transform(_cut(v, at), lambda line: F.struct(F.get(line, F.lit(0))["y"].alias("y"), _by_x(line).alias("runs"))))

    return let(ordered, lines)


def split_by_gaps(runs: Column, gap: float | Column) -> Column:
    """array<array<run>>: a line's runs, cut where the space to the run before exceeds ``gap``."""
    apart = lambda v, k: F.coalesce(F.get(v, k)["x"] - (F.get(v, k - 1)["x"] + F.get(v, k - 1)["w"]) > gap, F.lit(True))
    places = lambda v: F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda k: (k < F.size(v)) & apart(v, k))
    return let(_by_x(runs), lambda v: let(places(v), lambda at: _cut(v, at)))


def line_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def line_left(runs: Column) -> Column:
    return F.array_min(F.transform(runs, lambda r: r["x"]))


def line_right(runs: Column) -> Column:
    return F.array_max(F.transform(runs, lambda r: r["x"] + r["w"]))


def gap_islands(rows: DataFrame, by: str, start: str, end: str, gap: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``island``: a new one where the space after the row before exceeds ``gap``."""
    w = Window.partitionBy(by).orderBy(start, *order)
    new = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(True))
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def bands_from_rects(rects: Column) -> Column:
    """array<struct(y0, y1)>: extents from top to bottom; one that shares over 0.8 of the shorter with the band before joins it."""
    raw = F.array_sort(F.transform(rects, lambda r: F.struct((-(r["y"] + r["h"])).cast("double").alias("t"), (-r["y"]).cast("double").alias("b"))))

    def apart(last: Column, r: Column) -> Column:
        shorter = F.least(last["y1"] - last["y0"], -r["t"] + r["b"])
        shared = F.least(last["y1"], -r["t"]) - F.greatest(last["y0"], -r["b"])
        return ~F.coalesce((shorter > 0) & (shared / F.when(shorter > 0, shorter) > OVERLAP), F.lit(False))

    grown = lambda last, r: F.struct(F.least(last["y0"], -r["b"]).alias("y0"), F.greatest(last["y1"], -r["t"]).alias("y1"))
    begun = lambda r: F.struct((-r["b"]).alias("y0"), (-r["t"]).alias("y1"))
    extent = lambda v: F.struct(F.array_min(F.transform(v, lambda r: -r["b"])).alias("y0"), F.array_max(F.transform(v, lambda r: -r["t"])).alias("y1")).cast(BAND)
    return let(raw, lambda v: let(_starts(v, BAND, apart, grown, begun), lambda at: F.transform(_cut(v, at), extent)))


def bands_from_labels(ys: Column, top: Column, bottom: Column) -> Column:
    """array<struct(y0, y1)>: between the midpoints of neighbouring labels, to the grid's edges."""
    s = F.reverse(F.array_sort(ys))
    return let(s, lambda v: F.transform(v, lambda y, k: F.struct(F.when(k == F.size(v) - 1, bottom).otherwise((y + F.get(v, k + 1)) / 2).alias("y0"), F.when(k == 0, top).otherwise((F.get(v, k - 1) + y) / 2).alias("y1"))))


def _nearest(values: Column, x: Column) -> Column:
    """The place (from 0) of the value nearest to x; the first of equals."""
    away = F.transform(values, lambda v: F.abs(v - x))
    return F.array_position(away, F.array_min(away)).cast("int") - 1


def labels_of_bands(bands: Column, labels: Column) -> Column:
    """struct(values, error): each band's nearest label (struct(y, value)) by its middle, from top to bottom.

    An order that runs back or a label without a band is an error, and then there are no values.
    """
    ordered = F.transform(F.array_sort(F.transform(labels, lambda x: F.struct((-x["y"]).alias("k"), x["value"].alias("value")))), lambda s: s)
    ys = lambda v: F.transform(v, lambda s: -s["k"])

    def judged(v: Column, at: Column) -> Column:
        back = F.exists(F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1))), lambda k: F.coalesce(F.get(at, k) < F.get(at, k - 1), F.lit(False)))
        bare = F.array_except(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), at)
        error = F.when(F.size(v) == 0, "no labels").when(back, "not monotonic").when(F.size(bare) > 0, F.concat(F.lit("labels with no band: "), F.array_join(F.transform(bare, lambda k: F.get(v, k)["value"].cast("string")), ", ")))
        return F.struct(F.when(error.isNull(), F.transform(at, lambda k: F.get(v, k)["value"])).alias("values"), error.alias("error"))

    return let(ordered, lambda v: let(F.transform(bands, lambda b: _nearest(ys(v), (b["y0"] + b["y1"]) / 2)), lambda at: judged(v, at)))


def outer_edges(centres: Column, left: Column, right: Column) -> Column:
    """Column edges: midpoints inside; outside the mirror of the neighbouring edge, or the band's edge if within half a pitch of it."""

    def made(c: Column) -> Column:
        n = F.size(c)
        at = lambda k: F.get(c, k)
        inner = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (at(k - 1) + at(k)) / 2)
        pitch = (at(n - 1) - at(F.lit(0))) / F.nullif(n - 1, F.lit(0))
        pick = lambda edge, mirror: F.when(F.abs(edge - mirror) < 0.5 * pitch, edge).otherwise(mirror)
        first, last = (at(F.lit(0)) + at(F.lit(1))) / 2, (at(n - 2) + at(n - 1)) / 2
        many = F.concat(F.array(pick(left, 2 * at(F.lit(0)) - first)), inner, F.array(pick(right, 2 * at(n - 1) - last)))
        return F.when(n == 1, F.array(left, right)).otherwise(many)

    return let(F.array_sort(centres), made)


CELL = "struct<x0: double, x1: double, parts: array<struct<y: double, text: string>>>"


def header_grid(lines: Column, left: Column, right: Column, gap: float = 3.0, override: Column | None = None) -> Column:
    """struct(edges, cols, gaps, error): the grid that a header's time ranges draw.

    Cells of several lines join by x overlap over 0.4 of the narrower. Labels that are no range are left out; none
    left, a label twice or edges that do not rise are errors. ``gaps`` are the columns that the next does not follow.
    ``override`` (an array; null for none) stands for the labels of a corrupt header, one a printed cell from left to
    right; the cells stay where they are. Another number of labels, or one that is no range, is an error.
    """
    given = override if override is not None else F.lit(None).cast("array<string>")
    segments = F.flatten(F.transform(lines, lambda line: split_by_gaps(line["runs"], gap)))

    def step(cells: Column, seg: Column) -> Column:
        x0, x1 = line_left(seg), line_right(seg)
        part = F.struct(F.get(seg, F.lit(0))["y"].alias("y"), line_text(seg).alias("text"))
        meets = F.transform(cells, lambda c: F.least(c["x1"], x1) - F.greatest(c["x0"], x0) > 0.4 * F.least(c["x1"] - c["x0"], x1 - x0))
        at = F.array_position(meets, True).cast("int") - 1
        grown = F.transform(cells, lambda c, k: F.when(k == at, F.struct(F.least(c["x0"], x0).alias("x0"), F.greatest(c["x1"], x1).alias("x1"), F.concat(c["parts"], F.array(part)).alias("parts"))).otherwise(c))
        return F.when(at < 0, F.concat(cells, F.array(F.struct(x0.alias("x0"), x1.alias("x1"), F.array(part).alias("parts"))))).otherwise(grown)

    cells = F.aggregate(segments, F.array().cast(f"array<{CELL}>"), step)
    label = lambda c: collapse(F.array_join(F.transform(F.array_sort(F.transform(c["parts"], lambda p: F.struct((-p["y"]).alias("k"), p["text"].alias("t")))), lambda s: s["t"]), ""))
    placed = F.array_sort(F.transform(cells, lambda c: F.struct(((c["x0"] + c["x1"]) / 2).alias("centre"), label(c).alias("label"))))

    def named(c: Column) -> Column:
        text = lambda x, k: F.when(given.isNull(), x["label"]).otherwise(F.get(given, k))
        return F.transform(c, lambda x, k: let(text(x, k), lambda t: F.struct(x["centre"].alias("centre"), t.alias("label"), parse_time_range(t).alias("range"))))

    def made(c: Column) -> Column:
        wrong = F.when(given.isNotNull() & (F.size(given) != F.size(c)), F.concat(F.size(given).cast("string"), F.lit(" labels for "), F.size(c).cast("string"), F.lit(" cells"))).when(given.isNotNull() & F.exists(c, lambda x: x["range"].isNull()), "a label given is no range")
        return let(F.filter(c, lambda x: x["range"].isNotNull()), lambda p: let(outer_edges(F.transform(p, lambda x: x["centre"]), left, right), lambda e: finished(p, e, wrong)))

    def finished(p: Column, edges: Column, wrong: Column) -> Column:
        n = F.size(p)
        rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(edges) - 1, F.lit(1))), lambda k: F.get(edges, k) > F.get(edges, k - 1))
        gaps = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: F.coalesce(F.get(p, k)["range"]["end_min"] != F.get(p, k + 1)["range"]["start_min"], F.lit(False)))
        error = F.when(wrong.isNotNull(), wrong).when(n == 0, "no time range in the header").when(F.size(F.array_distinct(F.transform(p, lambda c: c["label"]))) < n, "a label stands twice").when(~rising, "edges do not rise")
        cols = F.transform(p, lambda c: F.struct(c["label"].alias("label"), c["range"]["start_min"].alias("start_min"), c["range"]["end_min"].alias("end_min")))
        return F.struct(edges.alias("edges"), cols.alias("cols"), gaps.alias("gaps"), error.alias("error"))

    return let(placed, lambda c: let(named(c), made))


def column_of(x: Column, edges: Column) -> Column:
    """The column (from 0) in which x lies, edges belonging to the right; the first or last beyond them."""
    inside = F.filter(F.transform(edges, lambda e, k: F.struct(k.alias("k"), e.alias("e"))), lambda s: s["e"] <= x)
    return F.least(F.greatest(F.size(inside) - 1, F.lit(0)), F.size(edges) - 2)


def column_widths(edges: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.get(edges, k) - F.get(edges, k - 1))


def snap(x: Column, edges: Column, tolerance: Column) -> Column:
    """The place of the nearest edge; null beyond the tolerance."""
    return let(_nearest(edges, x), lambda k: F.when(F.abs(F.get(edges, k) - x) <= tolerance, k))


def span_of_rect(x: Column, w: Column, edges: Column, tolerance: Column | None = None) -> Column:
    """struct(a, b): the columns that a rectangle covers; null if an edge does not snap (within 0.35 of the narrowest column) or none is covered."""
    t = tolerance if tolerance is not None else 0.35 * F.array_min(column_widths(edges))
    ends = F.struct(snap(x, edges, t).alias("a"), (snap(x + w, edges, t) - 1).alias("b"))
    return let(ends, lambda s: F.when(s["b"] >= s["a"], s))


def index_percentile(values: Column, q: float) -> Column:
    """The value at place floor(q n) of the sorted values (no interpolation); 0 for none."""
    return F.coalesce(F.get(F.array_sort(values), F.least(F.size(values) - 1, F.floor(F.size(values) * F.lit(q)).cast("int"))), F.lit(0.0))


def median_of(values: Column) -> Column:
    """The middle value, or the mean of the middle two; 0 for none."""
    s, n = F.array_sort(values), F.size(values)
    return F.coalesce((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2, F.lit(0.0))


def middles(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by, middle, percentile): ``median_of`` and ``index_percentile`` of each group's values, by their places in order, so that no group is gathered. Nulls are no values; a group of nulls gives no row."""
    known = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    placed = known.select(*by, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(value)) - 1).alias("_k"), F.count("*").over(w).alias("_n"))
    inside = (F.col("_k") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_k") == F.floor(F.col("_n") / 2))
    at = F.col("_k") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q)))
    return placed.where(inside | at).groupBy(*by).agg(F.avg(F.when(inside, F.col("_v"))).alias("middle"), F.max(F.when(at, F.col("_v"))).alias("percentile"))


def y_gap_parts(lines: Column, factor: float) -> Column:
    """A cluster's lines (struct(y, runs), top first) in parts: cut where a step down exceeds the 25th percentile of steps times ``factor``.

    Fewer than three lines stay together; a part that is only a room line joins the one above.
    """
    from slotwise.functions.text import room_of

    steps = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda k: F.get(v, k - 1)["y"] - F.get(v, k)["y"])
    zero = F.array().cast(f"array<array<{LINE}>>")

    def cut(v: Column, limit: Column) -> Column:
        def step(parts: Column, line: Column) -> Column:
            last = F.try_element_at(parts, F.lit(-1))
            near = F.coalesce(F.try_element_at(last, F.lit(-1))["y"] - line["y"] <= limit, F.lit(False))
            return F.when(near, F.concat(_but_last(parts), F.array(F.concat(last, F.array(line))))).otherwise(F.concat(parts, F.array(F.array(line))))

        return F.aggregate(v, zero, step)

    def fold_rooms(parts: Column) -> Column:
        def step(out: Column, part: Column) -> Column:
            room = (F.size(part) == 1) & room_of(line_text(F.get(part, F.lit(0))["runs"])).isNotNull() & (F.size(out) > 0)
            last = F.try_element_at(out, F.lit(-1))
            return F.when(room, F.concat(_but_last(out), F.array(F.concat(last, part)))).otherwise(F.concat(out, F.array(part)))

        return F.aggregate(parts, zero, step)

    return let(lines, lambda v: let(index_percentile(steps(v), 0.25) * factor, lambda limit: F.when((F.size(v) < 3) | ~(limit > 0), F.array(v)).otherwise(fold_rooms(cut(v, limit)))))


def block_features(lines: Column) -> Column:
    """struct(name, room, centre, width, x_min, x_max, y_top, y_bottom) of a block's lines, top first."""
    texts = F.transform(lines, lambda x: line_text(x["runs"]))
    mid = F.transform(lines, lambda x: (line_left(x["runs"]) + line_right(x["runs"])) / 2)
    return F.struct(
        collapse(F.array_join(name_lines(texts), " ")).alias("name"), extract_room(texts).alias("room"), median_of(mid).alias("centre"),
        F.array_max(F.transform(lines, lambda x: line_right(x["runs"]) - line_left(x["runs"]))).alias("width"),
        F.array_min(F.transform(lines, lambda x: line_left(x["runs"]))).alias("x_min"), F.array_max(F.transform(lines, lambda x: line_right(x["runs"]))).alias("x_max"),
        F.array_max(F.transform(lines, lambda x: x["y"])).alias("y_top"), F.array_min(F.transform(lines, lambda x: x["y"])).alias("y_bottom"),
    )


CLUSTER = f"struct<x0: double, x1: double, lines: array<{LINE}>>"


def blocks_in_band(lines: Column, y0: Column, y1: Column, gap: float | Column, overlap: float = 0.5, factor: float | None = None, single: bool = False) -> Column:
    """The text blocks of a row band (features, top first then left): segments by gaps, each into the first cluster that it overlaps in x by more than ``overlap`` of the narrower, clusters cut at jumps of ``factor``.

    ``single``: all text is one cell, and only the jumps cut it.
    """
    inside = F.filter(lines, lambda x: (x["y"] >= y0) & (x["y"] < y1))
    parts = F.flatten(F.transform(inside, lambda x: F.transform(split_by_gaps(x["runs"], gap), lambda r: F.struct(F.get(r, F.lit(0))["y"].alias("y"), r.alias("runs")))))
    ordered = F.transform(F.array_sort(F.transform(parts, lambda s: F.struct((-s["y"]).alias("k1"), line_left(s["runs"]).alias("k2"), s.alias("s")))), lambda t: t["s"])

    def step(clusters: Column, seg: Column) -> Column:
        x0, x1 = line_left(seg["runs"]), line_right(seg["runs"])
        meets = F.transform(clusters, lambda c: F.least(c["x1"], x1) - F.greatest(c["x0"], x0) > overlap * F.least(c["x1"] - c["x0"], x1 - x0))
        at = F.array_position(meets, True).cast("int") - 1
        grown = F.transform(clusters, lambda c, k: F.when(k == at, F.struct(F.least(c["x0"], x0).alias("x0"), F.greatest(c["x1"], x1).alias("x1"), F.concat(c["lines"], F.array(seg)).alias("lines"))).otherwise(c))
        return F.when(at < 0, F.concat(clusters, F.array(F.struct(x0.alias("x0"), x1.alias("x1"), F.array(seg).alias("lines"))))).otherwise(grown)

    if single:
        groups = F.filter(F.array(ordered), lambda g: F.size(g) > 0)
    else:
        groups = F.transform(F.aggregate(ordered, F.array().cast(f"array<{CLUSTER}>"), step), lambda c: c["lines"])
    if factor:
        groups = F.flatten(F.transform(groups, lambda g: y_gap_parts(g, factor)))
    made = F.transform(groups, lambda g: block_features(g))
    return F.transform(F.array_sort(F.transform(made, lambda b: F.struct((-b["y_top"]).alias("k1"), b["x_min"].alias("k2"), b.alias("b")))), lambda t: t["b"])


def span_candidates(centre: Column, width: Column, edges: Column, gaps: Column, first: Column, last: Column) -> Column:
    """array<struct(cost, a, b)>: the spans of columns that can hold a block, least cost first; one that crosses a gap cannot, nor one too narrow.

    Cost is the distance of the centres and what the text overflows. Without any, the whole extent at a great cost.
    """
    at = lambda k: F.get(edges, k)
    spans = F.flatten(F.transform(F.sequence(first, last), lambda a: F.transform(F.sequence(a, last), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    legal = F.filter(spans, lambda s: ~F.exists(gaps, lambda g: (g >= s["a"]) & (g < s["b"])) & (at(s["b"] + 1) - at(s["a"]) >= width * (1 - WIDTH_TOLERANCE)))
    off = lambda a, b: F.abs(centre - (at(a) + at(b + 1)) / 2)
    priced = F.transform(legal, lambda s: F.struct((off(s["a"], s["b"]) + F.greatest(F.lit(0.0), width - (at(s["b"] + 1) - at(s["a"])))).alias("cost"), s["a"].alias("a"), s["b"].alias("b")))
    whole = F.array(F.struct((off(first, last) + 1e4).alias("cost"), first.alias("a"), last.alias("b")))
    return F.array_sort(F.when(F.size(priced) > 0, priced).otherwise(whole))


def assign_spans(bands: DataFrame, key: list[str]) -> DataFrame:
    """For each band (key, blocks: array<struct(centre, width)>, edges, gaps, first, last) the cheapest ordered, disjoint spans of its blocks: key, spans, cost, margin."""
    return bands.withColumn("_s", block_spans(F.array_sort("blocks"), F.col("edges"), F.col("gaps"), F.col("first"), F.col("last"))).select(*key, "_s.*")


SPANS = "struct<spans: array<struct<a: int, b: int>>, cost: double, margin: double>"


def block_spans(blocks: Column, edges: Column, gaps: Column, first: Column, last: Column) -> Column:
    """``disjoint_spans`` of the ``span_candidates`` of blocks (array<struct(centre, width)>, in order), for all rows of an Arrow batch at once. Not for use inside a lambda.

    Null blocks give null.
    """

    @F.pandas_udf(SPANS)
    def made(blocks: pd.Series, edges: pd.Series, gaps: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        out: list[tuple | None] = [None] * len(blocks)
        like: dict[tuple[int, int], list[int]] = {}
        for i, (b, e) in enumerate(zip(blocks, edges, strict=True)):
            if b is not None:
                like.setdefault((len(b), len(e) - 1 if e is not None else 0), []).append(i)
        for (n, columns), rows in like.items():
            if not n:
                for i in rows:
                    out[i] = ([], 0.0, None)
                continue
            at = np.array([edges.iat[i] for i in rows], dtype=float)
            centre, width = (np.array([[x[c] for x in blocks.iat[i]] for i in rows], dtype=float) for c in ("centre", "width"))
            closed = np.zeros((len(rows), columns + 1), dtype=int)  # gaps before each column
            for k, i in enumerate(rows):
                for g in gaps.iat[i]:
                    if 0 <= g < columns:
                        closed[k, g + 1] += 1
            spans, cost, margin = _cheapest(centre, width, at, np.cumsum(closed, axis=1), first.to_numpy()[rows].astype(int), last.to_numpy()[rows].astype(int))
            for k, i in enumerate(rows):
                out[i] = ([{"a": int(a), "b": int(b)} for a, b in spans[k]], float(cost[k]), None if np.isinf(margin[k]) else float(margin[k]))
        return pd.DataFrame([o or (None, None, None) for o in out], columns=["spans", "cost", "margin"]).astype({"spans": object, "cost": "Float64", "margin": "Float64"})

    return F.when(blocks.isNotNull(), made(F.transform(blocks, lambda b: F.struct(b["centre"].cast("double").alias("centre"), b["width"].cast("double").alias("width"))), edges.cast("array<double>"), gaps.cast("array<int>"), first.cast("int"), last.cast("int")))


def _two_least(cost: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The places of each row's two least by (cost, code)."""
    at, cost, code = [], cost.copy(), code.copy()
    for _ in range(2):
        ties = np.where(cost == cost.min(axis=1, keepdims=True), code, np.iinfo(np.int64).max)
        at.append(ties.argmin(axis=1))
        cost[np.arange(len(cost)), at[-1]], code[np.arange(len(cost)), at[-1]] = np.inf, np.iinfo(np.int64).max
    return np.stack(at, axis=1)


def _cheapest(centre: np.ndarray, width: np.ndarray, edges: np.ndarray, closed: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spans, cost, margin) of bands of equally many blocks and columns, a row each; an infinite margin: no runner-up.

    Block by block, the best two partial assignments that end before each column go on, the first by spans of those that cost the same.
    """
    n, columns, row = centre.shape[1], edges.shape[1] - 1, np.arange(len(centre))
    a, b = np.triu_indices(columns)  # by a, then b
    wide, middle = edges[:, b + 1] - edges[:, a], (edges[:, a] + edges[:, b + 1]) / 2
    open_ = (closed[:, b] == closed[:, a]) & (a >= first[:, None]) & (b <= last[:, None])
    whole = (a == first[:, None]) & (b == last[:, None])
    before = np.zeros((len(row), columns, 2)), np.zeros((len(row), columns, 2), dtype=np.int64), np.full((len(row), columns, 2), -1)  # cost, rank and state of what ends before each column
    before[0][:, :, 1] = np.inf
    steps, own, alone = [], np.zeros((len(row), n), dtype=np.int64), np.zeros(len(row))
    for k in range(n):
        away, short = np.abs(centre[:, k, None] - middle), width[:, k, None] - wide
        legal = open_ & (wide >= width[:, k, None] * (1 - WIDTH_TOLERANCE))
        price = np.where(legal, away + np.maximum(0.0, short), np.inf)
        price = np.where(legal.any(axis=1)[:, None] | ~whole, price, away + 1e4)
        own[:, k] = price.argmin(axis=1)
        alone = alone + price.min(axis=1)
        cost, rank, state = (x[:, a] for x in before)
        cost, code = cost + price[:, :, None], rank * len(a) + np.arange(len(a))[:, None]
        kept = [[], [], [], []]
        for end in range(columns):
            mine = np.flatnonzero(b == end)
            c, d, s = (x[:, mine].reshape(len(row), -1) for x in (cost, code, state))
            best = _two_least(c, d)
            for x, v in zip(kept, (c, d, s, np.repeat(mine, 2)[None].repeat(len(row), 0)), strict=True):
                x.append(np.take_along_axis(v, best, 1))
        cost, code, state, span = (np.stack(x, axis=1) for x in kept)  # (rows, ends, 2)
        steps.append((state.reshape(len(row), -1), span.reshape(len(row), -1)))
        rank = code.reshape(len(row), -1).argsort(axis=1, kind="stable").argsort(axis=1).reshape(cost.shape)
        state = np.arange(2 * columns).reshape(1, columns, 2).repeat(len(row), 0)
        gone = [[np.full((len(row), 2), v)] for v in (np.inf, 0, -1)]
        for end in range(columns):
            c, d, s = (np.concatenate([g[-1], x[:, end]], axis=1) for g, x in zip(gone, (cost, rank, state), strict=True))
            best = _two_least(c, d)
            for g, v in zip(gone, (c, d, s), strict=True):
                g.append(np.take_along_axis(v, best, 1))
        before = tuple(np.stack(g[:-1], axis=1) for g in gone)
        done = tuple(g[-1] for g in gone)
    found, at = np.isfinite(done[0][:, 0]), done[2][:, 0]
    chosen = own
    for k in reversed(range(n)):
        chosen[:, k] = np.where(found, steps[k][1][row, np.maximum(at, 0)], own[:, k])
        at = steps[k][0][row, np.maximum(at, 0)]
    with np.errstate(invalid="ignore"):
        margin = np.where(found, done[0][:, 1] - done[0][:, 0], 0.0)
    return np.stack([a[chosen], b[chosen]], axis=2), np.where(found, done[0][:, 0], alone), margin


def disjoint_spans(candidates: Column) -> Column:
    """struct(spans, cost, margin): the cheapest ordered, disjoint spans of any number of blocks, from their ``span_candidates`` in order.

    A fold over the blocks; of the partial assignments that end at one column only the best two go on, which loses
    neither the cheapest nor its runner-up. The margin over the runner-up is null where there is none. Blocks for which
    no assignment exists take each its own cheapest span, with margin 0.
    """
    kind = "array<struct<cost: double, spans: array<struct<a: int, b: int>>, end: int>>"
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<struct<a: int, b: int>>").alias("spans"), F.lit(-1).alias("end"))).cast(kind)
    span = lambda s: F.struct(s["a"].cast("int").alias("a"), s["b"].cast("int").alias("b"))

    def step(states: Column, cand: Column) -> Column:
        grown = F.flatten(F.transform(states, lambda t: F.transform(F.filter(cand, lambda s: s["a"] > t["end"]), lambda s: F.struct((t["cost"] + s["cost"]).alias("cost"), F.concat(t["spans"], F.array(span(s))).alias("spans"), s["b"].cast("int").alias("end")))))
        ends = F.array_distinct(F.transform(grown, lambda t: t["end"]))
        return F.flatten(F.transform(ends, lambda e: F.slice(F.array_sort(F.filter(grown, lambda t: t["end"] == e)), 1, 2))).cast(kind)

    def chosen(c: Column, done: Column) -> Column:
        best = F.get(done, F.lit(0))
        found = F.struct(best["spans"].alias("spans"), best["cost"].alias("cost"), (F.get(done, F.lit(1))["cost"] - best["cost"]).alias("margin"))
        own = F.struct(F.transform(c, lambda x: span(F.get(x, F.lit(0)))).alias("spans"), F.aggregate(F.transform(c, lambda x: F.get(x, F.lit(0))["cost"]), F.lit(0.0), lambda a, x: a + x).alias("cost"), F.lit(0.0).alias("margin"))
        return F.when(F.size(done) > 0, found).otherwise(own)

    return let(candidates, lambda c: let(F.array_sort(F.aggregate(c, start, step)), lambda done: chosen(c, done)))


def free_span(columns: Column, occupied: Column) -> Column:
    """struct(a, b): the widest run of columns (0 to columns - 1) that nothing occupies; the first of equals; all columns if none is free."""
    free = F.array_sort(F.array_except(F.sequence(F.lit(0), columns - 1), occupied))
    zero = F.array().cast("array<struct<a: int, b: int>>")

    def step(runs: Column, k: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        grows = F.coalesce(last["b"] == k - 1, F.lit(False))
        return F.when(grows, F.concat(_but_last(runs), F.array(F.struct(last["a"].alias("a"), k.alias("b"))))).otherwise(F.concat(runs, F.array(F.struct(k.alias("a"), k.alias("b")))))

    runs = F.aggregate(free, zero, step)
    widest = F.try_element_at(F.array_sort(F.transform(runs, lambda r: F.struct((r["a"] - r["b"]).alias("k"), r["a"].alias("a"), r["b"].alias("b")))), F.lit(1))
    return let(widest, lambda w: F.struct(F.coalesce(w["a"], F.lit(0)).alias("a"), F.coalesce(w["b"], columns - 1).alias("b")))


def widest_rect(rects: Column, y: Column) -> Column:
    """The widest rectangle whose height holds y; the first of equals; null for none."""
    holding = F.filter(rects, lambda r: (r["y"] <= y) & (y <= r["y"] + r["h"]))
    ranked = F.transform(holding, lambda r, k: F.struct((-r["w"]).alias("w"), k.alias("k"), r.alias("r")))
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["r"]


def spaced_text(runs: Column) -> Column:
    """A line's text with a blank between runs, but where one of them has a space there or they overlap by more than half a point (a word that was split)."""
    zero = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("end"))

    def step(acc: Column, r: Column) -> Column:
        glued = acc["end"].isNull() | acc["t"].rlike(spaced(r"\s$")) | r["text"].rlike(spaced(r"^\s")) | (r["x"] - acc["end"] < -0.5)
        return F.struct(F.concat(acc["t"], F.when(glued, "").otherwise(" "), r["text"]).alias("t"), (r["x"] + r["w"]).alias("end"))

    return F.aggregate(_by_x(runs), zero, step)["t"]


def unwrap_hyphens(lines: Column) -> Column:
    """Lines (struct(y, text)) of which each that follows a hyphen at the end of the one before is joined to it; the hyphen stays."""
    zero = F.array().cast("array<struct<y: double, text: string>>")

    def step(out: Column, line: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = F.coalesce(last["text"].rlike(spaced(r"-\s*$")), F.lit(False))
        joined = F.struct(last["y"].alias("y"), F.concat(F.regexp_replace(last["text"], spaced(r"\s+$"), ""), F.regexp_replace(line["text"], spaced(r"^\s+"), "")).alias("text"))
        return F.when(joins, F.concat(_but_last(out), F.array(joined))).otherwise(F.concat(out, F.array(F.struct(line["y"].cast("double").alias("y"), line["text"].alias("text")))))

    return F.aggregate(lines, zero, step)
