"""Overlap of intervals: collisions, conflicts with a plan, clusters and lanes.

An overlap join of rows meets in cells: ranges of a day's starts that are cut by their measured work, and parts of
those ranges that are heavy still. A day or a start that a large part of all rows share is thus spread by what it costs.

Where only existence or numbers are asked, rows are first reduced to slots, the distinct (day, start, end and
what else matters) with their numbers and their least and greatest key. Slots are few, whatever the rows:
they meet one another, and each row then looks up its slot. A row meets another key's exactly if the least or
the greatest key that its slot meets is not its own.
"""

from __future__ import annotations

from bisect import insort
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.times import ranges_overlap

BUCKET, SALTS = 30, 16
#: Cells of an overlap join for each of the session's shuffle partitions. In a narrow range nearly all that meets overlaps; in a wide one most pairs are tried in vain.
CELLS_A_TASK = 64
#: Tasks of an overlap join for each of the session's shuffle partitions, up to ``MOST`` in all (never fewer than the session has): no core waits long for the last one. Cells grow with them.
TURNS, MOST = 16, 400
#: Rows of a list of the later side: what is made of one in one go stays small.
LISTED = 500


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def start_ranges(rows: DataFrame, day: str, cells: int) -> DataFrame:
    """(day, ranges: array<struct(s, a_parts, b_parts)>): each day's starts in ranges of about equal work, from their measured numbers.

    The work of a start is the number of pairs in which the later interval starts then: its rows times the rows open by then. A range
    holds starts in a row up to a share of all work, one in ``cells``; ``s`` is its first start. A range of more work (one start, say) is dealt
    to a_parts by b_parts cells.
    """
    sound = rows.where("s < e")
    steps = sound.groupBy(day, F.col("s").alias("t")).agg(F.count("*").alias("n")).select(day, "t", "n", F.lit(0).cast("bigint").alias("gone"))
    ends = sound.groupBy(day, F.col("e").alias("t")).agg(F.count("*").alias("gone")).select(day, "t", F.lit(0).cast("bigint").alias("n"), "gone")
    at = steps.union(ends).groupBy(day, "t").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"))
    by = Window.partitionBy(day).orderBy("t")  # a day has as many rows here as it has times
    begun = at.withColumn("open", F.sum(F.col("n") - F.col("gone")).over(by)).where("n > 0").withColumn("work", F.col("n").cast("double") * F.col("open"))
    total = begun.agg(F.sum("work").alias("all"))
    share = F.greatest(F.col("all") / cells, F.lit(1.0))
    ranged = begun.crossJoin(F.broadcast(total))  # one row
    ranged = ranged.withColumn("range", F.floor((F.sum("work").over(by) - F.col("work")) / share))
    ranges = ranged.groupBy(day, "range").agg(F.min("t").alias("s"), F.ceil(F.sum("work") / F.first(share)).alias("parts"))
    b_parts = F.ceil(F.sqrt("parts"))
    listed = F.struct("s", F.ceil(F.col("parts") / b_parts).cast("int").alias("a_parts"), b_parts.cast("int").alias("b_parts"))
    return ranges.groupBy(day).agg(F.array_sort(F.collect_list(listed)).alias("ranges"))


def _dealt(rows: DataFrame, day: str, order: list[str], cells: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of an overlap join with their cells (_range, _a, _b): rows in every range that they reach into, and rows in the range in which they start.

    Only days of several cells are looked up. Each has more work than one in ``cells`` of all, so they are fewer than ``cells``, whatever the rows, and go to all tasks.
    """
    cut = start_ranges(rows, day, cells).where((F.size("ranges") > 1) | (F.col("ranges")[0]["a_parts"] > 1) | (F.col("ranges")[0]["b_parts"] > 1))
    sound = rows.where(F.col(day).isNotNull() & (F.col("s") < F.col("e"))).join(F.broadcast(cut), day, "left")
    first, last = (F.greatest(F.coalesce(F.size(F.filter("ranges", f)), F.lit(0)) - 1, F.lit(0)) for f in (lambda r: r["s"] <= F.col("s"), lambda r: r["s"] < F.col("e")))
    part = lambda n: F.pmod(F.xxhash64(*order), n).cast("int")
    several = lambda n: F.sequence(F.lit(0), n - 1)
    parts = lambda c: F.coalesce(F.get("ranges", F.col("_range"))[f"{c}_parts"], F.lit(1))
    sides = []
    for mine, other, until in (("a", "b", last), ("b", "a", first)):
        dealt = sound.withColumn("_range", F.explode(F.sequence(first, until)))
        dealt = dealt.withColumn(f"_{mine}", part(parts(mine))).withColumn(f"_{other}", F.explode(several(parts(other))))
        sides.append(dealt.select(*rows.columns, "_range", "_a", "_b"))
    return sides[0], sides[1]


def _earlier(order: list[str]) -> Column:
    """Whether a_* comes before b_* by the columns of ``order``, nulls first."""
    less = F.lit(False)
    for c in reversed(order):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        less = F.coalesce(x < y, x.isNull() & y.isNotNull()) | (x.eqNullSafe(y) & less)
    return less


def overlap_pairs(rows: DataFrame, day: str, order: list[str], keep: Column | None = None, cells: int | None = None) -> DataFrame:
    """Pairs (a_*, b_*) of rows of one ``day`` that overlap half-open on (s, e), a before b by (s, *order).

    ``order`` makes ties definite: it must tell rows apart. ``keep`` is a condition over both sides. Empty
    intervals (e <= s) overlap none. Rows with a null day or bound match none. Both sides meet in the cells of ``start_ranges``: a pair counts in
    the range in which the later one starts, so once, and an interval is carried over into every range that it reaches. So a crowded
    day, or one crowded start, is spread over many tasks of like work. In a cell the later side stands in lists of at most ``LISTED`` rows, in order
    of their starts: a row meets the lists that it reaches, and only pairs are made of them.
    """
    tasks = max(_tasks(rows), min(TURNS * _tasks(rows), MOST))
    cell = [day, "_range", "_a", "_b"]
    # as many tasks as named: what a cell costs is its pairs, and few bytes may be many pairs
    reached, begun = (x.repartition(tasks, *cell) for x in _dealt(rows, day, order, cells or CELLS_A_TASK // TURNS * tasks))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("s", "e", *order)) - 1
    row = F.struct(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    lists = begun.withColumn("_list", F.floor(place / LISTED)).groupBy(*cell, "_list").agg(F.min("s").alias("_from"), F.max("s").alias("_to"), F.collect_list(row).alias("_rows"))
    lists = lists.select(*[F.col(c).alias(f"_l{c}") for c in cell], "_from", "_to", "_rows")
    on = (F.col("a_s") <= F.col("_to")) & (F.col("_from") < F.col("a_e"))
    for c in cell:
        on &= F.col(f"a_{c}") == F.col(f"_l{c}")
    pairs = _named(reached, "a").join(lists, on).select(*[f"a_{c}" for c in rows.columns], F.inline("_rows"))
    later = (F.col("a_s") < F.col("b_s")) | ((F.col("a_s") == F.col("b_s")) & _earlier(order))
    met = later & (F.col("b_s") < F.col("a_e"))
    return pairs.where(met if keep is None else met & keep)


def session_collisions(placed: DataFrame, order: list[str]) -> DataFrame:
    """Weekly sessions (key, d, s, e, v_from, v_to) of different keys that overlap on a weekday (1-5) while both are valid."""
    valid = ranges_overlap(F.col("a_v_from"), F.col("a_v_to"), F.col("b_v_from"), F.col("b_v_to"))
    return overlap_pairs(placed.where(F.col("d").between(1, 5)), "d", order, (F.col("a_key") != F.col("b_key")) & valid)


#: Rows of a weekday that meet in one cell of ``session_counts``, on either side.
COUNTED = 100_000


def session_counts(placed: DataFrame, order: list[str]) -> DataFrame:
    """(d, a_key, n, others): of ``session_collisions``, each earlier side's number of pairs and of distinct later keys, by weekday.

    Pairs are counted where they meet and never move. A weekday's rows meet in cells of about ``COUNTED`` rows a side, dealt on either side by the
    hash of their key: the rows of two keys meet in one cell, so what cells count adds up.
    """
    named, far = [f"_o{k}" for k in range(len(order))], F.lit(1 << 40)  # a window without bounds is always
    since = F.coalesce(F.unix_date("v_from"), -far).alias("_from")
    until = F.when(F.col("v_from").isNull(), far).otherwise(F.coalesce(F.unix_date("v_to"), -far)).alias("_to")
    sound = placed.where(F.col("d").between(1, 5) & (F.col("s") < F.col("e")) & F.col("key").isNotNull()).select("key", "d", "s", "e", *[F.col(c).alias(o) for c, o in zip(order, named, strict=True)], since, until)
    sound = sound.join(sound.groupBy("d").agg(F.ceil(F.count("*") / COUNTED).cast("int").alias("_parts")), "d")
    part, every = F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    sides = [sound.withColumn("_earlier", F.lit(k == 0)).withColumn(mine, part).withColumn(other, every) for k, (mine, other) in enumerate((("_a", "_b"), ("_b", "_a")))]

    def counted(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b, by = rows[rows["_earlier"]], rows[~rows["_earlier"]], ["s", *named]
        both = pd.concat([a, b], ignore_index=True)
        place = both[by].sort_values(by, na_position="first").groupby(by, sort=False, dropna=False).ngroup().sort_index().to_numpy()
        code, keys = pd.factorize(both["key"])
        ranked = len(a) + np.argsort(place[len(a) :], kind="stable")
        b_code, b_s, b_from, b_to = code[ranked], *(both[c].to_numpy()[ranked] for c in ("s", "_from", "_to"))
        low = np.searchsorted(place[ranked], place[: len(a)], side="right")
        high = np.searchsorted(b_s, a["e"].to_numpy())
        own, a_from, a_to = code[: len(a)], a["_from"].to_numpy(), a["_to"].to_numpy()
        seen, out = np.zeros(len(keys), dtype=bool), []
        turns = np.argsort(own, kind="stable")
        for rows in np.split(turns, np.flatnonzero(np.diff(own[turns])) + 1) if len(turns) else []:
            n = 0
            for i in rows:
                at = slice(low[i], max(low[i], high[i]))
                found = b_code[at][(b_code[at] != own[i]) & (a_from[i] <= b_to[at]) & (b_from[at] <= a_to[i])]
                n += len(found)
                seen[found] = True
            if n:
                out.append((cell[0], keys[own[rows[0]]], n, int(np.count_nonzero(seen))))
                seen[:] = False
        return pd.DataFrame(out, columns=["d", "a_key", "n", "others"])

    kind = {f.name: f.dataType.simpleString() for f in sound.schema}
    cells = sides[0].unionByName(sides[1]).drop("_parts").groupBy("d", "_a", "_b")
    met = cells.applyInPandas(counted, f"d {kind['d']}, a_key {kind['key']}, n bigint, others bigint")
    return met.groupBy("d", "a_key").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))


def severity(a_s: Column, a_e: Column, a_assumed: Column, b_s: Column, b_e: Column, b_assumed: Column) -> Column:
    """``certain`` if the overlap stands with every assumed end drawn in to a minute after its start, else ``possible``."""
    a_hard = F.when(a_assumed, a_s + 1).otherwise(a_e)
    b_hard = F.when(b_assumed, b_s + 1).otherwise(b_e)
    return F.when((b_s < a_hard) & (a_s < b_hard), "certain").otherwise("possible")


def exam_collisions(placed: DataFrame, order: list[str]) -> DataFrame:
    """Dated exams (key, date, s, e, assumed) of different keys that overlap, graded by ``severity``."""
    pairs = overlap_pairs(placed, "date", order, F.col("a_key") != F.col("b_key"))
    side = lambda x: [F.col(f"{x}_{c}") for c in ("s", "e", "assumed")]
    return pairs.withColumn("severity", severity(*side("a"), *side("b")))


def _slots(rows: DataFrame, day: str, more: list[str]) -> DataFrame:
    return rows.where("s < e").groupBy(day, "s", "e", *more).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))


def _spread(slots: DataFrame, side: str) -> DataFrame:
    return _named(slots.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("s") / BUCKET), F.floor((F.col("e") - 1) / BUCKET)))), side)


def met(rows: DataFrame, placed: DataFrame, day: str, more: list[str], kinds: dict[str, Column]) -> DataFrame:
    """``rows`` that overlap a row of another key in ``placed`` on one day, each once, with a flag for every kind of overlap.

    ``more`` are columns of both beside (key, day, s, e) that ``kinds``, conditions over a_* (of rows) and b_*, refer to.
    A row of which every flag is false is left out. Rows with a null key, day or bound meet none.
    """
    a, b = _spread(_slots(rows, day, more), "a"), _spread(_slots(placed, day, more), "b")
    on = (F.col(f"a_{day}") == F.col(f"b_{day}")) & (F.col("a__bucket") == F.col("b__bucket")) & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e"))
    own = [day, "s", "e", *more]
    bounds = [f(F.when(when, F.col(f"b_{c}"))).alias(f"_{kind}_{c}") for kind, when in kinds.items() for f, c in ((F.min, "lo"), (F.max, "hi"))]
    reach = a.join(b, on).groupBy(*[F.col(f"a_{c}").alias(f"_{c}") for c in own]).agg(*bounds).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("_salt") == F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")  # many rows may share a slot
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    flag = lambda kind: F.coalesce((F.col(f"_{kind}_lo") != F.col("key")) | (F.col(f"_{kind}_hi") != F.col("key")), F.lit(False)).alias(kind)
    out = rows.join(reach, same).select(*rows.columns, *[flag(k) for k in kinds])
    return out.where(" or ".join(kinds))


def _valid() -> Column:
    return ranges_overlap(F.col("a_v_from"), F.col("a_v_to"), F.col("b_v_from"), F.col("b_v_to"))


def blocking_keys(candidates: DataFrame, placed: DataFrame, day: str, valid: bool = False) -> DataFrame:
    """Keys of candidates that would overlap what is placed (or, with its own kin, never): each key once.

    A candidate's rows only meet rows of other keys. An empty plan blocks nothing.
    """
    more = ["v_from", "v_to"] if valid else []
    return met(candidates, placed, day, more, {"blocked": _valid() if valid else F.lit(True)}).select("key").distinct()


def colliding_keys(sessions: DataFrame, exams: DataFrame) -> DataFrame:
    """Every key that is a side of a collision: of weekly sessions (1-5) while both are valid, or of dated exams."""
    weekly = sessions.where(F.col("d").between(1, 5))
    return blocking_keys(weekly, weekly, "d", valid=True).union(blocking_keys(exams, exams, "date")).distinct()


def _grade() -> Column:
    return severity(*[F.col(f"{x}_{c}") for x in "ab" for c in ("s", "e", "assumed")])


def worst_severity(placed: DataFrame) -> DataFrame:
    """The dated exams (key, date, s, e, assumed) that collide, with ``worst``: certain outweighs possible."""
    found = met(placed, placed, "date", ["assumed"], {"certain": _grade() == "certain", "any": F.lit(True)})
    return found.withColumn("worst", F.when(F.col("certain"), "certain").otherwise("possible")).drop("certain", "any")


def collision_counts(placed: DataFrame) -> DataFrame:
    """(date, certain, possible): how many pairs of dated exams of different keys overlap: all pairs less those of one key, by slots."""

    def counted(by: list[str], sign: int) -> DataFrame:
        slots = placed.where("s < e").groupBy(*by, "s", "e", "assumed").agg(F.count("*").alias("n"))
        a, b = _named(slots, "a"), _named(slots, "b")
        place = lambda x: F.struct(*[f"{x}_{c}" for c in ("s", "e", "assumed")])
        on = (place("a") <= place("b")) & (F.col("b_s") < F.col("a_e"))
        for c in by:
            on &= F.col(f"a_{c}") == F.col(f"b_{c}")
        pairs = F.when(place("a") == place("b"), F.expr("a_n * (a_n - 1) div 2")).otherwise(F.col("a_n") * F.col("b_n"))
        return a.join(b, on).select(F.col("a_date").alias("date"), _grade().alias("severity"), (pairs * sign).alias("n"))

    both = counted(["date"], 1).union(counted(["date", "key"], -1))
    sums = [F.coalesce(F.sum(F.when(F.col("severity") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("certain", "possible")]
    return both.groupBy("date").agg(*sums).where("certain + possible > 0")


def merge_slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """Rows (key, d, s, e, prog, room, sem, label, inferred, vision) with equal (key, d, s, e) as one.

    Their values are sets, each value at its first place by ``order``; nulls are left out. What is collected is
    a slot's distinct values, found before by an aggregation of their own.
    """
    slot, kinds = ["key", "d", "s", "e"], {"prog": "progs", "room": "rooms", "sem": "sems", "label": "labels"}
    flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False))).alias(c)
    values = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).cast("string").alias("value")) for c, n in kinds.items()])
    firsts = placed.select(*slot, "inferred", "vision", F.struct(*order).alias("place"), F.inline(values)).groupBy(*slot, "kind", "value").agg(F.min("place").alias("place"), flag("inferred"), flag("vision"))
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == n) & F.col("value").isNotNull(), F.struct("place", "value")))), lambda x: x["value"]).alias(n)
    return firsts.groupBy(*slot).agg(*[listed(n) for n in kinds.values()], flag("inferred"), flag("vision"))


def clusters(rows: DataFrame, day: str) -> DataFrame:
    """``rows`` (s < e) with ``cluster``: the number, within its day, of the run of blocks that overlap one another without a gap.

    Blocks of one start are in one run, so the runs are found on a day's distinct starts, each with its latest
    end, whatever the number of blocks.
    """
    starts = rows.groupBy(day, "s").agg(F.max("e").alias("_e"))
    by = Window.partitionBy(day).orderBy("s")
    before = F.max("_e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("s") >= F.coalesce(before, F.col("s"))).cast("int")
    numbered = starts.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(by)).select(day, "s", "cluster")
    return rows.join(numbered, [day, "s"])


def lane_counts(clustered: DataFrame, day: str) -> DataFrame:
    """(day, cluster, lanes): the most blocks at one time, from a sweep over starts and ends (ends first)."""
    steps = clustered.select(day, "cluster", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("by")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("by")))).alias("x")).select(day, "cluster", "x.*")
    summed = steps.groupBy(day, "cluster", "t").agg(F.sum(F.when(F.col("by") < 0, F.col("by"))).alias("ends"), F.sum(F.when(F.col("by") > 0, F.col("by"))).alias("starts"))
    level = F.sum(F.coalesce("ends", F.lit(0)) + F.coalesce("starts", F.lit(0))).over(Window.partitionBy(day, "cluster").orderBy("t"))
    return summed.withColumn("level", level).groupBy(day, "cluster").agg(F.max("level").alias("lanes"))


def _lane_plan(slots: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(s, e, first rank, first lane, number) for slots (s, e, number of blocks) in order: each block takes the lowest lane whose last block has ended.

    Lanes are dealt with in runs of neighbours, so the work grows with the slots and not with the blocks.
    """
    free: list[tuple[int, int]] = []  # runs of lanes (from, to), in order
    busy: list[tuple[int, int, int]] = []  # (end, from, to)
    lanes, out = 0, []
    for s, e, n in slots:
        while busy and busy[0][0] <= s:
            _, a, b = heappop(busy)
            insort(free, (a, b))
        done = 0
        while done < n:
            if free:
                a, b = free.pop(0)
                take = min(n - done, b - a)
                if take < b - a:
                    free.insert(0, (a + take, b))
            else:
                a, take = lanes, n - done
                lanes += take
            out.append((s, e, done, a, take))
            heappush(busy, (e, a, a + take))
            done += take
    return out


def assign_lanes(clustered: DataFrame, day: str, order: list[str]) -> DataFrame:
    """(day, cluster, *order, s, e, lane): each block in the first lane whose last block has ended by its start, in order of (s, e, *order).

    Blocks of one slot (s, e) fare alike, so lanes are planned for the slots of a cluster and their numbers;
    each block finds its lane by its rank in its slot.
    """
    slots = clustered.groupBy(day, "cluster", "s", "e").agg(F.count("*").alias("n"))
    kind = {c: slots.schema[c].dataType.simpleString() for c in (day, "cluster")}
    names = ["s", "e", "rank", "lane", "n"]

    def plan(key: tuple, t: pa.Table) -> pa.Table:
        rows = _lane_plan(sorted(zip(*(t.column(c).to_pylist() for c in ("s", "e", "n")), strict=True)))
        own = [pa.array([v.as_py()] * len(rows), v.type) for v in key]
        return pa.table([*own, *(pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True))], names=[day, "cluster", *names])

    planned = slots.groupBy(day, "cluster").applyInArrow(plan, ", ".join(f"`{c}` {k}" for c, k in kind.items()) + ", " + ", ".join(f"{c} bigint" for c in names))
    slot = [day, "cluster", "s", "e"]
    ranked, parts = slot_ranks(clustered, slot, order)
    # each part of a slot with the runs of lanes that its ranks fall in
    runs = planned.select(*[F.col(c).alias(f"_{c}") for c in slot], "rank", "lane", "n")
    on = (F.col("_before") < F.col("rank") + F.col("n")) & (F.col("rank") < F.col("_before") + F.col("_rows"))
    for c in slot:
        on &= F.col(c) == F.col(f"_{c}")
    runs = parts.join(runs, on).select(*[F.col(f"_{c}") for c in slot], F.col("_part").alias("_p"), "_before", "rank", "lane", "n")
    on = (F.col("_part") == F.col("_p")) & (F.col("_local") + F.col("_before") >= F.col("rank")) & (F.col("_local") + F.col("_before") < F.col("rank") + F.col("n"))
    for c in slot:
        on &= F.col(c) == F.col(f"_{c}")
    return ranked.join(runs, on).select(day, "cluster", "s", "e", *order, (F.col("lane") + F.col("_local") + F.col("_before") - F.col("rank")).cast("int").alias("lane"))


def slot_ranks(rows: DataFrame, slot: list[str], order: list[str], parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _part and _local, their part of their slot and their rank (from 0) in it, and (slot, _part, _rows, _before): the parts' rows and the rows of the slot's earlier parts.

    A row's rank in its slot by ``order`` is _before + _local. A part is a range of the first column of ``order``, if that is a whole number
    (else there is one), so a slot of any number of rows is ranked in many tasks.
    """
    first, n = order[0], parts or CELLS_A_TASK * _tasks(rows)
    part = F.lit(0)
    if rows.schema[first].dataType.typeName() in ("byte", "short", "integer", "long"):
        low, high = rows.agg(F.min(first), F.max(first)).first()
        if low is not None and high > low:
            part = F.coalesce(F.floor((F.col(first).cast("decimal(20,0)") - low) * n / (high - low + 1)).cast("int"), F.lit(-1))
    placed = rows.withColumn("_part", part)
    local = F.row_number().over(Window.partitionBy(*slot, "_part").orderBy(*order)) - 1
    counts = placed.groupBy(*slot, "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*slot).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_local", local), counts.withColumn("_before", F.coalesce(before, F.lit(0)))


def grid_row(minute: Column, start: int = 540, step: int = 30) -> Column:
    """The row of a week grid at which a time stands, from 1."""
    return F.floor((minute - start) / step).cast("int") + 1


def bar(s: Column, e: Column, day_start: int = 540, day_end: int = 1260, least: float = 4.0) -> Column:
    """struct(left, width): a bar's place in percent of the day, no narrower than ``least``."""
    span = day_end - day_start
    return F.struct(((s - day_start) * 100.0 / span).alias("left"), F.greatest((e - s) * 100.0 / span, F.lit(least)).alias("width"))
