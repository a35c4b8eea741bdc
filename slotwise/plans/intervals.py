"""Queries on dated and weekly intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import times
from slotwise.operators import intervals as iv
from slotwise.plans.common import PLACED, SESSIONS, placed_exams, placed_sessions

SEVERITY = "case when b.s < case when a.assumed then a.s + 1 else a.e end and a.s < case when b.assumed then b.s + 1 else b.e end then 'certain' else 'possible' end"
EXAM_PAIRS = f"exam_pairs as (select a.event_id as a_id, b.event_id as b_id, a.key as a_key, b.key as b_key, a.date as date, a.s as a_s, a.e as a_e, b.s as b_s, b.e as b_e, {SEVERITY} as severity from placed a join placed b on a.date = b.date and (a.s < b.s or (a.s = b.s and a.event_id < b.event_id)) and b.s < a.e and a.key <> b.key)"
SESSION_PAIRS = "session_pairs as (select a.event_id as a_id, b.event_id as b_id, a.key as a_key, b.key as b_key, a.d as d from sessions a join sessions b on a.d = b.d and a.d <= 5 and (a.s < b.s or (a.s = b.s and a.event_id < b.event_id)) and b.s < a.e and a.key <> b.key and (a.v_from is null or b.v_from is null or (a.v_from <= b.v_to and b.v_from <= a.v_to)))"


def exam_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated overlaps, certain or possible."""
    c = iv.exam_collisions(placed_exams(spark, sf_dir), ["event_id"])
    return c.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), "a_key", "b_key", F.col("a_date").alias("date"), "a_s", "a_e", "b_s", "b_e", "severity")


def exam_collision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of each date by severity."""
    return iv.collision_counts(placed_exams(spark, sf_dir))


def exam_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity of each exam that collides: certain outweighs possible."""
    return iv.worst_severity(placed_exams(spark, sf_dir)).select("event_id", "worst")


def session_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly overlaps while both are valid, counted by weekday and pair of programmes' keys."""
    return iv.session_counts(placed_sessions(spark, sf_dir), ["event_id"])


def colliding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in any collision of either kind."""
    return iv.colliding_keys(placed_sessions(spark, sf_dir), placed_exams(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    exams, sessions = placed_exams(spark, sf_dir), placed_sessions(spark, sf_dir)
    mine = F.col("key") % 75 == 0
    return exams.where(mine), exams.where(~mine), sessions.where(mine), sessions.where(~mine)


def blocks_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose exams or first-semester sessions would clash with those of the chosen users."""
    exams, others, sessions, more = _plan(spark, sf_dir)
    active = F.col("sem") == "1S"
    by_session = iv.blocking_keys(more.where(active & F.col("d").between(1, 5)), sessions.where(active), "d", valid=True)
    return iv.blocking_keys(others, exams, "date").union(by_session).distinct()


def fits_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other users that would clash with none."""
    _, others, _, _ = _plan(spark, sf_dir)
    return others.select("key").distinct().join(blocks_plan(spark, sf_dir), "key", "left_anti")


MEETS = "c.s < p.e and p.s < c.e and c.key <> p.key"
BLOCKING = f"""blocking as (select distinct c.key as key from placed c where c.key % 75 <> 0 and exists (select 1 from placed p where p.key % 75 = 0 and p.date = c.date and {MEETS})
 union select distinct c.key from sessions c where c.key % 75 <> 0 and c.sem = '1S' and c.d <= 5 and exists (select 1 from sessions p where p.key % 75 = 0 and p.sem = '1S' and p.d = c.d and {MEETS} and (c.v_from is null or p.v_from is null or (c.v_from <= p.v_to and p.v_from <= c.v_to))))"""


def preview_occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' sessions that start where a chosen user's does (same day and start, whatever the length)."""
    _, _, mine, others = _plan(spark, sf_dir)
    return others.select("event_id", "d", "s").join(mine.select("d", "s").distinct(), ["d", "s"], "left_semi")


def slot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal slots of a user as one."""
    m = iv.merge_slots(placed_sessions(spark, sf_dir), ["event_id"])
    joined = [F.array_join(c, ",").alias(c) for c in ("progs", "rooms", "sems", "labels")]
    return m.select("key", "d", "s", "e", *joined, "inferred", "vision")


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.clusters(placed_exams(spark, sf_dir).where(~F.col("assumed")), "date")


def overlap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of overlapping blocks of each date."""
    return _clustered(spark, sf_dir).groupBy("date", "cluster").agg(F.count("*").alias("blocks"), F.min("s").alias("first_s"), F.max("e").alias("last_e"))


def lane_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lanes each run needs."""
    return iv.lane_counts(_clustered(spark, sf_dir), "date")


def lane_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's lane."""
    return iv.assign_lanes(_clustered(spark, sf_dir), "date", ["event_id"]).select("date", "cluster", "event_id", "s", "e", "lane")


def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exam's row in the grid, its bar and its printed range."""
    b = iv.bar(F.col("s"), F.col("e"))
    return placed_exams(spark, sf_dir).select("event_id", iv.grid_row(F.col("s")).alias("grid_row"), F.round(b["left"], 4).alias("bar_left"), F.round(b["width"], 4).alias("bar_width"), F.regexp_replace(times.fmt_range(F.col("s"), F.col("e"), F.col("assumed")), "–", "-").alias("label"), times.on_grid(F.col("s")).alias("on_grid"))


CLUSTERED = PLACED + """, flagged as (select *, case when s >= coalesce(max(e) over (partition by date order by s, e, event_id rows between unbounded preceding and 1 preceding), s) then 1 else 0 end as f from placed where not assumed),
clustered as (select *, cast(sum(f) over (partition by date order by s, e, event_id) as bigint) as cluster from flagged)"""

QUERIES = {f.__name__: f for f in (exam_collisions, exam_collision_summary, exam_worst, session_collisions, colliding_keys, blocks_plan, fits_plan, preview_occupied, slot_merge, overlap_clusters, lane_count, lane_assignment, grid_layout)}
ORACLE_SQL = {
    "exam_collisions": f"with {PLACED}, {EXAM_PAIRS} select * from exam_pairs",
    "exam_collision_summary": f"with {PLACED}, {EXAM_PAIRS} select date, count(*) filter (where severity = 'certain') as certain, count(*) filter (where severity = 'possible') as possible from exam_pairs group by date",
    "exam_worst": f"with {PLACED}, {EXAM_PAIRS} select event_id, case when max(c) = 1 then 'certain' else 'possible' end as worst from (select a_id as event_id, case when severity = 'certain' then 1 else 0 end as c from exam_pairs union all select b_id, case when severity = 'certain' then 1 else 0 end from exam_pairs) group by event_id",
    "session_collisions": f"with {SESSIONS}, {SESSION_PAIRS} select d, a_key, count(*) as n, count(distinct b_key) as others from session_pairs group by d, a_key",
    "colliding_keys": f"with {SESSIONS}, {EXAM_PAIRS}, {SESSION_PAIRS} select a_key as key from session_pairs union select b_key from session_pairs union select a_key from exam_pairs union select b_key from exam_pairs",
    "blocks_plan": f"with {SESSIONS}, {BLOCKING} select key from blocking",
    "fits_plan": f"with {SESSIONS}, {BLOCKING} select distinct key from placed where key % 75 <> 0 and not exists (select 1 from blocking b where b.key = placed.key)",
    "preview_occupied": f"with {SESSIONS} select event_id, d, s from sessions c where key % 75 <> 0 and exists (select 1 from sessions p where p.key % 75 = 0 and p.d = c.d and p.s = c.s)",
    "slot_merge": f"with {SESSIONS}, v as (" + " union all ".join(f"select key, d, s, e, '{c}' as kind, {c} as v, min(event_id) as first from sessions group by 1, 2, 3, 4, 5, 6" for c in ("prog", "room", "sem", "label")) + "), flags as (select key, d, s, e, bool_or(inferred) as inferred, bool_or(vision) as vision from sessions group by 1, 2, 3, 4) select key, d, s, e, " + ", ".join(f"coalesce(string_agg(v, ',' order by first, v) filter (where kind = '{c}' and v is not null), '') as {c}s" for c in ("prog", "room", "sem", "label")) + ", any_value(inferred) as inferred, any_value(vision) as vision from v join flags using (key, d, s, e) group by 1, 2, 3, 4",
    "overlap_clusters": f"with {CLUSTERED} select date, cluster, count(*) as blocks, min(s) as first_s, max(e) as last_e from clustered group by date, cluster",
    "lane_count": f"with {CLUSTERED}, steps as (select date, cluster, t, sum(c) as by_t from (select date, cluster, s as t, 1 as c from clustered union all select date, cluster, e, -1 from clustered) group by date, cluster, t), levels as (select date, cluster, sum(by_t) over (partition by date, cluster order by t) as level from steps) select date, cluster, cast(max(level) as bigint) as lanes from levels group by date, cluster",
    "lane_assignment": f"with recursive {CLUSTERED}, items as (select *, row_number() over (partition by date, cluster order by s, e, event_id) as r from clustered), lanes as (select date, cluster, event_id, s, e, r, [e] as ends, 0 as lane from items where r = 1 union all select i.date, i.cluster, i.event_id, i.s, i.e, i.r, case when free = 0 then list_append(ends, i.e) else list_transform(ends, lambda x, k: case when k = free then i.e else x end) end, case when free = 0 then len(ends) else free - 1 end from (select l.*, coalesce(list_position(list_transform(l.ends, lambda x: x <= n.s), true), 0) as free from lanes l join items n on n.date = l.date and n.cluster = l.cluster and n.r = l.r + 1) l join items i on i.date = l.date and i.cluster = l.cluster and i.r = l.r + 1) select date, cluster, event_id, s, e, cast(lane as int) as lane from lanes",
    "grid_layout": f"with {PLACED} select event_id, cast(floor((s - 540) / 30.0) as int) + 1 as grid_row, round((s - 540) * 100.0 / 720, 4)::double as bar_left, round(greatest((e - s) * 100.0 / 720, 4.0), 4)::double as bar_width, printf('%02d:%02d', s // 60, s % 60) || '-' || case when assumed then '~' else '' end || printf('%02d:%02d', e // 60, e % 60) as label, s % 30 = 0 as on_grid from placed",
}
