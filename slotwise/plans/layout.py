"""Queries for page geometry, on axes made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.operators import geometry as geo
from slotwise.plans.common import parts, table


def _minutes() -> F.Column:
    return F.hour("ts") * 60 + F.minute("ts")


def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: a new one after more than a day without an event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("t"))
    i = geo.gap_islands(e, "user_id", "t", "t", F.lit(86400), ["event_id"])
    return i.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of text of each user, by an anchor rule on the minute of their day."""
    run = F.struct((_minutes() / 4.0).alias("y"), F.col("value").alias("x"), F.lit(5.0).alias("w"), F.col("event_type").alias("text"))
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    lines = pages.select("user_id", F.posexplode(geo.group_lines(F.col("runs"))).alias("line", "l"))
    return lines.select("user_id", "line", F.round("l.y", 6).alias("y"), F.size("l.runs").alias("n"), F.size(geo.split_by_gaps(F.col("l.runs"), 10.0)).alias("segments"))


def voronoi_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands around the distinct hours of each user's purchases."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.collect_set(F.hour("ts").cast("double")).alias("ys"))
    b = e.select("user_id", F.posexplode(geo.bands_from_labels(F.col("ys"), F.lit(24.0), F.lit(0.0))).alias("k", "b"))
    return b.select("user_id", "k", "b.y0", "b.y1")


def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of six hours given to the nearest of four labels: all of them, in order."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct((24.0 - (k + 1) * 3.0).alias("y0"), (24.0 - k * 3.0).alias("y1")))
    labels = F.array(*[F.struct((F.lit(21.0 - 6 * k) + F.col("user_id") % 3).alias("y"), F.lit(f"L{k}").alias("value")) for k in range(4)])
    users = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", geo.labels_of_bands(bands, labels).alias("x"))
    return users.select("user_id", F.array_join("x.values", ",").alias("labels"), F.col("x.error").alias("error"))


def discontinuities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of which the next of the order does not follow by one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("next", F.lead("l_linenumber").over(w)).where("next <> l_linenumber + 1").select("l_orderkey", "l_linenumber", "next")


def rect_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of rectangles from part sizes of each brand, and the widest rectangle over a line. A rectangle that stands twice changes neither, so distinct ones are gathered."""
    r = F.struct((F.col("p_size") * 10.0).alias("y"), F.lit(0.0).alias("x"), (F.col("p_partkey") % 50 * 1.0).alias("w"), (F.lit(8.0) + F.col("p_partkey") % 9).alias("h"), F.lit(None).cast("string").alias("fill"))
    p = table(spark, sf_dir, "part").select("p_brand", r.alias("r")).distinct().groupBy("p_brand").agg(F.array_sort(F.collect_list("r")).alias("rects"))
    structural = F.filter("rects", lambda x: geo.is_structural(x["fill"], x["w"], x["h"]))
    return p.select("p_brand", F.size(geo.bands_from_rects(structural)).alias("bands"), F.coalesce(geo.widest_rect(F.col("rects"), F.lit(255.0))["w"], F.lit(-1.0)).alias("widest"))


def column_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, snapped edges and spans of parts' positions in a grid of six, and the widest free run."""
    edges = F.array(*[F.lit(x) for x in (0.0, 40.0, 80.0, 130.0, 170.0, 220.0, 260.0)])
    x, w = F.col("p_partkey") % 300 * 1.0, F.col("p_size") * 3.0
    span = geo.span_of_rect(x, w, edges)
    return table(spark, sf_dir, "part").select("p_partkey", geo.column_of(x, edges).alias("col"), geo.snap(x, edges, F.lit(14.0)).alias("snapped"), span["a"].alias("a"), span["b"].alias("b"), geo.free_span(F.lit(6), F.array((F.col("p_partkey") % 6).cast("int"), (F.col("p_size") % 6).cast("int")))["a"].alias("free_a"))


def span_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two blocks a band, in a grid of five with a gap after the third column."""
    edges = F.array(*[F.lit(40.0 * k) for k in range(6)])
    block = lambda c, width: F.struct((c * 1.0).alias("centre"), (width * 1.0).alias("width"))
    k = F.col("p_partkey")
    bands = parts(spark, sf_dir).select("p_partkey", F.array(block(k % 97 + 3, F.col("p_size") + 10), block(k % 89 + 105, F.col("p_size") * 2)).alias("blocks"), edges.alias("edges"), F.array(F.lit(2)).alias("gaps"), F.lit(0).alias("first"), F.lit(4).alias("last"))
    out = geo.assign_spans(bands, ["p_partkey"])
    return out.select("p_partkey", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["a"].cast("string"), s["b"].cast("string"))), ",").alias("spans"), F.round("cost", 6).alias("cost"), F.round("margin", 6).alias("margin"))


def nearest_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle, and the value at a quarter of the sorted, of each user's values."""
    return geo.middles(table(spark, sf_dir, "events"), ["user_id"], "value", 0.25).select("user_id", F.round("middle", 6).alias("median"), F.round("percentile", 6).alias("p25"))


QUERIES = {f.__name__: f for f in (gap_islands, line_clusters, voronoi_bands, nearest_label, discontinuities, rect_bands, column_grid, span_inference, nearest_median)}
SPANS = """p as (select p_partkey, (p_partkey % 97 + 3)::double as c1, (p_size + 10)::double as w1, (p_partkey % 89 + 105)::double as c2, (p_size * 2)::double as w2 from part),
 s as (select a.k as a, b.k as b, (a.k * 40.0 + (b.k + 1) * 40.0) / 2 as centre, (b.k + 1 - a.k) * 40.0 as width from (select unnest(range(5)) as k) a join (select unnest(range(5)) as k) b on b.k >= a.k where not (a.k <= 2 and b.k > 2)),
 c as (select p_partkey, 1 as n, a, b, abs(c1 - centre) + greatest(0, w1 - width) as cost from p, s where width >= w1 * 0.82 union all select p_partkey, 2, a, b, abs(c2 - centre) + greatest(0, w2 - width) from p, s where width >= w2 * 0.82),
 d as (select p_partkey, n, a, b, cost from c union all select p_partkey, 1, 0, 4, 1e4 + abs(c1 - 100) from p where not exists (select 1 from c where c.p_partkey = p.p_partkey and n = 1) union all select p_partkey, 2, 0, 4, 1e4 + abs(c2 - 100) from p where not exists (select 1 from c where c.p_partkey = p.p_partkey and n = 2)),
 j as (select x.p_partkey, concat(x.a, '-', x.b, ',', y.a, '-', y.b) as spans, x.cost + y.cost as cost from d x join d y on x.p_partkey = y.p_partkey and x.n = 1 and y.n = 2 and y.a > x.b),
 r as (select *, row_number() over w as n, lead(cost) over w - cost as margin from j window w as (partition by p_partkey order by cost, spans)),
 o as (select *, row_number() over (partition by p_partkey, n order by cost, a, b) as k from d)"""
ORACLE_SQL = {
    "line_clusters": "with recursive e as (select user_id, (extract(hour from ts) * 60 + extract(minute from ts)) / 4.0::double as y, value as x, event_type as t, row_number() over (partition by user_id order by y desc, value, event_type) as n from events), w as (select user_id, n, x, t, y, y as anchor, 0 as line from e where n = 1 union all select e.user_id, e.n, e.x, e.t, e.y, case when abs(e.y - w.anchor) <= 2 then w.anchor else e.y end, case when abs(e.y - w.anchor) <= 2 then w.line else w.line + 1 end from w join e on e.user_id = w.user_id and e.n = w.n + 1), g as (select *, case when x - lag(x + 5.0) over (partition by user_id, line order by x, y, t) <= 10.0 then 0 else 1 end as cut from w) select user_id, line, round(max(anchor), 6) as y, cast(count(*) as int) as n, cast(sum(cut) as int) as segments from g group by user_id, line",
    "rect_bands": "with recursive r as (select p_brand, p_size * 10.0::double as y, (p_partkey % 50)::double as w, (8 + p_partkey % 9)::double as h from part), o as (select p_brand, y as y0, y + h as y1, row_number() over (partition by p_brand order by y + h desc, y desc) as n from r where w >= 6 and h >= 6), f as (select p_brand, n, y0, y1, 1 as bands from o where n = 1 union all select o.p_brand, o.n, case when least(f.y1, o.y1) - greatest(f.y0, o.y0) > 0.8 * least(f.y1 - f.y0, o.y1 - o.y0) then least(f.y0, o.y0) else o.y0 end, case when least(f.y1, o.y1) - greatest(f.y0, o.y0) > 0.8 * least(f.y1 - f.y0, o.y1 - o.y0) then greatest(f.y1, o.y1) else o.y1 end, case when least(f.y1, o.y1) - greatest(f.y0, o.y0) > 0.8 * least(f.y1 - f.y0, o.y1 - o.y0) then bands else bands + 1 end from f join o on o.p_brand = f.p_brand and o.n = f.n + 1) select p_brand, cast(max(bands) as int) as bands, coalesce((select max(w) from r where r.p_brand = f.p_brand and y <= 255 and y + h >= 255), -1.0) as widest from f group by p_brand",
    "gap_islands": "with e as (select user_id, event_id, cast(floor(epoch(ts)) as bigint) as t from events), f as (select *, case when t - lag(t) over w <= 86400 then 0 else 1 end as x from e window w as (partition by user_id order by t, event_id)), i as (select *, cast(sum(x) over (partition by user_id order by t, event_id) as bigint) as island from f) select user_id, island, count(*) as n, min(t) as first_t, max(t) as last_t from i group by 1, 2",
    "voronoi_bands": "with y as (select distinct user_id, cast(extract(hour from ts) as double) as y from events where event_type = 'purchase') select user_id, cast(row_number() over w - 1 as int) as k, coalesce((y + lead(y) over w) / 2, 0.0) as y0, coalesce((lag(y) over w + y) / 2, 24.0) as y1 from y window w as (partition by user_id order by y desc)",
    "nearest_label": "with b as (select u.user_id, k, 24.0 - k * 3.0 - 1.5 as mid from (select distinct user_id from events) u, range(8) t(k)), n as (select user_id, k, arg_min(j, abs(21.0 - 6 * j + user_id % 3 - mid) * 100 + j) as j from b, range(4) t(j) group by 1, 2) select user_id, string_agg('L' || j, ',' order by k) as labels, cast(null as varchar) as error from n group by 1",
    "discontinuities": "select * from (select l_orderkey, l_linenumber, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber) as next from lineitem) where next <> l_linenumber + 1",
    "column_grid": "with e as (select * from (values (0, 0.0), (1, 40.0), (2, 80.0), (3, 130.0), (4, 170.0), (5, 220.0), (6, 260.0)) t(k, x)), p as (select p_partkey, p_size, (p_partkey % 300)::double as x, (p_partkey % 300 + p_size * 3)::double as r from part), n as (select p.*, (select arg_min(k, abs(e.x - p.x) * 100 + k) from e) as kx, (select min(abs(e.x - p.x)) from e) as dx, (select arg_min(k, abs(e.x - p.r) * 100 + k) from e) as kr, (select min(abs(e.x - p.r)) from e) as dr, (select count(*) from e where e.x <= p.x) as c from p), f as (select p_partkey, k, k - row_number() over (partition by p_partkey order by k) as g from part, range(6) t(k) where k <> p_partkey % 6 and k <> p_size % 6), w as (select p_partkey, arg_min(a, -n * 100 + a) as a from (select p_partkey, min(k) as a, count(*) as n from f group by p_partkey, g) group by 1) select p_partkey, cast(least(greatest(c - 1, 0), 5) as int) as col, cast(case when dx <= 14 then kx end as int) as snapped, cast(case when dx <= 14 and dr <= 14 and kr - 1 >= kx then kx end as int) as a, cast(case when dx <= 14 and dr <= 14 and kr - 1 >= kx then kr - 1 end as int) as b, cast(w.a as int) as free_a from n left join w using (p_partkey)",
    "span_inference": f"with {SPANS} select p_partkey, spans, round(cost, 6) as cost, round(margin, 6) as margin from r where n = 1 union all select x.p_partkey, concat(x.a, '-', x.b, ',', y.a, '-', y.b), round(x.cost + y.cost, 6), 0.0 from o x join o y using (p_partkey) where x.n = 1 and y.n = 2 and x.k = 1 and y.k = 1 and not exists (select 1 from j where j.p_partkey = x.p_partkey)",
    "nearest_median": "with r as (select user_id, value, row_number() over (partition by user_id order by value) as k, count(*) over (partition by user_id) as n from events) select user_id, round(median(value), 6) as median, round(max(case when k = least(n, cast(floor(n * 0.25) as int) + 1) then value end), 6) as p25 from r group by 1",
}
