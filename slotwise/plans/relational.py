"""Queries for joins, groupings, set operations and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions.catalogue import is_assumed, strength
from slotwise.operators import relational as op
from slotwise.plans.common import PLACED, placed_exams, table


def programme_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation, how many have open or finished orders, and how many have none: flags are made before the join, so nothing fans out."""
    orders = table(spark, sf_dir, "orders")
    flags = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("open"), F.bool_or(F.col("o_orderstatus") == "F").alias("finished"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(flags, "c_custkey", "left")
    out = rows.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count_if("open").alias("with_open"), F.count_if("finished").alias("with_finished"))
    return out.withColumn("balance", F.col("customers") - F.col("with_finished"))


def anti_orderless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment without a pending order."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return op.missing(c, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, customer, nation and region, summed by region and year."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")  # noqa: E741
    n = F.broadcast(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))  # 25 rows
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "year").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


def witness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the number of their lines (0 where there is none)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("witnesses"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("witnesses", F.lit(0)).alias("witnesses"))


def shared_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that two suppliers or more ship: whether all their lines have one return flag."""
    return op.agreement(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", F.col("l_returnflag"))


def first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order of each status."""
    return op.first_of(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


def exam_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a part and flag as one: suppliers joined, quantities summed, the status of the first."""
    rows = table(spark, sf_dir, "lineitem").withColumn("supplier", F.format_string("%06d", "l_suppkey"))
    m = op.merge_exams(rows, ["l_partkey", "l_returnflag"], "supplier", F.col("l_linenumber"), ["l_orderkey", "l_linenumber"], ["l_linestatus"])
    return m.select("l_partkey", "l_returnflag", F.array_join("groups", ",").alias("suppliers"), "witnesses", "l_linestatus")


def _mixed_case() -> Column:
    """Part names, every other one in capitals, all with a letter that only Unicode folds."""
    return F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" É"))).otherwise(F.concat("p_name", F.lit(" é")))


def course_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as one: first name, types, whether any is large."""
    r = op.roll_up(table(spark, sf_dir, "part").withColumn("p_name", _mixed_case()), F.lower("p_brand"), "p_name", "p_type", F.col("p_size") > 45, ["p_partkey"])
    return r.select("key", "name", F.array_join("groups", ",").alias("types"), F.col("flagged").alias("large"))


def source_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels and labels without documents."""
    return op.account(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def path_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths found, their accents spelt out (as one file system lists them), against those declared with composed letters."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("horarios/"), F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("path"))
    found = p.where("k % 3 <> 0").select(F.concat("path", F.lit(" Ma\u0301ster 2\u00ba.pdf")).alias("path"))
    return op.account(found, p.where("k % 4 <> 0").select(F.concat("path", F.lit(" M\u00e1ster 2\u00ba.pdf")).alias("path")), "path")


def family_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct types of each brand's parts, in order."""
    return op.distinct_list(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "types").select("p_brand", F.array_join("types", ",").alias("types"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash is not the recorded one (recorded for even ids, for every tenth from its lower case; others are not looked up)."""
    d = table(spark, sf_dir, "documents")
    recorded = d.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.lower("text")).otherwise(F.col("text")), 256).alias("expected"))
    return d.select("doc_id", F.sha2("text", 256).alias("sha256")).join(recorded, "doc_id", "left").where("sha256 <> expected").select("doc_id")


def metric_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each language, by metric, against frozen ones."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    measured = op.long_metrics(d, ["lang"], ["documents", "sources"], "actual")
    expected = spark.createDataFrame([(lang, m, n) for lang in ("de", "en", "it") for m, n in (("documents", 150), ("sources", 20))], "lang string, metric string, expected long")
    return op.metric_check(expected, measured, ["lang"])


def duration_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams by the source of their end, most first."""
    return placed_exams(spark, sf_dir).groupBy(F.when(F.col("assumed"), "slot_default2h").otherwise("explicit_range").alias("duration_source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "duration_source")


def assumed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exams, those with an assumed end, and users with one."""
    rows = duration_mix(spark, sf_dir)
    return rows.agg(F.sum("n").alias("exams"), F.sum(F.when(is_assumed(F.col("duration_source")), F.col("n"))).alias("assumed"))


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines out of range, orders that stand twice for a customer and day, and lines and orders without a parent."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    subject = F.concat_ws("|", "l_orderkey", "l_linenumber")
    ranges = op.violations(lines, {"quantity": F.col("l_quantity").between(1, 49), "discount": F.col("l_discount") <= 0.09, "flag": F.col("l_returnflag").isin("A", "N", "R")}, subject)
    twice = op.duplicates(orders, [F.col("o_custkey"), F.to_date("o_orderdate"), F.col("o_orderpriority")], "order_unique")
    orphans = op.orphans(orders, table(spark, sf_dir, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey", "o_orderkey", "order_customer")
    return ranges.union(twice).union(orphans).groupBy("check").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks as diagnostics, and the verdict over them."""
    v = constraint_violations(spark, sf_dir)
    d = v.select(F.when(F.col("check") == "order_customer", "error").otherwise("warn").alias("severity"))
    return op.verdict(d)


def diagnostic_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of two codes as notes."""
    e = table(spark, sf_dir, "events")
    d = e.select(F.when(F.col("value") > 50, "warn").otherwise("info").alias("severity"), F.col("event_type").alias("code"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("subject"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("detail"))
    return op.notes(d, ["purchase", "click"])


def credit_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of each brand over its types, from cells with a decimal comma; null where one conflicts."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("key"), "p_type", F.upper("p_type").alias("english"), F.concat((F.col("p_size") % 4).cast("string"), F.when(F.col("p_partkey") % 5 == 0, ",5 ECTS").otherwise(",5")).alias("credits"))
    broken = p.withColumn("credits", F.when(F.length("p_type") % 7 == 0, "-").otherwise(F.col("credits")))
    return op.credit_sums(broken, "key", "credits", "p_type", "english")


def plan_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over a plan of brands, and how many give none."""
    c = credit_sum(spark, sf_dir).where("key like 'Brand#1%'")
    return c.agg(F.sum("credits").alias("credits"), F.count_if(F.col("credits").isNull()).alias("missing"))


def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by the conjunction of filters: type overlap, any size in the active sizes or none at all, and text."""
    sizes = F.collect_set(F.when(F.col("p_size") < 45, F.col("p_size")))
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"), sizes.alias("sizes"), F.count("*").alias("n"))
    active = F.array(*[F.lit(x) for x in (1, 2, 3, 40)])
    chosen = b.join(table(spark, sf_dir, "part").select(F.explode(F.array("p_type")).alias("t")).distinct().agg(F.slice(F.array_sort(F.collect_set("t")), 1, 5).alias("wanted")), how="cross")  # one row
    on = (F.size("wanted") == 0) | F.arrays_overlap("types", "wanted")
    return chosen.where(on & ((F.size("sizes") == 0) | F.exists("sizes", lambda s: F.array_contains(active, s))) & F.contains(F.lower("p_brand"), F.lit("brand#"))).select("p_brand", "n")


def witness_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's strongest line: the source of a line's figure counts by its strength, equal ones by line number."""
    kinds = ["curated", "explicit_range", "start_override_default2h", "vision_default2h", "slot_default2h"]
    source = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", source.alias("source"))
    return op.strongest(rows, ["l_orderkey"], strength(F.col("source")), ["l_linenumber"])


def exam_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the priority that a curated list gives their customer in place of their own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    curated = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), F.lit("0-CURATED").alias("o_orderpriority"))
    return op.override(o, curated, ["o_custkey"], ["o_orderpriority"])


def truth_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late purchases against signups by exact day, start and end of the first hour: matched or not."""
    p = placed_exams(spark, sf_dir)
    derived = p.where(~F.col("assumed")).select("date", "s", F.lit(True).alias("hit")).distinct()
    return p.where(F.col("assumed") & (F.col("s") >= 900)).join(derived, ["date", "s"], "left").groupBy("date").agg(F.count("*").alias("blocks"), F.count_if("hit").alias("matched"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who purchase, sign up, do both or one only."""
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id").distinct()
    a, b = of("purchase"), of("signup")
    parts = [("union", a.union(b).distinct()), ("both", a.intersect(b)), ("purchase_only", a.subtract(b)), ("bag", a.union(b))]
    out = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def nocase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names numbered in order without regard to case."""
    names = table(spark, sf_dir, "part").select(_mixed_case().alias("name"), "p_brand").distinct()
    return names.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(op.nocase(F.col("name")), "name")))


def top_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three priced orders of each customer and how many more there are."""
    o = table(spark, sf_dir, "orders")
    ranked = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("n <= 3")
    best = ranked.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("n", F.col("o_orderkey").cast("string").alias("k")))).alias("x"))
    counts = o.groupBy("o_custkey").agg(F.greatest(F.count("*") - 3, F.lit(0)).cast("int").alias("more"))
    return best.join(counts, "o_custkey").select("o_custkey", F.array_join(F.transform("x", lambda r: r["k"]), ",").alias("first"), "more")


def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest order and its margin over the next."""
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(by)).withColumn("next", F.lead("o_totalprice").over(by)).where("n = 1")
    return o.select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.col("next"), 2).alias("margin"))


def offering_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands matched to parts by name, by plain name or by a curated extra, and disambiguated by size."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("row_id"), F.array(F.lower("p_brand"), F.concat(F.lit("t"), F.col("p_size").cast("string"))).alias("name_keys"))
    keys = p.select(F.lower("p_brand").alias("key")).distinct()
    courses = keys.withColumn("plain_key", F.concat(F.lit("t"), F.regexp_extract("key", r"(\d)$", 1)))
    extras = keys.where("key like '%1'").withColumn("extra_key", F.lit("t50"))
    m = op.match_offerings(courses, rows, extras).join(p.select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("name_key"), (F.col("p_size") % 3).cast("double").alias("credits"), F.array(F.col("p_brand")).alias("plans")), "row_id")
    preferred = keys.where("key like '%2'").withColumn("prefer", F.array(F.concat(F.lit("B"), F.substring("key", 2, 100))))
    out = op.disambiguate(m.select("key", "name_key", "row_id", "credits", "plans"), preferred)
    return out.groupBy("key").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"), F.sum("row_id").alias("ids"))


def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts resolved to brands by alias, then exact name, then without case, then without a prefix."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("x: "), F.lower("p_brand"))).when(F.col("p_partkey") % 4 == 1, F.lower("p_brand")).when(F.col("p_partkey") % 7 == 0, F.lit("The Alias")).when(F.col("p_partkey") % 11 == 0, F.lit("nobody")).otherwise(F.col("p_brand")).alias("raw"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("item")).distinct()
    alias = spark.createDataFrame([("The Alias", "Brand#11")], "raw string, alias string")
    by = lambda left, right: p.withColumn("k", left).join(brands.withColumn("k", right), "k").select("p_partkey", "item")
    lower = F.lower(F.col("item"))
    steps = [
        ("alias", p.join(F.broadcast(alias), "raw").join(brands, F.col("alias") == F.col("item")).select("p_partkey", "item")),
        ("exact", by(F.col("raw"), F.col("item"))),
        ("normalised", by(F.lower("raw"), lower)),
        ("prefix", by(F.regexp_extract(F.lower("raw"), r"^\w+:\s*(.+)$", 1), lower)),
    ]
    return op.resolve(p, steps, "p_partkey", "item")


def nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a customer with its orders inside; those without any are dropped."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("orders"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), "orders")).alias("document"), F.size("orders").alias("n"))


EXAM_SOURCE = "select case when assumed then 'slot_default2h' else 'explicit_range' end as duration_source, count(*) as n from placed group by 1"
CHECKS = """checks as (
 select 'quantity' as "check", concat(l_orderkey, '|', l_linenumber) as subject from lineitem where not (l_quantity between 1 and 49)
 union all select 'discount', concat(l_orderkey, '|', l_linenumber) from lineitem where not (l_discount <= 0.09)
 union all select 'flag', concat(l_orderkey, '|', l_linenumber) from lineitem where l_returnflag not in ('A', 'N', 'R')
 union all select 'order_unique', concat(o_custkey, '|', cast(o_orderdate as date), '|', o_orderpriority) from orders group by 2 having count(*) > 1
 union all select 'order_customer', cast(o_orderkey as varchar) from orders o where o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_acctbal > 0))"""
CREDITS = """cells as (select concat(p_brand, '/', p_size) as key, lower(p_type) as offering, case when length(p_type) % 7 = 0 then '-' else concat(p_size % 4, ',5') end as c from part),
 each_ as (select key, offering, min(try_cast(replace(c, ',', '.') as double)) as lo, max(try_cast(replace(c, ',', '.') as double)) as hi from cells group by 1, 2),
 summed as (select key, case when not bool_or(lo <> hi) then sum(lo) end as credits from each_ where lo is not null group by 1),
 credit as (select k.key, s.credits from (select distinct key from cells) k left join summed s using (key))"""

QUERIES = {f.__name__: f for f in (
    programme_balance, anti_orderless, star_join, witness_counts, shared_agreement, first_dedupe, exam_merge, course_rollup, source_accounting, path_accounting, family_lists, manifest_check, metric_expectations,
    duration_mix, assumed_share, constraint_violations, quality_verdict, diagnostic_notes, credit_sum, plan_credits, catalogue_filter, witness_merge, exam_overrides, truth_blocks,
    set_operations, nocase_order, top_slots, runner_up, offering_match, resolution_cascade, nested_export,
)}
ORACLE_SQL = {
    "programme_balance": "select n_name, count(distinct c_custkey) as customers, count(distinct case when o_orderstatus = 'O' then c_custkey end) as with_open, count(distinct case when o_orderstatus = 'F' then c_custkey end) as with_finished, count(distinct c_custkey) - count(distinct case when o_orderstatus = 'F' then c_custkey end) as balance from nation join customer on n_nationkey = c_nationkey left join orders on o_custkey = c_custkey group by n_name",
    "anti_orderless": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "star_join": "select r_name, cast(year(o_orderdate) as int) as year, count(*) as lines, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "witness_counts": "select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as witnesses from orders",
    "shared_agreement": "select l_partkey, count(distinct l_suppkey) as groups, count(distinct l_returnflag) as versions, count(distinct l_returnflag) = 1 as ok from lineitem group by 1 having count(distinct l_suppkey) >= 2",
    "first_dedupe": "select o_custkey, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as n from orders) where n = 1",
    "exam_merge": "select l_partkey, l_returnflag, array_to_string(list_sort(list(distinct printf('%06d', l_suppkey))), ',') as suppliers, cast(sum(l_linenumber) as bigint) as witnesses, arg_min(l_linestatus, l_orderkey * 100 + l_linenumber) as l_linestatus from lineitem group by 1, 2",
    "course_rollup": "with p as (select lower(p_brand) as key, case when p_partkey % 2 = 0 then upper(p_name) || ' É' else p_name || ' é' end as name, p_type, p_size, p_partkey from part), o as (select *, row_number() over (partition by key order by translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), name, p_partkey) as n from p), t as (select key, p_type, min(n) as n from o group by 1, 2) select key, (select name from o where o.key = x.key and n = 1) as name, (select string_agg(p_type, ',' order by n) from t where t.key = x.key) as types, large from (select key, bool_or(p_size > 45) as large from p group by 1) x",
    "source_accounting": "select coalesce(d.doc_id, l.doc_id) as doc_id, case when d.doc_id is null then 'missing' else 'undeclared' end as problem from (select distinct doc_id from documents) d full outer join (select distinct doc_id from labels) l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null",
    "path_accounting": "select 'horarios/' || p_name || ' ' || p_partkey || ' M\u00e1ster 2\u00ba.pdf' as path, case when p_partkey % 3 = 0 then 'missing' else 'undeclared' end as problem from part where (p_partkey % 3 = 0) <> (p_partkey % 4 = 0)",
    "family_lists": "select p_brand, array_to_string(list_sort(list(distinct p_type)), ',') as types from part group by 1",
    "manifest_check": "select doc_id from documents where doc_id % 10 = 0 and sha256(text) <> sha256(lower(text))",
    "metric_expectations": "select e.lang, e.metric, e.expected, m.actual, coalesce(e.expected = m.actual, false) as ok from (select l.lang, x.metric, x.expected from (values ('de'), ('en'), ('it')) l(lang), (values ('documents', 150::bigint), ('sources', 20::bigint)) x(metric, expected)) e left join (select lang, 'documents' as metric, count(*) as actual from documents group by 1 union all select lang, 'sources', count(distinct source) from documents group by 1) m using (lang, metric)",
    "duration_mix": f"with {PLACED} {EXAM_SOURCE} order by n desc",
    "assumed_share": f"with {PLACED}, mix as ({EXAM_SOURCE}) select cast(sum(n) as bigint) as exams, cast(sum(n) filter (where duration_source like '%default2h') as bigint) as assumed from mix",
    "constraint_violations": f'with {CHECKS} select "check", count(*) as n, min(subject) as first_subject from checks group by 1',
    "quality_verdict": f"with {CHECKS}, d as (select case when \"check\" = 'order_customer' then 'error' else 'warn' end as severity from (select distinct \"check\" from checks)) select count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warn') as warnings, count(*) filter (where severity = 'error') = 0 as passed from d",
    "diagnostic_notes": "select event_type as code, case when user_id % 2 = 0 then concat('user ', user_id, ': ') else '' end || concat('event ', event_id) as note from events where value > 50 and event_type in ('purchase', 'click')",
    "credit_sum": f"with {CREDITS} select key, credits from credit",
    "plan_credits": f"with {CREDITS} select sum(credits) as credits, count(*) filter (where credits is null) as missing from credit where key like 'Brand#1%'",
    "catalogue_filter": "select p_brand, count(*) as n from part group by 1 having list_has_any(list(distinct p_type), (select list(t) from (select distinct p_type as t from part order by 1 limit 5))) and (count(*) filter (where p_size < 45) = 0 or bool_or(p_size in (1, 2, 3, 40))) and lower(p_brand) like '%brand#%'",
    "witness_merge": "select l_orderkey, l_linenumber, ['curated', 'explicit_range', 'start_override_default2h', 'vision_default2h', 'slot_default2h'][k + 1] as source from (select *, l_suppkey % 5 as k, row_number() over (partition by l_orderkey order by l_suppkey % 5, l_linenumber) as n from lineitem) where n = 1",
    "exam_overrides": "select o_orderkey, o_custkey, case when c_custkey is not null then '0-CURATED' else o_orderpriority end as o_orderpriority, c_custkey is not null as curated from orders left join customer on c_custkey = o_custkey and c_acctbal > 9000",
    "truth_blocks": f"with {PLACED} select date, count(*) as blocks, count(*) filter (where exists (select 1 from placed b where not b.assumed and b.date = a.date and b.s = a.s)) as matched from placed a where assumed and s >= 900 group by date",
    "set_operations": "with a as (select distinct user_id from events where event_type = 'purchase'), b as (select distinct user_id from events where event_type = 'signup') select 'union' as part, count(*) as n from (select * from a union select * from b) union all select 'both', count(*) from (select * from a intersect select * from b) union all select 'purchase_only', count(*) from (select * from a except select * from b) union all select 'bag', (select count(*) from a) + (select count(*) from b)",
    "nocase_order": "select name, p_brand, cast(row_number() over (partition by p_brand order by translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), name) as int) as place from (select distinct case when p_partkey % 2 = 0 then upper(p_name) || ' É' else p_name || ' é' end as name, p_brand from part)",
    "top_slots": "select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by n) filter (where n <= 3) as first, cast(greatest(count(*) - 3, 0) as int) as more from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) group by 1",
    "runner_up": "select o_custkey, o_orderkey, round(o_totalprice - nxt, 2) as margin from (select *, row_number() over w as n, lead(o_totalprice) over w as nxt from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)) where n = 1",
    "offering_match": "with p as (select * from part), k as (select distinct lower(p_brand) as key from p), m as (select distinct k.key, p.p_partkey as row_id, p.p_type as name_key, (p_size % 3)::double as credits, p_brand = 'B' || substr(k.key, 2) and k.key like '%2' as mine from k join p on lower(p_brand) = k.key or p_size = cast(right(k.key, 1) as int) or (k.key like '%1' and p_size = 50)), g as (select *, count(distinct credits) over (partition by key, name_key) as v, count(distinct case when mine then credits end) over (partition by key, name_key) as kept from m) select key, count(*) as n, count(*) filter (where v > 1 and kept <> 1) as ambiguous, cast(sum(row_id) as bigint) as ids from g where not (v > 1 and kept = 1) or mine group by key",
    "resolution_cascade": "with p as (select p_partkey, case when p_partkey % 4 = 0 then 'x: ' || lower(p_brand) when p_partkey % 4 = 1 then lower(p_brand) when p_partkey % 7 = 0 then 'The Alias' when p_partkey % 11 = 0 then 'nobody' else p_brand end as raw from part), b as (select distinct p_brand as item from part), f as (select p_partkey, 'Brand#11' as item, 0 as r, 'alias' as method from p where raw = 'The Alias' and exists (select 1 from b where item = 'Brand#11') union all select p_partkey, item, 1, 'exact' from p join b on raw = item union all select p_partkey, item, 2, 'normalised' from p join b on lower(raw) = lower(item) union all select p_partkey, item, 3, 'prefix' from p join b on regexp_extract(lower(raw), '^\\w+:\\s*(.+)$', 1) = lower(item)) select p.p_partkey, x.item, coalesce(x.method, 'unresolved') as method from p left join (select *, row_number() over (partition by p_partkey order by r, item) as n from f) x on x.p_partkey = p.p_partkey and n = 1",
    "nested_export": "select c_custkey, '{\"name\":\"' || c_name || '\",\"orders\":[' || string_agg(concat('{\"k\":', o_orderkey, ',\"s\":\"', o_orderstatus, '\"}'), ',' order by o_orderkey) || ']}' as document, cast(count(*) as int) as n from customer join orders on o_custkey = c_custkey group by c_custkey, c_name",
}
