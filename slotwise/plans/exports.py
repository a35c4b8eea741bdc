"""Queries for what is exported and what a plan shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import fuzzy, text
from slotwise.functions.catalogue import candidate_guides, plan_code_pairs
from slotwise.operators import exports as ex
from slotwise.plans.common import PLACED, SESSIONS, placed_exams, placed_sessions, table
from slotwise.plans.scalars import BASE


def _cells() -> tuple[Column, Column]:
    """Each part's plans and codes."""
    k = F.col("p_partkey").cast("string")
    return F.concat(F.lit("10A,20B,"), F.col("p_size").cast("string")), F.concat(k, F.lit(", "), k, F.lit(",7"))


def guide_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each part that are known to exist: those in English of every third, those in Spanish of every second part."""
    p = table(spark, sf_dir, "part")
    link = lambda plan, lang: F.concat(F.lit(f"{BASE}/2026-27/GA_{plan}_"), F.col("p_partkey").cast("string"), F.lit(f"_{lang}_2026-27.pdf")).alias("url")
    verified = p.where("p_partkey % 3 = 0").select(link("10A", "EN")).union(p.where("p_partkey % 2 = 0").select(link("20B", "ES")))
    return ex.verified_guides(p, "p_partkey", candidate_guides(BASE, "2026-27", *_cells()), verified)


def guide_taught_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each part, by its plans and codes."""
    p, code = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string").alias("code")
    known = p.where("p_partkey % 3 = 0").select(F.lit("10A").alias("plan"), code, F.lit("ES").alias("lang")).union(p.where("p_partkey % 2 = 0").select(F.lit("20B"), code, F.lit("EN"))).union(p.select(F.col("p_size").cast("string"), F.lit("7"), F.lit("EN")).where("p_size = 7"))
    return ex.taught_in(p, "p_partkey", plan_code_pairs(*_cells()), known)


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' printed names resolved to brands: alias, split, exact, normalised, prefix, fuzzy within the manufacturer's first digit; declared orphans, and the rest."""
    p, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 9
    raw = F.when(m == 0, "The Alias").when(m == 1, F.concat("p_brand", F.lit(" / Brand#21"))).when(m == 2, F.col("p_brand")).when(m == 3, F.upper("p_brand")).when(m == 4, F.concat(F.lit("HCI: "), "p_brand"))
    raw = raw.when(m == 5, F.concat(F.lit("Brend number "), F.substring("p_brand", 7, 2))).when(m == 6, "Declared").otherwise(F.lit("nobody"))
    targets = p.select(raw.alias("raw"), F.substring("p_brand", 7, 1).alias("block")).distinct().withColumn("n", text.normalise(F.col("raw")))
    items = p.select(F.col("p_brand").alias("item"), F.substring("p_brand", 7, 1).alias("block"), F.concat(F.lit("Brand number "), F.substring("p_brand", 7, 2)).alias("long")).distinct().withColumn("i", text.normalise(F.col("item"))).withColumn("l", text.normalise(F.col("long")))
    alias = spark.createDataFrame([("The Alias", "Brand#11")], "raw string, alias string")
    close = fuzzy.best_match(targets.join(items, "block").select("raw", "item", fuzzy.score(F.col("n"), F.col("l")).alias("score")), "raw", "item", "item").where("outcome in ('accept-high', 'accept-low')")
    steps = [
        ("alias", targets.join(F.broadcast(alias), "raw").join(items, F.col("alias") == F.col("item"))),
        ("split", targets.select("raw", F.explode(F.split("raw", " / ")).alias("part")).where("raw like '% / %'").join(items, F.col("part") == F.col("item"))),
        ("exact", targets.join(items, F.col("raw") == F.col("item"))),
        ("normalised", targets.join(items, F.col("n.full") == F.col("i.full"))),
        ("prefix", targets.select("raw", F.explode("n.candidates").alias("c")).join(items, F.col("c") == F.col("i.full"))),
        ("fuzzy", close),
    ]
    return ex.resolve_names(targets, steps, spark.createDataFrame([("Declared",)], "raw string"), "raw", "item")


def room_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' rooms, with those that a rule gives to a user's kind of event in their place."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.concat(F.lit("R"), (F.col("event_id") % 9).cast("string")).alias("room"))
    rules = e.where("event_type = 'purchase' and user_id % 4 = 0").select("user_id", "event_type", F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("room")).distinct()
    return ex.with_rules(e, rules, ["user_id", "event_type"], "room")


def plan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a plan names: those of customers with orders are kept, the others dropped and reported."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    kept, dropped = ex.known_keys(keys, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")
    return kept.withColumn("state", F.lit("kept")).union(dropped.withColumn("state", F.lit("dropped")))


def exported_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as JSON, with what is optional only where there is something to say."""
    s = placed_sessions(spark, sf_dir)
    col = F.col
    made = ex.session_json(col("prog"), col("sem"), col("d"), col("s"), col("e"), F.when(col("key") % 5 > 0, col("room")), col("label"), col("v_from").cast("string"), col("v_to").cast("string"), F.when(col("inferred"), "inferred").otherwise("rect"), F.when(col("vision"), "vision").otherwise("pdfjs"))
    return s.select("event_id", made.alias("json"))


def exported_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams as JSON."""
    x, col = placed_exams(spark, sf_dir), F.col
    source = F.when(col("assumed"), "slot_default2h").otherwise("explicit_range")
    return x.select("event_id", ex.exam_json(col("date").cast("string"), col("s"), col("e"), F.lit(None).cast("string"), (col("key") % 3).cast("int"), source, F.when(col("key") % 7 == 0, "vision").otherwise("pdfjs")).alias("json"))


def calendar_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as witnesses of orders: what suppliers of one nation say of an order's day beside the order itself."""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("exam_id"), F.date_sub(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("date"), F.col("l_linenumber").cast("int").alias("start_min"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_nationkey") < 5, "E-e").otherwise("E-a").alias("family"))
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exam_id"), F.col("o_custkey").alias("course_id"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("start_min"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_id"), F.col("c_name").alias("name"))
    return ex.witnessed(w, s, e, c).groupBy("name").agg(F.count("*").alias("n"), F.count_if("ok").alias("agree"))


def stale_transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is not the one that was transcribed (every tenth was cut, every seventh is unknown)."""
    d = table(spark, sf_dir, "documents")
    made = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.substring("text", 1, 5)).otherwise(F.col("text")), 256).alias("sha256"))
    return ex.stale(made, d.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")


def clashing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged blocks of the week and whether they clash."""
    return ex.flagged_blocks(placed_sessions(spark, sf_dir), ["event_id"]).select("key", "d", "s", "e", F.size("rooms").alias("rooms"), "clash")


def last_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's distinct slots with the room of the last session."""
    return ex.distinct_slots(placed_sessions(spark, sf_dir), ["key", "d", "s", "e"], ["room", "sem"], ["event_id"])


def plan_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's exams by date."""
    mine = placed_exams(spark, sf_dir).where("key % 25 = 0").select("date", "s", "event_id")
    return ex.exams_by_date(mine, ["s", "event_id"]).select("date", F.array_join(F.transform("exams", lambda x: x["event_id"].cast("string")), ",").alias("exams"))


def plan_assumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a plan's exams end by assumption."""
    x = placed_exams(spark, sf_dir).withColumn("duration_source", F.when(F.col("assumed"), "vision_default2h").otherwise("explicit_range"))
    return ex.assumed_in_plan(x, x.where("key % 25 = 0").select("key"))


def bundle_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a bundle of users, their signups and purchases holds, and the notes beside it."""
    lists = placed_exams(spark, sf_dir).groupBy("key").agg(F.collect_list(F.when(~F.col("assumed"), F.col("event_id"))).alias("sessions"), F.collect_list(F.when(F.col("assumed"), F.col("event_id"))).alias("exams"))
    return ex.totals(lists, table(spark, sf_dir, "events").where("value > 90"))


def derived_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a segment's customers whose clerk's lines count as primary: the five-way join with its parameters."""
    s = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("session_id"), F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("source_id"))
    src = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_nationkey") % 2 == 0, "primary").otherwise("crosscheck").alias("role"), F.when(F.col("s_nationkey") % 3 == 0, "vision").otherwise("pdfjs").alias("method"))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("programme"), F.when(F.col("p_size") % 2 == 0, "1S").otherwise("3S").alias("semester"))
    return ex.derived_sessions(s, src, c, "Brand#11", "1S").select("session_id", "name")


QUERIES = {f.__name__: f for f in (
    guide_verification, guide_taught_in, name_resolution, room_rules, plan_keys, exported_sessions, exported_exams, calendar_agreement, stale_transcriptions, clashing_blocks, last_slots, plan_exams,
    plan_assumed, bundle_totals, derived_sessions,
)}
_LINK = f"'{BASE}/2026-27/GA_' || plan || '_' || p_partkey || '_' || lang || '_2026-27.pdf'"
_VALID = "(a.v_from is null or b.v_from is null or (a.v_from <= b.v_to and b.v_from <= a.v_to))"
ORACLE_SQL = {
    "guide_verification": f"select p_partkey, string_agg({_LINK}, chr(10) order by plan) as guides from (select p_partkey, '10A' as plan, 'EN' as lang from part where p_partkey % 3 = 0 union all select p_partkey, '20B', 'ES' from part where p_partkey % 2 = 0) group by p_partkey",
    "guide_taught_in": "select p_partkey, string_agg(lang, ' + ' order by lang) as languages from (select p_partkey, 'ES' as lang from part where p_partkey % 3 = 0 union select p_partkey, 'EN' from part where p_partkey % 2 = 0 or p_size = 7) group by p_partkey",
    "name_resolution": "with b as (select distinct p_brand as item from part), m as (select distinct p_partkey % 9 as m, p_brand from part), t as (select m, p_brand, case m when 0 then 'The Alias' when 1 then p_brand || ' / Brand#21' when 2 then p_brand when 3 then upper(p_brand) when 4 then 'HCI: ' || p_brand when 5 then 'Brend number ' || substr(p_brand, 7, 2) when 6 then 'Declared' else 'nobody' end as raw from m) select distinct raw, case when m = 0 then 'Brand#11' when m < 6 then x.item end as item, case m when 0 then 'alias' when 1 then 'split' when 2 then 'exact' when 3 then 'normalised' when 4 then 'prefix' when 5 then 'fuzzy' when 6 then 'orphan' else 'unresolved' end as method from t join b x on x.item = p_brand or (m = 1 and x.item = 'Brand#21')",
    "room_rules": "select event_id, user_id, event_type, case when event_type = 'purchase' and user_id % 4 = 0 then 'P' || user_id else 'R' || event_id % 9 end as room from events",
    "plan_keys": "select c_custkey as key, case when exists (select 1 from orders where o_custkey = c_custkey) then 'kept' else 'dropped' end as state from customer",
    "exported_sessions": f"with {SESSIONS} select event_id, '{{\"prog\":\"' || prog || '\",\"sem\":\"' || sem || '\",\"d\":' || d || ',\"s\":' || s || ',\"e\":' || e || ',\"room\":' || case when key % 5 > 0 then '\"' || room || '\"' else 'null' end || case when label is not null then ',\"v\":{{\"label\":\"' || label || '\",\"from\":\"' || v_from || '\",\"to\":\"' || v_to || '\"}}' else '' end || case when inferred then ',\"inferred\":true' else '' end || case when vision then ',\"vision\":true' else '' end || '}}' as json from sessions",
    "exported_exams": f"with {PLACED} select event_id, '{{\"date\":\"' || date || '\",\"s\":' || s || ',\"e\":' || e || ',\"room\":null,\"witnesses\":' || key % 3 || case when assumed then ',\"assumed\":true' else '' end || case when key % 7 = 0 then ',\"vision\":true' else '' end || '}}' as json from placed",
    "calendar_agreement": "select c_name as name, count(*) as n, count(*) filter (where cast(l_shipdate as date) - cast(l_linenumber as int) = cast(o_orderdate as date) and l_linenumber = o_orderkey % 3 + 1) as agree from lineitem join supplier on l_suppkey = s_suppkey and s_nationkey < 5 join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_name",
    "stale_transcriptions": "select doc_id, sha256(substr(text, 1, 5)) as transcribed, sha256(text) as actual from documents where doc_id % 10 = 0 and doc_id % 7 <> 0 and length(text) > 5",
    "clashing_blocks": f"with {SESSIONS}, c as (select distinct a.key, a.d, a.s, a.e from sessions a where a.d <= 5 and exists (select 1 from sessions b where b.d = a.d and b.s < a.e and a.s < b.e and a.key <> b.key and {_VALID})) select key, d, s, e, cast(count(distinct room) as int) as rooms, bool_or(c.key is not null) as clash from sessions left join c using (key, d, s, e) group by 1, 2, 3, 4",
    "last_slots": f"with {SESSIONS} select key, d, s, e, arg_max(room, event_id) as room, arg_max(sem, event_id) as sem from sessions group by 1, 2, 3, 4",
    "plan_exams": f"with {PLACED} select date, string_agg(event_id::varchar, ',' order by s, event_id) as exams from placed where key % 25 = 0 group by date",
    "plan_assumed": f"with {PLACED} select count(*) as exams, count(*) filter (where assumed) as assumed from placed where key % 25 = 0",
    "bundle_totals": f"with {PLACED} select count(distinct key) as courses, cast(count(*) filter (where not assumed) as bigint) as sessions, cast(count(*) filter (where assumed) as bigint) as exams, (select count(*) from events where value > 90) as notes from placed",
    "derived_sessions": "select l_orderkey || '|' || l_linenumber as session_id, p_name as name from lineitem join part on l_partkey = p_partkey and p_brand = 'Brand#11' and p_size % 2 = 0 join supplier on l_suppkey = s_suppkey and s_nationkey % 2 = 0 and s_nationkey % 3 <> 0",
}
