"""Queries for the column functions, on cells made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import catalogue, fuzzy, lessons, text, times
from slotwise.functions.binding import let, pin
from slotwise.plans.common import table


def _pick(options: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(by, F.lit(len(options))) + 1).cast("int"))


def _sql_list(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def _values(options: dict[str, object]) -> str:
    """A SQL table of (raw, ...) from expected values."""
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(lit(x) for x in (k, *(v if isinstance(v, tuple) else (v,)))) + ")" for k, v in options.items()) + ")"


def _minutes() -> Column:
    return F.hour("ts") * 60 + F.minute("ts")


def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's time as HH:MM."""
    return table(spark, sf_dir, "events").select("event_id", times.fmt_min(_minutes()).alias("at"))


def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's time printed in one of five notations and read again."""
    m = _minutes()
    h, mm = F.floor(m / 60).cast("int"), F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0")
    half = F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string")
    shapes = F.array(F.concat_ws(":", h.cast("string"), mm), F.concat(h.cast("string"), F.lit("."), mm, F.lit(" h.")), F.concat(half, F.lit(":"), mm, F.when(h >= 12, " PM").otherwise(" AM")), F.concat(h.cast("string"), F.lit("h")), F.concat(F.lit("at "), mm))
    raw = F.element_at(shapes, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", times.parse_time(raw).alias("parsed"), times.parse_time_input(raw).alias("typed"))


RANGES = {"15:00 - 16:00": (900, 960), "10-12h.": (600, 720), "9:30 to 11:00": (570, 660), "10:00 to 9:00": (None, None), "7:00 PM - 8:30 PM": (1140, 1230), "noon": (None, None), "12.15–13.45": (735, 825)}


def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges in several notations."""
    raw = table(spark, sf_dir, "events").select("event_id", let(times.parse_time_range(_pick(list(RANGES), F.col("event_id"))), lambda r: r).alias("r"))
    return raw.select("event_id", "r.start_min", "r.end_min")


def weekday_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's weekday, printed date, the date a week on, and the number of working days of its month's first ten."""
    d = F.to_date("o_orderdate")
    work = times.weekdays_between(F.trunc(d, "month"), F.date_add(F.trunc(d, "month"), 9))
    return table(spark, sf_dir, "orders").select("o_orderkey", times.weekday_of(d).alias("weekday"), times.fmt_date(d).alias("printed"), F.date_add(d, 7).alias("next_week"), F.size(work).alias("working"))


DATES = {"12-January": "2027-01-12", "MONDAY 11": "2027-01-11", "Miércoles 20": "2027-01-20", "TUESDAY 11": None, "3 febrero": "2027-02-03", "someday": None}
NAMES_OF_DAYS = {"Lunes": 1, "TUESDAY": 2, " miércoles ": 3, "jueves.": 4, "Friday": 5, "sábado": None}


def exam_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed dates and weekday names."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", times.parse_exam_date(_pick(list(DATES), k)).alias("date"), times.parse_weekday(_pick(list(NAMES_OF_DAYS), k)).alias("weekday"))


WINDOWS = {"Weeks 1-7": ("2026-09-07", "2026-10-25"), "sep-oct": ("2026-09-01", "2026-10-31"), "nov-ene": ("2026-11-01", "2027-01-31"), "Weeks 10-30": ("2026-11-09", "2027-01-08"), "always": (None, None)}


def validity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity labels as windows, and whether two of them meet."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", times.resolve_validity(_pick(list(WINDOWS), k)).alias("a"), times.resolve_validity(_pick(list(WINDOWS), F.floor(k / 5))).alias("b"))
    return rows.select("event_id", F.col("a.from").alias("a_from"), F.col("a.to").alias("a_to"), times.ranges_overlap(F.col("a.from"), F.col("a.to"), F.col("b.from"), F.col("b.to")).alias("meet"))


def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The working days of the events' span and the events of each."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    spine = e.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(times.weekdays_between(F.col("a"), F.col("b"))).alias("date"))
    return spine.join(e, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


#: What is printed behind a text, and what is left of it in canonical form.
PRINTED = {" (10:00 to 12:00)": "", " 12:00 h.": "", " (Weeks 1-7)": "", " (*)": "", " ///": "", " Tiếng Việt № Ⅱ": " tieng viet no ii", "\u00a0ﬁn & Co\u2011op E-Mail": " fin and co op email", "": ""}


def normalised_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical key and core tokens of every document with something printed behind it."""
    raw = F.concat("text", _pick(list(PRINTED), F.col("doc_id")))
    n = pin(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), n=text.normalise(F.col("raw")))
    return n.select("doc_id", F.col("n.key").alias("key"), F.array_join("n.tokens", " ").alias("tokens"))


def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name with a letter dropped, matched to the names as they are that share a token with it, or nearly."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("item")).distinct()
    dropped = F.concat(F.substring("item", 1, 4), F.substring("item", 6, 100))
    items = names.select("item", text.normalise(F.col("item")).alias("b"))
    targets = names.select(dropped.alias("target")).distinct().select("target", text.normalise(F.col("target")).alias("a"))
    scored = fuzzy.candidates(targets, items).select("target", "item", fuzzy.score(F.col("a"), F.col("b")).alias("score"))
    best = targets.select("target").join(fuzzy.best_match(scored, "target", "item", "item"), "target", "left")
    return best.select("target", "item", "runner_up", F.round("score.total", 6).alias("total"), F.round("margin", 6).alias("margin"), F.coalesce("outcome", F.lit("none")).alias("outcome"))


def name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of neighbouring parts' names, and its share of the longer."""
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    d = F.levenshtein("p_name", "other")
    return p.join(other, "p_partkey").select("p_partkey", d.alias("distance"), F.round(1 - d / F.greatest(F.length("p_name"), F.length("other")), 6).alias("lev"))


ANNOTATED = {
    "%s (10:00 to 12:00)": ("explicitRange", 600, 720, None), "%s 12:00 h.": ("startOverride", 720, None, None), "%s (Weeks 1-7)": ("weekRange", None, None, "Weeks 1-7"), "%s (sep - oct)": ("dateRange", None, None, "sep-oct"),
    "%s (elective)": ("elective", None, None, None), "%s ///": ("placeholder", None, None, None), "%s *": ("star", None, None, None), "%s": (None, None, None, None), "%s (*)": ("elective", None, None, None),
}


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with something printed beside them, taken apart."""
    raw = F.replace(_pick(list(ANNOTATED), F.col("p_partkey")), F.lit("%s"), F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.strip_annotations(raw).alias("x")).select("p_partkey", F.col("x.name").alias("name"), F.try_element_at("x.annotations", F.lit(1)).alias("a"))
    return rows.select("p_partkey", "name", "a.kind", "a.start_min", "a.end_min", "a.label")


ROOM_LINES = {"Aula  6202": "6202", "Rooms 5001 - 5005": "5001-5005", "[H-1004]": "H-1004", "(Classroom 3 B)": "3B", "Room for improvement": None, "Data 101": None}
FILLERS = {"Actividades de evaluación": "filler", "Uso  extraordinario": "filler", "Complementary and evaluation activities": "filler", " / / ": "filler", "Scientific Research": "course", "Complementary studies": "course"}
PATHS = {"timetables/Máster X/foo bar.PDF": "timetables--master-x--foo-bar", "a/b.pdf": "a--b", "Ñandú (1).pdf": "nandu-1", "x.y-z": "x.y-z"}


def names_and_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room lines, filler names and file slugs."""
    k = F.col("p_partkey")
    room = text.extract_room(F.array(F.lit("A course"), _pick(list(ROOM_LINES), k), F.lit("of two lines")))
    return table(spark, sf_dir, "part").select("p_partkey", room.alias("room"), text.classify_block(_pick(list(FILLERS), k)).alias("kind"), text.slug(_pick(list(PATHS), k)).alias("slug"))


def exam_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When exams run, by what is printed beside their names and by their slots."""
    p = table(spark, sf_dir, "part").select("p_partkey", text.strip_annotations(F.replace(_pick(list(ANNOTATED), F.col("p_partkey")), F.lit("%s"), F.col("p_name"))).alias("x"), F.when(F.col("p_partkey") % 2 == 0, 540).otherwise(630).alias("slot"))
    vision = F.when(F.col("p_partkey") % 5 == 0, 800)
    t = p.select("p_partkey", catalogue.derive_exam_time(F.col("x.annotations"), F.col("slot"), F.col("slot") + 150, vision, F.when(F.col("p_partkey") % 10 == 0, 890)).alias("t"))
    return t.select("p_partkey", "t.*", catalogue.is_assumed(F.col("t.duration_source")).alias("assumed"), catalogue.strength(F.col("t.duration_source")).alias("strength"))


CREDITS = {"4,5": "4.5", "3": "3", " 6 ECTS": "6", "-": None, "": None, "1,5abc": "1.5"}


def credit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit cells as numbers, and cleaned cells."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", catalogue.credit_value(_pick(list(CREDITS), k)).alias("credits"), catalogue.clean_cell(F.when(k % 3 == 0, "#REF!").when(k % 3 == 1, F.concat(F.lit("  "), "p_type", F.lit(" ")))).alias("cell"))


BASE = "https://example.org/guides"


def plan_code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists of plans and codes as pairs, their links, and the pair and label read back from one."""
    k = F.col("p_partkey").cast("string")
    plans, codes = F.concat(F.lit("10A, "), k, F.lit(",10A,20B")), F.concat(F.lit("103,x"), k, F.lit(", 103 ,7"))
    rows = table(spark, sf_dir, "part").select("p_partkey", catalogue.plan_code_pairs(plans, codes).alias("pairs"), catalogue.candidate_guides(BASE, "2026-27", plans, codes).alias("urls"))
    last = F.element_at("urls", -1)
    return rows.select("p_partkey", F.array_join(F.transform("pairs", lambda x: F.concat_ws("|", x["plan"], x["code"])), ",").alias("pairs"), F.array_join("urls", " ").alias("urls"), catalogue.guide_pair(last)["code"].alias("code"), catalogue.guide_label(last)["language"].alias("language"))


GUIDES = {"Idioma: Español": "ES", "LANGUAGE | English": "EN", "Language\\nInglés": "EN", "language skills\\nnone\\nIDIOMA\\nspanish": "ES", "slanguage english": None, "Lengua": None}


def guide_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teaching language that guides' lines name, and the union by residue of the ids, as it is joined to courses."""
    lines = F.split(F.replace(_pick(list(GUIDES), F.col("p_partkey")), F.lit("\\n"), F.lit("\n")), "\n")
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 9).alias("plan"), catalogue.guide_language(lines).alias("lang"))
    return rows.groupBy("plan").agg(F.array_join(F.array_sort(F.collect_set("lang")), " + ").alias("languages"))


def custom_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons through a link's value and back; those off the grid or out of bounds are dropped."""
    k = F.col("p_partkey")
    one = lambda name, shift: F.struct(name.alias("name"), (k % 6).cast("int").alias("day"), (F.lit(480 + shift) + k % 8 * 30).cast("int").alias("start"), (F.lit(600 + shift) + k % 8 * 30).cast("int").alias("end"), F.when(k % 2 == 0, F.concat(F.lit("R~"), k.cast("string"))).alias("room"))
    value = lessons.encode(F.array(one(F.col("p_name"), 0), one(F.concat("p_name", F.lit(" (ñ) é+1'|")), 30)))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(lessons.decode(value)).alias("l"))
    return rows.select("p_partkey", "l.id", "l.name", "l.day", "l.start", "l.end", "l.room")


M = "cast(extract(hour from ts) * 60 + extract(minute from ts) as int)"
HM = f"select event_id, {M} as m, {M} // 60 as h, printf('%02d', {M} % 60) as mm from events"


def _joined(options: dict, columns: str, key: str, table_: str, select: str) -> str:
    return f"select {select} from (select {key} as id, {_sql_list(list(options))}[cast({key} % {len(options)} as int) + 1] as raw from {table_}) t join {_values(options)} v({columns}) using (raw)"


QUERIES = {f.__name__: f for f in (time_format, time_parse, time_ranges, weekday_date, exam_dates, validity_overlap, date_spine, normalised_key, fuzzy_best_match, name_distance, annotations, names_and_rooms, exam_timing, credit_values, plan_code_pairs, guide_languages, custom_lessons)}
ANNOTATIONS = f"a as (select p_partkey, p_name, v.* exclude (raw) from (select p_partkey, p_name, {_sql_list(list(ANNOTATED))}[cast(p_partkey % {len(ANNOTATED)} as int) + 1] as raw from part) join {_values(ANNOTATED)} v(raw, kind, start_min, end_min, label) using (raw))"
#: For names of at most two tokens, none a stopword: tokens meet as in ``fuzzy.shared_tokens``, pairs as in ``fuzzy.candidates``.
FUZZY = """with n as (select distinct p_name as item from part), i as (select item, lower(item) as f, list_distinct(list_filter(string_split(lower(item), ' '), lambda t: t <> '')) as t from n),
 a as (select distinct substr(item, 1, 4) || substr(item, 6) as target from n), t as (select target, trim(regexp_replace(lower(target), ' +', ' ', 'g')) as f, list_distinct(list_filter(string_split(lower(target), ' '), lambda t: t <> '')) as t from a),
 ik as (select distinct item, unnest(list_concat([w], case when length(w) >= 5 then list_transform(range(1, length(w) + 1), lambda k: substr(w, 1, k - 1) || substr(w, k + 1)) else [] end)) as key from (select item, unnest(t) as w from i)),
 tk as (select distinct target, unnest(list_concat([w], case when length(w) >= 5 then list_transform(range(1, length(w) + 1), lambda k: substr(w, 1, k - 1) || substr(w, k + 1)) else [] end)) as key from (select target, unnest(t) as w from t)),
 c as (select distinct target, item from tk join ik using (key)),
 s as (select target, item, t.f as ft, i.f as fi, t.t as a, i.t as b, list_filter(i.t, lambda x: not list_contains(t.t, x)) as free, len(list_filter(t.t, lambda x: list_contains(i.t, x))) as n from c join t using (target) join i using (item)),
 h as (select *, list_filter(free, lambda x: x = a[1] or (least(length(a[1]), length(x)) >= 5 and abs(length(a[1]) - length(x)) <= 1 and levenshtein(a[1], x) <= 1))[1] as h1 from s),
 g as (select *, list_filter(list_filter(free, lambda x: h1 is null or x <> h1), lambda x: len(a) > 1 and (x = a[2] or (least(length(a[2]), length(x)) >= 5 and abs(length(a[2]) - length(x)) <= 1 and levenshtein(a[2], x) <= 1)))[1] as h2 from h),
 m as (select *, n + case when n = least(len(a), len(b)) then 0 else (h1 is not null)::int + (h2 is not null)::int end as shared from g),
 p as (select target, item, 1 - levenshtein(ft, fi) / greatest(length(ft), length(fi), 1)::double as lev, shared / (len(a) + len(b) - shared)::double as ts, shared / least(len(a), len(b))::double as cont from m),
 w as (select *, 0.45::double * lev + 0.25::double * ts + 0.25::double * cont + 0.05::double * 0 as total from p),
 r as (select *, row_number() over o as k, lead(total) over o as next, lead(item) over o as runner_up from w window o as (partition by target order by total desc, item)),
 b as (select *, total - next as margin from r where k = 1)
 select t.target, item, runner_up, round(total, 6) as total, round(margin, 6) as margin, case when total >= 0.93 and coalesce(margin, 1e9) >= 0.06 then 'accept-high' when total >= 0.8 and coalesce(margin, 1e9) < 0.12 then 'ambiguous' when total >= 0.8 and cont >= 0.85 then 'accept-low' else 'none' end as outcome from t left join b using (target)"""
ORACLE_SQL = {
    "time_format": f"select event_id, printf('%02d:%02d', {M} // 60, {M} % 60) as at from events",
    "time_parse": f"select event_id, cast(case event_id % 5 when 3 then h * 60 when 4 then null else m end as int) as parsed, cast(case when event_id % 5 = 0 then m end as int) as typed from ({HM})",
    "time_ranges": _joined(RANGES, "raw, start_min, end_min", "event_id", "events", "id as event_id, start_min, end_min"),
    "weekday_date": "select o_orderkey, cast(isodow(o_orderdate) as int) as weekday, strftime(o_orderdate, '%a %-d %b') as printed, cast(o_orderdate as date) + 7 as next_week, cast(len(list_filter(generate_series(date_trunc('month', o_orderdate)::timestamp, date_trunc('month', o_orderdate)::timestamp + interval 9 day, interval 1 day), lambda d: isodow(d) < 6)) as int) as working from orders",
    "exam_dates": f"select a.event_id, cast(a.date as date) as date, b.weekday from ({_joined(DATES, 'raw, date', 'event_id', 'events', 'id as event_id, date')}) a join ({_joined(NAMES_OF_DAYS, 'raw, weekday', 'event_id', 'events', 'id as event_id, weekday')}) b using (event_id)",
    "validity_overlap": f"with w as (select row_number() over () - 1 as k, raw, a_from::date as f, a_to::date as t from {_values(WINDOWS)} v(raw, a_from, a_to)), o as (select list_position({_sql_list(list(WINDOWS))}, raw) - 1 as k, f, t from w) select event_id, a.f as a_from, a.t as a_to, a.f is null or b.f is null or (a.f <= b.t and b.f <= a.t) as meet from events join o a on a.k = event_id % 5 join o b on b.k = (event_id // 5) % 5",
    "date_spine": "with e as (select cast(ts as date) as date, count(*) as n from events group by 1) select cast(d as date) as date, coalesce(n, 0) as n from (select unnest(generate_series((select min(date) from e)::timestamp, (select max(date) from e)::timestamp, interval 1 day)) as d) s left join e on e.date = s.d where isodow(d) < 6",
    "normalised_key": f"with raw as (select doc_id, text, {_sql_list(list(PRINTED))}[cast(doc_id % {len(PRINTED)} as int) + 1] as raw from documents), d as (select doc_id, text || ' ' || clean as text from raw join {_values(PRINTED)} v(raw, clean) using (raw)), n as (select doc_id, trim(regexp_replace(regexp_replace(replace(replace(trim(regexp_replace(replace(replace(strip_accents(lower(text)), '&', ' and '), '-', ' '), '\\s+', ' ', 'g')), 'e health', 'ehealth'), 'e mail', 'email'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as f from d) select doc_id, replace(f, ' ', '-') as key, array_to_string(list_filter(string_split(f, ' '), lambda t: t <> '' and t not in ({', '.join(repr(w) for w in text.STOPWORDS)})), ' ') as tokens from n",
    "fuzzy_best_match": FUZZY,
    "name_distance": "select a.p_partkey, cast(levenshtein(a.p_name, b.p_name) as int) as distance, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) as lev from part a join part b on b.p_partkey = a.p_partkey + 1",
    "annotations": f"with {ANNOTATIONS} select p_partkey, p_name as name, kind, start_min, end_min, label from a",
    "names_and_rooms": f"select a.p_partkey, room, kind, slug from ({_joined(ROOM_LINES, 'raw, room', 'p_partkey', 'part', 'id as p_partkey, room')}) a join ({_joined(FILLERS, 'raw, kind', 'p_partkey', 'part', 'id as p_partkey, kind')}) b using (p_partkey) join ({_joined(PATHS, 'raw, slug', 'p_partkey', 'part', 'id as p_partkey, slug')}) c using (p_partkey)",
    "exam_timing": f"with {ANNOTATIONS}, s as (select *, case when p_partkey % 2 = 0 then 540 else 630 end as slot, case when kind = 'explicitRange' then 1 when kind = 'startOverride' then 2 when p_partkey % 10 = 0 then 3 when p_partkey % 5 = 0 then 4 else 5 end as how from a) select p_partkey, cast(case how when 1 then start_min when 2 then start_min when 5 then slot else 800 end as int) as start_min, cast(case how when 1 then end_min when 2 then start_min + 120 when 3 then 890 when 4 then 920 else slot + 120 end as int) as end_min, ['explicit_range', 'start_override_default2h', 'explicit_range', 'vision_default2h', 'slot_default2h'][how] as duration_source, how = 1 and (start_min < slot or end_min > slot + 150) as outside_slot, how in (2, 4, 5) as assumed, [4, 3, 4, 2, 1][how] as strength from s",
    "credit_values": f"select id as p_partkey, credits::double as credits, case when id % 3 = 1 then trim(p_type) else '' end as cell from (select p_partkey as id, p_type, {_sql_list(list(CREDITS))}[cast(p_partkey % {len(CREDITS)} as int) + 1] as raw from part) join {_values(CREDITS)} v(raw, credits) using (raw)",
    "plan_code_pairs": f"select p_partkey, '10A|103,20B|7' as pairs, array_to_string(list_transform(['10A_103_EN', '10A_103_ES', '20B_7_EN', '20B_7_ES'], lambda x: '{BASE}/2026-27/GA_' || x || '_2026-27.pdf'), ' ') as urls, '7' as code, 'Spanish' as language from part",
    "guide_languages": f"select plan, coalesce(array_to_string(list_sort(list(distinct lang) filter (where lang is not null)), ' + '), '') as languages from (select p_partkey % 9 as plan, {_sql_list(list(GUIDES))}[cast(p_partkey % {len(GUIDES)} as int) + 1] as raw from part) join {_values(GUIDES)} v(raw, lang) using (raw) group by plan",
    "custom_lessons": "select p_partkey, 'shared-' || i as id, case i when 0 then p_name else p_name || ' (ñ) é+1''|' end as name, cast(p_partkey % 6 as int) as day, cast(480 + 30 * i + p_partkey % 8 * 30 as int) as start, cast(600 + 30 * i + p_partkey % 8 * 30 as int) as \"end\", case when p_partkey % 2 = 0 then 'R~' || p_partkey end as room from part, (values (0), (1)) v(i) where p_partkey % 6 between 1 and 5 and 480 + 30 * i + p_partkey % 8 * 30 >= 540 and 600 + 30 * i + p_partkey % 8 * 30 <= 1260",
}
