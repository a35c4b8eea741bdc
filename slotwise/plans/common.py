"""Tables, and the intervals that the schedule queries take from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt to the session's tasks: what is made of a row (a page, say) takes far longer than to read it, and a file of few bytes is read by one task."""
    return table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def placed_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases (their end assumed, two hours) and signups (an hour) as dated intervals of users."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    s = (F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30) * 30).cast("int")
    assumed = F.col("event_type") == "purchase"
    return e.select("event_id", F.col("user_id").alias("key"), F.to_date("ts").alias("date"), s.alias("s"), (s + F.when(assumed, 120).otherwise(60)).alias("e"), assumed.alias("assumed"))


PLACED = """placed as (select event_id, user_id as key, cast(ts as date) as date, cast(30 * floor((extract(hour from ts) * 60 + extract(minute from ts)) / 30) as int) as s,
 cast(30 * floor((extract(hour from ts) * 60 + extract(minute from ts)) / 30) as int) + case when event_type = 'purchase' then 120 else 60 end as e, event_type = 'purchase' as assumed
 from events where event_type in ('purchase', 'signup'))"""


def placed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signups by weekday; those of two thirds of the users are valid for a part of the term only."""
    p = placed_exams(spark, sf_dir).where(~F.col("assumed"))
    cut = F.col("key") % 3
    return p.select(
        "event_id", "key", (F.weekday("date") + 1).alias("d"), "s", "e",
        F.when(cut == 1, F.lit("2024-01-01")).when(cut == 2, F.lit("2024-03-01")).cast("date").alias("v_from"),
        F.when(cut == 1, F.lit("2024-02-29")).when(cut == 2, F.lit("2024-05-31")).cast("date").alias("v_to"),
        F.concat(F.lit("P"), (F.col("key") % 6).cast("string")).alias("prog"), F.concat(F.lit("R"), (F.col("event_id") % 9).cast("string")).alias("room"),
        F.when(F.col("key") % 2 == 0, "1S").otherwise("3S").alias("sem"), F.when(cut > 0, F.concat(F.lit("v"), cut.cast("string"))).alias("label"),
        (F.col("event_id") % 5 == 0).alias("inferred"), (F.col("event_id") % 7 == 0).alias("vision"),
    )


SESSIONS = PLACED + """, sessions as (select event_id, key, cast(isodow(date) as int) as d, s, e,
 case key % 3 when 1 then date '2024-01-01' when 2 then date '2024-03-01' end as v_from, case key % 3 when 1 then date '2024-02-29' when 2 then date '2024-05-31' end as v_to,
 'P' || cast(key % 6 as varchar) as prog, 'R' || cast(event_id % 9 as varchar) as room, case when key % 2 = 0 then '1S' else '3S' end as sem,
 case when key % 3 > 0 then 'v' || cast(key % 3 as varchar) end as label, event_id % 5 = 0 as inferred, event_id % 7 = 0 as vision from placed where not assumed)"""
