"""An extension beyond batch: exams that arrive as a stream, checked against a plan and counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.operators.intervals import severity


def stream_conflicts(arriving: DataFrame, plan: DataFrame) -> DataFrame:
    """Arriving exams (key, date, s, e, assumed, ts) beside the planned ones that they overlap, graded. The plan is a batch table."""
    p = plan.select(*[F.col(c).alias(f"p_{c}") for c in ("key", "date", "s", "e", "assumed")])
    on = (F.col("date") == F.col("p_date")) & (F.col("s") < F.col("p_e")) & (F.col("p_s") < F.col("e")) & (F.col("key") != F.col("p_key"))
    both = arriving.join(p, on)
    grade = severity(F.col("s"), F.col("e"), F.col("assumed"), F.col("p_s"), F.col("p_e"), F.col("p_assumed"))
    return both.withColumn("severity", grade)


def conflicts_by_window(conflicts: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Conflicts of each window of arrival by severity; rows later than ``late`` behind the newest are dropped by the watermark."""
    return conflicts.withWatermark("ts", late).groupBy(F.window("ts", size).alias("window"), "severity").count()
