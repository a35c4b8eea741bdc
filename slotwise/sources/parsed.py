"""The store of parsed sources: every run's outcomes, and a control table that says which run each source's rows are of.

A run writes its outcomes once, rows and diagnostics apart. The control table then has a new build (``versions``), in which each source of the run
points to it if it was parsed, also when it has no row now, and to where it pointed before if it failed. So a source that breaks
keeps what it had, an emptied one is empty, and other sources are not touched or copied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.outcomes import failed_sources
from slotwise.sources import versions

#: run: that of the source's rows (null: it was never parsed); last_run: that of its diagnostics.
CONTROL = "source string, run string, last_run string, rows long, errors long, warnings long, status string"


def control(spark: SparkSession, path: str) -> DataFrame:
    """A row a source, see ``CONTROL``."""
    if "control" in versions.tables(spark, path):
        return versions.read(spark, path, "control")
    return spark.createDataFrame([], CONTROL)


def write_outcomes(outcomes: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Store a run's outcomes (source, kind, row, problem) of these ``sources`` (source); the control rows of the run.

    ``sources`` are all that the run was to parse: one without any outcome was parsed and is empty. A source of which
    there is an outcome is one of them even if it is not named.
    """
    spark, run = outcomes.sparkSession, uuid.uuid4().hex
    at = f"{path}/runs/run={run}"
    try:
        outcomes.withColumn("source", F.col("source").cast("string")).write.partitionBy("kind").parquet(at)
        made = spark.read.schema(_plain(outcomes)).parquet(at)
        asked = sources.select(F.col("source").cast("string")).union(made.select("source")).distinct()
        status = asked.join(failed_sources(made), "source", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        status = status.select("source", F.lit(run).alias("last_run"), zero("rows"), zero("errors"), zero("warnings"), F.coalesce("status", F.lit("parsed")).alias("status"))
        old = control(spark, path)
        before = old.select("source", F.col("run").alias("_before"))
        mine = status.join(before, "source", "left").withColumn("run", F.when(F.col("status") == "parsed", F.lit(run)).otherwise(F.col("_before")))
        merged = mine.select(*old.columns).unionByName(old.join(status.select("source"), "source", "left_anti"))
        versions.publish(spark, path, {"control": merged})
    except BaseException:
        versions.delete(spark, at)
        raise
    return control(spark, path).where(F.col("last_run") == run)


def _plain(outcomes: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {'string' if f.name == 'source' else f.dataType.simpleString()}" for f in outcomes.schema)


def _runs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("basePath", f"{path}/runs").parquet(f"{path}/runs").where(F.col("kind") == kind)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """Each source's rows, of the last run that parsed it: source and the fields of the rows."""
    at = control(spark, path).where("run is not null").select("source", "run")
    return _runs(spark, path, "row").join(at, ["source", "run"], "left_semi").select("source", "row.*")


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Each source's diagnostics, of the last run that tried it."""
    at = control(spark, path).select("source", F.col("last_run").alias("run"))
    return _runs(spark, path, "problem").join(at, ["source", "run"], "left_semi").select("source", "problem.*")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the runs that no source points to; how many. Not while a run is being written."""
    used = control(spark, path).select(F.explode(F.array("run", "last_run")).alias("run")).distinct()
    there = spark.createDataFrame([(n.split("=", 1)[1],) for n in versions._names(spark, f"{path}/runs") if n.startswith("run=")], "run string")
    gone = [r[0] for r in there.join(used, "run", "left_anti").collect()]
    for run in gone:
        versions.delete(spark, f"{path}/runs/run={run}")
    return len(gone)
