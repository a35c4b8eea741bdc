"""Reading documents: extractions, parsed artefacts, curation maps, catalogues, bundles and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import lessons
from slotwise.functions.binding import strip
from slotwise.functions.catalogue import clean_cell
from slotwise.sources import schemas


def read_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row a JSON document (a file each), with its path; unknown fields and comments are passed over."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, sha256) of the files of a folder; contents are hashed where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, rects): the positioned text and rectangles of extraction documents; blank runs are left out.

    A missing or empty list gives no rows. Manifest files (without a source path) are passed over.
    """
    docs = read_documents(spark, path, schemas.EXTRACTION).where("source.path is not null")
    runs = docs.select(F.col("source.path").alias("source"), F.inline("runs")).where("trim(text) <> ''")
    rects = docs.select(F.col("source.path").alias("source"), F.inline("rects"))
    return runs, rects


def read_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, exams, diagnostics) of parsed artefacts; of several files for one source the last by path counts."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("sourcePath").orderBy(F.desc("file")))
    docs = read_documents(spark, path, schemas.PARSED).where("sourcePath is not null").withColumn("_n", last).where("_n = 1")
    keys = ["sourcePath", "layoutFamily", "extractionMethod", "programme"]
    sessions = docs.where("kind = 'timetable'").select(*keys, "semester", F.inline("sessions"))
    exams = docs.where("kind = 'exam'").select(*keys, F.inline("exams"))
    diagnostics = docs.select(F.inline("diagnostics"))
    return sessions, exams, diagnostics


def read_map(spark: SparkSession, path: str, schema: str, column: str) -> DataFrame:
    """(key, value) of a curation map, one row an entry; keys that start with $ are comments."""
    return read_documents(spark, path, schema).select(F.explode(column).alias("key", "value")).where(~F.startswith("key", F.lit("$")))


def read_catalogue(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of semicolon catalogues by the names in their headers (any case, any order, any further columns).

    Quoted cells may hold line breaks and doubled quotes; a missing column is empty; broken cells are empty; rows
    that are blank throughout are left out.
    """
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        raw = spark.read.option("sep", ";").option("quote", '"').option("escape", '"').option("multiLine", True).option("header", True).csv(path)
        at = {c.strip().lstrip("﻿").lower(): c for c in reversed(raw.columns)}
        some = F.greatest(*[F.length(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) for c in raw.columns], F.lit(0)) > 0
        cells = [clean_cell(F.col(f"`{at[k]}`") if k in at else F.lit("")).alias(n) for k, n in schemas.CATALOGUE.items()]
        rows = raw.where(some).select(*cells)
        out = rows if out is None else out.unionByName(rows)
    return out


def masters(rows: DataFrame) -> DataFrame:
    return rows.where(F.lower("level") == "master")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The courses of a bundle of schema version 1; another version or no course is an error when it is read."""
    docs = read_documents(spark, path, schemas.BUNDLE)
    sound = (F.col("schemaVersion") == 1) & (F.size("courses") > 0)
    checked = docs.select(F.when(sound, F.col("courses")).otherwise(F.raise_error(F.lit("not a bundle of version 1")).cast(docs.schema["courses"].dataType)).alias("courses"))
    return checked.select(F.inline("courses"))


def read_plan_link(link: Column) -> Column:
    """struct(keys, lessons) of a link's fragment (``#p=a,b&c=...``); what is missing is empty."""
    part = lambda name: F.nullif(F.regexp_extract(link, rf"(?:^|[#&]){name}=([^&]*)", 1), F.lit(""))
    keys = F.filter(F.transform(F.split(F.coalesce(F.try_url_decode(part("p")), F.lit("")), ","), strip), lambda k: k != "")
    return F.struct(F.array_distinct(keys).alias("keys"), lessons.decode(F.coalesce(part("c"), F.lit(""))).alias("lessons"))


PLAN = "version int, selected array<string>, semesters array<string>, days array<int>, custom array<struct<id: string, name: string, day: int, start: int, `end`: int, room: string>>"


def read_plan(stored: Column) -> Column:
    """A stored plan; broken JSON or another version than 1 is an empty plan."""
    empty = F.from_json(F.lit('{"version": 1, "selected": [], "semesters": [], "days": [], "custom": []}'), PLAN)
    read = F.from_json(stored, PLAN)
    sound = F.coalesce(read["version"] == 1, F.lit(False))
    kept = F.struct(*[F.when(sound, F.coalesce(read[c], empty[c])).otherwise(empty[c]).alias(c) for c in ("version", "selected", "semesters", "days", "custom")])
    return kept


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the ``KEY=VALUE`` lines of a file; other lines are passed over."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^([A-Z0-9_]+)=(.*)$", 1).alias("key"), F.regexp_extract("value", r"^([A-Z0-9_]+)=(.*)$", 2).alias("value"))
    return lines.where("key <> ''").select("key", strip(F.col("value")).alias("value"))


def in_scope(sources: DataFrame) -> DataFrame:
    """The sources that are read for timetables and exams: neither out of scope nor for cross-checks alone."""
    return sources.where(~F.col("role").isin("out-of-scope", "crosscheck"))
