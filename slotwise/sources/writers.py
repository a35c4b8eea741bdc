"""Writing results: nested bundles, partitioned JSON with a manifest, mirrors and reports."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import lessons
from slotwise.operators import geometry as geo

DURING = {"error": "✗", "warn": "!", "info": "·"}


def bundle(courses: DataFrame, sessions: DataFrame, exams: DataFrame) -> DataFrame:
    """Courses (key, name, progs, elective) with their sessions and exams inside; a course with neither is left out. Sorted by name when written."""
    s = sessions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("d", "s", "e", "prog", "sem", "room") if c in sessions.columns]))).alias("sessions"))
    x = exams.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("date", "s", "e", "assumed", "witnesses", "room") if c in exams.columns]))).alias("exams"))
    both = courses.join(s, "key", "left").join(x, "key", "left").where("sessions is not null or exams is not null")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return both.select(*courses.columns, empty("sessions"), empty("exams"))


#: Entries of one JSON document of a bundle or of the guides, about: a larger build is several documents, in order.
A_DOCUMENT = 1000


def _numbered(df: DataFrame, by: str | Column, size: int) -> DataFrame:
    """``df`` with _doc: ranges of ``by`` in order, of about ``size`` rows each (Spark samples their bounds)."""
    n = max(1, -(-df.count() // size))
    return df.repartitionByRange(n, by).withColumn("_doc", F.spark_partition_id())


def _write_documents(docs: DataFrame, path: str) -> None:
    """One JSON document a row, in files that are in the order of _doc."""
    docs.repartitionByRange(F.col("_doc")).sortWithinPartitions("_doc").drop("_doc").write.mode("overwrite").json(path)


def write_bundle(courses: DataFrame, path: str, built_at: str, size: int = A_DOCUMENT) -> None:
    """The bundle as JSON documents of about ``size`` courses each, in the order of their names as people sort them; a bundle of that size or less is one document."""
    named = _numbered(courses.withColumn("_k", F.collate("name", "UNICODE")), "_k", size)
    some = named.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("_k", F.struct(*courses.columns).alias("c")))).alias("x"))
    _write_documents(some.select("_doc", F.lit(1).alias("schemaVersion"), F.lit(built_at).alias("builtAt"), F.transform("x", lambda r: r["c"]).alias("courses")), path)


def write_ordered(df: DataFrame, column: str, path: str, files: int, collation: str = "UNICODE") -> None:
    """A table as Parquet in ``files`` files at most, in the order in which people sort ``column``: within each file, and from file to file by name.

    Rows are dealt out by ranges of the collated column, whose bounds Spark samples; equal values lie in one file. No task holds more than its range.
    """
    key = F.collate(F.col(column), collation)
    df.withColumn("_k", key).repartitionByRange(files, "_k").sortWithinPartitions("_k", column).drop("_k").write.mode("overwrite").parquet(path)


def write_changed(df: DataFrame, old: DataFrame, key: str, path: str) -> DataFrame:
    """Write those documents of ``df`` (a folder a key) that the manifest ``old`` has not or has otherwise; (key, change) of all that differ, as ``changes``."""
    found = changes(manifest(df, key), old, key)
    df.join(found.where("change <> 'removed'"), key, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)
    return found


def extraction_manifest(docs: DataFrame) -> DataFrame:
    """(path, sha256, bytes, runs, rects, imageOnly) of extraction documents: what the manifest beside them records."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    return docs.select(F.col("source.path").alias("path"), F.col("source.sha256").alias("sha256"), F.col("source.bytes").alias("bytes"), size("runs"), size("rects"), F.coalesce("imageOnly", F.lit(False)).alias("imageOnly"))


def write_guides(verified: DataFrame, languages: DataFrame, year: str, path: str, size: int = A_DOCUMENT) -> None:
    """The curated guides as JSON documents of about ``size`` entries: links (url) that exist, and languages (plan, code, lang) by ``plan|code``, each in order. Both are written, whichever was found anew."""
    links = _numbered(verified.select("url").distinct(), "url", size).groupBy("_doc").agg(F.array_sort(F.collect_list("url")).alias("verified"))
    by = languages.groupBy(F.concat_ws("|", "plan", "code").alias("k")).agg(F.array_sort(F.collect_set("lang")).alias("v"))
    spoken = _numbered(by, "k", size).groupBy("_doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("languages"))
    both = links.join(spoken, "_doc", "full_outer")
    none = lambda c: F.coalesce(c, F.map_from_arrays(F.array(), F.array()).cast("map<string, array<string>>") if c == "languages" else F.array().cast("array<string>")).alias(c)
    _write_documents(both.select("_doc", F.lit(year).alias("year"), none("verified"), none("languages")), path)


def plan_link(keys: Column, custom: Column) -> Column:
    """A plan as a link's fragment; an empty plan is an empty one."""
    return F.when((F.size(keys) > 0) | (F.size(custom) > 0), F.concat(F.lit("#p="), F.array_join(keys, ","), F.lit("&c="), lessons.encode(custom))).otherwise("")


def page_lines(pages: DataFrame, gap: float | None = None) -> DataFrame:
    """(source, line, segment, x0, x1, y, text) of pages (source, runs), for looking at: each line, or (``gap``) each of its parts."""
    lines = pages.select("source", F.posexplode(geo.group_lines(F.col("runs"))).alias("line", "l"))
    parts = lines.select("source", "line", F.col("l.y").alias("y"), F.posexplode(F.array(F.col("l.runs")) if gap is None else geo.split_by_gaps(F.col("l.runs"), gap)).alias("segment", "s"))
    return parts.select("source", "line", "segment", geo.line_left(F.col("s")).alias("x0"), geo.line_right(F.col("s")).alias("x1"), "y", geo.line_text(F.col("s")).alias("text"))


def manifest(df: DataFrame, key: str) -> DataFrame:
    """(key, sha256, bytes) of each document's JSON: what a later run is compared with."""
    doc = F.to_json(F.struct(*df.columns))
    return df.select(F.col(key), F.sha2(doc, 256).alias("sha256"), F.octet_length(doc).alias("bytes"))


def changes(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(key, change): documents that are added, removed or changed between two manifests."""
    both = new.select(key, F.col("sha256").alias("_new")).join(old.select(key, F.col("sha256").alias("_old")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") != F.col("_old"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def parents_first(tables: list[str], references: dict[str, list[str]]) -> list[str]:
    """The tables so that each comes after those that it refers to (a table may refer to itself), else as they are given. A ring of references is an error."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(r in left and r != t for r in references.get(t, []))]
        if not free:
            raise ValueError(f"tables refer to one another in a ring: {', '.join(sorted(left))}")
        out.append(free[0])
        left.remove(free[0])
    return out


def mirror(tables: dict[str, DataFrame], references: dict[str, list[str]], url: str, properties: dict[str, str], batch: int = 500) -> list[str]:
    """Tables over those of a database, in one transaction; the order in which they are filled.

    ``references`` has the tables that a table's foreign keys point to. Spark's tasks write copies beside the tables; then one transaction
    empties children before parents and fills parents before children from the copies. So readers see the old tables or
    the new ones, and a failure changes nothing. The copies go either way.
    """
    spark = next(iter(tables.values())).sparkSession
    order = parents_first(list(tables), references)
    copy = {name: f"{name}_incoming" for name in order}
    jvm = spark._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    try:
        for name in order:
            tables[name].write.mode("overwrite").option("batchsize", batch).jdbc(url, copy[name], properties=properties)
        if "driver" in properties:
            jvm.java.lang.Class.forName(properties["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        link = jvm.java.sql.DriverManager.getConnection(url, given)
        try:
            link.setAutoCommit(False)
            run = link.createStatement()
            for name in reversed(order):
                run.executeUpdate(f"delete from {name}")
            for name in order:
                columns = ", ".join(f'"{c}"' for c in tables[name].columns)
                run.executeUpdate(f"insert into {name} ({columns}) select {columns} from {copy[name]}")
            link.commit()
        except BaseException:
            link.rollback()
            raise
        finally:
            link.close()
    finally:
        link = jvm.java.sql.DriverManager.getConnection(url, given)
        for name in order:
            with contextlib.suppress(Exception):
                link.createStatement().executeUpdate(f"drop table {copy[name]}")
        link.close()
    return order


def report(diagnostics: DataFrame, title: str, most: int = 1000) -> str:
    """A markdown report of diagnostics by severity: the counts of all, and the first ``most`` lines (a report is for reading)."""
    counts = {r["severity"]: r["count"] for r in diagnostics.groupBy("severity").count().collect()}
    rows = diagnostics.orderBy("severity", "code", "subject", "detail").limit(most).collect()
    lines = [f"# {title}", "", ", ".join(f"{n} {s}" for s, n in sorted(counts.items())) or "nothing to report", ""]
    return "\n".join(lines + [f"- {DURING.get(r['severity'], '·')} `{r['code']}` {r['subject'] or ''}: {r['detail']}" for r in rows]) + "\n"
