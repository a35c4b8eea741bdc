"""What a bundle is made of: verified guides, languages, resolved names, optional fields, what a plan shows, and what fails a build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.catalogue import is_assumed
from slotwise.operators import intervals as iv


def verified_guides(rows: DataFrame, key: str, candidates: Column, verified: DataFrame, url: str = "url") -> DataFrame:
    """(key, guides): of each row's candidate links those that are verified, in their order, a line each; rows without any are left out."""
    each = rows.select(key, F.posexplode(candidates).alias("_at", url)).join(verified.select(url).distinct(), url, "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", url))), lambda x: x[url])
    return each.groupBy(key).agg(F.array_join(listed, "\n").alias("guides"))


def taught_in(rows: DataFrame, key: str, pairs: Column, languages: DataFrame) -> DataFrame:
    """(key, languages): the languages recorded for any of a row's (plan, code) pairs, each once and in order; rows without any are left out."""
    each = rows.select(key, F.inline(pairs)).distinct().join(languages.select("plan", "code", "lang").distinct(), ["plan", "code"])
    return each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("lang")), " + ").alias("languages"))


def resolve_names(targets: DataFrame, strategies: list[tuple[str, DataFrame]], orphans: DataFrame, target: str, item: str) -> DataFrame:
    """(target, item, method): the items of each target by the first strategy that finds any.

    A strategy (target, item) is one join. ``split`` may give a target several items, the others the least. Targets
    that none finds are ``orphan`` where ``orphans`` declares them, else ``unresolved``, with a null item.
    """
    found = None
    for k, (name, df) in enumerate(strategies):
        one = df.select(target, item).distinct() if name == "split" else df.groupBy(target).agg(F.min(item).alias(item))
        ranked = one.select(target, item, F.lit(k).alias("_rank"), F.lit(name).alias("method"))
        found = ranked if found is None else found.union(ranked)
    first = found.withColumn("_first", F.min("_rank").over(Window.partitionBy(target))).where("_rank = _first").select(target, item, "method")
    declared = orphans.select(target).distinct().withColumn("_orphan", F.lit("orphan"))
    out = targets.select(target).distinct().join(first, target, "left").join(declared, target, "left")
    return out.select(target, item, F.coalesce("method", "_orphan", F.lit("unresolved")).alias("method"))


def with_rules(rows: DataFrame, rules: DataFrame, on: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` as the rule of their key says, where there is one (one rule a key)."""
    both = rows.join(rules.select(*on, F.col(value).alias("_rule")), on, "left")
    return both.withColumn(value, F.coalesce("_rule", value)).drop("_rule").select(*rows.columns)


def known_keys(keys: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the keys that are still known, and those that are not."""
    return keys.join(known, key, "left_semi"), keys.join(known, key, "left_anti")


def with_optional(fields: Column, optional: Column) -> Column:
    """A JSON object of the struct ``fields``, nulls and all, and those of ``optional`` that are not null."""
    base, more = F.to_json(fields, {"ignoreNullFields": "false"}), F.to_json(optional)
    return F.when(more == "{}", base).otherwise(F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))


def session_json(prog: Column, sem: Column, d: Column, s: Column, e: Column, room: Column, label: Column, v_from: Column, v_to: Column, source: Column, method: Column) -> Column:
    """A session as it is exported: a window only if label and bounds are known, ``inferred`` and ``vision`` only if true."""
    window = F.when(label.isNotNull() & v_from.isNotNull() & v_to.isNotNull(), F.struct(label.alias("label"), v_from.alias("from"), v_to.alias("to")))
    fields = F.struct(prog.alias("prog"), sem.alias("sem"), d.alias("d"), s.alias("s"), e.alias("e"), room.alias("room"))
    return with_optional(fields, F.struct(window.alias("v"), F.when(source == "inferred", True).alias("inferred"), F.when(method == "vision", True).alias("vision")))


def exam_json(date: Column, s: Column, e: Column, room: Column, witnesses: Column, duration: Column, method: Column) -> Column:
    """An exam as it is exported: ``assumed`` and ``vision`` only if true."""
    fields = F.struct(date.alias("date"), s.alias("s"), e.alias("e"), room.alias("room"), witnesses.alias("witnesses"))
    return with_optional(fields, F.struct(F.when(is_assumed(duration), True).alias("assumed"), F.when(method == "vision", True).alias("vision")))


def witnessed(witnesses: DataFrame, sources: DataFrame, exams: DataFrame, courses: DataFrame, family: str = "E-e") -> DataFrame:
    """(name, date, start_min, grid_date, grid_start, ok): what a source of one family says of exams beside what the grid says.

    Witnesses (source_id, exam_id, date, start_min), sources (source_id, family), exams (exam_id, course_id, date, start_min), courses (course_id, name).
    """
    grid = exams.select("exam_id", "course_id", F.col("date").alias("grid_date"), F.col("start_min").alias("grid_start"))
    both = witnesses.join(sources.where(F.col("family") == family).select("source_id"), "source_id").join(grid, "exam_id").join(courses.select("course_id", "name"), "course_id")
    ok = F.col("date").eqNullSafe(F.col("grid_date")) & F.col("start_min").eqNullSafe(F.col("grid_start"))
    return both.select("name", "date", "start_min", "grid_date", "grid_start", ok.alias("ok"))


def stale(transcribed: DataFrame, manifest: DataFrame, key: str, sha: str = "sha256") -> DataFrame:
    """(key, transcribed, actual) of the transcriptions whose source has changed since; sources that the manifest does not know are passed over."""
    both = transcribed.select(key, F.col(sha).alias("transcribed")).join(manifest.select(key, F.col(sha).alias("actual")), key)
    return both.where("actual is not null and not transcribed <=> actual")


def require_none(problems: DataFrame, subject: str, message: str, most: int = 20) -> None:
    """Fail a build that has problems: an error that names the first ``most`` (for reading; any one fails it)."""
    found = [str(r[0]) for r in problems.select(subject).orderBy(subject).limit(most).collect()]
    if found:
        raise ValueError(message + ":\n  " + "\n  ".join(found))


def flagged_blocks(placed: DataFrame, order: list[str]) -> DataFrame:
    """Merged slots of weekly sessions (``merge_slots``) with ``clash``: whether any of a slot's sessions collides with another key's."""
    weekly = placed.where(F.col("d").between(1, 5))
    valid = iv.ranges_overlap(F.col("a_v_from"), F.col("a_v_to"), F.col("b_v_from"), F.col("b_v_to"))
    clashes = iv.met(weekly, weekly, "d", ["v_from", "v_to"], {"clash": valid}).select("key", "d", "s", "e").distinct().withColumn("clash", F.lit(True))
    return iv.merge_slots(placed, order).join(clashes, ["key", "d", "s", "e"], "left").withColumn("clash", F.coalesce("clash", F.lit(False)))


def distinct_slots(sessions: DataFrame, keys: list[str], payload: list[str], order: list[str]) -> DataFrame:
    """One row for each slot (``keys``): of several the last by ``order`` counts."""
    last = F.max_by(F.struct(*payload), F.struct(*order))
    return sessions.groupBy(*keys).agg(last.alias("_p")).select(*keys, "_p.*")


def exams_by_date(exams: DataFrame, order: list[str]) -> DataFrame:
    """(date, exams): each date's exams in order, as they are shown. What is collected is one plan's date."""
    return exams.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("exams"))


def assumed_in_plan(exams: DataFrame, plan: DataFrame, key: str = "key", source: str = "duration_source") -> DataFrame:
    """(exams, assumed): how many exams the plan's keys have, and how many of those end by assumption."""
    return exams.join(plan.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("exams"), F.count_if(is_assumed(F.col(source))).alias("assumed"))


def totals(courses: DataFrame, notes: DataFrame) -> DataFrame:
    """(courses, sessions, exams, notes) of a bundle whose courses hold their sessions and exams."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
    return courses.agg(F.count("*").alias("courses"), size("sessions"), size("exams")).join(notes.agg(F.count("*").alias("notes")), how="cross")  # one row each


def derived_sessions(sessions: DataFrame, sources: DataFrame, courses: DataFrame, programme: str, semester: str) -> DataFrame:
    """Sessions of a programme's semester that were read from primary sources, and not transcribed: with their course's name.

    Sessions (session_id, course_id, source_id, ...), sources (source_id, role, method), courses (course_id, name, programme, semester).
    """
    mine = courses.where((F.col("programme") == programme) & (F.col("semester") == semester)).select("course_id", "name")
    read = sources.where("role = 'primary' and method = 'pdfjs'").select("source_id")
    return sessions.join(read, "source_id").join(mine, "course_id")
