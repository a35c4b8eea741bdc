"""Joins, groupings and checks over schedule tables. Every ranking has an order that leaves no ties."""

from __future__ import annotations

import string

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.catalogue import credit_value
from slotwise.functions.text import collapse, composed


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` has no partner for."""
    return left.join(right, on, "left_anti")


def account(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, problem): declared keys that were not found, and found ones that were not declared. Texts are told apart in their composed form (NFC), as file systems spell paths in either."""
    text = {df.schema[key].dataType.typeName() for df in (found, declared)} == {"string"}
    own = F.col(key) if not text else composed(F.col(key)).alias(key)
    a = found.select(own).distinct().withColumn("_found", F.lit(True))
    b = declared.select(own).distinct().withColumn("_declared", F.lit(True))
    problem = F.when(F.col("_found").isNull(), "missing").when(F.col("_declared").isNull(), "undeclared")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def distinct_list(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): each group's distinct values in order, nulls left out. They are found first, so no more than those are collected."""
    return df.select(*by, value).distinct().groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def long_metrics(df: DataFrame, key: list[str], metrics: list[str], value: str) -> DataFrame:
    """(key, metric, value) of a table that has a column for each metric."""
    return df.unpivot(key, metrics, "metric", value)


def metric_check(expected: DataFrame, measured: DataFrame, key: list[str]) -> DataFrame:
    """Expected metrics beside those measured (null where there is none), and whether they agree."""
    both = expected.join(measured, [*key, "metric"], "left")
    return both.select(*key, "metric", "expected", "actual", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of ``keys``, nulls being equal."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def first_value(value: str | Column, *order: str) -> Column:
    """The value of a group's first row by ``order``."""
    return F.min_by(value, F.struct(*order))


def nocase(c: Column) -> Column:
    """For comparing without regard to case as SQLite does: the 26 ASCII letters only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def roll_up(rows: DataFrame, key: Column, name: str, group: str, flag: Column, order: list[str]) -> DataFrame:
    """Rows of one canonical key as one: its first name without regard to case, its groups as they appear in that order, whether any is flagged.

    ``order`` makes ties definite. A key's distinct groups are found first, so no more than those are collected.
    """
    place = F.struct(nocase(F.col(name)).alias("k"), F.col(name).alias("name"), *order)
    each = rows.groupBy(key.alias("key"), F.col(group).alias("group")).agg(F.min(place).alias("place"), F.bool_or(F.coalesce(flag, F.lit(False))).alias("flagged"))
    groups = F.transform(F.array_sort(F.collect_list(F.when(F.col("group").isNotNull(), F.struct("place", "group")))), lambda x: x["group"])
    return each.groupBy("key").agg(F.min("place")["name"].alias("name"), groups.alias("groups"), F.bool_or("flagged").alias("flagged"))


def merge_exams(rows: DataFrame, keys: list[str], group: str, witnesses: Column, order: list[str], others: list[str]) -> DataFrame:
    """Rows of one key as one exam: groups joined, witnesses added up, the other fields of the first."""
    kept = [first_value(c, *order).alias(c) for c in others]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(group)).alias("groups"), F.sum(witnesses).alias("witnesses"), *kept)


def agreement(rows: DataFrame, key: str, group: str, value: Column, least: int = 2) -> DataFrame:
    """(key, groups, versions, ok) of the keys that ``least`` groups share: ok where all give one value."""
    both = rows.groupBy(key).agg(F.countDistinct(group).alias("groups"), F.countDistinct(value).alias("versions"))
    return both.where(F.col("groups") >= least).withColumn("ok", F.col("versions") == 1)


def credit_sums(rows: DataFrame, key: str, credits: str, name: str, english: str) -> DataFrame:
    """(key, credits): a course's credits over its offerings, null if one has conflicting or a course no numbers.

    Offerings are told by both names, without regard to case and spaces; cells without a number do not count.
    """
    offering = F.lower(collapse(F.concat(F.col(name), F.lit("|"), F.col(english))))
    valued = rows.select(F.col(key), offering.alias("offering"), credit_value(F.col(credits)).alias("v")).where("v is not null")
    each = valued.groupBy(key, "offering").agg(F.min("v").alias("v"), (F.min("v") != F.max("v")).alias("conflict"))
    summed = each.groupBy(key).agg(F.when(~F.bool_or("conflict"), F.sum("v")).alias("credits"))
    return rows.select(key).distinct().join(summed, key, "left")


def strongest(rows: DataFrame, keys: list[str], strength: Column, order: list[str]) -> DataFrame:
    """The row of most strength in each group; equal ones fall to the first by ``order``."""
    return first_of(rows.withColumn("_strength", strength), keys, [F.col("_strength").desc(), *[F.col(c) for c in order]]).drop("_strength")


def override(rows: DataFrame, overrides: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the columns that ``overrides`` gives for their key in place of their own; ``curated`` tells which."""
    o = overrides.select(*on, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("curated"))
    kept = [c for c in rows.columns if c not in columns]
    return rows.join(o, on, "left").select(*kept, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], F.coalesce("curated", F.lit(False)).alias("curated"))


def match_offerings(courses: DataFrame, rows: DataFrame, extras: DataFrame) -> DataFrame:
    """(key, row_id, route): catalogue rows of each course by its key, by its key without a group prefix, or by a curated extra key.

    ``courses`` has key and plain_key, ``rows`` row_id and name_keys (an array), ``extras`` key and extra_key. Each
    route is an equi-join on exploded keys; a row found by several routes counts once, by the first.
    """
    wanted = courses.select("key", F.explode(F.array(F.struct(F.lit(1).alias("route"), F.col("key").alias("k")), F.struct(F.lit(2).alias("route"), F.col("plain_key").alias("k")))).alias("x")).select("key", "x.route", "x.k")
    wanted = wanted.union(courses.select("key").join(extras, "key").select("key", F.lit(3).alias("route"), F.col("extra_key").alias("k")))
    keyed = rows.select("row_id", F.explode(F.array_distinct("name_keys")).alias("k"))
    return wanted.join(keyed, "k").groupBy("key", "row_id").agg(F.min("route").alias("route"))


def disambiguate(matched: DataFrame, preferred: DataFrame) -> DataFrame:
    """Rows (key, name_key, row_id, credits, plans) after the preference for plans, with ``ambiguous``.

    Where rows of one name have several credits, those of preferred plans stay alone if they agree on one;
    else all stay and are ambiguous. ``preferred`` has key and prefer (an array).
    """
    group = Window.partitionBy("key", "name_key")
    rows = matched.join(preferred, "key", "left").withColumn("_mine", F.coalesce(F.arrays_overlap("plans", "prefer"), F.lit(False)))
    rows = rows.withColumn("_values", F.size(F.collect_set("credits").over(group))).withColumn("_kept", F.size(F.collect_set(F.when(F.col("_mine"), F.col("credits"))).over(group))).withColumn("_null", F.max((F.col("_mine") & F.col("credits").isNull()).cast("int")).over(group))
    settled = (F.col("_values") > 1) & (F.col("_kept") == 1) & (F.col("_null") == 0)
    return rows.where(~settled | F.col("_mine")).select("key", "name_key", "row_id", "credits", ((F.col("_values") > 1) & ~settled).alias("ambiguous"))


def resolve(targets: DataFrame, strategies: list[tuple[str, DataFrame]], target: str, item: str) -> DataFrame:
    """(target, item, method): each target's item by the first strategy that finds one, null where none does.

    A strategy is a table of (target, item), made by one join; equal finds of a strategy fall to the least item.
    """
    found = [df.select(F.col(target), F.col(item), F.lit(k).alias("_rank"), F.lit(name).alias("method")) for k, (name, df) in enumerate(strategies)]
    best = reduce(DataFrame.union, found).groupBy(target).agg(F.min(F.struct("_rank", item, "method")).alias("m"))
    return targets.select(target).distinct().join(best, target, "left").select(target, F.col(f"m.{item}").alias(item), F.coalesce("m.method", F.lit("unresolved")).alias("method"))


def violations(df: DataFrame, checks: dict[str, Column], subject: Column) -> DataFrame:
    """(check, subject) for every row and check that does not hold; an unknown outcome (null) is none."""
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(failed).alias("check"), subject.cast("string").alias("subject"))


def duplicates(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """(check, subject) for every key that more than one row has."""
    key = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return df.groupBy(key.alias("subject")).count().where("count > 1").select(F.lit(name).alias("check"), "subject")


def orphans(df: DataFrame, parent: DataFrame, column: str, parent_key: str, subject: str, name: str) -> DataFrame:
    """(check, subject) for every row whose key (where it has one) has no parent."""
    return df.where(F.col(column).isNotNull()).join(parent, df[column] == parent[parent_key], "left_anti").select(F.lit(name).alias("check"), F.col(subject).cast("string").alias("subject"))


def verdict(diagnostics: DataFrame, strict: bool = False) -> DataFrame:
    """(errors, warnings, passed) of diagnostics by severity; strict counts warnings as errors."""
    n = lambda s: F.count_if(F.col("severity") == s)
    failed = n("error") + (n("warn") if strict else F.lit(0))
    return diagnostics.agg(n("error").alias("errors"), n("warn").alias("warnings"), (failed == 0).alias("passed"))


def notes(diagnostics: DataFrame, codes: list[str]) -> DataFrame:
    """Warnings of the given codes as text: ``subject: detail``."""
    text = F.when(F.coalesce(F.col("subject"), F.lit("")) == "", F.col("detail")).otherwise(F.concat("subject", F.lit(": "), "detail"))
    return diagnostics.where((F.col("severity") == "warn") & F.col("code").isin(codes)).select("code", text.alias("note"))
