"""Rows and diagnostics of one pass: what a step cannot read goes on as a problem beside what it can.

A frame under way has a column ``_problem``: null where the row is still being read, else what was wrong, and then all that is
peculiar to the step may be null. ``branch`` opens an array of a row, and lets problems pass. At the end ``emit`` makes outcomes: (keys, kind,
row, problem), a row for each result (kind ``row``) and each diagnostic (kind ``problem``). The input is read once for both; outcomes
are written once, a folder a kind, and read as either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.binding import pin

PROBLEM = "struct<severity: string, code: string, subject: string, detail: string>"


def nothing() -> Column:
    return F.lit(None).cast(PROBLEM)


def problem(severity: str, code: str, subject: Column | None, detail: Column) -> Column:
    """A diagnostic; ``error`` says that a source could not be read, ``warn`` and ``info`` that something of it was left out or guessed."""
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"), detail.alias("detail")).cast(PROBLEM)


def start(df: DataFrame, wrong: Column | None = None) -> DataFrame:
    """``df`` under way, with the problem of each row (null: none)."""
    return df.withColumn("_problem", nothing() if wrong is None else wrong)


def halt(df: DataFrame, wrong: Column) -> DataFrame:
    """Rows still being read take this problem, where it is not null."""
    return df.withColumn("_problem", F.coalesce("_problem", wrong))


def branch(df: DataFrame, name: str, items: Column, notes: Column | None = None) -> DataFrame:
    """A row for each of the array's items, as ``name``, and for each of the row's ``notes`` (problems that do not stop it); a row that is a problem stays one row. Neither gives none."""
    rows = pin(df, _items=F.when(F.col("_problem").isNull(), items))
    wrong = F.when(F.col("_problem").isNotNull(), F.array("_problem"))
    if notes is not None:
        wrong = F.concat(F.coalesce(wrong, F.array().cast(f"array<{PROBLEM}>")), F.coalesce(notes, F.array().cast(f"array<{PROBLEM}>")))
    live = F.transform("_items", lambda x: F.struct(x.alias("x"), nothing().alias("p")))
    stopped = F.transform(wrong, lambda p: F.struct(F.get("_items", F.lit(-1)).alias("x"), p.alias("p")))
    own = [c for c in df.columns if c not in ("_problem", name)]
    opened = rows.select(*own, F.explode(F.flatten(F.array_compact(F.array(live, stopped)))).alias("_both"))
    return opened.select(*own, F.col("_both.p").alias("_problem"), F.col("_both.x").alias(name))


def emit(df: DataFrame, keys: list[str], row: Column, notes: Column | None = None) -> DataFrame:
    """The outcomes of a frame under way: its rows (a struct; null: none), their notes, and its problems."""
    done = branch(df.withColumn("_row", row), "_out", F.array_compact(F.array("_row")), notes)
    return done.select(*keys, F.when(F.col("_problem").isNull(), "row").otherwise("problem").alias("kind"), F.col("_out").alias("row"), F.col("_problem").alias("problem"))


def rows_of(outcomes: DataFrame) -> DataFrame:
    """The keys and the results."""
    return outcomes.where("kind = 'row'").select(*[c for c in outcomes.columns if c not in ("kind", "row", "problem")], "row.*")


def problems_of(outcomes: DataFrame) -> DataFrame:
    """The keys and the diagnostics: severity, code, subject, detail."""
    return outcomes.where("kind = 'problem'").select(*[c for c in outcomes.columns if c not in ("kind", "row", "problem")], "problem.*")


def dispatch(pages: DataFrame, family: str, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(source, family, kind, row, problem): the outcomes of each page by the parser of its family, results as one struct of all families' fields.

    A page of a family without a parser is a problem, ``UNKNOWN_FAMILY``. Each parser reads the pages of its family only, so where pages lie in
    folders by family every page is read once.
    """
    made = [(name, parse(pages.where(F.col(family) == name)).select("source", F.lit(name).alias("family"), "kind", "row", "problem")) for name, parse in parsers.items()]
    fields: dict[str, str] = {}
    for _, df in made:
        fields |= {f.name: f.dataType.simpleString() for f in df.schema["row"].dataType}
    unknown = start(pages.where(F.col(family).isNull() | ~F.col(family).isin(list(parsers))))
    wrong = problem("error", "UNKNOWN_FAMILY", F.col(family), F.lit("no parser reads pages of this family"))
    row = f"struct<{', '.join(f'`{n}`: {t}' for n, t in fields.items())}>"
    out = emit(halt(unknown, wrong).withColumn("family", F.col(family)), ["source", "family"], F.lit(None).cast(row))
    for _, df in made:
        has = df.schema["row"].dataType.names
        wide = F.struct(*[(F.col(f"row.{n}") if n in has else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
        out = out.unionByName(df.withColumn("row", F.when(F.col("kind") == "row", wide)))
    return out


def failed_sources(outcomes: DataFrame, key: str = "source") -> DataFrame:
    """(source, rows, errors, warnings, status) of every source that has an outcome: ``failed`` if it has an error, else ``parsed``."""
    count = lambda c: F.count(F.when(c, 1))
    per = outcomes.groupBy(key).agg(count(F.col("kind") == "row").alias("rows"), count(F.col("problem.severity") == "error").alias("errors"), count(F.col("problem.severity") == "warn").alias("warnings"))
    return per.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("parsed"))
