"""Tables that change all at once: each build is written to a folder of its own, and becomes the current one by a pointer that is put last.

A pointer is an empty file whose name has its number and the build's id, so putting it is one step on any file system, and readers see
the build before it or all of it. A build that fails leaves no pointer. Older builds stay for ``keep`` more, for readers at work, then go.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _pointers(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, f"{path}/published") if "-" in n]


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current build; None before the first."""
    found = _pointers(spark, path)
    return f"{path}/builds/{found[-1].split('-', 1)[1]}" if found else None


def tables(spark: SparkSession, path: str) -> list[str]:
    """The names of the current build's tables."""
    at = current(spark, path)
    return [n for n in _names(spark, at) if not n.startswith(("_", "."))] if at else []


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current build; it stays readable while a later build is made."""
    if name not in tables(spark, path):
        raise ValueError(f"the current build of {path} has no table {name}")
    return spark.read.parquet(f"{current(spark, path)}/{name}")


def publish(spark: SparkSession, path: str, made: dict[str, DataFrame | Callable[[], DataFrame]], keep: int = 1) -> str:
    """Write the tables as a new build and make it the current one; its id. Tables of earlier builds that are not named are not in it.

    A table may be a function that gives it, called when the ones before are written. Whatever fails, the current build stays what it was.
    """
    build = uuid.uuid4().hex
    at = f"{path}/builds/{build}"
    try:
        for name, df in made.items():
            (df if isinstance(df, DataFrame) else df()).write.parquet(f"{at}/{name}")
    except BaseException:
        delete(spark, at)
        raise
    before = _pointers(spark, path)
    number = int(before[-1].split("-", 1)[0]) + 1 if before else 1
    fs, p = _fs(spark, f"{path}/published/{number:012d}-{build}")
    fs.create(p, False).close()
    for old in before[: max(0, len(before) - keep)]:
        delete(spark, f"{path}/builds/{old.split('-', 1)[1]}")
        delete(spark, f"{path}/published/{old}")
    return build
