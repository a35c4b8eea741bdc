"""SQLite databases as a Spark data source: tables and queries are read in tasks, in ranges of rowids, and never changed."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


class Range(InputPartition):
    """Rows of rowids from ``first`` up to (without) ``last``; without bounds all."""

    def __init__(self, first: int | None = None, last: int | None = None):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = schema.fieldNames(), options

    def partitions(self) -> list[InputPartition]:
        """Ranges of equally many rowids of a table; a query is one."""
        n, table = int(self.options.get("partitions", 1)), self.options.get("table")
        if not table or n <= 1:
            return [Range()]
        with closing(_open(self.options["path"])) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
        if low is None:
            return [Range()]
        step = max(1, -(-(high - low + 1) // n))
        return [Range(k, k + step) for k in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        table = self.options.get("table")
        names = ", ".join(f'"{c}"' for c in self.columns)
        if table:
            text, args = f'select {names} from "{table}"', []
            if partition.first is not None:
                text, args = text + " where rowid >= ? and rowid < ?", [partition.first, partition.last]
        else:
            text, args = f"select {names} from ({self.options['query']})", [v for k, v in sorted((int(k[1:]), v) for k, v in self.options.items() if k[:1] == "p" and k[1:].isdigit())]
        with closing(_open(self.options["path"])) as db:
            yield from db.execute(text, args)


class SqliteSource(DataSource):
    """Options: path, and table (with partitions) or query (with parameters p1, p2, ...)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, schema: str, *, table: str | None = None, query: str | None = None, params: tuple = (), partitions: int = 8) -> DataFrame:
    """A table, or a query's rows, of a database that all executors can open; ``schema`` names and types its columns.

    A missing database or table is an error when it is read; an empty table gives none. Parameters are bound, never spelt out.
    """
    spark.dataSource.register(SqliteSource)
    made = spark.read.format("sqlite").schema(schema).option("path", path).option("partitions", partitions)
    made = made.option("table", table) if table else made.option("query", query)
    for k, v in enumerate(params, 1):
        made = made.option(f"p{k}", v)
    return made.load()
