"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets its own: rows may be of any length.
BATCH_BYTES = "2m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it on their path already, and bound Arrow batches by bytes."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    on_path = {os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.path.realpath(os.getcwd())}
    sc = spark.sparkContext
    if str(ROOT) in on_path or getattr(sc, "_slotwise_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "slotwise.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "slotwise").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._slotwise_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only where all tasks run on this machine (tests) it may be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (at or f"{tempfile.gettempdir()}/slotwise-checkpoints").rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, {})[next(_numbers)] = path
    return spark.read.schema(df.schema).parquet(path)


#: Tables that ``materialize`` wrote and nothing has deleted, by application and in order.
_written: dict[str, dict[int, str]] = {}
_numbers = itertools.count()


def mark() -> int:
    """A moment between two tables, for ``discard``."""
    return next(_numbers)


def discard(spark: SparkSession, keep: int = 0, since: int = -1) -> None:
    """Delete the tables written in this application since then, but for the last ``keep``: for when no result that reads them is still to be computed."""
    tables = _written.get(spark.sparkContext.applicationId, {})
    late = [k for k in tables if k > since]
    for k in late[: max(0, len(late) - keep)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(tables.pop(k))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it holds more than this part of the rows; so there are at most as many hot keys.
HOT_PARTS = 500


def join_hot(rows: DataFrame, info: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``info`` (one row a key, with the key's number of rows as ``count``); ``total``: at least the number of rows.

    Rows of hot keys, which a shuffle would send to one task, meet their (at most ``HOT_PARTS``) keys as a broadcast where they are.
    """
    limit = total // HOT_PARTS
    hot = F.broadcast(info.where(F.col(count) > limit).withColumn("_hot", F.lit(True)))
    met = rows.join(hot, on, "left")
    cold = met.where("_hot is null").select(*rows.columns).join(info.where(F.col(count) <= limit), on)
    return cold.unionByName(met.where("_hot").drop("_hot"))


def join_maybe_hot(rows: DataFrame, info: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``join_hot`` where there is a hot key, else a plain join in one go over ``rows``. ``info`` is looked into at once, so it must be a written table."""
    if info.where(F.col(count) > total // HOT_PARTS).isEmpty():
        return rows.join(info, on)
    return join_hot(rows, info, on, count, total)


#: Bits of the filter of ``possible``: a fixed size (2 ** 18 words of 64 bits).
FILTER_BITS = 24


def possible(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among those of ``wanted``: all that are, and few others while the filter, which is a bounded broadcast, is sparse."""
    h = F.xxhash64(key)
    word, bit = F.shiftrightunsigned(h, 70 - FILTER_BITS), F.pmod(F.shiftrightunsigned(h, 64 - FILTER_BITS), F.lit(64)).cast("int")
    set_ = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(set_), "_word").where(F.getbit("_bits", bit) == 1)
    return met.drop("_word", "_bits")


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle of this package: the session's setting, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
