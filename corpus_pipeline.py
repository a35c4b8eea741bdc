"""The corpus pipeline: documents through STAGES, each written as Parquet and read again by the next.

Poor documents go, then lines that an earlier line has (and documents of which no word is left), then all but
the first of near-duplicates; what is left is mixed to the weights of its sources and packed into sequences.
Every stage works on all rows that its predecessor kept, and all but the last return the columns of
``documents``. Null ids, null and empty texts, repeated rows and empty tables have the results that the stages state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.llm import line_dedup, mixing, near_dedup, packing, quality_classifier, runtime
from slotwise.llm.queries import GRADE, WEIGHTS, levels, table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose probability of a good grade is at least a half, by a model trained on the rated ones.

    Each row is judged by its text alone: null and empty ones alike, by the thresholds. Null ids have no rating but are judged too.
    """
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1) and toxic in (0, 1)")
    model = quality_classifier.train(docs, labels, F.expr(GRADE))
    return quality_classifier.grade(docs.select(*COLUMNS), model).where("selected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines, but for those that lose lines and have no word left: all they said stands in earlier ones.

    n_chars is that of the text left. Documents that come without a word stay (a null text as null). Rows equal in id and text fare alike.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), exact_all=True)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, a long that tells documents apart, and _print, a hash of the text.

    It is the id where that is not negative and all its rows have one text (by two hashes of 64 bits each). Rows of an id with unlike texts, of a
    negative one or of none are told by a hash of id and text below 0, which no id has.
    """
    rows = docs.withColumn("_print", F.xxhash64(F.lit(1), "text"))
    marks = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("a"), F.col("_print").alias("b"), F.col("text").isNull().cast("int").alias("c"))
    several = marks.groupBy("doc_id").agg(*[f(x).alias(f"{x}{k}") for x in "abc" for k, f in enumerate((F.min, F.max))]).where("a0 <> a1 or b0 <> b1 or c0 <> c1")
    several = runtime.materialize(several.select("doc_id", F.lit(True).alias("_several")), "several")
    hashed = line_dedup.document_key(F.col("doc_id"), F.col("text")).bitwiseOR(F.lit(-1 << 63))
    met = rows.join(several, "doc_id", "left")
    return met.withColumn("_key", F.when((F.col("doc_id") >= 0) & F.col("_several").isNull(), F.col("doc_id")).otherwise(hashed)).drop("_several")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each near-duplicate class: that of the least id (null ids last), of rows that share it the one of the least key.

    A row is told by its id and text, so rows that share an id but no text are documents of their own; rows equal
    in both are one. Null texts are no duplicates of one another.
    """
    rows = _told_apart(docs.select(*COLUMNS))
    keys = rows.select("_key", "doc_id", "text")
    found = near_dedup.classes(keys, id_col="_key").distinct().withColumnsRenamed({"doc_id": "_key", "class_id": "_class"})
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key")
    first = keys.select("_key", "doc_id").join(found, "_key").groupBy("_class").agg(F.min(order)["_key"].alias("_key")).select("_key")
    number = F.row_number().over(Window.partitionBy("_key", "doc_id", "_print").orderBy("lang", "source", "n_chars"))
    return rows.join(first, "_key", "left_semi").withColumn("_n", number).where("_n = 1").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to the weights, a row for each epoch that has them. Null and empty texts cost no token; null languages and sources are leaves too."""
    return mixing.mix_sources(docs.select(*COLUMNS), levels(), WEIGHTS, tokenizer_path(), share=0.75, max_epochs=2, seed=7, unknown="ignore").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in packed sequences; a null or empty text is its end token. Repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``; what lies between two stages is a table in the shared folder, deleted when the next is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), runtime.mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = runtime.materialize(docs, f"stage-{name}")
            runtime.discard(spark, since=since, keep=1)
    return docs


#: SQL has no trained classifier, signatures or tokenizer: tests hold the stages against brute-force versions.
ORACLE_SQL = None
