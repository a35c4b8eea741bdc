"""The registered corpus queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import collocations, language_id, line_dedup, media, mixing, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity
from slotwise.llm.oracles import ORACLE_SQL


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of every document."""
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, labels.where("toxic in (0, 1)"), "toxic", keep=~held_out("id"))
    scored = toxicity.score(docs, model, 0.3)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("sentences").alias("n_sentences"), F.try_element_at("sentences", F.lit(1))["start"].alias("first_start"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a medium, sniffed and read back."""
    return media.store_texts(table(spark, sf_dir, "documents"), with_media=False)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"), 0.8)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has, removed from every document."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


#: The tree over which sources are mixed: a source's domain follows from its name.
DOMAIN = "case when source = 'src0' then 'web' when cast(regexp_extract(source, '[0-9]+', 0) as int) % 2 = 0 then 'books' else 'forums' end"
#: Weights of nodes by their path; all others weigh 1.
WEIGHTS = {("web",): 0.3, ("books",): 0.45, ("forums",): 0.25, ("web", "en"): 2, ("books", "en"): 2, ("forums", "en"): 2}


def levels() -> dict:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to the weights of domains, languages and sources: three quarters of their tokens, at most two epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix_sources(docs, levels(), WEIGHTS, tokenizer_path(), share=0.75, max_epochs=2, seed=7, unknown="ignore")
    return out.select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", "epoch")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line equals or nearly equals."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_all=True)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length(kept).cast("bigint").alias("kept_bytes"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


#: A document's grade: 0 poor, 1 good but toxic, 2 good.
GRADE = "quality * (2 - toxic)"


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and the probability that it is at least good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where("quality in (0, 1) and toxic in (0, 1)"), F.expr(GRADE))
    return quality_classifier.grade(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_probability", "selected")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by its text alone, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    model = language_id.train(docs, keep=rest != 0)
    return language_id.detect(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words (with those that the contract plants by id), and what is left without repetitions."""
    return periodic_runs.runs_of(table(spark, sf_dir, "documents"), key_col="doc_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to five words that occur 100 times or more, by how far they exceed chance."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_toxicity, op4_media_columns, op5_near_dedup, op6_token_counts, op7_suffix_dedup, op8_mixing, op9_line_dedup, op10_quality_classifier, op11_language_id, op12_periodic_runs, op13_collocations)}
