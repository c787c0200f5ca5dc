"""Queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dialogue, divergence, fingerprint, html_text, language, licences, mixing, ngrams, pieces, quality, rules, simhash, warc
from tidemark.llm.shared import crc_of_id, table


def in_fold(n: int, which: int) -> Column:
    return F.pmod(crc_of_id("doc_id"), F.lit(n)) == which


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the posterior of the labellers' votes, the trained scorer's score, and whether the document is kept."""
    docs = table(spark, sf_dir, "documents")
    labels, scorer = quality.fit(docs)
    answer = docs.select("doc_id", quality.score(spark, scorer, F.col("text")).alias("a"))
    return answer.select("doc_id", quality.posterior(spark, labels, F.col("a.pattern")).alias("posterior"), F.col("a.score").alias("score"), (F.col("a.score") >= scorer.threshold).alias("kept"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the mixture of sources under flattened weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix.*")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngrams.score(docs, in_fold(7, 2)).withColumnRenamed("key", "doc_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole text, their number, and whether they give the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), pieces.encode_and_compare(spark, F.col("text")).alias("c"))
    return coded.select("doc_id", "n_chars", F.size("c.ids").cast("long").alias("n_tokens"), "c.ids", "c.round_trip")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", in_fold(5, 0))
    model = language.fit(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", language.predict(spark, model, F.col("text")).alias("a")).select("doc_id", "held_out", "a.*")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_and_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.judge(docs, labels).withColumnRenamed("key", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from archives written of all pages."""
    found = warc.stored(table(spark, sf_dir, "pages"), keep=False)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"), "problem")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_mixing_sources, op3_license_scans, op4_lm_scoring, op5_sentencepiece, op6_html_extraction, op7_simhash, op8_language_id, op9_document_fingerprints, op10_quality_rules,
        op11_source_divergence, op12_warc, op13_conversation_repair,
    )
}
ORACLE: dict[str, str] = {"op9_document_fingerprints": fingerprint.sql(), "op11_source_divergence": divergence.sql()}
