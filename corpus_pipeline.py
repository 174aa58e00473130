"""The corpus pipeline: quality, near copies, benchmark, personal data, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of documents. The first
three decide on rows, not on doc_ids: each row gets a number, so rows without
a doc_id and rows that share one are judged by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderlake.llm import decontaminate, mixing, ngram_join, pii, quality
from larderlake.llm.common import keep, table

ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written to the shared folder, so that it stays."""
    return keep(docs.withColumn(ROW, F.monotonically_increasing_id()))


def by_number(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows' numbers as doc_id, and some of their columns."""
    return rows.select(F.col(ROW).alias("doc_id"), *columns)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows without those whose numbers are in gone (doc_id)."""
    return rows.join(gone.select(F.col("doc_id").alias(ROW)), ROW, "left_anti").drop(ROW)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rows = numbered(docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", quality.held_out("doc_id").alias("held_out"))
    labels = labels.join(rows.select("doc_id", ROW), "doc_id").select(F.col(ROW).alias("doc_id"), "quality", "toxic", "held_out")
    return without(rows, quality.classify(by_number(rows, "lang", "text"), labels).where("not accepted")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.8 over five-word shingles the one with the smallest doc_id stays, once; null doc_ids come last."""
    rows = numbered(docs)
    groups = ngram_join.ngram_join(by_number(rows, "text"), 5, 80, 100).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))
    kept = groups.join(rows.select("doc_id", ROW), ROW).groupBy("component_id").agg(first.alias("x")).select(F.col(f"x.{ROW}").alias(ROW))
    return rows.join(kept.hint("merge"), ROW, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    rows = numbered(docs)
    return without(rows, decontaminate.decontaminate(by_number(rows, "text"), table(spark, sf_dir, "benchmark")).where("contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and disclosing terms are replaced in the texts; n_chars follows."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, weights 1, 2, 3."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no Kneser-Ney model or string tiling; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None
