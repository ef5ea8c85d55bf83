"""The corpus pipeline: quality rules, line deduplication, near-duplicates, benchmark decontamination, tokens.

Every stage takes the documents its predecessor kept, whole, and all but the last
give back the columns of documents, extra ones included. ``run`` writes each stage's
result below the shared folder and reads it again for the next.

Null texts count as empty and fail the quality rules, so no later stage sees one
unless it is called by itself. Rows that are equal or share an id are judged each
by its own text, except in ``near_duplicates``, where one row per component stays.
Empty tables pass through every stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, jaccard, lines, quality
from tracewell.llm.queries import tokenizer_file
from tracewell.sources.tables import table
from tracewell.storage import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' joint verdict keeps."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of an earlier one; those of which no word is left go."""
    done = lines.dedup_lines(docs)
    emptied = (F.col("_llm_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    left = done.filter(~emptied).drop("_llm_deleted", "_llm_before")
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 or more in five-word shingles, the one with the smallest id.

    Found by SimHash's deletion variants and by MinHash bands, checked on the whole sets.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number, and whether they decode to its text."""
    both = bpe.encode_and_decode(docs, tokenizer_file(), keep_text=True)
    return both.select("doc_id", F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("restored"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
ORACLE_SQL = None  # posteriors, alignments and merges have no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
