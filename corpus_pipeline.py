"""Corpus pipeline: language ID, line dedup, near-duplicate documents, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
``documents``; the last returns the mix. Every decision is made on all rows of the
stage's own input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import decontam, langid, linedup, mixing, ngramjoin
from partloom.llm._util import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents of which a smaller share of n-grams belongs to any language are rejected.
MIN_LANGUAGE_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null texts too, and those whose n-grams belong to no learned language;
    an empty table stays empty."""
    out = langid.identify_by_own_labels(docs)
    return out.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; documents that had lines and lose all of them go. n_chars follows the text; null texts stay."""
    out = linedup.dedup_lines(docs)
    emptied = F.coalesce((F.col("n_lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == ""), F.lit(False))
    changed = F.col("n_kept") < F.col("n_lines")
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~(emptied & changed)).withColumn("n_chars", n_chars).select(*COLUMNS)


def _key() -> Column:
    """What a document is to the decisions: its doc_id and its text, so that rows without a doc_id, or that share
    one and differ in text, are decided apart. The smallest doc_id sorts first, none last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, that of the smallest doc_id (none last, then by a hash of the
    text). Rows that repeat are one document; null texts resemble nothing; an empty table stays empty."""
    classes = ngramjoin.similar_documents(docs.select(_key().alias("doc_id"), "text"))
    gone = materialize(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("gone_key")).distinct())
    kept = docs.join(gone, _key() == F.col("gone_key"), "left_anti")
    # Rows that repeat have one doc_id and one text; rows of one doc_id and other texts are other documents.
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a passage of a benchmark item, and no other row that shares their doc_id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.find_contamination(docs.select(_key().alias("doc_id"), "text"), benchmark)
    hit = materialize(hit.select(F.col("doc_id").alias("hit_key")).distinct())
    return docs.join(hit, _key() == F.col("hit_key"), "left_anti").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources reach their target weights."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = labels.select("doc_id", (F.lit(1.0) + F.coalesce("quality", F.lit(0))).alias("weight"))
    return mixing.mix_sources(docs, weights).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Not expressible: hashes, MinHash and the language filters have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, clean=True)
    return docs
