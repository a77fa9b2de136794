"""From raw documents to packed training sequences.

Five stages in order: quality rules, quality classifier, near-duplicates by the n-gram
Jaccard join, secret scans, packing. Each takes what the one before it kept, as reread from
Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwright.llm import classifier, jaccard, packing, quality, secrets
from costwright.llm.shared import crc_fold, marked, removed_folder, repeated_keys, shared_dir, shipped, table, unused, written

#: Near-duplicates share this percentage of their shingles of this many words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and whose n-grams look like the trusted ones (label 1)."""
    shipped(spark)
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    weights = quality.ratio_weights(docs, trusted, "doc_id", "text")
    return quality.passing(docs, weights)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that a model, learned on the labelled ones outside fold 1 of 3, scores 0.5 or more."""
    shipped(spark)
    learned = table(spark, sf_dir, "labels").filter(crc_fold("doc_id", 3) != 1)
    score = unused(docs, "score")
    return classifier.score(docs, classifier.fit(docs, learned), score=score).filter(F.col(score) >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones: that with the least doc_id of the group.

    Rows that share an id are told apart by a hash of their text: each goes the way of its own text, and of
    rows that share both one stays. Rows without an id are all kept, as none of them can be named. Only
    rows that may have to go are shuffled: the others are told by a bitmap of fixed size in the scan.
    """
    shipped(spark)
    columns = docs.columns
    key, other, similar, rows, held = (unused(docs, c) for c in ("key", "other", "similar", "rows", "held"))
    content = F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")
    docs = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), content))
    groups = jaccard.similar_groups(docs.select(key, "text"), key, "text", words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    fate = (
        groups.filter(f"not {key}.none")
        .groupBy(F.col(key).alias(other))
        .agg(F.bool_and(F.col(key) != F.col("component_id")).alias(similar), F.count(F.lit(1)).alias(rows))
        .filter(f"{similar} or {rows} > 1")
    )
    fate = written(fate, "fate")
    marks = written(repeated_keys(fate, F.xxhash64(other), least=1), "marks")
    checked = marked(docs, F.xxhash64(key), marks, held)
    found = checked.filter(held).join(fate, F.col(key) == F.col(other), "left").filter(f"{similar} is null or not {similar}")
    whole = F.struct(*columns)
    repeated = found.filter(f"{rows} > 1").groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(other))
    return (
        checked.filter(f"not {held}")
        .select(columns)
        .unionByName(found.filter(f"{rows} is null").select(columns))
        .unionByName(repeated.select(f"{other}.*"))
    )


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; n_chars counts the new text."""
    shipped(spark)
    cleaned = secrets.redact_secrets(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a training sequence."""
    shipped(spark)
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packed_sequences),
]

#: Several stages have no SQL form; tests compare run() with a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
