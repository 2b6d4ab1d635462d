"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents; a dropped document is gone for the later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, decontaminate, jaccard, langid, line_dedup
from colloquy.llm.common import free_name, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no letters in them, or nothing to compare with); others get the language
    that was found as ``lang``."""
    prototypes = langid.learn(docs)
    found_as = free_name(docs.columns, "found_lang")
    found = langid.predict(docs, prototypes, lang_out=found_as).filter(F.col(found_as) != "und")
    return found.select(*(F.col(found_as).alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share, and documents of which nothing but white space is left by that."""
    dropped = free_name(docs.columns, "n_dropped")
    kept = line_dedup.dedup(docs, n_dropped=dropped)
    left = (F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(F.coalesce(left, F.lit(True))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each whole text and whether they decode to it."""
    ids, decoded, n, same = (free_name(docs.columns, c) for c in ("ids", "decoded", "n_tokens", "round_trip"))
    coded = bpe.decode(bpe.encode(docs, ids_col=ids), ids, decoded)
    return coded.withColumn(n, F.size(ids).cast("long")).withColumn(same, F.col(decoded) == F.coalesce("text", F.lit(""))).drop(decoded)


#: In order.
STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: A language model and a tokenizer are not expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
