"""Line dedup across documents in DataFrame functions only.

A line's key is the line without white space at its ends and with A-Z lowered. Keys of at least ``min_chars``
code points that occur in at least ``min_docs`` documents lose their lines everywhere but in the document with the
largest id. Only 128-bit hashes of keys, ids and positions are shuffled for the counts; the hashes are distinct per
document before they meet, so a line that most documents hold arrives as one partial count from each task.

Edge cases: null or empty text is one empty line and stays as it is; repeated rows of a document count as one
document and all lose the same lines; rows without doc_id count for nothing and lose nothing; columns besides stay, and
a result name that is taken gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, materialize

MIN_CHARS = 20
MIN_DOCS = 3


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each line long enough: doc_id, text_hash (tells rows of one doc_id apart), pos, and two hashes of its key."""
    key = F.trim(F.col("line"), F.lit(" \t\n\x0b\x0c\r"))
    return (
        docs.filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines(ascii_lower(F.col("text")))).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys in at least ``min_docs`` documents: h1, h2, n_docs, last_doc."""
    return (
        _hashed(docs, min_chars)
        .select("h1", "h2", "doc_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .filter(F.col("n_docs") >= min_docs)
    )


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with repeated lines dropped from text, and ``n_lines`` (before) and ``n_dropped``."""
    many = materialize(repeated(docs, min_chars, min_docs), "repeated-lines")  # so that a hot line's rows can be split in the join
    th, key, gone, all_ = (free_name(docs.columns, n) for n in ("text_hash", "drop_id", "drop_lines", "own_lines"))
    n_lines, n_dropped = (free_name(docs.columns, n) for n in (n_lines, n_dropped))
    drops = (
        _hashed(docs, min_chars)
        .join(many.select("h1", "h2", "last_doc"), ["h1", "h2"])
        .filter(F.col("doc_id") != F.col("last_doc"))
        .groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(th))
        .agg(F.collect_set("pos").alias(gone))
    )
    joined = docs.join(drops, (docs["doc_id"] == drops[key]) & (F.xxhash64(docs["text"]) == drops[th]), "left")
    own = lines(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(gone)), lambda i: F.get(all_, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    with_lines = joined.withColumn(all_, own)
    return with_lines.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.size(all_).cast("long").alias(n_lines),
        F.coalesce(F.size(F.when(F.col(gone).isNotNull(), F.col(gone))), F.lit(0)).cast("long").alias(n_dropped),
    )
