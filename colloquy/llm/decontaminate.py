"""Benchmark decontamination in DataFrame functions only.

Words are runs of letters a-z (after A-Z are lowered), digits and characters beyond ASCII. A window is ``width``
consecutive words of a benchmark item; an item with fewer words is one window. The windows' hashes, with the
windows themselves, go to all tasks; each document's windows are hashed (each word once, then its hashes), looked up,
and hits verified word by word. A benchmark of more than ``BROADCAST_BYTES`` goes in parts of at most about that size,
one pass over the documents for each: no word of a document is shuffled, and no document waits for another.

Edge cases: null text has no words and no hits; an item without words is no window; windows that several items
share count for each; repeated documents have a result each; rows without an id are handled as any other. An empty
benchmark hits nothing. Columns besides stay in ``clean`` and are left out of ``hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, materialize

#: Words of a window.
WIDTH = 10
#: Bytes of benchmark windows that are sent to all tasks at once.
BROADCAST_BYTES = 64 << 20
#: The key of the one row that each document keeps besides its hits.
_KEPT = 0


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: length, hash, words and the items (as strings) that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - width + 1, F.lit(1)))
    return (
        items.filter("n > 0")
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.least(F.col("n"), F.lit(width))))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .select(F.size("window").alias("length"), _hash(_codes(F.col("window"))).alias("h"), "window", "items")
    )


def _codes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _hash(codes: Column) -> Column:
    h = F.xxhash64(codes)
    return F.when(h == _KEPT, F.lit(1).cast("long")).otherwise(h)


def _probe(n: int, entry):
    return lambda i: entry(_hash(F.slice("codes", i, n)), i, n)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document (id column doc_id): text_hash, n_words, spans (struct of first word from 1 and length), items (sorted strings)."""
    spark = docs.sparkSession
    found = windows(benchmark, width)
    size = F.length(F.array_join("window", " ")) + F.length(F.array_join("items", " ")) + 64
    sizes = found.groupBy("length").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()  # width rows at most
    lengths = sorted(r["length"] for r in sizes) or [width]
    kept = spark.range(1).select(F.lit(0).alias("length"), F.lit(_KEPT).cast("long").alias("h"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))
    entry = lambda h, at, n: F.struct(h.cast("long").alias("h"), at.cast("int").alias("at"), F.lit(n).alias("length"))
    probes = []
    for n in lengths:
        starts = F.when(F.col("n_words") >= n, F.sequence(F.lit(1), F.col("n_words") - n + 1)).otherwise(F.array().cast("array<int>"))
        probes.append(F.transform(starts, _probe(n, entry)))
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w")).withColumn("codes", _codes(F.col("w")))
    own = ("doc_id", "text_hash", "n_words")

    def one_pass(table: DataFrame, first: bool) -> DataFrame:
        """Hits on the windows of ``table``; the first pass has a row for each document besides."""
        keep = [F.array(entry(F.lit(_KEPT), F.lit(0), 0))] if first else []
        probed = worded.select(*own, "w", F.explode(F.concat(*keep, *probes)).alias("p")).select(*own, "w", "p.h", "p.at", "p.length")
        table = F.broadcast((table.unionByName(kept) if first else table).withColumnsRenamed({"h": "wh", "length": "wl"}))
        same = (F.col("length") == 0) | (F.slice("w", F.col("at"), F.col("length")) == F.col("window"))
        return probed.join(table, (F.col("h") == F.col("wh")) & (F.col("length") == F.col("wl")) & same).select(*own, "at", "length", "items")

    parts = max(1, -(-sum(r["bytes"] for r in sizes) // BROADCAST_BYTES))
    if parts == 1:
        verified = one_pass(found, True)
    else:
        found = materialize(found.withColumn("part", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(parts))), "windows")
        passes = [materialize(one_pass(found.filter(F.col("part") == i).drop("part"), i == 0), "hits") for i in range(parts)]
        verified = passes[0]
        for more in passes[1:]:
            verified = verified.unionByName(more)
    hit = F.col("length") > 0
    grouped = verified.groupBy(*own).agg(
        F.collect_set(F.when(hit, F.struct("at", "length"))).alias("spans"),
        F.collect_set(F.when(hit, F.col("items"))).alias("items"),
        F.sum(F.when(hit, 0).otherwise(1)).alias("rows"),
    )
    return grouped.select(*own, F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("row")


def n_hit(spans: Column) -> Column:
    """Words inside any of the spans."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark."""
    th, key = (free_name(docs.columns, n) for n in ("text_hash", "hit_id"))
    bad = hits(docs, benchmark, width).filter(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("text_hash").alias(th)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[key]) & (F.xxhash64(docs["text"]) == bad[th]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``kept_words``: the normalised words outside all hits, for uses that drop spans rather than documents."""
    th, key, spans, kept = (free_name(docs.columns, n) for n in ("text_hash", "hit_id", "spans", "kept_words"))
    found = hits(docs, benchmark, width).select(F.col("doc_id").alias(key), F.col("text_hash").alias(th), F.col("spans").alias(spans)).distinct()
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[key]) & (F.xxhash64(docs["text"]) == found[th]), "left")
    w = words(F.col("text"))
    gone = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    every = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
    return joined.withColumn(kept, F.transform(F.array_except(every, F.coalesce(gone, F.array().cast("array<int>"))), lambda i: F.element_at(w, i))).drop(th, key, spans)
