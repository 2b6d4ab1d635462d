"""How five quality filters act on each other: what each would drop in every order of application.

A: fewer than 50 words; B: fewer than 65 distinct words in 100; C: more than 5 capitals A-Z in 100 code points; D: any of
``#$%&*|``; E: the text of a document with a smaller id. Words are runs of anything but ASCII white space.

1. One pass over the texts gives each row a hash of its text and its failures A to D as bits.
2. Hashes that several ids have are counted (ids and hashes only, pre-aggregated). Only rows with such a hash, the smallest
   id of each left out, are sent with their texts: a left-semi join on hash, exact text and a smaller id marks E. Its right
   side is one row for each different text; a text with many copies is dealt over cells of about ``CELL`` rows.
3. The rows that E marks and all rows with their other failures are united and added up by row, then by part and
   combination of bits: at most 32 rows for each part.
4. What an order keeps after some filters are the rows that fail none of them, so every count of every order is a
   difference of two of 32 sums.

Edge cases: null text is empty; an empty text fails A only (no words, no characters), and E if it is there again; rows
without doc_id are counted and never fail E; repeated rows of one doc_id and text are counted each and are no
earlier copy of each other; a document with several labels has the best quality and the worst toxicity of them; null
sources are the part ''; an empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sent_if_small

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: Rows of one text that meet in one cell, about.
CELL = 1_000
_E, _ALL = 16, 31


def failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    tests = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )
    bits = [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def judged(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, th (hash of its text), bits (its failures A to D)."""
    return _rows(docs).select("doc_id", "part", F.xxhash64("text").alias("th"), failures(F.col("text")).alias("bits"))


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, part, th) whose text a smaller doc_id has; ``rows`` are the rows of ``judged``, written down."""
    seen = rows.filter("doc_id IS NOT NULL").groupBy("th").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    many = materialize(seen.filter("first < last").select("th", "first", F.ceil(F.col("n") / CELL).cast("int").alias("cells")), "repeated-texts")
    own = _rows(docs).withColumn("th", F.xxhash64("text")).join(sent_if_small(many, 24), "th")
    later = own.filter("doc_id > first").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int"))
    texts = own.filter("doc_id IS NOT NULL").groupBy("th", "text").agg(F.min("doc_id").alias("smallest"), F.max("cells").alias("cells"))
    texts = texts.select(F.col("th").alias("seen_th"), F.col("text").alias("seen_text"), "smallest", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("seen_cell"))
    same = (later["th"] == texts["seen_th"]) & (later["cell"] == texts["seen_cell"]) & (later["text"] == texts["seen_text"]) & (texts["smallest"] < later["doc_id"])
    return later.join(texts, same, "left_semi").select("doc_id", "part", "th")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and combination of failures (bits): n documents, good and toxic ones by their labels."""
    rows = materialize(judged(docs), "judged")
    marks = rows.select("doc_id", "part", "th", "bits", F.lit(1).cast("long").alias("n"))
    copies = repeats(docs, rows).select("doc_id", "part", "th", F.lit(_E).alias("bits"), F.lit(0).cast("long").alias("n"))
    each = marks.unionByName(copies).groupBy("doc_id", "part", "th").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return each.join(known, "doc_id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _steps() -> Column:
    """All orders and steps: filter_order, step, at (number of the filter), before (bits of the filters before it)."""
    out = []
    for order in itertools.permutations(range(len(LETTERS))):
        name = "".join(LETTERS[i] for i in order)
        out += [{"filter_order": name, "step": k + 1, "at": at, "before": sum(1 << i for i in order[:k])} for k, at in enumerate(order)]
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order:string,step:int,at:int,before:int>>")


def _orders(f: int, m: int) -> int:
    """How often a document that ``m`` keeps counts as removed by filter ``f``, over all orders: once for each order in which
    the filters of ``m`` come first and f next; what is still there after f is taken off again."""
    first, sign = (m & ~(1 << f)).bit_count(), -1 if m >> f & 1 else 1
    return sign * math.factorial(first) * math.factorial(len(LETTERS) - 1 - first)


def report(found: DataFrame) -> DataFrame:
    """Per part, order and step what ``combinations`` add up to (see the module)."""
    masks = range(_ALL + 1)
    parts = found.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # 32 at most
    zero = F.lit(0).cast("long")

    def kept(what: str) -> Column:
        fit = lambda m: lambda s, c: s + F.when(c["bits"].bitwiseAND(m) == 0, c[what]).otherwise(0)
        return F.transform(F.sequence(F.lit(0), F.lit(_ALL)), lambda m: F.aggregate("c", zero, fit(m)))

    weights = F.from_json(F.lit(json.dumps([[_orders(f, m) for m in masks] for f in range(len(LETTERS))])), "array<array<bigint>>")
    kept_by = parts.select("part", *(kept(c).alias(c) for c in ("n", "good", "toxic")))
    shapley = F.transform(weights, lambda w: F.aggregate(F.zip_with("n", w, lambda a, b: a * b), zero, lambda s, x: s + x))
    arrays = kept_by.withColumn("shapley", shapley)
    steps = arrays.select("*", F.explode(_steps()).alias("s")).select("*", "s.*")
    bit = F.expr("shiftleft(1, at)")
    after = F.col("before").bitwiseOR(bit)
    of = lambda c, m: F.get(F.col(c), m)
    lost = lambda c: of(c, F.col("before")) - of(c, after)
    return steps.select(
        "part",
        "filter_order",
        "step",
        of("n", after).alias("kept"),
        lost("n").alias("removed"),
        (of("n", F.lit(0)) - of("n", bit) - lost("n")).alias("redundant"),
        (of("n", F.lit(_ALL) - bit) - of("n", F.lit(_ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        of("shapley", F.col("at")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source), order of the five filters and step: kept, removed, redundant (fails, but removed earlier),
    unique_fails (fails this filter only), good_lost, toxic_lost, shapley (removed by this filter, over all orders)."""
    return report(combinations(docs, labels))
