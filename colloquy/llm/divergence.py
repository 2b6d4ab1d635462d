"""How the sources of each language differ in their words.

Terms are runs of letters: a-z (A-Z lowered) and characters beyond ASCII. Each language keeps the terms in at least
``MIN_DOCS`` of its documents. A kept term's share in a group (language and source), or in the language, is
p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), where N adds up the counts of the V kept terms; all of it in whole
numbers. Two sources differ by the sum of abs(p - q) over all kept terms; a term stands out in a source by how far its share
exceeds that of the language.

Strings are materialised late:

1. Occurrences are counted by 64-bit digests of the terms, sorted within a document so that its first occurrence of each
   tells documents from occurrences: only digests, of fixed width, are shuffled, added up in each task first.
2. Digests that are kept by some language are looked up: of their terms, one row for each different string of a task is sent,
   and each digest gets its smallest and largest string. If the two differ, several terms collide: those digests
   alone are counted again by string and split (``alt``). A term that is kept has a digest that is kept, so none is missed.
3. Everything else works on digests; text is joined back for terms that reach the result or tie with one that does.

Terms that a group has not (nearly all, for small groups) have one share in it, its base, and are never listed: a pair's sum is
V * abs(base - base), corrected by the terms that one of both has. Corrections are added up in cells of a language's terms
and two blocks of at most ``BLOCK`` sources, as vectors over the terms of a cell.

Edge cases: null text, language and source are empty strings; every group that occurs is in the result even without
terms; a language without kept terms gives pairs of value 0 and no terms; a row is a document, repeated rows too; rows without
doc_id count like any other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, is_small, materialize, sent_if_small

MIN_DOCS, SMOOTH, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Sources of a block, and counts of terms in a cell, about.
BLOCK, CELL = 64, 4_000
#: Characters that no term has.
_OTHER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_GROUP = ("lang", "source")


def _rows(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), ascii_lower(F.coalesce("text", empty)).alias("text"))


def _terms(text: Column) -> Column:
    """A text's terms, and an empty string where it begins or ends with another character."""
    return F.split(text, _OTHER)


Digest = Callable[[Column], Column]


def _occurrences(rows: DataFrame, values: Column) -> DataFrame:
    """A row for each of ``values``, an array of each row: lang, source, value, first (1 at its first time in the row, else 0)."""
    own = rows.select(*_GROUP, F.sort_array(values).alias("v"))
    kind = own.schema["v"].dataType.elementType.simpleString()
    before = F.concat(F.array(F.lit(None).cast(kind)), "v")
    each = own.select(*_GROUP, F.explode(F.arrays_zip(F.col("v").alias("value"), before.alias("before"))).alias("x")).select(*_GROUP, "x.*").filter("value IS NOT NULL")
    return each.select(*_GROUP, "value", F.when(F.col("before") == F.col("value"), 0).otherwise(1).alias("first"))


def _counts(rows: DataFrame, digest: Digest) -> DataFrame:
    """Per group and digest: n occurrences, df documents."""
    digests = F.transform(F.filter(_terms(F.col("text")), lambda t: t != ""), lambda t: digest(t))
    return _occurrences(rows, digests).groupBy(*_GROUP, F.col("value").alias("digest")).agg(F.count("*").alias("n"), F.sum("first").alias("df"))


def _strings(rows: DataFrame, wanted: DataFrame, digest: Digest) -> DataFrame:
    """The different terms of the digests that are ``wanted``: digest, term."""
    each = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).filter("term <> ''").select(digest(F.col("term")).alias("digest"), "term")
    if is_small(wanted, 8):
        return each.join(F.broadcast(wanted), "digest").distinct()
    return each.distinct().join(wanted, "digest")


def _split(rows: DataFrame, collided: DataFrame, digest: Digest) -> DataFrame:
    """Per group and term (alt) of the digests that several terms have: digest, alt, n, df."""
    each = _occurrences(rows, F.filter(_terms(F.col("text")), lambda t: t != "")).withColumn("digest", digest(F.col("value")))
    own = each.join(sent_if_small(collided, 8), "digest")
    return own.groupBy(*_GROUP, "digest", F.col("value").alias("alt")).agg(F.count("*").alias("n"), F.sum("first").alias("df"))


def counted(docs: DataFrame, min_docs: int = MIN_DOCS, digest: Digest = F.xxhash64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of kept terms by group (lang, source, digest, alt, n) and by language (lang, digest, alt, n), and the terms
    (digest, alt, term). ``alt`` is empty but for terms whose digests collide."""
    rows = _rows(docs)
    counts = materialize(_counts(rows, digest), "term-counts")

    def of_lang(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy("lang", *by).agg(F.sum("n").alias("n"), F.sum("df").alias("df")).filter(F.col("df") >= min_docs).drop("df")

    kept = materialize(of_lang(counts, "digest"), "kept-terms")
    wanted = materialize(kept.select("digest").distinct(), "kept-digests")
    spans = materialize(_strings(rows, wanted, digest).groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "spans")
    collided = materialize(spans.filter("term <> last").select("digest"), "collisions")
    alone = F.lit("").alias("alt")
    terms = spans.filter("term = last").select("digest", alone, "term")
    kept, groups = kept.select("lang", "digest", alone, "n"), counts.select(*_GROUP, "digest", alone, "n")
    if not collided.isEmpty():
        split = materialize(_split(rows, collided, digest), "split-terms")
        kept = kept.join(collided, "digest", "left_anti").select(kept.columns).unionByName(of_lang(split, "digest", "alt"))
        kept = materialize(kept, "kept-terms")
        groups = groups.join(collided, "digest", "left_anti").select(groups.columns).unionByName(split.drop("df"))
        terms = terms.unionByName(split.select("digest", "alt", F.col("alt").alias("term")).distinct())
    key = ["lang", "digest", "alt"]
    groups = groups.join(sent_if_small(kept.select(key), 64), key, "left_semi").select(groups.columns)
    return materialize(groups, "group-counts"), kept, terms


def _share(n: str, total: str, terms: str) -> Column:
    whole = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {whole(f'{n} + {SMOOTH}')} * CAST({SCALE} AS DECIMAL(10, 0)) div {whole(f'{total} + {SMOOTH} * {terms}')} ELSE 0 END")


def _group_table(docs: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group: lang, source, no (of the source in its language, from 0), block, total, terms, base, lang_total, cells, blocks."""
    own = groups.groupBy(*_GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("listed"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    every = _rows(docs).select(*_GROUP).distinct().join(own, list(_GROUP), "left").join(langs, "lang", "left").fillna(0, ["total", "listed", "terms", "lang_total"])
    by_lang = Window.partitionBy("lang")
    no = F.row_number().over(by_lang.orderBy("source")) - 1
    return every.select(
        *_GROUP,
        no.alias("no"),
        F.floor(no / BLOCK).cast("int").alias("block"),
        "total",
        "terms",
        "lang_total",
        _share("0", "total", "terms").alias("base"),
        F.ceil(F.greatest(F.sum("listed").over(by_lang) / CELL, F.lit(1))).cast("int").alias("cells"),
        F.ceil(F.count("*").over(by_lang) / BLOCK).cast("int").alias("blocks"),
    )


def _differences(cell: pd.DataFrame) -> pd.DataFrame:
    """Of the sources in a cell, for each two (of its blocks, one in either): what its terms add to V * abs(base - base)."""
    marks, found = cell[cell["mark"]], cell[~cell["mark"]]
    no, at = np.unique(marks["no"].to_numpy(), return_index=True)
    base = marks["share"].to_numpy()[at]
    term = found.groupby(["digest", "alt"], sort=False).ngroup().to_numpy()
    shares = np.repeat(base[:, None], term.max(initial=-1) + 1, axis=1)
    shares[np.searchsorted(no, found["no"].to_numpy()), term] = found["share"].to_numpy()
    block = marks["block"].to_numpy()[at]
    lang, low, high = marks["lang"].iloc[0], marks["low"].iloc[0], marks["high"].iloc[0]
    ones, twos, values = [], [], []
    for i in np.flatnonzero(block == low):
        j = np.flatnonzero((block == high) & (no > no[i]))
        ones.append(np.full(len(j), no[i]))
        twos.append(no[j])
        values.append((np.abs(shares[j] - shares[i]) - np.abs(base[j] - base[i])[:, None]).sum(axis=1))
    one, two, value = (np.concatenate(x).astype(np.int64) for x in (ones, twos, values))
    return pd.DataFrame({"lang": pd.Series([lang] * len(one), dtype=object), "one": one, "two": two, "value": value})


def _pairs(shares: DataFrame, table: DataFrame) -> DataFrame:
    """Every two sources of a language, in both orders: lang, source, item (the other), value."""
    both = lambda b: F.struct(F.least(b, "block").alias("low"), F.greatest(b, "block").alias("high"))
    blocks = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), both))
    columns = ("lang", "cell", "low", "high", "no", "block", "mark", "digest", "alt", "share")
    listed = shares.withColumn("cell", F.pmod(F.xxhash64("digest", "alt"), F.col("cells")).cast("int")).withColumn("b", blocks).select("*", "b.*").withColumn("mark", F.lit(False))
    marks = table.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("b", blocks).select("*", "b.*")
    marks = marks.select("*", F.lit(True).alias("mark"), F.lit(0).cast("long").alias("digest"), F.lit("").alias("alt"), F.col("base").alias("share"))
    cells = listed.select(*columns).unionByName(marks.select(*columns))
    parts = cells.groupBy("lang", "cell", "low", "high").applyInPandas(_differences, "lang string, one long, two long, value long")
    sums = parts.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    name = lambda no, as_: sent_if_small(table, 128).select("lang", F.col("no").cast("long").alias(no), F.col("source").alias(as_), F.col("base").alias(f"{no}_base"), F.col("terms").alias(f"{no}_terms"))
    named = sums.join(name("one", "a"), ["lang", "one"]).join(name("two", "b"), ["lang", "two"])
    named = named.withColumn("value", F.col("value") + F.col("one_terms") * F.abs(F.col("one_base") - F.col("two_base")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return named.select("lang", both.alias("p"), "value").select("lang", "p.*", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, digest: Digest = F.xxhash64) -> DataFrame:
    """Per group (lang, source) and part: item, value, rank. Part ``pair`` has every other source of the language, part
    ``term`` the ``ranks`` terms that stand out most."""
    groups, kept, terms = counted(docs, min_docs, digest)
    table = materialize(_group_table(docs, groups, kept), "groups")
    shares = groups.join(sent_if_small(table, 128), list(_GROUP)).withColumn("share", _share("n", "total", "terms"))
    by_group = Window.partitionBy(*_GROUP)
    pairs = _pairs(shares, table).withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "item")))

    key = ["lang", "digest", "alt"]
    common = kept.select(*key, F.col("n").alias("lang_n"))
    above = shares.join(common, key).withColumn("value", F.col("share") - _share("lang_n", "lang_total", "terms")).filter("value > 0")
    # Ties at the last rank stay until their strings tell which comes first.
    best = above.withColumn("place", F.rank().over(by_group.orderBy(F.desc("value")))).filter(F.col("place") <= ranks)
    named = best.join(terms, ["digest", "alt"]).select(*_GROUP, F.col("term").alias("item"), "value")
    ranked = named.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= ranks)
    part = lambda df, name: df.select(*_GROUP, F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(ranked, "term"))
