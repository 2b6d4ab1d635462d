"""SpotSigs fingerprints of documents in DataFrame functions only.

Words are runs of letters (A-Z lowered), digits and characters beyond ASCII. Every common word (``ANCHORS``) followed by at
least ``CHAIN`` others that are not common, wherever the next of them stand, gives a signature: the anchor and that chain of
content words. A text's signatures are a set; a text with words but without any signature is one signature of all its
words. The fingerprint is a hash of the set, and likeness is the sets' Jaccard similarity.

``fingerprints`` pairs each document with its edited text and with the next document. Documents are dealt by range of
(doc_id, hash of text) into buckets of about ``BUCKET_BYTES`` of text, whose bounds come from ids and hashes alone; the
first document of each bucket goes to the bucket before too, so that every document finds its next one in its own bucket:
each text is shuffled once, and no task holds more than a bucket's rows in order.

``near_copies`` searches the whole table for documents alike. Equal sets are one class. Sets are partitioned by length, so that
two that can be alike are in one partition or in neighbouring ones; each class posts the rarest signatures of its set, as many
as it takes for alike sets to share one, in its partition and in the next. A posting list compares its longest member with
the others, on whole sets and only where sizes fit; members of one component need not meet any more, so a group of copies has
about as many comparisons as members. After ``ROUNDS`` longest members, what is left of a list meets pairwise, dealt over
cells of ``CELL`` members by all others.

Edge cases: null text is empty; a text without words has no signatures and is like nothing but another such text; equal
fingerprints have a likeness of 1; rows without doc_id come before all others and take part; repeated rows are
documents of their own, next to each other; a table of one row is its own next document; an empty table gives no rows.
Other columns are not read. In ``near_copies`` rows of one doc_id have the links of
each of them, and rows without signatures or doc_id are alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import discard, freed_shuffles, materialize
from .components import components
from .decontaminate import words

#: Content words after an anchor that make a signature with it.
CHAIN = 3
#: Common words of four languages; any other list can be given.
ANCHORS = tuple(
    """
    the of and to a in is that it for was on with as be by this are at from have not or an which can will has he she they we you but
    der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un du une que est pour qui dans par sur pas au avec il ce ne se ou son plus mais nous sont
    el y los se del las con no su lo al es una por para como más pero sus le ya o este sí porque
    """.split()
)
#: Bytes of text in a bucket of neighbouring documents, about, and the most buckets that there can be.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 65_536
#: Members of a posting list that are compared with all others, one after the other, before the rest meets; members of a cell.
ROUNDS, CELL = 4, 256


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text."""
    common = sorted(set(anchors))

    def spots(p: Column) -> Column:
        # The j-th anchor (from 0) stands at word i, with i - j content words before it.
        spot = lambda i, j: F.when(i - j + chain <= F.size(p["content"]), F.concat_ws(" ", F.get(p["w"], i), F.slice(p["content"], i - j + 1, chain)))
        return F.sort_array(F.array_distinct(F.array_compact(F.transform(p["at"], spot))))

    def of(w: Column) -> Column:
        at = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(common), i)))
        parts = F.struct(w.alias("w"), F.filter(w, lambda x: ~x.isin(common)).alias("content"), at.alias("at"))
        whole = F.when(F.size(w) > 0, F.array(F.concat(F.lit(" "), F.array_join(w, " ")))).otherwise(F.array().cast("array<string>"))
        return _let(_let(parts, spots), lambda some: F.when(F.size(some) > 0, some).otherwise(whole))

    return _let(words(text), of)


def fingerprint(sigs: Column) -> Column:
    """A hash of a set of signatures as ``signatures`` gives it."""
    return F.sha2(F.array_join(sigs, "\n"), 256)


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of two sets: sets that are equal, or of which one is empty, are told without comparing them."""
    shared = F.size(F.array_intersect(one, two))
    jaccard = shared / (F.size(one) + F.size(two) - shared)
    return F.when(one == two, 1.0).when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(jaccard)


# -- each document with the next one ----------------------------------------------------------


def _bounds(rows: DataFrame) -> tuple[list[dict], Row | None]:
    """The first (doc_id, hash of text) of each bucket but the first, in order, ``MOST_BUCKETS`` at most; and the first of all."""
    ids = materialize(rows.select("doc_id", "th", F.octet_length("text").cast("long").alias("bytes")), "ids")
    key = F.struct("doc_id", "th").alias("k")
    n, size, first = ids.select(key, "bytes").agg(F.count("*"), F.sum("bytes"), F.min("k")).first()
    buckets = min(max(1, -(-(size or 0) // BUCKET_BYTES)), MOST_BUCKETS, max(n, 1))
    dealt = ids.filter("doc_id IS NOT NULL").repartitionByRange(int(buckets), "doc_id", "th").select(F.spark_partition_id().alias("p"), key)
    firsts = sorted(tuple(r["k"]) for r in dealt.groupBy("p").agg(F.min("k").alias("k")).collect())
    return [{"doc_id": d, "th": t} for d, t in firsts[1:]], first


def _with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Rows (doc_id, text) after ``prepare``, with ``columns`` of the next row as ``next_`` columns; see the module."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    bounds, first = _bounds(rows)
    known = F.from_json(F.lit(json.dumps(bounds)), "array<struct<doc_id:bigint,th:bigint>>")
    own = F.struct("doc_id", "th")
    # How many bounds are at or before a row, by halving.
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(len(bounds).bit_length(), 1)))))
    at = F.aggregate(steps, F.lit(0), lambda done, step: F.when(F.get(known, done + step - 1) <= own, done + step).otherwise(done))
    keyed = rows.withColumn("bucket", at)
    place = lambda bucket, guest: F.struct(bucket.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    # A bucket's first row (with rows equal to it) is a guest in the bucket before, the first of all in the last one.
    leads = (F.col("bucket") > 0) & (own == F.get(known, F.col("bucket") - 1))
    is_first = F.col("doc_id").eqNullSafe(F.lit(first["doc_id"] if first else None).cast("long")) & (F.col("th") == F.lit(first["th"] if first else None).cast("long"))
    places = F.array_compact(F.array(place(F.col("bucket"), 0), F.when(leads, place(F.col("bucket") - 1, 1)), F.when(is_first, place(F.lit(len(bounds)), 2))))
    placed = keyed.select("doc_id", "th", "text", F.explode(places).alias("at")).select("doc_id", "th", "text", "at.*")
    dealt = prepare(placed.repartition("bucket"))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "th")
    led = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return led.filter("guest = 0").drop("guest", "bucket", "th")


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last quarter of code points is replaced by as many of the beginning of ``following``, or all it has."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(following, F.lit(1), n))


def fingerprints(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Per row: doc_id, text, sigs, edited_text, edited_sigs, and near_edited and near_next, the likeness of its signatures to
    those of its edited text and of the next document."""
    led = _with_next(docs, lambda df: df.withColumn("sigs", signatures(F.col("text"), anchors, chain)), ["text", "sigs"])
    changed = led.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    both = changed.withColumn("edited_sigs", signatures(F.col("edited_text"), anchors, chain))
    near = {name: likeness(F.col("sigs"), F.col(other)).alias(name) for name, other in (("near_edited", "edited_sigs"), ("near_next", "next_sigs"))}
    return both.select("doc_id", "text", "sigs", "edited_text", "edited_sigs", *near.values())


# -- alike documents of the whole table -------------------------------------------------------


def length_bounds(most: int, num: int, den: int) -> list[int]:
    """The smallest length of each partition: no set is alike to one two partitions further."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return out


def _classes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Per class of equal sets: node, fp, doc_id (the smallest), n, part, codes (its signatures' hashes), prefix (the rarest)."""
    own = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("codes").alias("codes"))
    own = materialize(own.withColumn("node", F.monotonically_increasing_id()), "spot-classes")
    parts = own.select("node", "n", F.explode("codes").alias("c"))
    ranked = parts.join(parts.groupBy("c").agg(F.count("*").alias("m")), "c").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("m", "c"))).alias("r"))
    least = F.ceil(F.col("n") * num / den)  # shared at least with any set alike
    prefix = F.transform(F.slice("r", F.lit(1), (F.col("n") - least + 1).cast("int")), lambda x: x["c"])
    bounds = F.array(*map(F.lit, length_bounds(own.agg(F.max("n")).first()[0] or 0, num, den)))
    part = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
    return materialize(own.join(ranked.select("node", prefix.alias("prefix")), "node").withColumn("part", part), "spot-classes")


def _alike(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets are alike."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("codes").alias(f"{name}_codes"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_codes", "b_codes"))
    return both.filter(shared * den >= (F.size("a_codes") + F.size("b_codes") - shared) * num).select("a", "b")


def _links(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Links between classes that lead to all that are alike: node, component."""
    homes = F.array(*(F.struct((F.col("part") + k).alias("p"), F.lit(bool(k)).alias("up")) for k in (0, 1)))
    posted = classes.select("node", "n", F.explode("prefix").alias("c"), homes.alias("homes")).select("node", "n", "c", F.explode("homes").alias("h"))
    lists = posted.select("node", "n", "h.up", F.xxhash64("c", "h.p").alias("tok"))
    fits = (F.least("n", "n_2") * den >= F.greatest("n", "n_2") * num) & ~(F.col("up") & F.col("up_2"))
    labels, links = classes.select("node", F.col("node").alias("component")), None

    def open_lists(now: DataFrame) -> DataFrame:
        """What is in lists of more than one component still."""
        labelled = now.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = labelled.groupBy("tok").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("tok")
        return materialize(labelled.join(mixed, "tok"), "spot-lists")

    for round_ in range(ROUNDS + 1):
        live = open_lists(lists)
        if live.isEmpty():
            break
        other = lambda df: df.withColumnsRenamed({c: f"{c}_2" for c in ("node", "n", "up", "component")})
        if round_ < ROUNDS:
            first = F.struct("n", "node", "up", "component")
            hubs = live.groupBy("tok").agg(F.max(first).alias("f")).select("tok", "f.*")
            met = live.join(other(hubs), "tok")
        else:
            cells = live.groupBy("tok").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
            dealt = live.join(cells, "tok")
            one = dealt.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).drop("cells")
            two = other(dealt.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells"))
            met = one.join(two, ["tok", "cell"]).filter("node < node_2")
        pairs = met.filter(fits & (F.col("component") != F.col("component_2"))).select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()
        found = materialize(_alike(pairs, classes, num, den), "spot-links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = materialize(components(links), "spot-components")
        # The longest member has met all others of its list.
        lists = live.select("node", "n", "up", "tok")
        if round_ < ROUNDS:
            lists = lists.join(hubs.select("tok", "node", "up"), ["tok", "node", "up"], "left_anti").select("node", "n", "up", "tok")
            lists = materialize(lists, "spot-lists")
        discard(live)
    return labels


def near_copies(docs: DataFrame, num: int = 80, den: int = 100, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Per row: doc_id, n_sigs, fingerprint and class_id, the smallest doc_id that links of a similarity of ``num / den`` lead to,
    itself included. Signatures are compared by 64-bit hashes."""
    with freed_shuffles(docs.sparkSession):
        sigs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text"), anchors, chain).alias("sigs"))
        sets = materialize(sigs.select("doc_id", F.size("sigs").alias("n"), fingerprint(F.col("sigs")).alias("fp"), F.transform("sigs", lambda x: F.xxhash64(x)).alias("codes")), "spots")
        classes = _classes(sets, num, den)
        found = classes.select("fp", "node").join(_links(classes, num, den), "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
        rows = sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "fp").distinct().join(found, "fp")
        # A document with several rows joins their components.
        by_doc = rows.select("doc_id", "component").distinct()
        lead = by_doc.groupBy("doc_id").agg(F.min("component").alias("lo"))
        bridges = by_doc.join(lead, "doc_id").select(F.col("component").alias("a"), F.col("lo").alias("b")).filter("a <> b").distinct()
        joined = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        whole = materialize(by_doc.join(joined, "component", "left").select("doc_id", F.coalesce("whole", "component").alias("whole")).distinct(), "spot-leads")
        leads = whole.groupBy("whole").agg(F.min("doc_id").alias("class_id"))
        of = materialize(whole.join(leads, "whole").select(F.col("doc_id").alias("_d"), "class_id").distinct(), "spot-leads")
    joined = sets.join(of, (F.col("doc_id") == F.col("_d")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_sigs"), F.col("fp").alias("fingerprint"), F.coalesce("class_id", "doc_id").alias("class_id"))
