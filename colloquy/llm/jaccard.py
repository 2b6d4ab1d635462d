"""N-gram Jaccard join with adaptive multi-match prefixes: near-duplicate documents and their components.

A document is its set of distinct word shingles (words between ASCII white space, A-Z lowered), as 64-bit hashes.
Two documents link when their sets' Jaccard similarity is at least ``num / den``.

1. One pass counts shingles in a sketch, sized by the bytes of all texts (all documents, added up across tasks). It
   only orders them: rare first, the same order for every document, so its errors cost time and never links.
2. Documents with equal sets become one class. Each class keeps the first shingles of its set: if a pair must share
   o of its n shingles, prefixes of n - o + k shingles share k of them. Each document chooses k by estimated cost
   (postings to read against candidates to verify); a pair must share as many as the smaller k of the two.
3. Round one compares every posting list with one member only, its hub, on whole sets, so a group of near copies
   becomes one component with about as many pairs as members. Members near a hub that stay outside its component are
   then compared by their differences from it (``_around_hubs``). Lists with many members near
   no hub get further ones. Round two joins the members of a list that are in
   different components still and not both near one hub, counts shared shingles, and verifies. A link is thus within
   a component of round one, or found in one of the other two ways: none is lost, and no group's pairs are all listed.
   A long list is dealt over cells, each with two parts of its members.

Edge cases: a text with fewer words than a shingle is one shingle of all of them; a text that is null or without words
has an empty set and links with nothing; in ``classes`` rows of equal doc_id are one document that has the links of
each of its rows, and each row is returned; rows without doc_id link with nothing and have no component. Columns besides
stay out of ``classes``; ``keep_one`` keeps them, and takes rows of one doc_id with different texts for different
documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, freed_shuffles, give_back, materialize, small_batches
from .components import components

#: The sketch has a counter (of a byte, once added up) for about ``SKETCH_BYTES`` bytes of text, and 2 to a power within
#: ``SKETCH_BITS`` of them; beyond that, shingles rarer than the mean counter cannot be told apart, which costs time.
SKETCH_BYTES, SKETCH_BITS = 128, (20, 25)
#: The parts in which tasks send it, and shingles that a task holds before it counts them.
PARTS, HELD = 32, 250_000
#: Largest number of shared shingles that a prefix may ask for.
MOST = 8
#: Bits of the filter that tells which documents are in any candidate pair: so many for each of them, and 2 to a power
#: within ``FILTER_BITS``; a full filter lets more documents through to the join, which decides.
FILTER_EACH, FILTER_BITS = 16, (16, 28)
#: A member is near a hub if ALIKE times what they share is at least the sizes of both: 4 for a similarity of a third.
ALIKE = 4
#: Members near no hub from which a list gets a further hub, and how often at most; round two joins what is left.
LONG, MORE = 64, 3
#: Members of a posting list, of either side, that meet in one cell; hubs of a group that a member remembers.
CELL, HUBS = 256, 4
#: Words whose hashes a worker keeps.
KEPT = 50_000

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h


def shingles(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters, ASCII white space
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    k = min(width, n)
    own = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        own = _mix(own * _M + codes[j : n - k + 1 + j])
    return np.unique(own)


def _levels() -> np.ndarray:
    """What each byte of a sketch stands for: 0 to 64, then steps of an eighth of a power of two."""
    return np.concatenate([np.arange(64), np.rint(64 * 2 ** (np.arange(192) / 8))]).astype(np.float64)


def _bits(n: float, within: tuple[int, int]) -> int:
    return min(max(int(np.ceil(np.log2(max(n, 1)))), within[0]), within[1])


def _sketched(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of shingles by the high bits of their hashes, as bytes (see ``_levels``)."""
    total_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(total_bytes / SKETCH_BYTES, SKETCH_BITS)
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes, squeeze = WordHashes(), zstandard.ZstdCompressor(level=1)
        total, held, n = np.zeros(size, dtype=np.uint16), [], 0  # of one task; full at 65,535

        def add() -> None:
            nonlocal held, n
            if held:
                at, times = np.unique((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                total[at] = np.minimum(total[at] + times, 65_535)
            held, n = [], 0

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(shingles(text, width, hashes))
                n += len(held[-1])
                if n > HELD:
                    add()
        add()
        if total.any():
            kind = "<u1" if total.max() <= 255 else "<u2"
            for i, part in enumerate(np.split(total, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([kind]), pa.array([squeeze.compress(part.astype(kind).tobytes())], pa.binary())], names=["part", "kind", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part, kind, counts = (batch.column(c)[i].as_py() for c in ("part", "kind", "counts"))
                sums[part] = sums.get(part, 0) + np.frombuffer(expand.decompress(counts), dtype=kind).astype(np.int64)
        codes = [np.minimum(np.searchsorted(_levels(), v, side="right") - 1, 255).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(["<u1"] * len(sums), pa.string()), pa.array(codes, pa.binary())], names=["part", "kind", "counts"])

    schema = "part int, kind string, counts binary"
    got = docs.select("text").mapInArrow(give_back(run), schema).repartition(PARTS, "part").mapInArrow(give_back(add_up), schema).collect()  # 2**SKETCH_BITS[1] bytes at most
    out = np.zeros((PARTS, size // PARTS), dtype=np.uint8)
    for r in got:
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.ravel()


def prefix(own: np.ndarray, counts: np.ndarray, noise: float, num: int, den: int) -> tuple[int, int, np.ndarray]:
    """How many shingles a pair must share, how many of the prefix's seem common, and the prefix."""
    n = len(own)
    if not n:
        return 1, 0, own
    codes = counts[(own >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)]
    order = np.lexsort((own, codes))
    own, seen = own[order], _LEVELS[codes[order]]
    postings = np.cumsum(np.maximum(seen - noise, 1.0))
    least = -(-n * num // den)  # shared at least with any partner
    k = np.arange(1, min(MOST, least) + 1)
    length = n - least + k
    cost = postings[length - 1] * (1 + n / 16 / k)  # postings to read, and candidates to verify on whole sets
    best = int(np.argmin(cost))
    head = slice(0, length[best])
    return int(k[best]), int((seen[head] > noise + 4 * np.sqrt(noise) + 1).sum()), own[head]


_LEVELS = _levels()


def _profiles(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, th (a hash of its text), n (set size), f1 and f2 (its 128-bit fingerprint), k, common, prefix."""
    counts = _sketched(docs, width)
    noise = float(_LEVELS[counts].mean())
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # 2**SKETCH_BITS[1] bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            size, first, second, ks, common, prefixes = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width, hashes)
                mark = xxhash.xxh3_128_digest(own.tobytes())
                k, many, head = prefix(own, sent.value, noise, num, den)
                size.append(len(own))
                first.append(int.from_bytes(mark[:8], "little", signed=True))
                second.append(int.from_bytes(mark[8:], "little", signed=True))
                ks.append(k)
                common.append(many)
                prefixes.append(head.view(np.int64))
            numbers = [pa.array(v, pa.int64()) for v in (size, first, second, ks, common)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *numbers, _lists(prefixes)], names=["doc_id", "th", "n", "f1", "f2", "k", "common", "prefix"])

    return docs.select("doc_id", "th", "text").mapInArrow(give_back(run), "doc_id long, th long, n long, f1 long, f2 long, k long, common long, prefix array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Whole sets of (at least) the rows with the (doc_id, th) that are wanted, once each: doc_id, th, own."""
    bits_ = _bits(FILTER_EACH * wanted.count(), FILTER_BITS)
    slot = F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << bits_))
    bits = (
        wanted.select(slot.alias("s"))
        .groupBy(F.floor(F.col("s") / 32768).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("s", F.lit(32768))).alias("bits"))
        .collect()  # 2**FILTER_BITS[1] bits at most
    )
    table = np.zeros((1 << bits_) // 8, dtype=np.uint8)
    for r in bits:
        table[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            s = batch.column("slot").to_numpy()
            chosen = np.flatnonzero(sent.value[s >> 3] >> (s & 7).astype(np.uint8) & 1)
            some = batch.take(pa.array(chosen))
            own = [shingles(t, width, hashes).view(np.int64) for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("th"), _lists(own)], names=["doc_id", "th", "own"])

    found = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "th", "text", slot.alias("slot")).mapInArrow(give_back(run), "doc_id long, th long, own array<long>")
    return found.groupBy("doc_id", "th").agg(F.first("own").alias("own"))  # repeated rows


def _met(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Pairs (a, b) of nodes with the whole sets of both (one, two) and the number of shingles they share; and the tables that
    can go once these have been used."""
    places = reps.select("node", "doc_id", "th")
    wanted = {side: materialize(pairs.select(F.col(side).alias("node")).distinct().join(places, "node"), "wanted") for side in ("b", "a")}
    for side, own in (("b", "two"), ("a", "one")):
        sets = _sets(docs, wanted[side], width).withColumnRenamed("own", own)
        pairs = pairs.join(wanted[side].withColumnRenamed("node", side), side).join(sets, ["doc_id", "th"]).drop("doc_id", "th")
    return pairs.withColumn("shared", F.size(F.array_intersect("one", "two"))), tuple(wanted.values())


def _alike(num: int, den: int):
    return F.col("shared") * den >= (F.size("one") + F.size("two") - F.col("shared")) * num


def _around_hubs(near: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links between members of a hub's group that are in different components, found by their differences from it.

    With D what a member lacks of the hub and A what it has besides, members x and y share
    h - |Dx| - |Dy| + s shingles, s being what their differences share. With cost c = den |D| + num |A|, they link iff
    (den + num) s >= c(x) + c(y) - (den - num) h. A member outside the hub's component has c > (den - num) h, so any
    partner must share part of its differences: rarest first, prefixes of the differences find all such pairs,
    though all of the group may be alike.
    """
    by = lambda df, name: df.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))
    n = near.join(by(labels, "node"), "node", "left").join(by(labels, "hub"), "hub", "left").withColumn("node_component", F.coalesce("node_component", "node")).withColumn("hub_component", F.coalesce("hub_component", "hub"))
    n = n.withColumn("outside", F.col("node_component") != F.col("hub_component"))
    n = materialize(n.join(n.filter("outside").select("hub").distinct(), "hub", "left_semi"), "near")
    parts = n.select("hub", "node", F.explode("diff").alias("e"))
    often = parts.groupBy("hub", "e").agg(F.count("*").alias("m")).filter("m > 1")
    # Elements that one member has alone come first and find nobody; they only take their places in the prefix.
    ranked = parts.join(often, ["hub", "e"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("m", "e"))).alias("common"))
    n = n.join(ranked, ["hub", "node"]).withColumn("alone", F.size("diff") - F.size("common"))
    spare = F.col("h") * (den - num)
    must_x = F.greatest(F.ceil((F.col("cost") - spare) / den), F.lit(1))  # of a partner that differs as little as it can
    must_y = F.floor(F.col("cost") / (den + num)) + 1  # with any member outside
    head = lambda must: F.slice("common", 1, F.greatest(F.size("diff") - must + 1 - F.col("alone"), F.lit(0)).cast("int"))
    side = lambda df, name, must: df.select("hub", F.col("node").alias(name), F.col("node_component").alias(f"{name}c"), F.col("cost").alias(f"{name}_cost"), F.size("common").alias("all"), "h", F.posexplode(head(must)).alias("at", "p"))
    # At the first element that both have, they can share no more than it and what follows it on either side.
    x = side(n.filter("outside"), "x", must_x).select("hub", "x", "xc", "x_cost", (F.col("all") - F.col("at")).alias("x_left"), (F.col("h") * (den - num)).alias("spare"), "p.e")
    y = side(n, "y", must_y).select("hub", "y", "yc", "y_cost", (F.col("all") - F.col("at")).alias("y_left"), "p.e")
    may = (F.col("xc") != F.col("yc")) & (F.least("x_left", "y_left") * (den + num) >= F.col("x_cost") + F.col("y_cost") - F.col("spare"))
    pairs = x.join(y, (x["hub"] == y["hub"]) & (x["e"] == y["e"]) & may).select(x["hub"], "x", "y").distinct()
    info = n.select("hub", "node", "h", "cost", "diff")
    both = pairs.join(info.select("hub", F.col("node").alias("x"), "h", F.col("cost").alias("cx"), F.col("diff").alias("dx")), ["hub", "x"])
    both = both.join(info.select("hub", F.col("node").alias("y"), F.col("cost").alias("cy"), F.col("diff").alias("dy")), ["hub", "y"])
    links = both.filter(F.size(F.array_intersect("dx", "dy")) * (den + num) >= F.col("cx") + F.col("cy") - spare)
    out = materialize(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    discard(n)
    return out


def _near(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (a: hub, b: node), which can go then, those near the hub: hub, node, h (the hub's size), linked, diff (what
    only one of them has) and its cost (see ``_around_hubs``)."""
    met, used = _met(pairs, docs, reps, width)
    lacks, extra = F.array_except("one", "two"), F.array_except("two", "one")
    halves = met.filter(F.col("shared") * ALIKE >= F.size("one") + F.size("two"))
    out = halves.select(
        F.col("a").alias("hub"), F.col("b").alias("node"), F.size("one").alias("h"), _alike(num, den).alias("linked"), F.concat(lacks, extra).alias("diff"),
        (F.size(lacks) * den + F.size(extra) * num).alias("cost"),
    )
    near = materialize(out, "near")
    discard(pairs, *used)
    return near


def _with_hubs(near: DataFrame, links: DataFrame | None, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links so far with those to and around the hubs of ``near``, and the components of them."""
    own = near.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = own if links is None else links.unionByName(own)
    labels = _labels(links)
    more = _around_hubs(near, labels, num, den)
    if more.isEmpty():
        return links, labels
    links = links.unionByName(more)
    discard(labels)
    return links, _labels(links)


def _labels(links: DataFrame) -> DataFrame:
    return materialize(components(links), "components")


def _rank() -> Column:
    """A member's rank within a list: by its common shingles, then by a hash."""
    return F.shiftleft(F.shiftright("nk", 8).bitwiseAND(4095), 48) + F.shiftrightunsigned(F.xxhash64("node"), 16)


def _lists_of(reps: DataFrame, num: int, den: int) -> tuple[DataFrame, Callable, Callable]:
    """Posting lists of two members and more: tok, node, nk, hub, hub_nk; and what tells of nk whether two sizes fit,
    and how many shingles a member asks for."""
    least = lambda c: F.col(c).bitwiseAND(255)
    fits = lambda a, b: F.least(F.shiftright(a, 20), F.shiftright(b, 20)) * den >= F.greatest(F.shiftright(a, 20), F.shiftright(b, 20)) * num
    # n, common and k of a member in one number.
    packed = F.shiftleft("n", 20) + F.shiftleft(F.least("common", F.lit(4095)), 8) + F.col("k")
    rank = _rank()
    postings = reps.select(F.explode("prefix").alias("tok"), "node", packed.alias("nk"))
    # A list's hub is the member with most common shingles, so that of a group of copies the least edited one leads.
    tops = postings.groupBy("tok").agg(F.max(rank).alias("top"), F.min(rank).alias("low")).filter("top <> low").select("tok", "top")
    listed = materialize(postings.join(tops, "tok"), "postings")
    hubs = listed.filter(rank == F.col("top")).groupBy("tok").agg(F.min(F.struct("node", "nk")).alias("h")).select("tok", F.col("h.node").alias("hub"), F.col("h.nk").alias("hub_nk"))
    shared = materialize(listed.drop("top").join(hubs, "tok"), "postings")
    discard(listed)
    return shared, fits, least


def _rest(shared: DataFrame, near: DataFrame, labels: DataFrame) -> DataFrame:
    """What round two has to join: tok, node, nk, component, hubs, near.

    ``hubs``: some of the hubs that a member is near, the most popular ones. Two members that are near one hub have been
    compared around it. In each list one such hub is the most frequent; ``near`` tells who is near that one. Lists within one
    component, and those whose members are all near one hub, are left out.
    """
    labelled = shared.select("tok", "node", "nk").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("tok").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("tok")
    around = near.select("hub", "node").unionByName(near.select("hub", F.col("hub").alias("node"))).distinct()
    popular = around.groupBy("hub").agg((-F.count("*")).alias("n"))
    own = around.join(popular, "hub").groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "hub"))), 1, HUBS).alias("h")).select("node", F.transform("h", lambda x: x["hub"]).alias("hubs"))
    rest = labelled.join(mixed, "tok").join(own, "node", "left").withColumn("hubs", F.coalesce("hubs", F.array().cast("array<long>")))
    rest = labelled_rest = materialize(rest, "postings")
    often = rest.select("tok", F.explode("hubs").alias("hub")).groupBy("tok", "hub").agg(F.count("*").alias("n")).groupBy("tok").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    marked = rest.join(often, "tok", "left").withColumn("near", F.coalesce(F.array_contains("hubs", F.col("hub")), F.lit(False))).drop("hub")
    open_ = marked.groupBy("tok").agg(F.min("near").alias("all")).filter(~F.col("all")).select("tok")
    out = materialize(marked.join(open_, "tok"), "postings")
    discard(labelled_rest)
    return out


def _meeting(rest: DataFrame, fits: Callable, least: Callable) -> DataFrame:
    """Pairs of members of one list, in different components and not both near a hub, that share as many shingles as they
    must. Only members that are not near the list's hub look for partners. Lists are dealt over cells of at most about ``CELL``
    members of either side."""
    some = lambda c: F.greatest(F.ceil(F.count(c) / CELL), F.lit(1)).cast("int")
    sizes = rest.groupBy("tok").agg(some(F.when(~F.col("near"), 1)).alias("ones"), some("node").alias("twos"))
    dealt = rest.join(sizes, "tok")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = lambda i: {c: f"{c}_{i}" for c in ("node", "nk", "component", "near", "hubs", "p", "q")}
    one = dealt.filter("NOT near").withColumn("p", part("ones")).withColumn("q", every("twos")).drop("ones", "twos").withColumnsRenamed(names(1))
    two = dealt.withColumn("q", part("twos")).withColumn("p", every("ones")).drop("ones", "twos").withColumnsRenamed(names(2))
    # Of two that look for partners, the one of the smaller node counts the pair.
    fit = (F.col("near_2") | (F.col("node_1") < F.col("node_2"))) & (F.col("component_1") != F.col("component_2")) & fits("nk_1", "nk_2") & ~F.arrays_overlap("hubs_1", "hubs_2")
    together = one.join(two, (one["tok"] == two["tok"]) & (one["p_1"] == two["p_2"]) & (one["q_1"] == two["q_2"]) & fit)
    counted = together.groupBy(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).agg(F.count("*").alias("times"), F.min(F.least(least("nk_1"), least("nk_2"))).alias("k"))
    return counted.filter("times >= k").select("a", "b")


def _classified(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (doc_id, th, n, f1, f2) and classes of equal sets (f1, f2, node, doc_id and th of the row that
    stands for it, and the component: the smallest node that links lead to)."""
    with freed_shuffles(docs.sparkSession):
        profiles = materialize(_profiles(docs, width, num, den), "profiles")
        return profiles.drop("k", "common", "prefix"), _linked(profiles, docs, width, num, den)


def _linked(profiles: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    some = profiles.filter("n > 0 AND doc_id IS NOT NULL")
    least_row = some.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "th", "n", "k", "common", "prefix")).alias("r"))
    reps = materialize(least_row.select("f1", "f2", "r.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    shared, fits, least = _lists_of(reps, num, den)

    # Round one: each list's members with its hub, where they share as many shingles as they must, or three.
    pairs = shared.filter((F.col("hub") != F.col("node")) & fits("hub_nk", "nk")).groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("times"), F.min(F.least(least("hub_nk"), least("nk"))).alias("k"))
    near = _near(materialize(pairs.filter("times >= least(k, 3)").select("a", "b"), "pairs"), docs, reps, width, num, den)
    links, labels = _with_hubs(near, None, num, den)
    rest = _rest(shared, near, labels)
    for _ in range(MORE):  # long lists of which many are near no hub get another one, of those
        far = rest.filter("NOT near AND size(hubs) = 0")
        long = far.groupBy("tok").agg(F.count("*").alias("n"), F.max_by("node", _rank()).alias("hub"), F.max_by("nk", _rank()).alias("hub_nk")).filter(F.col("n") >= LONG)
        pairs = far.join(long, "tok").filter((F.col("node") != F.col("hub")) & fits("hub_nk", "nk")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            break
        more = _near(pairs, docs, reps, width, num, den)
        discard(labels, rest)
        links, labels = _with_hubs(more, links, num, den)
        near = near.unionByName(more)
        rest = _rest(shared, near, labels)
    discard(shared)

    # Round two: members of one list in different components that are not near one hub.
    pairs = materialize(_meeting(rest, fits, least), "pairs")
    met, used = _met(pairs, docs, reps, width)
    second = materialize(met.filter(_alike(num, den)).select("a", "b").distinct(), "links")
    discard(rest, pairs, *used)
    final = labels if second.isEmpty() else _labels(links.unionByName(second))
    by_class = reps.select("f1", "f2", "node", "doc_id", "th").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return by_class


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included)."""
    with freed_shuffles(docs.sparkSession):
        profiles, by_class = _classified(_rows(docs), width, num, den)
        leads = by_class.groupBy("component").agg(F.min("doc_id").alias("lead"))
        by_class = by_class.join(leads, "component").select("f1", "f2", "lead")
        out = profiles.filter("n > 0 AND doc_id IS NOT NULL").join(by_class, ["f1", "f2"]).select("doc_id", "n", "lead")
        out = materialize(out, "leads")
        # Rows of one doc_id are one document: it joins all that any of them links with.
        several = out.groupBy("doc_id").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
        links = out.join(several, "doc_id").filter("lead <> lo").select(F.col("lead").alias("a"), F.col("lo").alias("b")).distinct()
        joins = _labels(links).select(F.col("node").alias("lead"), F.col("component").alias("joined"))
        out = out.join(joins, "lead", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("joined", "lead").alias("component_id"))
    empty = profiles.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (then hash of text, then hash of the row).

    Rows without doc_id, and those without words, all stay.
    """
    names = ("seen_id", "seen_text", "seen_lead", "seen_lead_text", "seen_times", "own_text")
    key, th, lead, lead_th, times, own = (free_name(docs.columns, n) for n in names)
    profiles, by_class = _classified(_rows(docs), width, num, den)
    first = by_class.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    by_class = by_class.join(first, "component").select("f1", "f2", "first")
    found = profiles.filter("n > 0 AND doc_id IS NOT NULL").join(by_class, ["f1", "f2"]).groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(F.min("first.doc_id").alias(lead), F.min("first.th").alias(lead_th), F.count("*").alias(times))
    found = found.filter((F.col(key) != F.col(lead)) | (F.col(th) != F.col(lead_th)) | (F.col(times) > 1))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    joined = hashed.join(found, (hashed["doc_id"].cast("long") == found[key]) & (hashed[own] == found[th]), "left")
    plain = joined.filter(F.col(key).isNull()).select(docs.columns)
    leads = joined.filter((F.col(key) == F.col(lead)) & (F.col(th) == F.col(lead_th)))  # rows that are there several times
    rows = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    one = leads.groupBy(key, th).agg(F.min_by(rows, F.xxhash64(rows)).alias("row")).select("row.*")
    return plain.unionByName(one)
