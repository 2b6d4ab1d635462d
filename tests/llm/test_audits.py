"""The audits of sources and filters and the spot signatures, by brute force and against their SQL."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from colloquy.llm import divergence, interaction, queries, spotsigs
from pyspark.sql import functions as F

from .test_operators import DOCS

CLASHES = ["th", "part", "bucket", "guest", "digest", "alt", "cell", "sigs"]


def same_as_sql(spark, name, folder):
    frame = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if '/tmp' in folder else ''}'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found.fetchall())
    got = Counter(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in frame.collect())
    assert got == want
    return frame


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_filter_interaction", "op13_spot_signatures"])
def test_by_sql(spark, sf_dir, name):
    assert same_as_sql(spark, name, sf_dir).count() > 0


def with_clashes(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


# -- divergence ----------------------------------------------------------------


def brute_divergence(rows, min_docs, ranks):
    texts = [(la or "", so or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")))) for _, t, la, so in rows]
    out = []
    for lang in {la for la, _, _ in texts}:
        df = Counter(w for la, _, c in texts if la == lang for w in c)
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        groups, total = defaultdict(Counter), Counter()
        for la, so, c in texts:
            if la == lang:
                groups[so].update({w: n for w, n in c.items() if w in set(kept)})
                total.update({w: n for w, n in c.items() if w in set(kept)})

        def share(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        shares, q = {so: share(c) for so, c in groups.items()}, share(total)
        for so, p in shares.items():
            pair = sorted((-sum(abs(p[w] - shares[o][w]) for w in kept), o) for o in shares if o != so)
            term = sorted((q[w] - p[w], w.encode(), w) for w in kept if groups[so][w] and p[w] > q[w])[:ranks]
            out += [(lang, so, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pair)]
            out += [(lang, so, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(term)]
    return sorted(out)


def corpus():
    dice = random.Random(11)
    words = ["the", "The", "und", "straße", "Éa", "x" * 30_000, "a", "b", "c", "d"] + [f"w{chr(97 + i)}" for i in range(25)]
    rows = [(i, " ".join(dice.choices(words, k=dice.randint(0, 25))), dice.choice(["en", "de", None, ""]), f"s{dice.randint(0, 6)}") for i in range(150)]
    rows += [(200, None, "en", None), (201, "", None, None), (202, "12 34", "xx", "only"), (203, "one word", "xx", "other"), (None, "the und", "en", "s1"), (5, "the the", "en", "s1"), (5, "the the", "en", "s1")]
    return rows


@pytest.mark.parametrize("cells", [4, 4_000])
@pytest.mark.parametrize("collide", [0, 7])
def test_divergence_by_brute_force(spark, monkeypatch, cells, collide):
    monkeypatch.setattr(divergence, "CELL", cells)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rows = corpus()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    digest = F.xxhash64 if not collide else lambda t: F.pmod(F.xxhash64(t), F.lit(collide))
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=4, ranks=6, digest=digest).collect())
    assert got == brute_divergence(rows, 4, 6)


def test_divergence_beyond_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr("colloquy.llm.common.SENT_BYTES", 0)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=4, ranks=6, digest=lambda t: F.pmod(F.xxhash64(t), F.lit(11))).collect())
    assert got == brute_divergence(rows, 4, 6)
    assert divergence.audit(docs.limit(0)).collect() == []


# -- filters -------------------------------------------------------------------


def brute_filters(rows, labels):
    quality = {i: max(1 if q == 1 else 0 for j, q, _ in labels if j == i) for i, _, _ in labels if i is not None}
    toxic = {i: max(1 if x == 1 else 0 for j, _, x in labels if j == i) for i, _, _ in labels if i is not None}
    judged = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        judged.append((s or "", i, fails))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        for step, f in enumerate(order, 1):
            for part in {p for p, _, _ in judged}:
                own = [(i, x) for p, i, x in judged if p == part]
                here = [(i, x) for i, x in own if not any(x[g] for g in order[: step - 1])]
                gone = [i for i, x in here if x[f]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(here) - len(gone), len(gone), sum(x[f] for _, x in own) - len(gone), sum(x[f] and sum(x.values()) == 1 for _, x in own), sum(quality.get(i, 0) for i in gone), sum(toxic.get(i, 0) for i in gone),
                ]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


@pytest.mark.parametrize(("cell", "sent"), [(1_000, 1 << 20), (2, 0)])
def test_filters_by_brute_force(spark, monkeypatch, cell, sent):
    monkeypatch.setattr(interaction, "CELL", cell)
    monkeypatch.setattr("colloquy.llm.common.SENT_BYTES", sent)
    dice = random.Random(12)
    pool = ["plain words " * 30, "AB CD #", None, "", " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)) + " $", "long" * 30_000, "a\x0bb\x1cc"]
    rows = [(i, dice.choice(pool), dice.choice(["s", "t", None, ""])) for i in range(60)]
    rows += [(i, f"{dice.random()}", "s") for i in range(100, 110)] + [rows[3], rows[3], (3, "another text of an id", "s"), (None, pool[0], "t"), (None, pool[0], "t")]
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("th", F.lit(1))
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in interaction.audit(docs, known).collect()}
    assert got == brute_filters(rows, labels)
    assert interaction.audit(docs.limit(0), known).collect() == []
    alone = interaction.audit(docs, known.limit(0)).filter("good_lost + toxic_lost > 0")
    assert alone.count() == 0


# -- spot signatures -----------------------------------------------------------


def brute_signatures(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    out = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if w in spotsigs.ANCHORS and len(chain) == spotsigs.CHAIN:
            out.add(" ".join([w, *chain]))
    return sorted(out or ({" " + " ".join(words)} if words else set()), key=str.encode)


def jaccard(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("size", [40, 4 << 20])
def test_fingerprints_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "BUCKET_BYTES", size)
    dice = random.Random(13)
    words = ["the", "of", "der", "la", "que", "x", "éa", "Cat", "dog", "runs", "über", "1", "😀"] + [f"w{i}" for i in range(9)]
    texts = [" ".join(dice.choices(words, k=dice.randint(0, 30))) for _ in range(60)] + [None, "", "a", "ab", "...", "the the the", "dog " * 20_000 + "the cat runs home"]
    rows = [(dice.randint(-50, 10_000) * 3, t) for t in texts] + [(None, "the small dog runs"), (None, None)]
    rows += [rows[7], rows[7], (rows[9][0], "another text of the same id")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.th))
    want = Counter()
    for r, after in zip(order, [*order[1:], order[0]]):
        n = len(r.text) // 4
        edited = r.text[: len(r.text) - n] + after.text[:n]
        own = [brute_signatures(t) for t in (r.text, edited, after.text)]
        want[r.doc_id, r.text, edited, tuple(own[0]), tuple(own[1]), round(jaccard(own[0], own[1]), 9), round(jaccard(own[0], own[2]), 9)] += 1
    found = spotsigs.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.text, r.edited_text, tuple(r.sigs), tuple(r.edited_sigs), round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want
    assert spotsigs.fingerprints(docs.limit(0)).collect() == []
    one = spotsigs.fingerprints(docs.filter("text = 'a'")).collect()
    assert [(r.text, r.edited_text, r.near_next) for r in one] == [("a", "a", 1.0)]


def test_fingerprint_is_of_the_set(spark):
    df = spark.createDataFrame([("the cat dog runs. The cat dog runs",), ("the cat dog runs",), ("the cat dog ran",)], "text string")
    a, b, c = (r[0] for r in df.select(spotsigs.fingerprint(spotsigs.signatures(F.col("text")))).collect())
    assert a == b != c
    assert b == hashlib.sha256(b"the cat dog runs").hexdigest()


def brute_near(rows, num, den):
    sets = [(i, set(brute_signatures(t))) for i, t in rows]
    lead = {i: i for i, _ in rows if i is not None}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
            lead[max(root(i), root(j))] = min(root(i), root(j))
    return Counter((i, len(s), None if i is None else root(i) if s else i) for i, s in sets)


@pytest.mark.parametrize(("rounds", "cell"), [(4, 256), (0, 3), (1, 2)])
def test_near_copies_by_brute_force(spark, monkeypatch, rounds, cell):
    monkeypatch.setattr(spotsigs, "ROUNDS", rounds)
    monkeypatch.setattr(spotsigs, "CELL", cell)
    dice = random.Random(14)
    content = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(dice.choice(["the", "of", "is", *content, *content]) for _ in range(n))
    rows, base = [], [text(150) for _ in range(4)]
    for i in range(60):
        words = dice.choice(base).split()
        for _ in range(dice.choice([0, 1, 2, 4, 8])):
            words[dice.randrange(len(words))] = dice.choice(content)
        rows.append((i * 7 % 61, " ".join(words[: dice.choice([150, 150, 135, 120])])))
    rows += [(100 + i, text(dice.randint(0, 40))) for i in range(10)] + [(200, None), (201, "!"), (202, "no anchors here"), (203, "no anchors here"), (None, base[0]), (300, base[1]), (300, base[2]), (0, base[3])]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_sigs, r.class_id) for r in spotsigs.near_copies(docs, 80, 100).collect())
    want = brute_near(rows, 80, 100)
    # A row without signatures of an id whose other rows have some is alone.
    assert got == want
    assert len({c for _, _, c in want}) < 45
    assert spotsigs.near_copies(docs.limit(0)).collect() == []


def test_length_partitions():
    bounds = spotsigs.length_bounds(5_000, 80, 100)
    part = lambda n: sum(b <= n for b in bounds)
    for a in range(1, 1_500):
        b = a * 100 // 80  # the longest that can be alike
        assert part(b) - part(a) <= 1
