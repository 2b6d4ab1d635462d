import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from colloquy.llm import chat, decontaminate, jaccard, langid, line_dedup, queries, topk, urls
from colloquy.llm.components import components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# -- chat ----------------------------------------------------------------------


def test_fold_deltas_edits_regenerations(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""), (1, 4, "delta", 1, None, "lo"), (1, 3, "delta", 1, None, "hel"),
        (1, 5, "message", 2, "user", "void"), (1, 6, "regenerate", 1, "assistant", ""), (1, 7, "delta", 1, None, "new"), (1, 8, "message", 2, "user", "q"), (1, 9, "edit", 2, "user", "Q"),
        (2, 1, "delta", 0, "user", "only"), (2, 1, "delta", 0, None, "only"), (2, 2, "noise", 0, "user", "x"), (None, 1, "message", None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq int, kind string, turn int, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "new"), (1, 2): ("user", "Q"), (2, 0): ("user", "onlyonly"), (None, None): ("", "")}
    assert chat.fold(events.limit(0)).count() == 0


def test_escapes_round_trip(spark):
    dice, bits = random.Random(2), ["<", ">", "|", "\\", "[", "]", "/", "s", "INST", "<|im_start|>", "<|im_end|>", "<|im_sep|>", "</s>", "[/INST]", "\n", "a", "é"]
    texts = ["".join(dice.choice(bits) for _ in range(dice.randint(0, 12))) for _ in range(800)]
    rows = [(i // 4, i % 4, dice.choice(["user", "assistant", "<|im_sep|>", ""]), t) for i, t in enumerate(texts)]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = chat.render(messages).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    for r in out:
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(own)


def test_op3_conversation_minus_seven(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, sf_dir).collect()}
    both = "</s>[INST] ok [/INST]"
    r = got[-7]
    assert (r.n_turns, r.loss_chars) == (2, len(both))
    assert r.loss_sha256 == hashlib.sha256(both.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{both}\nassistant\n{both}\n".encode()).hexdigest()


def test_op3_over_null_empty_and_repeated_rows(spark, tmp_path):
    dice = random.Random(9)
    rows = [(c, t, dice.choice(["user", "assistant", None]), dice.choice([None, "", "x", "word " * dice.randint(1, 60), "</s> <|im_end|>\n"])) for c in (1, 2, None) for t in [*range(6), 2, 2]]
    rows += [(3, 0, "assistant", "long " * 40_000)]
    rows += rows[3:6] * 2
    folder = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, 1, 2) for r in dice.sample(rows, len(rows))], "conv_id long, turn int, role string, text string, copy int, kind int").write.parquet(folder)
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for c in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    spark.read.parquet(folder).limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in queries.op3_chat_format(spark, f"{tmp_path}/none").collect()] == [-7]


def test_server_log_hides_final_texts(spark):
    rows = spark.createDataFrame([(i, 0, 1, "user", f"text {i} " * 30) for i in range(60)], "conv_id long, turn long, copy int, role string, text string")
    log = queries._server_log(rows)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.join(rows.select("text"), "text").isEmpty()
    assert log.filter("role = 'void' OR text LIKE 'draft%'").count() > 0


# -- decontamination -----------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("most", [64 << 20, 3_000])
def test_hits_by_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)  # a benchmark of one part, or of several
    dice = random.Random(4)
    vocabulary = ["a", "B", "é", "É", "c1", "İ", "ß"]
    items = [(i, " ".join(dice.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 5, 10, 11, 14, 2])] + [(6, None), (7, "!!"), (8, "c1 c1 É")]
    rows = [(i, " ".join(dice.choice(vocabulary) for _ in range(dice.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (None, items[4][1]), (5, items[3][1]), (62, items[4][1]), (62, items[4][1])]
    rows += [(63, "X, " + items[4][1].replace(" ", "; ") + "! y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.hits(docs_of(spark, rows), bench).withColumn("n_hit", decontaminate.n_hit(F.col("spans"))).collect())
    want = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            for g in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == g:
                        hit |= set(range(k, k + n))
                        found.add(str(item))
        want.append(((i if i is not None else -1), len(w), len(hit), ",".join(sorted(found))))
    assert got == sorted(want)
    clean = decontaminate.clean(docs_of(spark, rows), bench)
    assert clean.count() == sum(not h for _, _, h, _ in want)
    assert decontaminate.hits(docs_of(spark, rows), bench.limit(0)).filter(F.size("spans") > 0).count() == 0
    assert decontaminate.hits(docs_of(spark, rows).limit(0), bench).count() == 0
    for r in decontaminate.remove_spans(docs_of(spark, rows).withColumn("spans", F.lit(1)), bench).collect():
        own = next(x for x in want if x[0] == (r.doc_id if r.doc_id is not None else -1) and x[1] == len(words(r.text)))
        assert len(r.kept_words) == own[1] - own[2]


# -- line dedup ----------------------------------------------------------------


def test_line_dedup_by_brute_force(spark):
    dice = random.Random(6)
    pool = ["short", "A line that is long enough", " a LINE that is long enough\t", "Ünd noch eine längere Zeile", "ünd noch eine längere Zeile", "", "yet another line of good length", "x" * 20, "y" * 19]
    rows = [(i, "\n".join(dice.choice(pool) for _ in range(dice.randint(0, 6)))) for i in range(25)] + [(30, None), (31, ""), (None, pool[1]), (3, pool[1]), (3, pool[1]), (32, "z" * 5000 + "\n" + pool[1])]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.n_lines, r.n_dropped) for r in line_dedup.dedup(docs_of(spark, rows)).collect())
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        want.append(((i if i is not None else -1), "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == sorted(want)
    assert line_dedup.dedup(docs_of(spark, rows).limit(0)).count() == 0
    clash = line_dedup.dedup(docs_of(spark, rows).withColumn("n_lines", F.lit(0)).withColumn("text_hash", F.lit(0)).withColumn("h1", F.lit(0)))
    assert clash.agg(F.sum("_n_lines")).first()[0] == sum(w[2] for w in want)


# -- Jaccard join --------------------------------------------------------------


def brute_classes(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)) if w else frozenset()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and len(x & y) * den >= len(x | y) * num:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, s in sets)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_classes_by_brute_force(spark, width, num, den):
    dice = random.Random(width)
    rows, i = [], 0
    for base in range(4):  # groups of edited copies, small and large edits, so that links are chains as well
        text = [dice.choice("abcdefghijklmnop") + dice.choice("qrstuvw") for _ in range(60 + 30 * base)]
        for _ in range(45):
            own = list(text)
            for _ in range(dice.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                own[dice.randrange(len(own))] = dice.choice(["new", "x" + str(dice.randint(0, 30))])
            rows.append((i, " ".join(own)))
            i += 1
    common = " ".join(f"w{k}" for k in range(30))
    rows += [(i + k, common + " " + " ".join(dice.choice("abcdefgh") for _ in range(25))) for k in range(40)]
    rows += [(900, None), (901, "  \t"), (902, "One two"), (903, "one TWO"), (None, rows[0][1]), (904, rows[1][1]), (904, "quite another text of seven words"), (905, "quite another text of seven words"), (906, "é É " * 3000)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.classes(docs_of(spark, rows).repartition(5), width, num, den).collect())
    assert got == brute_classes(rows, width, num, den)


def test_classes_of_repeated_ids(spark):
    """An id with several texts joins the components of all of them."""
    dice = random.Random(12)
    texts = [" ".join(dice.choice("abcdefghijklmnop") + dice.choice("qrstuvwxyz") for _ in range(40)) for _ in range(30)]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (5, texts[0]), (5, texts[1]), (5, texts[2])]
    for i in range(10, 40):
        rows += [(i, dice.choice(texts[3:])) for _ in range(dice.choice([1, 1, 2, 3, 5]))]
    rows += rows[-5:] * 3
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs_of(spark, rows), 3, 90, 100).collect())
    assert got == brute_classes(rows, 3, 90, 100)


@pytest.mark.parametrize("cell", [2, 5])
def test_classes_around_hubs(spark, cell, monkeypatch):
    """Lists of many members that are alike, but mostly not alike enough, dealt over small cells."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    dice = random.Random(cell)
    hub = [f"h{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = list(hub)
        for _ in range(dice.choice([1, 3, 6, 9, 12, 15])):
            own[dice.randrange(60)] = f"x{dice.randint(0, 12)}"
        rows.append((dice.randint(0, 120), " ".join(own[: dice.choice([60, 60, 40, 20])])))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs_of(spark, rows).repartition(4), 1, 80, 100).collect())
    assert got == brute_classes(rows, 1, 80, 100)


def test_keep_one_of_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "quite other words stand in here"), (1, "a b c d e f g"), (2, "quite other words stand in here"), (3, ""), (3, None)]
    kept = sorted((r.doc_id, r.text or "") for r in jaccard.keep_one(docs_of(spark, rows)).collect())
    assert kept == [(1, "a b c d e f g"), (1, "quite other words stand in here"), (3, ""), (3, "")]


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words are here now"), (3, "other words are here now"), (None, "a b c d e f g"), (4, None), (5, None)]
    kept = sorted((r.doc_id or 0) for r in jaccard.keep_one(docs_of(spark, rows)).collect())
    assert kept == [0, 1, 3, 4, 5]
    assert jaccard.keep_one(docs_of(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(a, a + 1) for a in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (202, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(41), 100]} | {200: 200, 201: 200, 202: 200}


# -- language ID ---------------------------------------------------------------


def test_language_by_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) >= 0.95 * len(tested)


def test_language_edges_and_brute_force(spark):
    train = docs_of(spark, [(i, "the quick brown fox") for i in range(4)]).unionByName(docs_of(spark, [(9, "der schnelle braune fuchs"), (None, "x")]).withColumn("lang", F.lit("de")))
    prototypes = langid.learn(train)
    assert set(prototypes) == {"en", "de"}
    texts = [None, "", "12 !!", "the fox", "der fuchs", "漢字", "é" * 10_000]
    got = langid.predict(docs_of(spark, list(enumerate(texts))), prototypes).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:5]] == ["und", "und", "und", "en", "de"]
    for r, text in zip(got[3:], texts[3:], strict=True):
        own = sum(langid.vectors(np.array([c]))[0].astype(float) for c in langid.trigrams(text))
        best = max((p @ own / np.linalg.norm(p) / np.linalg.norm(own)) for p in prototypes.values())
        assert r.score == pytest.approx(max(0, best), abs=1e-6)
    assert {r.lang_pred for r in langid.predict(docs_of(spark, [(1, "abc")]), {}).collect()} == {"und"}
    assert langid.learn(train.limit(0)) == {}
    assert langid.predict(train.withColumn("Score", F.lit(1)), prototypes).filter("_score > 0").count() == 6


# -- URLs ----------------------------------------------------------------------


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"), "http://Example.COM/en/x?y": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://a.b.example.com/en/#t": ("a.b.example.com", "/en/", "example.com/en/", "block"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"), "https://x.net/es/?a=/": ("x.net", "/es/", "net/es/", "block"), "https://x.net/es": ("x.net", "/es", None, "allow"),
        "https://com?casino": ("com", "", None, "block"), "http://x.org/casinos": ("x.org", "/casinos", None, "allow"), "http://x.org/Free-BET": ("x.org", "/Free-BET", None, "block"),
        "http://x.org/free/free": ("x.org", "/free/free", None, "allow"), "": ("", "", None, "allow"), "a://b://c/xxx": ("b:", "//c/xxx", None, "block"),
    }
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, extra int")
    got = {r.url: (r.host, r.path, r["rule"], r.verdict) for r in urls.judge(pages).collect()}
    assert got == cases
    assert urls.judge(pages.limit(0)).count() == 0
    clash = urls.judge(pages.withColumn("Host", F.lit("x")).withColumn("weight", F.lit(0)))
    assert {r.url: (r._host, r.path, r["rule"], r.verdict) for r in clash.collect()} == cases


def test_url_terms(spark):
    same = "https://news.example.org/story?ref=home&utm_source=mail"
    far = "http://x.org/" + "a" * 100_000 + "/poker?free"
    rows = [(1, same), (1, same), (2, far), (3, "http://x.org/KIWI"), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in urls.judge(pages).collect()) == [(1, "allow"), (1, "allow"), (2, "block"), (3, "allow"), (4, "allow")]
    table = spark.createDataFrame([("Kiwi", 2), ("kiwi", 1), (None, 3), ("", 9), ("poker", 0)], "term string, weight int")
    assert urls.vocabulary(table) == {"kiwi": 2}
    assert sorted((r.page_id, r.verdict) for r in urls.judge(pages, terms=table).collect()) == [(1, "allow"), (1, "allow"), (2, "allow"), (3, "block"), (4, "allow")]
    assert {r.verdict for r in urls.judge(pages, terms=table.limit(0)).collect()} == {"allow"}


# -- top-k ---------------------------------------------------------------------


def test_top_k_by_brute_force(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(700, 8)).astype(np.float32)
    x[100:260] = x[100]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [1.0] * 7 + [float("nan")]), (740, [None] + [1.0] * 7), (None, [1.0] * 8), (760, [1.0, 2.0]), (763, [2.0, 2.0]), (780, []), (781, [float("inf")] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantize(F.col("embedding")).alias("x"))
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for q in range(0, 700, 20):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:20]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    want[760] = [(1, 763, 64 * 128 + 128 * 128)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_over_many_pages(spark, monkeypatch):
    """Several cells, rings and pages, a cell of equal vectors, and columns besides."""
    for name, value in {"PAGE": 40, "BLOCK": 7, "LEAF": 8, "GROUP": 2, "RINGS": 3}.items():
        monkeypatch.setattr(topk, name, value)
    dice = np.random.default_rng(5)
    x = (dice.normal(size=(9, 6))[dice.integers(0, 9, 900)] * 3 + dice.normal(size=(900, 6)) * 0.2).astype(np.float32)
    x[300:620] = x[300]
    frame = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, cell int, dim int").select("vec_id", topk.quantize(F.col("embedding")).alias("x"), "cell", "dim")
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 900, 20):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_bounds_avoid_computations():
    """On clustered vectors most scores are ruled out by stored distances."""
    dice = np.random.default_rng(6)
    x = np.floor(64 * (dice.normal(size=(40, 16))[np.arange(4000) % 40] + dice.normal(size=(4000, 16)) * 0.05))
    centre = x.mean(axis=0)
    space = topk.Space(centre, float(((x - centre) ** 2).sum(axis=1).max()))
    pivot = space.lift(x[:1])[0]
    order, *tree = topk.build_page(x, pivot, space)
    q = x[:100]
    none = np.zeros(100, dtype=np.int64)
    (at, ids, score), computed = topk.search_page(q, np.arange(100), none, none > 0, 20, order, x[order], tuple(tree), pivot, space)
    (_, again, _), less = topk.search_page(q, np.arange(100), score[19::20], none == 0, 20, order, x[order], tuple(tree), pivot, space)
    assert (ids == again).all() and less < 0.3 * q.shape[0] * len(x)
    assert less <= computed


def test_top_k_of_large_components(spark):
    frame = spark.createDataFrame([(0, [2.0**40, 3.0]), (1, [2.0**13 + 1, 1.0]), (2, [2.0**13, 2.0**43])], "vec_id long, x array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(2, 2**53 + 3 * 2**43), (1, 2**53 + 2**40 + 3)]
