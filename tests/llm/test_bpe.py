import hashlib
import random
import zlib

import numpy as np
import pytest
from colloquy.llm import bpe, queries, token_counts, token_store
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BITS = ["a", "b", "e", " ", " ", "\n", "'", "s", "'s", "ll", "1", "22", "é", "ü", "漢", "!", "...", "\t", "<|endoftext|>", "xxxxxxx", "the", " ", "　", "é", "🙂", "ß"]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(bpe.default_path())
    out.no_truncation()
    out.no_padding()
    return out


def test_tree_concatenation_is_exact(library):
    own, dice = bpe.vocabulary(bpe.default_path()), random.Random(3)
    for _ in range(3000):
        few = dice.sample(BITS, dice.randint(1, len(BITS)))
        text = "".join(dice.choice(few) for _ in range(dice.choice([3, 8, 20, 60])))
        leaves = own.leaves(text, dice.randint(1, 15))
        assert "".join(leaves) == text
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want
        assert own.tree([own.encode(x) for x in leaves]).tolist() == want, text


def test_tree_of_one_long_piece(library):
    own = bpe.vocabulary(bpe.default_path())
    text = "abba" * 20_000 + "x" * 5_000
    assert own.tree([own.encode(x) for x in own.leaves(text, 1000)]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_decode_frames(spark, library):
    rows = [(1, None, "p"), (2, "", "q"), (None, "no id", "r"), (3, "Ab c's " * 400, "s"), (3, "Ab c's " * 400, "t"), (4, "é" * 3000, None), (5, "<|endoftext|> x\n\n  y" * 50, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaf_key string")
    got = bpe.decode(bpe.encode(docs, leaf=100)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.leaf_key or "") for r in got) == sorted((a or 0, b or "", c or "") for a, b, c in rows)
    for r in got:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.encode(docs.limit(0)).count() == 0
    assert bpe.decode(bpe.encode(docs.withColumn("IDS", F.lit(1))), "_ids", "Text").columns == ["doc_id", "text", "leaf_key", "IDS", "_ids", "_Text"]


def test_op2_as_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _brute(text, spans, rule, library):
    """Allots token by token."""
    raw, out, at = text.encode(), [0.0] * len(spans), 0
    own = bpe.vocabulary(bpe.default_path())
    to_byte = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for i in library.encode(text, add_special_tokens=False).ids:
        a, b = at, at + len(own.tokens[i])
        at = b
        for k, (s, e) in enumerate(spans):
            s, e = to_byte[s], to_byte[e]
            if rule == "share":
                out[k] += max(0, min(b, e) - max(a, s)) / (b - a)
            else:
                x = a if rule == "start" else (a + b) / 2
                out[k] += s <= x < e
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, library, rule):
    text = "Größe der Straße\nIs it's ünî"
    spans = [(0, 3), (2, 9), (9, 28), (28, 28)]
    docs = spark.createDataFrame([(1, text, [{"start": a, "end": b} for a, b in spans]), (2, None, [{"start": 0, "end": None}]), (3, "x", None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = token_counts.attribute(docs, sections_col="parts", rule=rule).orderBy("doc_id", "section").collect()
    assert np.allclose([r.n_tokens for r in got if r.doc_id == 1], _brute(text, spans, rule, library))
    assert [(r.doc_id, r.n_tokens) for r in got if r.doc_id > 1] == [(2, 0)]


def test_op1_lines_add_up(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sums, ends = {}, {}
    for r in queries.op1_token_counts(spark, sf_dir).orderBy("doc_id", "section").collect():
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.end
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
    for k, text in texts.items():
        assert ends[k] == len(text)
        assert sums[k] == len(library.encode(text, add_special_tokens=False).ids)


def test_pack_round_trip():
    dice = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (dice.integers(0, 1 << 32, n, dtype=np.uint64) >> dice.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_store.pack(x)
        assert len(control) == -(-n // 4)
        assert (token_store.unpack(control, data, n) == x).all()


def test_op6_as_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_token_store(spark, sf_dir).collect()}
    at = 0
    for k in sorted(texts):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_store_edges(spark):
    docs = spark.createDataFrame([(5, None, 1), (None, "a b", 2), (2, "c", 3), (2, "c", 4)], "doc_id long, text string, start int")
    store = token_store.new_store(spark)
    token_store.write(docs, store, end_id=2)
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_store.read(spark, store).orderBy("start").collect()]
    assert got == [(None, 0, 3), (2, 3, 2), (2, 5, 2), (5, 7, 1)]
    empty = token_store.new_store(spark)
    token_store.write(docs.limit(0), empty)
    assert token_store.read(spark, empty).count() == 0


def _grown(plan):
    """Rows that come out of the groups that join leaves."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _grown(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _grown(plan.plan())
    if name == "FlatMapGroupsInArrowExec":
        return plan.metrics().get("pythonNumRowsReceived").get().value()
    return sum(_grown(plan.children().apply(i)) for i in range(plan.children().size()))


def test_copies_of_a_long_text_are_grown_once(spark, library):
    long, other = "Ab c's " * 400, "é" * 3000
    rows = [(k % 25, long) for k in range(60)] + [(100, other), (None, long), (7, "short")]
    for keep in (True, False):
        coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), leaf=100, keep_text=keep)
        got = coded.collect()
        assert sorted(r.doc_id or 0 for r in got) == sorted(k or 0 for k, _ in rows)
        want = {t: library.encode(t, add_special_tokens=False).ids for t in (long, other, "short")}
        assert all(list(r.ids) == want[other if r.doc_id == 100 else "short" if r.doc_id == 7 and len(r.ids) < 9 else long] for r in got)
        assert not keep or all(list(r.ids) == want[r.text] for r in got)
        assert _grown(coded._jdf.queryExecution().executedPlan()) == 2
    alone = bpe.encode(spark.createDataFrame([(long,)] * 5, "text string"), leaf=100).collect()
    assert [r.text for r in alone] == [long] * 5


def test_op1_edges(spark, library):
    """Null, empty and very long texts, repeated rows, no rows, and columns with names of the result."""
    rows = [(1, None, 7), (2, "", 7), (3, "one\n" * 30_000, 7), (4, "two\n\nlines", 7), (4, "two\n\nlines", 7), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section int").withColumn("start", F.lit(1)).withColumn("n_tokens", F.lit(2))
    got = token_counts.attribute(docs)
    assert got.columns == ["doc_id", "section", "start", "end", "n_tokens"]
    sums = {r.doc_id: (r.n, r.lines) for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("lines")).collect()}
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert sums == {1: (0, 1), 2: (0, 1), 3: (size(rows[2][1]), 30_001), 4: (2 * size(rows[3][1]), 6), None: (1, 1)}
    assert token_counts.attribute(docs.limit(0)).count() == 0


def test_op6_very_long_text(spark, library, tmp_path):
    rows = [(1, "ab c\n" * 60_000), (2, None), (3, "x" * 20_000)]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_tokens int, start int").write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for r in queries.op6_token_store(spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = [*library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
