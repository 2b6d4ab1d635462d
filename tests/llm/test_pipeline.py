import random

import corpus_pipeline as cp
import pytest
from colloquy.llm.common import materialize

from .test_operators import DOCS, brute_classes, words

LINE = "this very line is found in many of the documents"
ITEM = "an item of the benchmark that must never be found in any training text at all"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    dice = random.Random(8)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(30)]
    rows += [(30 + i, rows[i][1] + " " + word()) for i in range(5)]  # near copies
    rows += [(40 + i, rows[10 + i][1]) for i in range(3)]  # copies
    rows += [(50 + i, " ".join(word() for _ in range(50)) + "\n" + LINE.upper() + "\n" + " ".join(word() for _ in range(9))) for i in range(6)]
    rows += [(60, " ".join(word() for _ in range(20)) + " " + ITEM), (61, None), (62, "12 34 !!"), (63, LINE), (64, " ".join(word() for _ in range(60)) + "\n" + "w" * 50_000)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows)


def test_stages_by_brute_force(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    held = texts
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, path), "stage")
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language ID":
            want = {i: t for i, t in held.items() if t and any(c.isalpha() for c in t)}
        elif name == "line dedup":
            last = max(i for i, t in held.items() if LINE in t.lower())
            want = {i: "\n".join(x for x in t.split("\n") if x.lower() != LINE or i == last) for i, t in held.items()}
        elif name == "n-gram Jaccard join":
            want = {i: held[i] for i, _, c in brute_classes(sorted(held.items()), 5, 80, 100) if i == c}
        elif name == "benchmark decontamination":
            v = words(ITEM)
            grams = {tuple(v[k : k + 10]) for k in range(len(v) - 9)}
            want = {i: t for i, t in held.items() if not any(tuple(words(t)[k : k + 10]) in grams for k in range(len(words(t))))}
            assert 60 in held and 60 not in want
        else:
            want = held
            assert {"ids", "n_tokens", "round_trip"} <= set(docs.columns)
            assert docs.filter("NOT round_trip OR n_tokens <> size(ids)").count() == 0
        assert got == want, name
        assert docs.columns[: len(names)] == names
        held = want
    whole = cp.run(spark, path)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(held)


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, folder, tmp_path):
    path, _ = folder
    names = ["ids", "n_dropped", "found_lang", "text_hash", "hit_id", "seen_id", "decoded"]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *[f"1 AS {n}" for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, plain = cp.run(spark, str(tmp_path)), cp.run(spark, path)
    assert set(names) < set(got.columns)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())
