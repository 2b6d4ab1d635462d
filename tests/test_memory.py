"""What tasks hold: slices of a batch of texts, and words of one segment."""

import tracemalloc
import unicodedata

import pyarrow as pa
from colloquy.functions import text as tx
from colloquy.operators import transcript as tr


def test_texts_of_a_batch_are_python_strings_slice_by_slice():
    texts = pa.array([("é" if i % 500 else "e\u0301") + "x" * 4_000 for i in range(10_000)] + [None])
    tracemalloc.start()
    out = tx._nfc.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # 40 MB of text
    assert out.to_pylist() == [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()]
    assert tx._nfc.func(texts[:0]).to_pylist() == []


def test_words_get_their_times_without_sorting(spark):
    rows = spark.createDataFrame([(1, 0, 1_000, "a bcd  ef"), (2, 5, 5, "none"), (3, 0, 10, "  "), (4, 0, 10, None), (5, 0, 60, "é\nकख")], "id long, start_ms long, end_ms long, text string")
    words = tr.approximate_words(rows, ["id"])
    assert sorted(map(tuple, words.collect())) == [(1, 0, "a", 0, 222), (1, 1, "bcd", 222, 667), (1, 2, "ef", 667, 1_000), (5, 0, "é", 0, 24), (5, 1, "कख", 24, 60)]
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
