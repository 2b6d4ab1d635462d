"""What must not grow with the number of meetings: files, calls of Python and passes over words."""

import os

from colloquy.operators import align as al
from colloquy.plans import registry
from colloquy.sources import readers as rd
from colloquy.streaming import replay
from pyspark.sql import functions as F


def test_span_files_do_not_grow_with_conversations(spark, sf_dir, tmp_path, monkeypatch):
    at = str(tmp_path / "spans")
    monkeypatch.setattr(replay, "folder", lambda *_: at)
    out = registry.queries()["S5_language_spans"](spark, sf_dir)
    files = sum(name.endswith(".txt") for _, _, names in os.walk(at) for name in names)
    assert files <= 8 < out.select("stem").distinct().count()


def test_bundled_spans(spark, tmp_path):
    (tmp_path / "a.txt").write_text('m 1\t[{"start": 0.5, "end": 1.25, "language": "en"}, {"start": 2, "end": 3}]\nno json\n\t[{"start": 1, "end": 2, "language": "or"}]\nb\t[]\nc\tnone\n')
    got = rd.read_language_spans(spark, str(tmp_path), pattern="*.txt", bundled=True).collect()
    assert sorted(map(tuple, got), key=str) == [("m 1", 500, 1_250, "en"), (None, 1_000, 2_000, "or")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_speakers_are_folded_many_in_a_call(spark):
    rows = [(m, g, p, 500 * g, 500 * g + 100, f"{m}{g}") for m in range(30) for g, p in enumerate(["P", "Q", "P", None, "Q", None])]
    grouped = spark.createDataFrame(rows, "meeting_id long, group int, speaker string, start_ms long, end_ms long, word string")
    out = al.merge_fragments(grouped, 2, 1_000)
    assert out.schema["group"].dataType == grouped.schema["group"].dataType and out.columns == grouped.columns
    assert "FlatMapGroups" not in _plan(out)
    into = {0: 2, 1: 1, 2: 2, 3: 5, 4: 4, 5: 5}
    assert sorted(map(str, out.collect())) == sorted(map(str, grouped.withColumn("group", F.element_at(F.create_map(*[F.lit(x) for kv in into.items() for x in kv]), F.col("group"))).collect()))
    assert al.merge_fragments(grouped.limit(0)).collect() == []


def test_parts_are_numbered_without_copying_what_is_done(spark):
    rows = [(1, 1, 10 * i, 10 * i + 10, "P", "a." if i % 4 == 3 else "b") for i in range(12)] + [(1, 2, 0, 500, "P", None), (2, 1, 7, 8, "Q", "x.")]
    grouped = spark.createDataFrame(rows, "meeting_id long, group long, start_ms long, end_ms long, speaker string, word string")
    out = al.split_long(grouped, 30)
    assert [r.part for r in out.filter("meeting_id = 1 AND group = 1").orderBy("start_ms").collect()] == [0] * 4 + [1] * 4 + [2] * 4
    assert sorted((r.meeting_id, r.part) for r in out.filter("NOT (meeting_id = 1 AND group = 1)").collect()) == [(1, 0), (2, 0)]
    assert "aggregate(" not in _plan(out)


def test_spans_meet_turns_once(spark):
    turns = spark.createDataFrame([(1, "B", 100, 200), (1, "A", 100, 200), (1, "C", 150, 150), (1, None, 5_000, 5_100), (1, "A", 5_000, 5_050)], "meeting_id long, speaker_label string, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0, 110, 160), (1, 1, 250, 240), (1, 2, 1_200, 1_300), (1, 3, 1_201, 1_300), (1, 4, 4_990, 5_090), (2, 5, 0, 9)], "meeting_id long, word_id long, start_ms long, end_ms long")
    out = al.speaker_for_span(words, turns)
    assert {r.word_id: (r.speaker, r.overlapping_speakers) for r in out.collect()} == {0: ("A", ["B", "C"]), 1: ("A", []), 2: ("A", []), 3: ("Unknown", []), 4: ("Unknown", ["A"]), 5: ("Unknown", [])}
    assert _plan(out).count("Join ") == 2
