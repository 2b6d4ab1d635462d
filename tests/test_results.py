"""Whole results, transcripts' reports, search rows of summaries, measures of runs and sketches that merge."""

import json
import random

import pytest
from colloquy.operators import ops
from colloquy.operators import transcript as tr
from colloquy.sources import documents as dc
from colloquy.sources import readers as rd
from colloquy.sources import sinks as sk
from pyspark.sql import functions as F


def parts_of(spark):
    f = spark.createDataFrame
    return {
        "run": f([(1, 10, "completed_with_errors", 5), (2, 20, "completed", 6)], "meeting_id long, run_id long, status string, started_ms long"),
        "stages": f([(10, 2, "align", "failed", 7, "boom"), (10, 1, "preprocess", "completed", 3, None), (10, 3, "summarize", "failed", 1, None)], "run_id long, stage_no int, name string, status string, duration_ms long, error string"),
        "quality": f([(1, "low", ["quiet"]), (3, "none", ["x"])], "meeting_id long, value string, warnings array<string>"),
        "languages": f([(1, ["en"])], "meeting_id long, value array<string>"),
        "speakers": f([(1, "B", "Bea", 5), (1, "A", None, 4), (3, "A", "", 1)], "meeting_id long, label string, display_name string, stats int"),
        "utterances": f([(1, 1, "B", 10, 20, "second"), (1, 0, "A", 0, 9, "first")], "meeting_id long, utterance_index long, speaker string, start_ms long, end_ms long, text string"),
        "transcript": f([(1, ["no timings"])], "meeting_id long, warnings array<string>"),
        "analytics": f([(1, 42)], "meeting_id long, value int"),
        "summary": f([(1, "sum", "ok")], "meeting_id long, value string, report string"),
    }


def test_whole_result(spark):
    meetings = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "meeting_id long, title string")
    got = {r.meeting_id: json.loads(r.result) for r in dc.whole_result(meetings, parts_of(spark)).collect()}
    one = got[1]
    assert one["warnings"] == ["align failed: boom", "summarize failed: None", "quiet", "no timings"]
    assert [s["name"] for s in one["processing"]["stages"]] == ["preprocess", "align", "summarize"]
    assert [(u["text"], u.get("speaker_name")) for u in one["transcript"]] == [("first", None), ("second", "Bea")]
    assert (one["schema_version"], one["meeting"], one["audio_quality"], one["languages"], one["analytics"], one["summary"], one["verification_report"]) == ("1.0.0", {"meeting_id": 1, "title": "One"}, "low", ["en"], 42, "sum", "ok")
    assert [s["label"] for s in one["speakers"]] == ["A", "B"] and one["included"] == ["transcript", "analytics", "summary"]
    assert got[2]["warnings"] == [] and "transcript" not in got[2] and got[2]["processing"]["run_id"] == 20
    assert got[3] == {"schema_version": "1.0.0", "meeting": {"meeting_id": 3, "title": "Three"}, "speakers": [{"label": "A", "display_name": "", "stats": 1}], "warnings": [], "included": ["transcript", "analytics", "summary"]}


def test_whole_result_of_some_sections(spark):
    meetings = spark.createDataFrame([(1, "One")], "meeting_id long, title string")
    (r,) = dc.whole_result(meetings, parts_of(spark), include=("analytics",)).collect()
    one = json.loads(r.result)
    assert one["included"] == ["analytics"] and "transcript" not in one and "summary" not in one
    assert one["warnings"] == ["align failed: boom", "summarize failed: None", "quiet"]  # the transcript's come with it
    few = {k: v for k, v in parts_of(spark).items() if k in ("run", "stages", "speakers")}
    assert json.loads(dc.whole_result(meetings, few).first().result)["warnings"] == ["align failed: boom", "summarize failed: None"]


def test_summary_rows(spark):
    meetings = spark.createDataFrame([(1, "Title", "In short"), (2, None, None)], "meeting_id long, title string, executive_summary string")
    items = spark.createDataFrame(
        [(1, "action_item", 4, None, "Send it"), (1, "decision", 9, None, "Agreed"), (1, "key_point", 7, "Topic", "Point"), (1, "key_point", 2, None, "Earlier"), (1, "open_question", 1, None, "Why?")],
        "meeting_id long, kind string, idx long, topic string, text string",
    )
    got = {r.meeting_id: (r.kind, r.ref, r.start_ms, r.speaker, r.text) for r in sk.summary_rows(meetings, items).collect()}
    assert got == {1: ("summary", "summary", None, None, "Title\nIn short\n. Earlier\nTopic. Point\nAgreed\nSend it"), 2: ("summary", "summary", None, None, "\n")}


def test_transcript_report(spark):
    rows = [
        (1, 0, 0, 1_000, "hello there friends", "en", 0.9, 0.1, 1.2), (1, 1, 1_000, 4_000, "नमस्ते दोस्तों hello", "hi", 0.2, 0.1, 1.2), (1, 2, 4_000, 5_000, "  ", "en", 0.9, 0.1, 1.2),
        (1, 3, 5_000, 5_500, "second words here", "en", 0.9, 0.1, 1.2), (2, 0, 0, 9, "", "en", 0.9, 0.1, 1.2), (3, 0, 0, 700, "no language given", None, None, 0.1, 1.2),
    ]
    seg = spark.createDataFrame(rows, "meeting_id long, id long, start_ms long, end_ms long, text string, language string, avg_confidence double, no_speech_prob double, compression_ratio double")
    final = tr.finalize_transcript(seg)
    assert [(r.meeting_id, r.id, r.new_id) for r in final.orderBy("meeting_id", "new_id").collect()] == [(1, 0, 0), (1, 1, 1), (1, 3, 2), (3, 0, 0)]
    got = {r.meeting_id: (r.n_segments, r.n_dropped, r.n_low_confidence, r.n_code_mixed, [tuple(x) for x in r.detected_languages]) for r in tr.transcript_report(seg, final).collect()}
    assert got == {1: (3, 1, 1, 1, [("hi", 3_000), ("en", 1_500)]), 2: (0, 1, 0, 0, []), 3: (1, 0, 0, 0, [("unknown", 700)])}


def test_measures_of_runs(spark):
    runs = spark.createDataFrame([(1, "completed", 60_000), (2, "failed", 60_000), (3, "completed_with_errors", 90_000), (4, "completed", None)], "run_id long, status string, audio_ms long")
    calls = spark.createDataFrame([("prompt", 10, 3), ("completion", 5, 4), ("prompt", 1, 0)], "kind string, tokens long, cost long")
    got = {(r.measure, r.label): r.value for r in ops.run_measures(runs, calls).collect()}
    assert got == {("runs", "completed"): 2, ("runs", "failed"): 1, ("runs", "completed_with_errors"): 1, ("audio_minutes", "completed"): 2.5, ("tokens", "prompt"): 11, ("tokens", "completion"): 5, ("cost", "all"): 7}
    stages = spark.createDataFrame([(1, "align", 6), (1, "align", 600_000), (3, "align", 90_000), (4, "align", 5)], "run_id long, stage_name string, duration_ms long")
    factors = {r.le: r.n for r in ops.factor_histogram(stages, runs).collect()}
    assert factors == {0.001: 1, float("inf"): 1, 1.0: 1}


@pytest.mark.parametrize("shape", ["even", "skewed"])
def test_sketches_merge_within_their_errors(spark, shape):
    dice = random.Random(41)
    value = (lambda: dice.random()) if shape == "even" else (lambda: dice.paretovariate(0.8))
    rows = [(dice.choice("ab"), dice.randint(0, 4_000), value(), dice.randint(0, 86_399_999)) for _ in range(40_000)]
    events = spark.createDataFrame(rows, "kind string, who long, x double, at_ms long").repartition(8)
    small = ops.window_sketches(events, ["kind"], "x", "who")
    assert small.count() == 2 * 288
    day = ops.sketch_estimates(ops.merge_sketches(ops.merge_sketches(small, ["kind"], 3_600_000), ["kind"]), {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()
    for r in day:
        own = sorted(x for k, _, x, _ in rows if k == r.kind)
        assert (r.n, r.least, r.most) == (len(own), own[0], own[-1])
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            rank = sum(x <= r[name] for x in own) / len(own)
            assert abs(rank - p) <= 1.5 * ops.RANK_ERROR
        users = len({w for k, w, _, _ in rows if k == r.kind})
        assert abs(r.n_distinct - users) <= 4 * ops.COUNT_ERROR * users
    assert ops.merge_sketches(small.filter(F.lit(False)), ["kind"]).count() == 0


def test_language_spans(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "a.b.lang.json").write_text('[{"start": 0.5, "end": 1.25, "language": "en"}, {"start": 2, "end": 3}, {"start": 1.2, "language": "hi"}]')
    (tmp_path / "c.lang.json").write_text('[{"end": 9, "start": 8, "language": "or", "note": "x"}]')
    (tmp_path / "d.lang.json").write_text("no json")
    (tmp_path / "a.txt").write_text("[]")
    got = sorted(map(tuple, rd.read_language_spans(spark, str(tmp_path)).collect()))
    assert got == [("a.b", 500, 1_250, "en"), ("c", 8_000, 9_000, "or")]
