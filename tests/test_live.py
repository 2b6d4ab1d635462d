"""Streams with state against the batch operators, on arrivals in any order and in many batches."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from colloquy.operators import intervals as iv
from colloquy.operators import ops
from colloquy.streaming import live, replay
from pyspark.sql import functions as F

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
MS = int(BASE.timestamp() * 1000)


def stream_of(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def turn(m, who, at, length):
    return (m, who, BASE + timedelta(milliseconds=at), MS + at, MS + at + length)


TURNS = "meeting_id long, speaker_label string, ts timestamp, start_ms long, end_ms long"
BUCKET = 60_000


def brute(turns):
    """Buckets of the unions that the batch operators see."""
    out = Counter()
    for m, who, _, s, _ in turns:
        out[m, who, s // BUCKET * BUCKET, "turns"] += 1
    for m, who in {(t[0], t[1]) for t in turns}:
        for at in sorted({x for t in turns if t[:2] == (m, who) for x in range(t[3], t[4])}):
            out[m, who, at // BUCKET * BUCKET, "ms"] += 1
    return out


def got(rows):
    out = Counter()
    for r in rows:
        if r.start_ms is not None:
            out[r.meeting_id, r.speaker_label, r.start_ms, "turns"] += r.turns
            out[r.meeting_id, r.speaker_label, r.start_ms, "ms"] += r.speaking_ms
    return +out


KEYS = ["meeting_id", "speaker_label", "start_ms"]


def test_live_speaking_time_of_shuffled_arrivals(spark, tmp_path):
    dice = random.Random(31)
    turns = [turn(dice.randint(1, 2), dice.choice("AB"), dice.randint(0, 500_000), dice.choice([0, 1, 900, 70_000, 200_000])) for _ in range(60)]
    dice.shuffle(turns)
    stream = stream_of(spark, str(tmp_path / "in"), [turns[i::4] for i in range(4)], TURNS)
    rows = replay.run_updates(live.live_conversation_stats(stream, BUCKET, "1 hour"), "live-test", KEYS).collect()
    assert got(rows) == brute(turns)
    assert all(r.late is None for r in rows)
    whole = spark.createDataFrame(turns, TURNS)
    batch = {(r.meeting_id, r.speaker_label): r.total_ms for r in iv.total_length(iv.speaker_intervals(whole), ["meeting_id", "speaker_label"]).collect()}
    sums = Counter()
    for (m, who, _, what), n in got(rows).items():
        sums[m, who] += n if what == "ms" else 0
    assert dict(sums) == batch


def test_live_late_turns_are_counted_and_closed_buckets_stay(spark, tmp_path):
    first, second = [turn(1, "A", 0, 30_000), turn(1, "A", 700_000, 100_000)], [turn(1, "A", 10_000, 40_000), turn(1, "A", 590_000, 30_000), turn(1, "A", 750_000, 100_000)]
    stream = stream_of(spark, str(tmp_path / "in"), [first, [turn(1, "B", 700_000, 1)], second], TURNS)
    rows = replay.run_updates(live.live_conversation_stats(stream, BUCKET, "100 seconds"), "live-late", KEYS).collect()
    late = {r.speaker_label: r.late for r in rows if r.start_ms is None}
    assert late == {"A": 2}  # the watermark is at 600 seconds when they come
    found = {(r.speaker_label, r.start_ms - MS): (r.turns, r.speaking_ms) for r in rows if r.start_ms is not None}
    assert found == {
        ("A", 0): (1, 30_000), ("A", 660_000): (1, 20_000), ("A", 720_000): (1, 60_000), ("A", 780_000): (0, 60_000), ("A", 840_000): (0, 10_000), ("A", 600_000): (0, 20_000),
        ("B", 660_000): (1, 1),
    }


EVENTS = "owner string, key string, n long, method string, path string, ts timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_idempotent_keys_of_shuffled_arrivals(spark, tmp_path, seed):
    dice = random.Random(seed)
    events = [(dice.choice(["a", "b", None]), f"k{dice.randint(0, 7)}", i, dice.choice(["POST", "POST", "PUT"]), f"/{dice.randint(0, 2)}" if i % 5 == 0 else "/0", BASE + timedelta(seconds=i)) for i in range(80)]
    want = ops.dedupe_events(spark.createDataFrame(events, EVENTS), ["owner", "key"], ["method", "path"], ["n"])
    dice.shuffle(events)
    stream = stream_of(spark, str(tmp_path / "in"), [events[i::5] for i in range(5)], EVENTS)
    found = replay.run_updates(live.idempotent_events(stream, ["owner", "key"], ["method", "path"], "n"), "keys-test", ["owner", "key"])
    assert Counter(map(tuple, found.select(want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_idempotent_keys_expire(spark, tmp_path):
    at = lambda n, k, method, hours: ("a", k, n, method, "/", BASE + timedelta(hours=hours))
    batches = [[at(1, "x", "POST", 0)], [at(2, "y", "POST", 30)], [at(3, "y", "POST", 31)], [at(4, "x", "PUT", 32)]]
    stream = stream_of(spark, str(tmp_path / "in"), batches, EVENTS)
    found = replay.run_updates(live.idempotent_events(stream, ["owner", "key"], ["method", "path"], "n", "1 hour", 3_600_000), "keys-gone", ["owner", "key"])
    rows = {r.key: (r.n, r.method, r.conflict, r.events) for r in found.collect()}
    assert rows == {"x": (4, "PUT", False, 1), "y": (2, "POST", False, 2)}  # x had been forgotten
    assert found.filter(F.col("conflict")).count() == 0


RUNS = "run_id long, ts timestamp, stage_name string, status string"


def test_progress_of_many_runs_in_few_states(spark, tmp_path):
    at = lambda run, stage, status, hours: (run, BASE + timedelta(hours=hours), stage, status)
    runs = range(2 * live.STATES)
    first = [at(r, "transcribe", "completed" if r % 3 else "failed", 0) for r in runs] + [at(r, "odd", "completed", 0) for r in runs if r % 2] + [at(None, "align", "completed", 0)]
    stream = stream_of(spark, str(tmp_path / "in"), [first, [at(0, "align", "completed", 30)], [at(0, "align", "completed", 31)], [at(1, "align", "completed", 32)]], RUNS)
    told = []
    query = live.live_progress(stream).writeStream.foreachBatch(lambda b, n: told.append({r.run_id: (r.stages, r.fraction) for r in b.collect()})).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    part = lambda *stages: sum(ops.WEIGHTS[s] for s in stages) / 100
    assert sum(ops.WEIGHTS.values()) == 100
    assert told[0] == {r: ((r % 3 > 0) + r % 2, part("transcribe") if r % 3 else 0) for r in runs} | {None: (1, part("align"))}
    assert told[1] == told[2] == {0: (1, part("align"))}  # run 0 began with a failure
    assert told[3] == {1: (1, part("align"))}  # what was known of it is gone
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= live.STATES and held[-1] <= 2


def test_idempotent_keys_and_shapes_that_are_whole_numbers_or_null(spark, tmp_path):
    big, none = 2**60, None
    kinds = "owner long, n long, size long, ts timestamp"
    rows = [(big, 1, big, BASE), (big, 2, big + 1, BASE), (none, 3, none, BASE), (none, 4, none, BASE), (big + 1, 5, none, BASE), (big + 1, 6, 0, BASE), (0, 7, 0, BASE)]
    stream = stream_of(spark, str(tmp_path / "in"), [rows[:4], rows[4:]], kinds)
    found = replay.run_updates(live.idempotent_events(stream, ["owner"], ["size"], "n"), "keys-null", ["owner"]).collect()
    assert {tuple(r) for r in found} == {(big, 1, big, True, 2), (none, 3, none, False, 2), (big + 1, 5, none, True, 2), (0, 7, 0, False, 1)}
