"""Scans in time slices against scans of whole keys."""

import random
from collections import Counter

import pytest
from colloquy.operators import align as al
from colloquy.operators import analytics as an
from colloquy.operators import intervals as iv
from colloquy.operators import language as lg
from colloquy.operators import slices as sl
from pyspark.sql import functions as F

TURNS = "meeting_id long, turn_id long, speaker_label string, start_ms long, end_ms long"


@pytest.fixture(scope="module")
def turns(spark):
    dice = random.Random(21)
    rows = []
    for m, n, far in ((1, 120, 3_000), (2, 40, 90_000), (None, 30, 2_000), (3, 1, 10)):
        rows += [(m, i, dice.choice("ABC"), at := dice.randint(-far, far), at + dice.choice([0, 1, 5, 40, 300, far])) for i in range(n)]
    rows += [(4, i, "A", 10 * i, 10 * i + 10) for i in range(50)] + [(4, 99, "A", 0, 10), (4, 100, "B", 777, 777)]
    return spark.createDataFrame(rows, TURNS).cache()


def rows(df):
    return Counter(str([r[c] for c in sorted(df.columns)]) for r in df.collect())


SCANS = {
    "merge": lambda t, n: iv.merge_intervals(t, ["meeting_id"], slice_ms=n),
    "own": lambda t, n: iv.speaker_intervals(t, n),
    "gaps": lambda t, n: iv.gap_merge(t, ["meeting_id", "speaker_label"], 25, slice_ms=n),
    "clip": lambda t, n: iv.clip_non_overlapping(t, ["meeting_id"], ["start_ms", "turn_id"], slice_ms=n),
    "overlap": lambda t, n: iv.overlap_by_speaker(t.filter("meeting_id IS NOT NULL"), slice_ms=n),
    "regions": lambda t, n: iv.find_overlap_regions(t.filter("meeting_id IS NOT NULL"), slice_ms=n),
    "runs": lambda t, n: an.floor_runs(t, n),
    "groups": lambda t, n: al.group_by_speaker(t.select("meeting_id", F.col("turn_id").alias("word_id"), F.col("speaker_label").alias("word"), F.col("speaker_label").alias("speaker"), "start_ms", "end_ms"), n),
    "adjacent": lambda t, n: lg.merge_adjacent(
        t.select("meeting_id", F.col("turn_id").alias("seq"), F.when(F.col("turn_id") % 7 > 0, F.col("speaker_label")).alias("speaker"), F.when(F.col("turn_id") % 5 > 0, "en").alias("language"), "start_ms", "end_ms", (F.col("turn_id") % 9 / 8).alias("confidence")), 30, n
    ),
}


@pytest.mark.parametrize("slice_ms", [7, 1_000, 10**9])
@pytest.mark.parametrize("name", SCANS)
def test_slices_change_nothing(turns, name, slice_ms):
    assert rows(SCANS[name](turns, slice_ms)) == rows(SCANS[name](turns, None))


def test_one_meeting_is_dealt_over_many_tasks(spark):
    """No task of the scan reads more than its slices: a meeting of many turns has rows in nearly all partitions."""
    one = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("meeting_id"), F.col("id").alias("turn_id"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 250).alias("end_ms"))
    with_conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in with_conf}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        dealt = sl.cut(one, ["meeting_id"], "start_ms", 100_000).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) >= 28 and max(r["count"] for r in dealt) < 0.12 * 200_000
        assert [tuple(r) for r in iv.merge_intervals(one, ["meeting_id"], slice_ms=100_000).collect()] == [(1, 0, 199_999 * 100 + 250)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_slices_edges(turns):
    assert iv.merge_intervals(turns.limit(0), ["meeting_id"], slice_ms=5).count() == 0
    with pytest.raises(ValueError):
        sl.cut(turns, ["meeting_id"], "start_ms", 0)
