"""The trigram index against a plain scan."""

import random
import re

import pytest
from colloquy.operators import trigrams as tg
from pyspark.sql import functions as F

ROWS = "meeting_id long, ref long, text string, start_ms long"


def texts(seed, meetings, n):
    dice = random.Random(seed)
    words = ["Budget", "nation", "the", "über", "İx", "x😀y", "to", "a", "ठीक है", "b\nc"]
    rows = [(m, r, " ".join(dice.choices(words, k=dice.randint(0, 8))), r) for m in meetings for r in range(n)]
    return rows + [(m, 10_000_000 + m, "far " + "long nation " * 3_000, 5) for m in meetings[:2]] + [(meetings[0], 9_999, None, None), (meetings[0], 9_998, "", None)]


def scan(rows, q):
    return sorted((m, r) for m, r, t, _ in rows if t is not None and q.lower() in t.lower())


QUERIES = ["N THE", "y", "far long", "über", "😀y", "i̇x", "ठीक", "b\nc", "not there"]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_lookups_by_scan(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(tg, "SENT_ROWS", sent)
    folder, rows = str(tmp_path / "index"), texts(1, [1, 2, 3, 4], 40)
    tg.write(spark.createDataFrame(rows, ROWS), folder)
    new = texts(2, [2, 7], 30)
    tg.upsert(spark.createDataFrame(new, ROWS), folder)
    now = [r for r in rows if r[0] != 2] + new
    tg.upsert(spark.createDataFrame(new[:3], ROWS), folder)
    now = [r for r in now if r[0] != 2] + new[:3]
    tg.compact(spark, folder, f"{folder}-one")
    for q in QUERIES:
        for f in (folder, f"{folder}-one") if q in QUERIES[:3] else (folder,):
            found = tg.lookup(spark, f, q)
            assert found.columns == ["meeting_id", "ref", "text", "start_ms"]
            assert sorted((r.meeting_id, r.ref) for r in found.collect()) == scan(now, q), q
    with pytest.raises(Exception, match="(?i)exist"):
        tg.write(spark.createDataFrame(rows, ROWS), folder)


def test_lookup_reads_the_wanted_parts_only(spark, tmp_path, capsys):
    folder = str(tmp_path / "index")
    tg.write(spark.createDataFrame(texts(3, list(range(40)), 5) + [(99, 1, "a zebra", 1)], ROWS), folder)
    posted = tg.postings(spark, folder, ["zeb"])
    assert len({r.bucket for r in posted.collect()}) == 1
    posted.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*gram", plan)
    found = tg.lookup(spark, folder, "a zebra")
    found.explain("formatted")
    assert re.search(r"PartitionFilters: \[.*shelf", capsys.readouterr().out)
    assert [(r.meeting_id, r.ref) for r in found.collect()] == [(99, 1)]


def test_blocks_hold_few_references(spark, tmp_path):
    folder = str(tmp_path / "index")
    tg.write(spark.range(9_000).select(F.lit(1).cast("long").alias("meeting_id"), F.col("id").alias("ref"), F.lit("abc").alias("text")), folder)
    blocks = spark.read.parquet(f"{folder}/postings").collect()
    assert sorted(b.n for b in blocks) == [808, 4_096, 4_096] and all(b.far[0] == 0 for b in blocks)
    assert tg.lookup(spark, folder, "ABC").count() == 9_000


def test_index_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "index")
    tg.write(spark.createDataFrame([], ROWS), folder)
    assert tg.rows_of(spark, folder).count() == 0
