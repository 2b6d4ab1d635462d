"""Registered queries hand whole tables to their operators."""

import pytest
from colloquy.operators import align as al
from colloquy.plans import lenses as ln
from colloquy.plans import registry
from pyspark.sql import functions as F


@pytest.mark.parametrize("name,taker", [("A4_split_segment", "split_segment"), ("A5_align_words", "align_words"), ("A9_merge_fragments", "speaker_for_span"), ("A10_split_long", "align_words"), ("A13_build_utterances", "align_words")])
def test_alignment_takes_all_turns_whole(spark, sf_dir, monkeypatch, name, taker):
    seen, real = [], getattr(al, taker)
    monkeypatch.setattr(al, taker, lambda *frames: seen.append(frames[-1]) or real(*frames))
    registry.queries()[name](spark, sf_dir)
    facts = lambda turns: turns.agg(F.count("*"), F.sum(F.col("end_ms") - F.col("start_ms"))).first()
    assert facts(seen[0]) == facts(ln.turns(spark, sf_dir))
