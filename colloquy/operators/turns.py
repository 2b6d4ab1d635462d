"""Diarization output cleaned: short turns, labels by first appearance, overlaps, chunks linked by voice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv


def drop_short_turns(turns: DataFrame, least_ms: int) -> DataFrame:
    """Keeps turns of at least ``least_ms``; a speaker without one keeps the first of the longest."""
    d = F.col("end_ms") - F.col("start_ms")
    key = Window.partitionBy("meeting_id", "speaker_label")
    rank = F.row_number().over(key.orderBy(d.desc(), "start_ms", "end_ms"))
    some = F.max(F.when(d >= least_ms, 1).otherwise(0)).over(key)
    return turns.withColumn("_rank", rank).withColumn("_some", some).filter((d >= least_ms) | ((F.col("_some") == 0) & (F.col("_rank") == 1))).drop("_rank", "_some")


def first_appearance_labels(turns: DataFrame) -> DataFrame:
    """speaker_label becomes Person 1, 2, … by first appearance; raw_label keeps what it was."""
    firsts = turns.groupBy("meeting_id", "speaker_label").agg(F.min(F.struct("start_ms", "end_ms", "speaker_label")).alias("f"))
    named = firsts.select("meeting_id", "speaker_label", F.concat(F.lit("Person "), F.row_number().over(Window.partitionBy("meeting_id").orderBy("f")).cast("string")).alias("person"))
    return turns.join(named, ["meeting_id", "speaker_label"]).withColumnRenamed("speaker_label", "raw_label").withColumnRenamed("person", "speaker_label")


def clean_turns(raw: DataFrame, merge_gap_ms: int = 500, least_ms: int = 300, width: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """Turns (with is_overlap) and overlap regions of raw segments."""
    merged = iv.gap_merge(raw, ["meeting_id", "speaker_label"], merge_gap_ms)
    turns = first_appearance_labels(drop_short_turns(merged, least_ms))
    regions = iv.find_overlap_regions(turns, width)
    spans = regions.select("meeting_id", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    hit = iv.interval_join(turns, spans, ["meeting_id"], width).select("meeting_id", "speaker_label", "start_ms", "end_ms").distinct().withColumn("is_overlap", F.lit(True))
    marked = turns.join(hit, ["meeting_id", "speaker_label", "start_ms", "end_ms"], "left").withColumn("is_overlap", F.coalesce("is_overlap", F.lit(False)))
    return marked, regions


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a side is null, empty, zero, not finite, or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.coalesce(F.when(good, value), F.lit(0.0))


def relink_chunks(voices: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One label per voice across the chunks of a meeting.

    Rows: meeting_id, chunk, label, emb. In order of chunks, labels are matched one to one with the running centroids,
    best similarity first; below ``threshold``, or without a vector, a label is a new voice. A chunk depends on those
    before it, so a meeting (some dozens of rows) is one group; meetings run in parallel.
    """
    import numpy as np

    def link(group: pd.DataFrame) -> pd.DataFrame:
        sums: list = []
        counts: list[int] = []
        out = []
        for chunk, rows in group.sort_values(["chunk", "label"]).groupby("chunk", sort=True):
            vectors = [None if e is None or not len(e) else np.asarray(e, dtype=float) for e in rows["emb"]]
            pairs = []
            for i, v in enumerate(vectors):
                for j, s in enumerate(sums):
                    if v is not None and s is not None and len(v) == len(s):
                        norm = np.linalg.norm(v) * np.linalg.norm(s)
                        sim = float(v @ s / norm) if norm > 0 and np.isfinite(norm) else 0.0
                        if sim >= threshold:
                            pairs.append((-sim, i, j))
            mine, taken = {}, set()
            for _, i, j in sorted(pairs):
                if i not in mine and j not in taken:
                    mine[i] = j
                    taken.add(j)
            for i, (label, v) in enumerate(zip(rows["label"], vectors, strict=True)):
                if i in mine:
                    j = mine[i]
                    sums[j] = (sums[j] * counts[j] + v) / (counts[j] + 1)
                    counts[j] += 1
                else:
                    j = len(sums)
                    sums.append(v)
                    counts.append(1)
                out.append((group["meeting_id"].iloc[0], chunk, label, j))
        return pd.DataFrame(out, columns=["meeting_id", "chunk", "label", "voice"])

    kind = voices.schema["meeting_id"].dataType.simpleString()
    return voices.select("meeting_id", F.col("chunk").cast("long").alias("chunk"), F.col("label").cast("string").alias("label"), "emb").groupBy("meeting_id").applyInPandas(link, f"meeting_id {kind}, chunk long, label string, voice int")


def relink_segments(chunks: DataFrame, segments: DataFrame, voices: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One timeline of a meeting's chunks: meeting_id, start_ms, end_ms, speaker_label.

    ``chunks``: meeting_id, chunk, start_ms, end_ms; ``segments``: meeting_id, chunk, label, start_ms, end_ms from the chunk's
    begin; ``voices``: see ``relink_chunks``. Segments are shifted and cut to the half of each overlap that their chunk owns.
    """
    begins = chunks.select("meeting_id", "chunk", F.col("start_ms").alias("offset"))
    shifted = segments.join(begins, ["meeting_id", "chunk"]).withColumn("start_ms", F.col("start_ms") + F.col("offset")).withColumn("end_ms", F.col("end_ms") + F.col("offset")).drop("offset")
    cut = iv.clip_to_chunks(shifted, iv.chunk_ownership(chunks))
    linked = relink_chunks(voices, threshold)
    name = F.concat(F.lit("SPEAKER_G"), F.when(F.col("voice") < 100, F.lpad(F.col("voice").cast("string"), 2, "0")).otherwise(F.col("voice").cast("string")))
    return cut.join(linked, ["meeting_id", "chunk", "label"]).select("meeting_id", "start_ms", "end_ms", name.alias("speaker_label"))
