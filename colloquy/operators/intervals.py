"""Interval algebra. Times are whole milliseconds, spans half open; everything is keyed, and windows are per key.

Functions with ``slice_ms`` scan a key in one task where it is None; with a length, in time slices (``slices``), for keys of
very many spans. Results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import slices as sl

Keys = Sequence[str]
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, keys: Keys, order: Sequence[str], begins: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one begins where ``begins`` holds."""
    return df.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_UPTO)))


def reach(keys: Keys, order: Sequence[str], end: str = "end_ms") -> Column:
    """The latest end among earlier rows; contained spans make it differ from the previous row's end."""
    return F.max(end).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_BEFORE))


def _united(spans: DataFrame, keys: Keys, gap_ms: int, start: str, end: str, slice_ms: int | None) -> DataFrame:
    """Spans of a key as one while each begins less than ``gap_ms`` after what came before."""
    order, late = [start, end], F.col("_reach").isNull() | (F.col(start) - F.col("_reach") >= gap_ms)
    if slice_ms is None:
        numbered = islands(spans.withColumn("_reach", reach(keys, order, end)), keys, order, late, "_island")
    else:
        reached = sl.Scan(keys, order).max_before("_reach", F.col(end)).over(sl.cut(spans, keys, start, slice_ms))
        numbered = sl.Scan(keys, order).sum_upto("_island", F.when(late, 1).otherwise(0)).over(reached)
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_intervals(df: DataFrame, keys: Keys, start: str = "start_ms", end: str = "end_ms", slice_ms: int | None = None) -> DataFrame:
    """The union of each key's spans; empty ones are dropped and touching ones merge."""
    return _united(df.filter(F.col(end) > F.col(start)).select(*keys, start, end), keys, 1, start, end, slice_ms)


def total_length(df: DataFrame, keys: Keys, start: str = "start_ms", end: str = "end_ms", name: str = "total_ms") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(name))


def _buckets(start: Column, end: Column, width: int) -> Column:
    last = F.greatest(F.floor((end - 1) / width), F.floor(start / width))
    return F.sequence(F.floor(start / width).cast("long"), last.cast("long"))


def interval_join(a: DataFrame, b: DataFrame, keys: Keys, width: int, how: str = "inner") -> DataFrame:
    """Pairs of overlapping spans of a (start_ms, end_ms) and b (b_start_ms, b_end_ms) of one key.

    Both sides are laid in buckets of ``width`` and joined on key and bucket; a pair counts in the bucket where its
    overlap begins, so none appears twice. ``width`` should be about the longest common span.
    """
    left = a.withColumn("_bucket", F.explode(_buckets(F.col("start_ms"), F.col("end_ms"), width)))
    right = b.withColumn("_bucket", F.explode(_buckets(F.col("b_start_ms"), F.col("b_end_ms"), width)))
    first = F.floor(F.greatest("start_ms", "b_start_ms") / width)
    pairs = left.join(right, [*keys, "_bucket"], how)
    return pairs.filter((F.col("start_ms") < F.col("b_end_ms")) & (F.col("b_start_ms") < F.col("end_ms")) & (F.col("_bucket") == first)).drop("_bucket")


def intersect_intervals(a: DataFrame, b: DataFrame, keys: Keys, width: int = 60_000) -> DataFrame:
    """Intersections of two keyed sets of merged spans."""
    other = b.select(*keys, F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    pairs = interval_join(a.select(*keys, "start_ms", "end_ms"), other, keys, width)
    return pairs.select(*keys, F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms"))


def speaker_intervals(turns: DataFrame, slice_ms: int | None = None) -> DataFrame:
    return merge_intervals(turns, ["meeting_id", "speaker_label"], slice_ms=slice_ms)


def sweep(spans: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Elementary segments of each meeting's merged speaker spans: start_ms, end_ms, active (speakers), id_sum.

    Where one speaker is active, id_sum is that speaker's number (``speaker_no``, by label)."""
    by_label = Window.partitionBy("meeting_id").orderBy("speaker_label")
    if slice_ms is None:
        numbered = spans.withColumn("speaker_no", F.dense_rank().over(by_label))
    else:
        numbered = spans.join(spans.select("meeting_id", "speaker_label").distinct().withColumn("speaker_no", F.row_number().over(by_label)), ["meeting_id", "speaker_label"])
    edges = numbered.select("meeting_id", F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("e"), "speaker_no")
    steps = edges.groupBy("meeting_id", F.col("e.t").alias("start_ms")).agg(F.sum("e.d").alias("d"), F.sum(F.col("e.d") * F.col("speaker_no")).alias("i"))
    w = Window.partitionBy("meeting_id").orderBy("start_ms")
    run = w.rowsBetween(*_UPTO)
    if slice_ms is None:
        out = steps.select("meeting_id", "start_ms", F.lead("start_ms").over(w).alias("end_ms"), F.sum("d").over(run).alias("active"), F.sum("i").over(run).alias("id_sum"))
    else:
        scan = sl.Scan(["meeting_id"], ["start_ms"]).next_after("end_ms", F.col("start_ms")).sum_upto("active", F.col("d")).sum_upto("id_sum", F.col("i"))
        out = scan.over(sl.cut(steps, ["meeting_id"], "start_ms", slice_ms)).select("meeting_id", "start_ms", "end_ms", "active", "id_sum")
    return out.filter(F.col("end_ms").isNotNull() & (F.col("active") > 0))


def overlap_by_speaker(turns: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Per speaker: speaking_ms, solo_ms, overlap_ms (time while others speak too)."""
    own = speaker_intervals(turns, slice_ms)
    total = own.groupBy("meeting_id", "speaker_label").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speaking_ms"))
    total = total.withColumn("speaker_no", F.dense_rank().over(Window.partitionBy("meeting_id").orderBy("speaker_label")))
    solo = sweep(own, slice_ms).filter("active = 1").groupBy("meeting_id", F.col("id_sum").alias("speaker_no")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("solo_ms"))
    out = total.join(solo, ["meeting_id", "speaker_no"], "left").withColumn("solo_ms", F.coalesce("solo_ms", F.lit(0)))
    return out.select("meeting_id", "speaker_label", "speaking_ms", "solo_ms", (F.col("speaking_ms") - F.col("solo_ms")).alias("overlap_ms"))


def find_overlap_regions(turns: DataFrame, width: int = 60_000, slice_ms: int | None = None) -> DataFrame:
    """Spans in which two or more speak, with their sorted labels; touching spans of one set merge."""
    own = speaker_intervals(turns, slice_ms)
    double = sweep(own, slice_ms).filter("active > 1").select("meeting_id", "start_ms", "end_ms")
    who = own.select("meeting_id", "speaker_label", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    sets = interval_join(double, who, ["meeting_id"], width).groupBy("meeting_id", "start_ms", "end_ms").agg(F.array_sort(F.collect_set("speaker_label")).alias("speakers"))
    keys, order = ["meeting_id"], ["start_ms"]
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = F.col("_end").isNull() | (F.col("_end") != F.col("start_ms")) | (F.col("_speakers") != F.col("speakers"))
    if slice_ms is None:
        numbered = islands(sets.withColumn("_end", F.lag("end_ms").over(w)).withColumn("_speakers", F.lag("speakers").over(w)), keys, order, begins, "_island")
    else:
        before = sl.Scan(keys, order).last_before("_end", F.col("end_ms")).last_before("_speakers", F.col("speakers")).over(sl.cut(sets, keys, "start_ms", slice_ms))
        numbered = sl.Scan(keys, order).sum_upto("_island", F.when(begins, 1).otherwise(0)).over(before)
    return numbered.groupBy("meeting_id", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speakers").alias("speakers")).drop("_island")


def clip_non_overlapping(df: DataFrame, keys: Keys, order: Sequence[str], slice_ms: int | None = None) -> DataFrame:
    """Each span starts no earlier than the end of those before it; what is left of nothing is dropped. ``order`` begins with
    start_ms."""
    if slice_ms is None:
        reached = df.withColumn("_cursor", reach(keys, order))
    else:
        reached = sl.Scan(keys, order).max_before("_cursor", F.col("end_ms")).over(sl.cut(df, keys, "start_ms", slice_ms)).drop(sl.SLICE)
    return reached.withColumn("start_ms", F.greatest("start_ms", F.coalesce("_cursor", F.col("start_ms")))).filter("end_ms > start_ms").drop("_cursor")


def gap_merge(df: DataFrame, keys: Keys, max_gap_ms: int, slice_ms: int | None = None) -> DataFrame:
    """Merges spans of a key whose gap to what came before is below ``max_gap_ms``."""
    return _united(df.select(*keys, "start_ms", "end_ms"), keys, max_gap_ms, "start_ms", "end_ms", slice_ms)


def plan_chunks(df: DataFrame, length_ms: int, overlap_ms: int, duration: str = "duration_ms") -> DataFrame:
    """Windows of ``length_ms`` that overlap by ``overlap_ms``; the last ends with the recording."""
    if length_ms <= 0 or overlap_ms < 0 or overlap_ms >= length_ms:
        raise ValueError("chunks need a positive length and an overlap below it")
    step = length_ms - overlap_ms
    count = F.greatest(F.ceil((F.col(duration) - overlap_ms) / step), F.lit(1)).cast("int")
    out = df.filter(F.col(duration) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    return out.withColumn("start_ms", (F.col("chunk") * step).cast("long")).withColumn("end_ms", F.least(F.col("start_ms") + length_ms, F.col(duration)).cast("long"))


def chunk_ownership(chunks: DataFrame) -> DataFrame:
    """Adds own_start_ms and own_end_ms: each chunk owns half of every overlap with its neighbours."""
    w = Window.partitionBy("meeting_id").orderBy("chunk")
    before, after = F.lag("end_ms").over(w), F.lead("start_ms").over(w)
    return chunks.withColumn("own_start_ms", F.coalesce(F.floor((before + F.col("start_ms")) / 2), F.col("start_ms")).cast("long")).withColumn(
        "own_end_ms", F.coalesce(F.floor((F.col("end_ms") + after) / 2), F.col("end_ms")).cast("long")
    )


def clip_to_chunks(spans: DataFrame, owned: DataFrame) -> DataFrame:
    """Spans (meeting_id, chunk, start_ms, end_ms) cut to what their chunk owns."""
    own = owned.select("meeting_id", "chunk", "own_start_ms", "own_end_ms")
    out = spans.join(own, ["meeting_id", "chunk"]).withColumn("start_ms", F.greatest("start_ms", "own_start_ms")).withColumn("end_ms", F.least("end_ms", "own_end_ms"))
    return out.filter("end_ms > start_ms").drop("own_start_ms", "own_end_ms")


def speech_regions(frames: DataFrame, threshold: float, bridge: int, least: int, most: int, frame_ms: int = 10) -> DataFrame:
    """Regions of frames with energy at or above ``threshold``; pauses below ``bridge`` frames are bridged, regions
    below ``least`` frames dropped, those above ``most`` divided evenly."""
    loud = frames.filter(F.col("energy") >= threshold).select("meeting_id", "frame")
    w = Window.partitionBy("meeting_id").orderBy("frame")
    last = F.lag("frame").over(w)
    numbered = islands(loud.withColumn("_begins", last.isNull() | (F.col("frame") - last - 1 >= bridge)), ["meeting_id"], ["frame"], F.col("_begins"), "_island")
    regions = numbered.groupBy("meeting_id", "_island").agg(F.min("frame").alias("f"), (F.max("frame") + 1).alias("t")).filter(F.col("t") - F.col("f") >= least)
    parts = F.ceil((F.col("t") - F.col("f")) / most).cast("int")
    cut = regions.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = lambda k: ((F.col("f") + F.floor((F.col("t") - F.col("f")) * k / F.col("parts"))) * frame_ms).cast("long")
    return cut.select("meeting_id", at(F.col("part")).alias("start_ms"), at(F.col("part") + 1).alias("end_ms"))


def silence_metrics(silences: DataFrame, durations: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Per recording: silence_ms, silence_ratio (at most 1; 1 for an empty recording), leading_ms, trailing_ms."""
    s = durations.join(silences.select("meeting_id", "start_ms", "end_ms"), "meeting_id", "left")
    length = F.col("end_ms") - F.col("start_ms")
    whole = (F.col("start_ms") <= tolerance_ms) & (F.col("end_ms") >= F.col("duration_ms") - tolerance_ms)
    return (
        s.groupBy("meeting_id", "duration_ms")
        .agg(
            F.coalesce(F.sum(length), F.lit(0)).alias("silence_ms"),
            F.coalesce(F.max(F.when(F.col("start_ms") <= tolerance_ms, F.col("end_ms"))), F.lit(0)).alias("leading_ms"),
            F.coalesce(F.max(F.when((F.col("end_ms") >= F.col("duration_ms") - tolerance_ms) & ~whole, length)), F.lit(0)).alias("trailing_ms"),
        )
        .withColumn("silence_ratio", F.when(F.col("duration_ms") <= 0, 1.0).otherwise(F.least(F.col("silence_ms") / F.col("duration_ms"), F.lit(1.0))))
    )


def quality_warnings(levels: DataFrame) -> DataFrame:
    """Adds warnings from mean_db, peak_db, duration_ms, silence_ratio."""
    named = [
        (F.col("mean_db").isNull() | (F.col("mean_db") < -40), "low_volume"),
        (F.col("peak_db") >= -0.1, "clipping"),
        (F.col("duration_ms") < 2000, "too_short"),
        (F.col("silence_ratio") > 0.8, "mostly_silent"),
    ]
    return levels.withColumn("warnings", F.filter(F.array(*[F.when(c, n) for c, n in named]), lambda x: x.isNotNull()))


def trim_window(metrics: DataFrame) -> DataFrame:
    """The span left without leading and trailing silence; null if there is nothing to trim or nothing left."""
    start, end = F.col("leading_ms"), F.col("duration_ms") - F.col("trailing_ms")
    some = ((F.col("leading_ms") > 0) | (F.col("trailing_ms") > 0)) & (end > start)
    return metrics.withColumn("trim_start_ms", F.when(some, start)).withColumn("trim_end_ms", F.when(some, end))
