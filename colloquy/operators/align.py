"""Words given to speakers, and utterances built from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import intervals as iv
from . import slices as sl
from .transcript import approximate_words

UNKNOWN = "Unknown"


def speaker_for_span(words: DataFrame, turns: DataFrame, max_gap_ms: int = 1_000, width: int = 60_000) -> DataFrame:
    """Adds speaker, overlapping_speakers to spans (meeting_id, word_id, start_ms, end_ms).

    The speaker with most overlap (on ties the one whose turn begins first, then by label); without any overlap that
    of the nearest turn within ``max_gap_ms`` (nearest, then first, then by label); else Unknown. A span counts as 1 ms
    at least.
    """
    w = words.withColumn("_end", F.greatest("end_ms", F.col("start_ms") + 1))
    spans = w.select("meeting_id", "word_id", "start_ms", F.col("_end").alias("end_ms"))
    t = turns.select("meeting_id", "speaker_label", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    # One join for both: spans are widened by the gap, end to end, and what overlaps a span itself comes first.
    wide = spans.select("meeting_id", "word_id", (F.col("start_ms") - max_gap_ms - 1).alias("start_ms"), (F.col("end_ms") + max_gap_ms + 1).alias("end_ms"))
    s, e = F.col("start_ms") + max_gap_ms + 1, F.col("end_ms") - max_gap_ms - 1
    met = iv.interval_join(wide, t, ["meeting_id"], width).withColumn("gap", F.greatest(F.col("b_start_ms") - e, s - F.col("b_end_ms"))).withColumn("hit", (s < F.col("b_end_ms")) & (F.col("b_start_ms") < e)).filter(F.col("hit") | (F.col("gap") <= max_gap_ms))
    shared = F.least(e, F.col("b_end_ms")) - F.greatest(s, F.col("b_start_ms"))
    sums = met.groupBy("meeting_id", "word_id", "speaker_label").agg(F.sum(F.when(F.col("hit"), shared)).alias("ms"), F.min(F.when(F.col("hit"), F.col("b_start_ms"))).alias("first"), F.min(F.when(~F.col("hit"), F.struct("gap", "b_start_ms", "speaker_label"))).alias("near"))
    ranked = sums.groupBy("meeting_id", "word_id").agg(F.sort_array(F.collect_list(F.when(F.col("ms").isNotNull(), F.struct((-F.col("ms")).alias("ms"), "first", "speaker_label")))).alias("r"), F.min("near").alias("near"))
    some = F.size("r") > 0
    best = ranked.select(
        "meeting_id", "word_id", F.when(some, F.get("r", F.lit(0))["speaker_label"]).alias("speaker"), F.when(~some, F.col("near.speaker_label")).alias("_near"),
        F.when(some, F.array_sort(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(1))), lambda x: x["speaker_label"]))).alias("overlapping_speakers"),
    )
    out = w.drop("_end").join(best, ["meeting_id", "word_id"], "left")
    return out.withColumn("speaker", F.coalesce("speaker", "_near", F.lit(UNKNOWN))).withColumn("overlapping_speakers", F.coalesce("overlapping_speakers", F.array().cast("array<string>"))).drop("_near")


def has_word_timings(words: Column) -> Column:
    return F.coalesce((F.size(words) > 0) & F.forall(words, lambda w: w["confidence"].isNotNull()), F.lit(False))


def split_segment(segments: DataFrame, turns: DataFrame, max_gap_ms: int = 1_000, width: int = 60_000) -> DataFrame:
    """The words of untimed segments, shared among the turns they overlap.

    Parts come from the turns in order; a turn of the same speaker that touches extends a part, one that begins inside
    the part before is passed over. Words go by largest remainder of the parts' lengths and are spread over them.
    """
    t = turns.select("meeting_id", "speaker_label", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    base = segments.select("meeting_id", "id", "start_ms", "end_ms", tx.tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    met = iv.interval_join(base.select("meeting_id", "id", "start_ms", "end_ms"), t, ["meeting_id"], width)
    cut = met.select("meeting_id", "id", F.struct(F.col("b_start_ms").alias("turn"), "speaker_label", F.greatest("start_ms", "b_start_ms").alias("s"), F.least("end_ms", "b_end_ms").alias("e")).alias("p"))
    kind = "array<struct<s:bigint,e:bigint,speaker:string>>"

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(F.when(F.size(a) > 0, a), -1)
        own = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["speaker_label"].alias("speaker"))
        grown = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["speaker"].alias("speaker"))))
        return F.when((F.size(a) > 0) & (last["speaker"] == x["speaker_label"]) & (x["s"] <= last["e"]), grown).when((F.size(a) == 0) | (x["s"] >= last["e"]), F.concat(a, F.array(own))).otherwise(a).cast(kind)

    folded = cut.groupBy("meeting_id", "id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("meeting_id", "id", F.aggregate("ps", F.array().cast(kind), step).alias("parts"))
    lone = base.join(folded, ["meeting_id", "id"], "left_anti").select("meeting_id", F.col("id").alias("word_id"), "start_ms", "end_ms")
    found = speaker_for_span(lone, turns, max_gap_ms, width).select("meeting_id", F.col("word_id").alias("id"), F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("speaker").alias("speaker"))).cast(kind).alias("parts"))
    whole = base.join(folded.unionByName(found), ["meeting_id", "id"])
    each = whole.select("meeting_id", "id", "tokens", F.posexplode("parts").alias("part", "p"))
    own = Window.partitionBy("meeting_id", "id")
    length = F.col("p.e") - F.col("p.s")
    total = F.sum(length).over(own)
    n = F.size("tokens")
    shares = each.withColumn("_down", F.when(total > 0, F.floor(n * length / total)).otherwise(F.when(F.col("part") == 0, n).otherwise(0))).withColumn("_rest", F.when(total > 0, (n * length) % F.greatest(total, F.lit(1))).otherwise(0))
    extra = F.row_number().over(own.orderBy(F.desc("_rest"), "part")) <= n - F.sum("_down").over(own)
    counted = shares.withColumn("_n", F.col("_down") + F.when(extra, 1).otherwise(0))
    begin = F.sum("_n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    chunks = counted.withColumn("_begin", begin).filter("_n > 0").select("meeting_id", "id", "part", F.col("p.speaker").alias("speaker"), F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"), F.array_join(F.slice("tokens", (F.col("_begin") + 1).cast("int"), F.col("_n").cast("int")), " ").alias("text"))
    timed = approximate_words(chunks, ["meeting_id", "id", "part", "speaker"])
    flat = chunks.filter("end_ms <= start_ms").select("meeting_id", "id", "part", "speaker", F.posexplode(F.split("text", " ")).alias("pos", "word"), "start_ms", "end_ms")
    return timed.unionByName(flat)


def align_words(timed: DataFrame, untimed: DataFrame, turns: DataFrame, max_gap_ms: int = 1_000, width: int = 60_000) -> DataFrame:
    """Every word with one speaker: timed words by their own spans, the others by their segments'. Confidence and language stay
    where timed words have them; languages are told from the words otherwise."""
    given = lambda c, kind: F.col(c).cast(kind) if c in timed.columns else F.lit(None).cast(kind)
    language = lambda own: F.coalesce(own, tx.word_language(F.col("word"))).alias("language")
    a = speaker_for_span(timed, turns, max_gap_ms, width).select("meeting_id", "word", "start_ms", "end_ms", "speaker", "overlapping_speakers", F.lit("word").alias("precision"), given("confidence", "double").alias("confidence"), language(given("language", "string")))
    b = split_segment(untimed, turns, max_gap_ms, width)
    return a.unionByName(b.select("meeting_id", "word", "start_ms", "end_ms", "speaker", F.array().cast("array<string>").alias("overlapping_speakers"), F.lit("segment").alias("precision"), F.lit(None).cast("double").alias("confidence"), language(F.lit(None).cast("string"))))


_ORDER = ["start_ms", "end_ms", "speaker", "word"]


def group_by_speaker(words: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Numbers runs of words of one speaker, in order of time."""
    keys, new = ["meeting_id"], F.col("_last").isNull() | (F.col("_last") != F.col("speaker"))
    if slice_ms is None:
        last = F.lag("speaker").over(Window.partitionBy(*keys).orderBy(*_ORDER))
        return iv.islands(words.withColumn("_last", last), keys, _ORDER, new, "group").drop("_last")
    before = sl.Scan(keys, _ORDER).last_before("_last", F.col("speaker")).over(sl.cut(words, keys, "start_ms", slice_ms))
    return sl.Scan(keys, _ORDER).sum_upto("group", F.when(new, 1).otherwise(0)).over(before).drop("_last", sl.SLICE)


def _joined(s: np.ndarray, e: np.ndarray, n: np.ndarray, starts: np.ndarray, min_words: int, gap_ms: int) -> np.ndarray:
    """For each of a speaker's groups, in order: the group it ends in. Of each: its start, its last word's end, how many words it
    has, and its last word's start."""
    s, e, n, starts = (v.astype(np.float64) for v in (s, e, n, starts))
    into, alive = np.arange(len(s)), np.ones(len(s), dtype=bool)
    far = lambda i: np.where(alive, np.maximum(np.maximum(s - e[i], s[i] - e), 0), np.inf)
    i = 0
    while i < len(s):
        if alive[i] and n[i] < min_words:
            gaps = far(i)
            gaps[i] = np.inf
            o = int(np.argmin(gaps))
            if gaps[o] <= gap_ms:
                if (starts[i], e[i]) > (starts[o], e[o]):  # the end is that of the last word, which begins last
                    starts[o], e[o] = starts[i], e[i]
                s[o], n[o] = min(s[o], s[i]), n[o] + n[i]
                alive[i], into[into == i] = False, o
                # Only what is near the group that has grown may join now though it could not before.
                again = np.flatnonzero((far(o) <= gap_ms) & (n < min_words) & alive)
                i = min(int(again[0]), i + 1) if len(again) else i + 1
                continue
        i += 1
    return into


def _merged(group: np.ndarray, start: np.ndarray, end: np.ndarray, min_words: int, gap_ms: int) -> np.ndarray:
    """The group that each of a speaker's words ends in."""
    order = np.lexsort((end, start, group))
    ids, first = np.unique(group[order], return_index=True)
    if len(ids) < 2:
        return group
    last = np.append(first[1:], len(order)) - 1
    into = _joined(start[order][first], end[order][last], last - first + 1, start[order][last], min_words, gap_ms)
    return ids[into][np.searchsorted(ids, group)]


def merge_fragments(grouped: DataFrame, min_words: int = 2, gap_ms: int = 1_000) -> DataFrame:
    """Groups below ``min_words`` join the nearest group of their speaker within ``gap_ms`` (the first on ties), in order, until
    none can. Each join changes what the next one sees, but only among a speaker's groups: those of a speaker in a meeting
    are folded, many speakers in a call, and their words pass by as they are."""
    keys = ["meeting_id", "speaker"]
    rest = [c for c in grouped.columns if c not in keys]
    kind = grouped.schema["group"].dataType

    @F.arrow_udf(T.ArrayType(kind))
    def fold(group: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        at = group.offsets.to_numpy()
        ids, s, e = (v.values.to_numpy(zero_copy_only=False) for v in (group, start, end))
        out = [_merged(*(v[i:j] for v in (ids, s, e)), min_words, gap_ms) for i, j in zip(at[:-1], at[1:], strict=True)]
        flat = np.concatenate(out) if out else ids[:0]
        return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(flat, group.type.value_type))

    words = grouped.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("w"))
    merged = words.withColumn("_into", fold(*(F.col("w")[c] for c in ("group", "start_ms", "end_ms"))))
    each = merged.select(*keys, F.inline(F.arrays_zip("w", "_into")))
    return each.select(*(c if c in keys else F.col("_into" if c == "group" else f"w.{c}").alias(c) for c in grouped.columns))


def _parts(start: list, end: list, ends: list, max_ms: int) -> list[int]:
    """The part of each of a group's words, in order, by whether it ends a sentence."""
    part, since, out = 0, None, []
    for s, e, sentence in zip(start, end, ends, strict=True):
        since = s if since is None else since
        out.append(part)
        if since is not None and e is not None and (e - since >= 2 * max_ms or sentence and e - since >= max_ms):
            part, since = part + 1, None
    return out


def split_long(grouped: DataFrame, max_ms: int = 30_000) -> DataFrame:
    """Numbers parts: a group ends with a sentence once it spans ``max_ms``, and anyway at twice that."""
    rows = grouped.groupBy("meeting_id", "group").agg(F.sort_array(F.collect_list(F.struct(*_ORDER, *[c for c in grouped.columns if c not in {*_ORDER, "meeting_id", "group"}], F.coalesce(tx.ends_sentence(F.col("word")), F.lit(False)).alias("_ends")))).alias("w"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def parts(start: pa.Array, end: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([_parts(*lists, max_ms) for lists in zip(start.to_pylist(), end.to_pylist(), ends.to_pylist(), strict=True)], pa.list_(pa.int32()))

    numbered = rows.withColumn("p", parts(*(F.col("w")[c] for c in ("start_ms", "end_ms", "_ends")))).select("meeting_id", "group", F.inline(F.arrays_zip("w", "p")))
    return numbered.select("meeting_id", "group", F.col("p").alias("part"), "w.*").drop("_ends")


def merge_same_speaker_overlaps(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers utterances (``u``): parts (start_ms, end_ms) of one speaker that overlap in time become one."""
    order = ["start_ms", "end_ms"]
    far = parts.withColumn("_reach", iv.reach(keys, order))
    return iv.islands(far, keys, order, F.col("_reach").isNull() | (F.col("start_ms") >= F.col("_reach")), "u").drop("_reach")


def to_utterance(words: DataFrame, keys: list[str]) -> DataFrame:
    """One utterance for each key of words (word, start_ms, end_ms, speaker, overlapping_speakers, precision, confidence, language).

    In order of time: text; words; base languages, the primary one being the most frequent, then the one heard first; the mean
    of known confidences to four decimals; speakers that overlap any word. Words without a column of languages are told by
    their letters; confidences may be missing.
    """
    if "language" not in words.columns:
        words = words.withColumn("language", tx.word_language(F.col("word")))
    if "confidence" not in words.columns:
        words = words.withColumn("confidence", F.lit(None).cast("double"))
    out = words.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "word", "confidence", "language"))).alias("w"), *([] if "speaker" in keys else [F.min_by("speaker", F.struct("start_ms", "end_ms", "word")).alias("speaker")]), F.avg("confidence").alias("mean"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("overlapping_speakers")))).alias("o"), F.max(F.col("precision") == "segment").alias("seg"),
    )
    out = out.withColumn("heard", F.transform(F.filter("w", lambda x: x["language"].isNotNull()), lambda x: F.substring_index(x["language"], "-", 1))).withColumn("distinct", F.array_distinct("heard"))
    ranked = F.transform("distinct", lambda x, i: F.struct((-F.size(F.filter("heard", lambda y: y == x))).alias("n"), i.alias("i"), x.alias("language")))
    start, end = F.col("w")[0]["start_ms"], F.array_max(F.transform("w", lambda x: x["end_ms"]))
    others = F.array_remove("o", F.col("speaker"))
    return out.select(
        *keys, *([] if "speaker" in keys else ["speaker"]), start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms"), F.size("w").cast("long").alias("n_words"), tx.join_words(F.transform("w", lambda x: x["word"])).alias("text"),
        F.array_min(ranked)["language"].alias("primary_language"), F.array_sort("distinct").alias("languages_present"), (F.size("distinct") > 1).alias("is_code_mixed"), F.round("mean", 4).alias("avg_confidence"),
        (F.size(others) > 0).alias("has_overlap"), others.alias("overlapping_speakers"), F.when(F.col("seg"), "segment").otherwise("word").alias("alignment_precision"),
        F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["confidence"].alias("confidence"), x["language"].alias("language"))).alias("words"),
    )


def build_utterances(words: DataFrame, max_ms: int = 30_000, min_words: int = 2, gap_ms: int = 1_000) -> DataFrame:
    """Utterances (see ``to_utterance``) in order of time, numbered in each meeting, from words of ``align_words``."""
    cut = split_long(merge_fragments(group_by_speaker(words), min_words, gap_ms), max_ms)
    rest = [c for c in cut.columns if c not in {"meeting_id", "speaker", "group", "part"}]
    parts = cut.groupBy("meeting_id", "speaker", "group", "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.collect_list(F.struct(*rest)).alias("w"))
    merged = merge_same_speaker_overlaps(parts, ["meeting_id", "speaker"]).select("meeting_id", "speaker", "u", F.inline("w"))
    out = to_utterance(merged, ["meeting_id", "speaker", "u"])
    number = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_ms", "speaker", "u")) - 1
    return out.withColumn("utterance_index", number).drop("u")


def alignment_stats(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Per meeting: words, shares assigned, unknown and given by segment, and diarized speakers without a word."""
    stats = words.groupBy("meeting_id").agg(F.count("*").alias("words"), F.avg((F.col("speaker") != UNKNOWN).cast("double")).alias("assigned"), F.avg((F.col("speaker") == UNKNOWN).cast("double")).alias("unknown"), F.avg((F.col("precision") == "segment").cast("double")).alias("segment_level"))
    silent = turns.select("meeting_id", F.col("speaker_label").alias("speaker")).distinct().join(words.select("meeting_id", "speaker").distinct(), ["meeting_id", "speaker"], "left_anti")
    number = F.coalesce(F.expr("try_cast(regexp_extract(speaker, '([0-9]+)$', 1) as int)"), F.lit(1 << 30))
    named = silent.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "speaker"))).alias("s"))
    return stats.join(named, "meeting_id", "left").withColumn("silent_speakers", F.transform(F.coalesce("s", F.array().cast("array<struct<n:int,speaker:string>>")), lambda x: x["speaker"])).drop("s")
