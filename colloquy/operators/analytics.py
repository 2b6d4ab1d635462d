"""Conversation analytics: who spoke how much, when, over whom, and in which language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import intervals as iv
from . import slices as sl
from .language import language_summary

UNKNOWN = "Unknown"


def speaking_time(turns: DataFrame) -> DataFrame:
    own = iv.speaker_intervals(turns)
    return own.groupBy("meeting_id", "speaker_label").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speaking_ms"), F.min("start_ms").alias("first_spoke_ms"), F.max("end_ms").alias("last_spoke_ms"))


def floor_runs(turns: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Consecutive turns of one speaker as one run that ends with the latest of them."""
    keys, order = ["meeting_id"], ["start_ms", "speaker_label", "end_ms", "turn_id"]
    begins = F.col("_last").isNull() | (F.col("_last") != F.col("speaker_label"))
    if slice_ms is None:
        last = F.lag("speaker_label").over(Window.partitionBy(*keys).orderBy(*order))
        numbered = iv.islands(turns.withColumn("_last", last), keys, order, begins, "run")
    else:
        before = sl.Scan(keys, order).last_before("_last", F.col("speaker_label")).over(sl.cut(turns, keys, "start_ms", slice_ms))
        numbered = sl.Scan(keys, order).sum_upto("run", F.when(begins, 1).otherwise(0)).over(before)
    return numbered.groupBy("meeting_id", "run").agg(F.first("speaker_label").alias("speaker_label"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def interruptions(turns: DataFrame, least_ms: int = 500, width: int = 60_000) -> DataFrame:
    """Turns that begin strictly inside another speaker's and overlap it by more than ``least_ms``: the interrupter and
    the one victim with the largest overlap. Who was already talking does not interrupt."""
    own = Window.partitionBy("meeting_id", "speaker_label")
    earlier = F.max("end_ms").over(own.orderBy("start_ms", "turn_id").rowsBetween(Window.unboundedPreceding, -1))
    twin = F.max("end_ms").over(Window.partitionBy("meeting_id", "speaker_label", "start_ms").orderBy("turn_id").rowsBetween(1, Window.unboundedFollowing))
    fresh = turns.withColumn("_talking", F.greatest(earlier, twin)).filter(F.col("_talking").isNull() | (F.col("_talking") <= F.col("start_ms"))).drop("_talking")
    fresh = fresh.withColumn("_bucket", F.floor(F.col("start_ms") / width))
    other = turns.select("meeting_id", F.col("turn_id").alias("victim_turn"), F.col("speaker_label").alias("victim"), F.col("start_ms").alias("v_start"), F.col("end_ms").alias("v_end"))
    other = other.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("v_start") / width), F.floor(F.greatest(F.col("v_end"), F.col("v_start")) / width))))
    overlap = F.least("end_ms", "v_end") - F.col("start_ms")
    met = fresh.join(other, ["meeting_id", "_bucket"]).filter((F.col("victim") != F.col("speaker_label")) & (F.col("v_start") < F.col("start_ms")) & (F.col("start_ms") < F.col("v_end")) & (overlap > least_ms))
    rank = F.row_number().over(Window.partitionBy("meeting_id", "turn_id").orderBy(overlap.desc(), "victim_turn"))
    return met.withColumn("overlap_ms", overlap).withColumn("_rank", rank).filter("_rank = 1").select("meeting_id", "turn_id", F.col("speaker_label").alias("speaker"), "victim", "overlap_ms")


def language_totals(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """Milliseconds and share by language, longest first."""
    sums = utterances.filter(F.col("primary_language").isNotNull()).groupBy(*keys, F.col("primary_language").alias("language")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    total = F.sum("ms").over(Window.partitionBy(*keys))
    return sums.withColumn("share", F.when(total > 0, F.col("ms") / total).otherwise(0.0)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ms"), "language")))


def _breakdown(utterances: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Languages of each key as an array of language, ms and share, longest first."""
    rows = language_totals(utterances, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "language", "ms", "share"))).alias(name))
    return rows.withColumn(name, shares_only(F.col(name)))


def shares_only(ranked: Column) -> Column:
    return F.transform(ranked, lambda x: F.struct(x["language"].alias("language"), x["ms"].cast("long").alias("ms"), x["share"].cast("double").alias("share")))


_SHARES = "array<struct<language:string,ms:bigint,share:double>>"


def centiseconds(ms: Column) -> Column:
    """Half-even on whole milliseconds, as reported seconds are rounded to two decimals."""
    return F.bround(ms / 10).cast("long")


def speaker_stats(turns: DataFrame, utterances: DataFrame, durations: DataFrame, least_ms: int = 500, languages: DataFrame | None = None) -> DataFrame:
    """A row for every speaker with turns or utterances, except Unknown; ms and unrounded ratios.

    ``durations``: meeting_id, duration_ms; ``languages``: meeting_id, speaker_label and the breakdown that is known from
    language ID, which goes before that of the utterances.
    """
    spoken = speaking_time(turns)
    over = iv.overlap_by_speaker(turns).select("meeting_id", "speaker_label", "overlap_ms")
    runs = floor_runs(turns).groupBy("meeting_id", "speaker_label").agg(F.count("*").alias("num_turns"))
    cuts = interruptions(turns, least_ms)
    made = cuts.groupBy("meeting_id", F.col("speaker").alias("speaker_label")).agg(F.count("*").alias("interruptions_made"))
    received = cuts.groupBy("meeting_id", F.col("victim").alias("speaker_label")).agg(F.count("*").alias("interruptions_received"))
    known = utterances.filter(F.col("speaker") != UNKNOWN).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    said = known.groupBy("meeting_id", F.col("speaker").alias("speaker_label")).agg(
        F.count("*").alias("num_segments"),
        F.avg("d").alias("avg_utterance_ms"),
        F.median("d").alias("median_utterance_ms"),
        F.max(F.struct("d", (-F.col("start_ms")).alias("s"), F.col("end_ms").alias("e"))).alias("longest"),
        F.sum("n_words").alias("word_count"),
        F.count(F.when(tx.is_question(F.col("text")), 1)).alias("questions_asked"),
    )
    key = ["meeting_id", "speaker_label"]
    out = spoken.join(said, key, "full").join(over, key, "left").join(runs, key, "left").join(made, key, "left").join(received, key, "left").join(durations, "meeting_id", "left")
    speech = iv.total_length(iv.merge_intervals(turns, ["meeting_id"]), ["meeting_id"], name="speech_ms")
    out = out.join(speech, "meeting_id", "left").join(_breakdown(known.withColumn("speaker_label", F.col("speaker")), key, "own_languages"), key, "left")
    if languages is not None:
        out = out.join(languages.select(*key, F.col("language_breakdown").alias("lid_languages")), key, "left").withColumn("own_languages", F.coalesce(F.when(F.size("lid_languages") > 0, F.col("lid_languages")), F.col("own_languages")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    all_segments = F.sum(zero("num_segments")).over(Window.partitionBy("meeting_id"))
    return out.select(
        *key,
        zero("speaking_ms").alias("speaking_ms"),
        ratio(zero("speaking_ms"), zero("speech_ms")).alias("share_of_speech"),
        ratio(zero("speaking_ms"), zero("duration_ms")).alias("share_of_meeting"),
        zero("num_segments").alias("num_segments"),
        ratio(zero("num_segments"), all_segments).alias("segment_share"),
        zero("num_turns").alias("num_turns"),
        F.coalesce("avg_utterance_ms", F.lit(0.0)).alias("avg_utterance_ms"),
        F.coalesce("median_utterance_ms", F.lit(0.0)).alias("median_utterance_ms"),
        (-F.col("longest.s")).alias("longest_start_ms"),
        F.col("longest.e").alias("longest_end_ms"),
        F.col("longest.d").alias("longest_ms"),
        zero("word_count").alias("word_count"),
        ratio(zero("word_count") * 60000, zero("speaking_ms")).alias("words_per_minute"),
        "first_spoke_ms",
        "last_spoke_ms",
        zero("interruptions_made").alias("interruptions_made"),
        zero("interruptions_received").alias("interruptions_received"),
        zero("overlap_ms").alias("overlap_ms"),
        zero("questions_asked").alias("questions_asked"),
        F.coalesce("own_languages", F.array().cast(_SHARES)).alias("language_breakdown"),
    )


def gini(stats: DataFrame, value: str = "speaking_ms") -> DataFrame:
    """Gini coefficient of each meeting, from values rounded to centiseconds; exact whole numbers until the division."""
    x = stats.withColumn("x", centiseconds(F.col(value)))
    i = F.row_number().over(Window.partitionBy("meeting_id").orderBy("x", "speaker_label"))
    n = F.count("*").over(Window.partitionBy("meeting_id"))
    sums = x.withColumn("w", (2 * i - n - 1) * F.col("x")).groupBy("meeting_id").agg(F.sum("w").alias("w"), F.sum("x").alias("x"), F.count("*").alias("num_speakers"))
    return sums.select("meeting_id", "num_speakers", F.when(F.col("x") > 0, F.col("w") / (F.col("num_speakers") * F.col("x"))).otherwise(0.0).alias("gini"))


def participation_balance(g: Column, speakers: Column, balanced: float = 0.2, dominated: float = 0.4) -> Column:
    return F.when(speakers < 2, "not applicable").when(g <= balanced, "balanced").when(g >= dominated, "dominated").otherwise("moderately dominated")


def timeline(turns: DataFrame, durations: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Speaking time of every turn-speaker in every bucket, zeros included; the last bucket may be shorter."""
    own = iv.speaker_intervals(turns)
    speakers = own.select("meeting_id", "speaker_label").distinct()
    grid = durations.filter("duration_ms > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration_ms") / bucket_ms).cast("long") - 1)))
    cells = grid.join(speakers, "meeting_id")
    parts = own.join(durations, "meeting_id").withColumn("end_ms", F.least("end_ms", "duration_ms")).filter("end_ms > start_ms")
    parts = parts.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))))
    inside = F.least(F.col("end_ms"), (F.col("bucket") + 1) * bucket_ms) - F.greatest(F.col("start_ms"), F.col("bucket") * bucket_ms)
    sums = parts.groupBy("meeting_id", "speaker_label", "bucket").agg(F.sum(inside).alias("speaking_ms"))
    out = cells.join(sums, ["meeting_id", "speaker_label", "bucket"], "left")
    return out.select("meeting_id", "speaker_label", (F.col("bucket") * bucket_ms).alias("start_ms"), F.least((F.col("bucket") + 1) * bucket_ms, F.col("duration_ms")).alias("end_ms"), F.coalesce("speaking_ms", F.lit(0)).alias("speaking_ms"))


def utterance_language_switches(utterances: DataFrame) -> DataFrame:
    last = F.lag("primary_language").over(Window.partitionBy("meeting_id").orderBy("start_ms", "utterance_index"))
    return utterances.filter(F.col("primary_language").isNotNull()).withColumn("_last", last).groupBy("meeting_id").agg(F.count(F.when(F.col("_last") != F.col("primary_language"), 1)).alias("switches"))


def meeting_stats(turns: DataFrame, utterances: DataFrame, durations: DataFrame, least_ms: int = 500, stats: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """A row per meeting of ``durations``. ``languages``: meeting_id, language_distribution and language_switches that are
    known from language ID, which go before those of the utterances."""
    stats = speaker_stats(turns, utterances, durations, least_ms) if stats is None else stats
    key = "meeting_id"
    swept = iv.sweep(iv.speaker_intervals(turns)).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    speech = swept.groupBy(key).agg(F.sum("d").alias("speech_ms"), F.sum(F.when(F.col("active") > 1, F.col("d")).otherwise(0)).alias("overlap_ms"), F.sum(F.col("d") * F.col("active")).alias("summed_ms"))
    runs = floor_runs(turns)
    mono = runs.groupBy(key).agg((F.count("*") - 1).alias("turn_switches"), F.max(F.struct((F.col("end_ms") - F.col("start_ms")).alias("d"), (-F.col("start_ms")).alias("s"), "speaker_label")).alias("mono"))
    known = utterances.filter(F.col("speaker") != UNKNOWN)
    said = known.groupBy(key).agg(F.count("*").alias("total_utterances"), F.sum("n_words").alias("total_words"))
    ordered = stats.groupBy(key).agg(
        F.min(F.struct((-centiseconds(F.col("speaking_ms"))).alias("c"), "speaker_label")).alias("first"),
        F.max(F.struct((-centiseconds(F.col("speaking_ms"))).alias("c"), "speaker_label")).alias("last"),
    )
    out = durations
    for part in (speech, mono, said, ordered, gini(stats), utterance_language_switches(known), _breakdown(known, [key], "own_languages")):
        out = out.join(part, key, "left")
    if languages is not None:
        lid = languages.select(key, F.col("language_distribution").alias("lid_languages"), F.col("language_switches").alias("lid_switches"))
        out = out.join(lid, key, "left").withColumn("own_languages", F.coalesce("lid_languages", "own_languages")).withColumn("switches", F.coalesce("lid_switches", "switches"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    silence = F.greatest(F.col("duration_ms") - zero("speech_ms"), F.lit(0))
    active = F.col("first.c") < 0
    return out.select(
        key,
        "duration_ms",
        zero("speech_ms").alias("speech_ms"),
        silence.alias("silence_ms"),
        F.when(F.col("duration_ms") > 0, silence / F.col("duration_ms")).otherwise(0.0).alias("silence_ratio"),
        zero("num_speakers").alias("num_speakers"),
        zero("total_utterances").alias("total_utterances"),
        zero("total_words").alias("total_words"),
        zero("turn_switches").alias("turn_switches"),
        zero("overlap_ms").alias("overlap_ms"),
        F.when(F.col("speech_ms") > 0, F.col("overlap_ms") / F.col("speech_ms")).otherwise(0.0).alias("overlap_ratio"),
        F.greatest(zero("summed_ms") - zero("speech_ms"), F.lit(0)).alias("double_counted_ms"),
        F.coalesce("gini", F.lit(0.0)).alias("gini"),
        participation_balance(F.coalesce("gini", F.lit(0.0)), zero("num_speakers")).alias("balance"),
        F.when(active, F.col("first.speaker_label")).alias("dominant_speaker"),
        F.when(active, F.col("last.speaker_label")).alias("least_active_speaker"),
        F.coalesce("own_languages", F.array().cast(_SHARES)).alias("language_distribution"),
        zero("switches").alias("language_switches"),
        F.col("mono.speaker_label").alias("monologue_speaker"),
        (-F.col("mono.s")).alias("monologue_start_ms"),
        F.col("mono.d").alias("monologue_ms"),
    )


def meeting_durations(turns: DataFrame, utterances: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """The recording's length, extended to cover all turns and utterances."""
    ends = turns.select("meeting_id", "end_ms").unionByName(utterances.select("meeting_id", "end_ms"))
    if recorded is not None:
        ends = ends.unionByName(recorded.select("meeting_id", F.col("duration_ms").alias("end_ms")))
    return ends.groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms"))


def conversation_analytics(turns: DataFrame, utterances: DataFrame, recorded: DataFrame | None = None, regions: DataFrame | None = None, least_ms: int = 500, bucket_ms: int = 60_000) -> dict[str, DataFrame]:
    """The whole report: ``meetings``, ``speakers`` and ``timeline``.

    ``regions``: smoothed language regions (meeting_id, speaker, language, start_ms, end_ms). Where a meeting has them they
    give its languages and switches, and the languages of each speaker that they name; utterances give them elsewhere.
    """
    durations = meeting_durations(turns, utterances, recorded)
    by_meeting = by_speaker = None
    if regions is not None:
        summary = language_summary(regions)
        by_meeting = summary.select("meeting_id", shares_only(F.col("languages")).alias("language_distribution"), F.col("num_switches").alias("language_switches"))
        by_speaker = summary.select("meeting_id", F.explode("speakers").alias("s")).select("meeting_id", F.col("s.speaker").alias("speaker_label"), shares_only(F.col("s.languages")).alias("language_breakdown"))
    speakers = speaker_stats(turns, utterances, durations, least_ms, by_speaker)
    return {"meetings": meeting_stats(turns, utterances, durations, least_ms, speakers, by_meeting), "speakers": speakers, "timeline": timeline(turns, durations, bucket_ms)}


#: What the reported metrics mean.
METRICS = {
    "speaking_time_seconds": "Length of the union of a speaker's turns, overlapped speech included.",
    "speaking_time_percent_of_speech": "Speaking time over the meeting's speech time; overlaps push the sum above 100.",
    "speaking_time_percent_of_meeting": "Speaking time over the meeting's length.",
    "num_segments": "Utterances that the speaker was given.",
    "segment_share_percent": "The speaker's part of all utterances with a known speaker.",
    "num_turns": "How often the floor came to the speaker.",
    "avg_utterance_seconds": "Average length of the speaker's utterances.",
    "median_utterance_seconds": "Median length of the speaker's utterances.",
    "longest_utterance": "The speaker's longest utterance and when it was said.",
    "word_count": "Words that the speaker was given.",
    "words_per_minute": "Words over speaking minutes.",
    "first_spoke_at": "When the speaker's first turn begins.",
    "last_spoke_at": "When the speaker's last turn ends.",
    "interruptions_made": "Turns begun inside somebody else's that overlap it for long enough.",
    "interruptions_received": "Turns of others begun inside this speaker's in that way.",
    "overlap_seconds": "Time in which the speaker and somebody else talk.",
    "language_breakdown": "Time and share of each language that the speaker uses.",
    "questions_asked": "Utterances with a question mark at the end or a Hindi or Odia question word.",
    "meeting_duration_seconds": "Length of the recording, extended to the last speech.",
    "total_speech_seconds": "Time with at least one speaker.",
    "total_silence_seconds": "The rest of the meeting.",
    "total_turn_switches": "Passes of the floor to another speaker.",
    "overlap_seconds_meeting": "Time with two speakers or more.",
    "overlap_percent": "Overlap over speech time.",
    "overlap_double_counted_seconds": "Speaking times added up, less the speech time.",
    "gini_coefficient": "Inequality of speaking times, from 0 (equal) towards 1.",
    "participation_balance": "The Gini coefficient in words.",
    "dominant_speaker": "Who speaks most.",
    "least_active_speaker": "Who speaks least.",
    "num_language_switches": "Changes of language from one region to the next.",
    "longest_monologue": "Longest time that one speaker holds the floor.",
    "timeline": "Speaking time of each speaker in windows of equal length.",
}


def metric_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS.items()), "metric string, definition string")


def analytics_context(meetings: DataFrame, stats: DataFrame) -> DataFrame:
    """A compact text per meeting; seconds and percentages are rounded half to even."""
    line = F.format_string("%s: %.0fs (%.0f%% of speech), %d words, %d questions", F.col("speaker_label"), F.bround(F.col("speaking_ms") / 1000), F.bround(100 * F.col("share_of_speech")), F.col("word_count"), F.col("questions_asked"))
    lines = stats.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct((-centiseconds(F.col("speaking_ms"))).alias("c"), "speaker_label", line.alias("line")))).alias("lines"))
    head = F.format_string("duration %.0fs, %d speakers, balance: %s, dominant speaker: %s", F.bround(F.col("duration_ms") / 1000), F.col("num_speakers"), F.col("balance"), F.coalesce("dominant_speaker", F.lit("-")))
    joined = meetings.join(lines, "meeting_id", "left")
    return joined.select("meeting_id", F.concat_ws("\n", head, F.transform(F.coalesce("lines", F.array()), lambda x: x["line"])).alias("context"))
