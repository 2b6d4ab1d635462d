"""Recognised text cleaned and tagged: hallucinations, confidence, chunk joins, scripts and code-mixing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

MIN_CHARS_FOR_COMPRESSION = 20


def filter_hallucinations(segments: DataFrame, most_compression: float = 2.4, most_no_speech: float = 0.6) -> DataFrame:
    """Adds ``dropped``: the first of empty, filler_in_silence, compression_ratio, repeated that holds; null if kept.

    A segment dropped as repeated has the text of the last kept one, so comparing with the one before, among those
    that no other reason drops, is the same as comparing with the last kept."""
    s = segments.withColumn("_c", tx.comparable(F.col("text")))
    first = (
        F.when(F.col("_c") == "", "empty")
        .when((F.col("no_speech_prob") >= most_no_speech) & tx.is_filler_only(F.col("_c")), "filler_in_silence")
        .when((F.col("compression_ratio") > most_compression) & (F.length("text") >= MIN_CHARS_FOR_COMPRESSION), "compression_ratio")
    )
    marked = s.withColumn("_r", first)
    w = Window.partitionBy("meeting_id", F.col("_r").isNull()).orderBy("start_ms", "end_ms", "id")
    again = F.col("_r").isNull() & (F.lag("_c").over(w) == F.col("_c"))
    return marked.withColumn("dropped", F.coalesce("_r", F.when(again, "repeated"))).drop("_c", "_r")


def flag_low_confidence(segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    return segments.withColumn("low_confidence", F.coalesce(F.col("avg_confidence") < threshold, F.lit(False)))


def shift(segments: DataFrame, offset_ms: Column) -> DataFrame:
    out = segments.withColumn("start_ms", F.col("start_ms") + offset_ms).withColumn("end_ms", F.col("end_ms") + offset_ms)
    if "words" in segments.columns:
        moved = lambda x: x.withField("start_ms", x["start_ms"] + offset_ms).withField("end_ms", x["end_ms"] + offset_ms)
        out = out.withColumn("words", F.transform("words", moved))
    return out


def renumber(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("meeting_id").orderBy("start_ms", "end_ms", "id")
    return segments.withColumn("new_id", F.row_number().over(w) - 1)


def language_durations(segments: DataFrame) -> DataFrame:
    lang = F.coalesce("language", F.lit("unknown"))
    sums = segments.groupBy("meeting_id", lang.alias("language")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.desc("ms"), "language")))


def approximate_words(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Words of ``text`` with times in proportion to their length plus one; none for spans without length."""
    # The sums are over a segment's own array: a window would sort all words of a task.
    spans = segments.filter("end_ms > start_ms").select(*keys, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), tx.tokens(F.col("text")).alias("w"))
    spans = spans.withColumn("upto", tx.running_sums(F.transform("w", lambda x: (F.length(x) + 1).cast("long"))))
    words = spans.select(*keys, "s", "e", F.try_element_at("upto", F.lit(-1)).alias("total"), F.posexplode(F.arrays_zip("w", "upto")).alias("pos", "x"))
    at = lambda n: F.col("s") + F.floor((F.col("e") - F.col("s")) * n / F.col("total") + 0.5).cast("long")
    return words.select(*keys, "pos", F.col("x.w").alias("word"), at(F.col("x.upto") - F.length("x.w") - 1).alias("start_ms"), at(F.col("x.upto")).alias("end_ms"))


def merge_chunk_transcripts(segments: DataFrame, owned: DataFrame, similar: float = 0.8) -> DataFrame:
    """Segments of overlapping chunks: each chunk keeps those whose middle it owns; of neighbours that overlap in time
    with nearly the same text (one holds the other, or matching blocks of at least ``similar``) the longer stays.

    A segment is compared with the last one kept, which may have been replaced, so a meeting's segments are folded
    in order; meetings run in parallel."""
    middle = (F.col("start_ms") + F.col("end_ms")) / 2
    mine = segments.join(owned.select("meeting_id", "chunk", "own_start_ms", "own_end_ms"), ["meeting_id", "chunk"]).filter((middle >= F.col("own_start_ms")) & (middle < F.col("own_end_ms")))
    rows = mine.select("meeting_id", F.col("id").cast("long").alias("id"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text", tx.comparable(F.col("text")).alias("c"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        kept: list = []
        for r in group.sort_values(["start_ms", "end_ms", "id"]).itertuples(index=False):
            last = kept[-1] if kept else None
            alike = last is not None and r.start_ms < last.end_ms and bool(r.c) and bool(last.c)
            if alike and (r.c in last.c or last.c in r.c or SequenceMatcher(None, last.c, r.c).ratio() >= similar):
                if len(r.c) > len(last.c):
                    kept[-1] = r
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=group.columns).drop(columns="c")

    kind = rows.schema["meeting_id"].dataType.simpleString()
    return rows.groupBy("meeting_id").applyInPandas(fold, f"meeting_id {kind}, id long, start_ms long, end_ms long, text string")


def tagged_words(segments: DataFrame, keys: list[str]) -> DataFrame:
    """A row per word: pos, word, script, language."""
    words = segments.select(*keys, F.posexplode(tx.tokens(F.col("text"))).alias("pos", "word"))
    return words.withColumn("script", tx.script_of(F.col("word"))).withColumn("word_language", tx.word_language(F.col("word")))


def tagged_counts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers (n) of a text's words by word_language: ``tagged_words`` counted where the text is, without a row for each word."""
    return segments.select(*keys, F.inline(tx.language_counts(F.col("text"))))


def code_mix(words: DataFrame, fallbacks: DataFrame, keys: list[str]) -> DataFrame:
    """From ``tagged_words`` or ``tagged_counts``, per segment of ``fallbacks`` (keys, language): primary language (ties to the fallback if among the leaders, else
    the first by name), languages, whether mixed, and the ratio of words outside the primary one."""
    base = F.substring_index("word_language", "-", 1)
    counts = words.filter(F.col("word_language").isNotNull()).groupBy(*keys, base.alias("lang")).agg((F.sum("n") if "n" in words.columns else F.count("*")).alias("n"))
    ranked = fallbacks.select(*keys, F.col("language").alias("fallback")).join(counts, keys, "left")
    best = F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("n")).alias("n"), (~F.coalesce(F.col("lang") == F.col("fallback"), F.lit(False))).alias("f"), "lang")))
    out = ranked.groupBy(*keys).agg(F.first("fallback").alias("fallback"), best.alias("best"), F.array_sort(F.collect_set("lang")).alias("langs"), F.sum("n").alias("total"))
    single = F.filter(F.array("fallback"), lambda x: x.isNotNull())
    return out.select(
        *keys,
        F.coalesce("best.lang", "fallback").alias("primary_language"),
        F.when(F.size("langs") > 0, F.col("langs")).otherwise(single).alias("languages_present"),
        (F.size("langs") > 1).alias("is_code_mixed"),
        F.when(F.col("total") > 0, 1 + F.col("best.n") / F.col("total")).otherwise(0.0).alias("code_mix_ratio"),
    )


def tag_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with the columns of ``code_mix``. Words are counted where the text is, and segments of equal keys are tagged
    together in a window, so that nothing is worked out twice and no text is joined."""
    own, base = Window.partitionBy(*keys), lambda x: F.substring_index(x["word_language"], "-", 1)
    out = segments.withColumn("_own", tx.language_counts(F.col("text"))).withColumn("_all", F.flatten(F.collect_list("_own").over(own)))
    out = out.withColumn("_fallback", F.first("language").over(own)).withColumn("_fallbacks", F.collect_set("language").over(own)).withColumn("_rows", F.count("*").over(own))
    out = out.withColumn("_langs", F.array_sort(F.array_distinct(F.transform("_all", base))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    ranked = F.transform("_langs", lambda y: F.struct((-total(F.filter("_all", lambda x: base(x) == y))).alias("n"), (~F.array_contains("_fallbacks", y)).alias("f"), y.alias("lang")))
    out = out.withColumn("_best", F.array_min(ranked)).withColumn("_total", total(F.col("_all")) * F.col("_rows"))
    return out.select(
        *segments.columns,
        F.coalesce("_best.lang", "_fallback").alias("primary_language"),
        F.when(F.size("_langs") > 0, F.col("_langs")).otherwise(F.array_compact(F.array("_fallback"))).alias("languages_present"),
        (F.size("_langs") > 1).alias("is_code_mixed"),
        F.when(F.col("_total") > 0, 1 + F.col("_best.n") / F.col("_total")).otherwise(0.0).alias("code_mix_ratio"),
    )


def finalize_transcript(segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Normalised, without hallucinations, flagged, tagged and renumbered."""
    clean = segments.withColumn("text", tx.normalize(F.col("text")))
    kept = filter_hallucinations(clean).filter("dropped IS NULL").drop("dropped")
    return renumber(tag_segments(flag_low_confidence(kept, threshold), ["meeting_id", "id"]))


def transcript_report(segments: DataFrame, final: DataFrame) -> DataFrame:
    """Per meeting of ``segments``: what became of them in ``final`` (see ``finalize_transcript``): n_segments, n_dropped,
    n_low_confidence, n_code_mixed, and the time of each language (as recognised, not as tagged), longest first."""
    before = segments.groupBy("meeting_id").agg(F.count("*").alias("n_all"))
    # Everything is counted by language first, so that ``final`` is worked out once.
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    parts = final.groupBy("meeting_id", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"), count("low_confidence"), count("is_code_mixed"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    entry = F.struct(F.col("ms").isNull().alias("none"), (-F.col("ms")).alias("rank"), "language", "ms")
    counts = parts.groupBy("meeting_id").agg(F.sum("n").alias("n"), F.sum("low_confidence").alias("low"), F.sum("is_code_mixed").alias("mixed"), F.array_sort(F.collect_list(entry)).alias("l"))
    out = before.join(counts, "meeting_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.array().cast("array<struct<language:string,ms:bigint>>")
    return out.select(
        "meeting_id",
        zero("n").alias("n_segments"),
        (F.col("n_all") - zero("n")).alias("n_dropped"),
        zero("low").alias("n_low_confidence"),
        zero("mixed").alias("n_code_mixed"),
        F.coalesce(F.transform("l", lambda x: F.struct(x["language"].alias("language"), x["ms"].cast("long").alias("ms"))), none).alias("detected_languages"),
    )
