"""Renderings of results as text, a value per meeting, and tables written per meeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.analytics import centiseconds, language_totals


def _joined(df: DataFrame, order: list[str], line: Column, name: str, separator: str, head: str = "") -> DataFrame:
    """Lines of each meeting in order as one text; each is written before rows are gathered."""
    rows = df.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_rows"))
    return rows.select("meeting_id", F.concat(F.lit(head), F.array_join(F.transform("_rows", lambda r: r["_line"]), separator)).alias(name))


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("meeting_id").orderBy(*order)))


def _cue(body: Column, marker: str = ",") -> Column:
    end = F.greatest(F.col("end_ms"), F.col("start_ms") + 1)
    return F.concat(tx.timestamp(F.col("start_ms"), marker), F.lit(" --> "), tx.timestamp(end, marker), F.lit("\n"), body, F.lit("\n"))


def segments_srt(segments: DataFrame) -> DataFrame:
    n = _numbered(segments, ["start_ms", "id"])
    return _joined(n, ["_n"], F.concat(F.col("_n").cast("string"), F.lit("\n"), _cue(F.col("text"))), "srt", "\n")


def segments_text(segments: DataFrame) -> DataFrame:
    lang = F.coalesce(F.concat(F.lit(" ("), F.col("language"), F.lit(")")), F.lit(""))
    return _joined(segments, ["start_ms", "id"], F.concat(F.lit("["), tx.timestamp(F.col("start_ms"), "."), F.lit("]"), lang, F.lit(" "), F.col("text"), F.lit("\n")), "text", "")


def _name(df: DataFrame) -> Column:
    return F.coalesce("speaker_name", "speaker") if "speaker_name" in df.columns else F.col("speaker")


_ORDER = ["start_ms", "utterance_index"]


def utterances_text(u: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), tx.hms(F.col("start_ms")), F.lit(" - "), tx.hms(F.col("end_ms")), F.lit("] "), _name(u), F.lit(": "), F.col("text"), F.lit("\n"))
    return _joined(u, _ORDER, line, "text", "")


def utterances_srt(u: DataFrame) -> DataFrame:
    n = _numbered(u, _ORDER)
    return _joined(n, ["_n"], F.concat(F.col("_n").cast("string"), F.lit("\n"), _cue(F.concat(_name(u), F.lit(": "), F.col("text")))), "srt", "\n")


def utterances_vtt(u: DataFrame) -> DataFrame:
    return _joined(u, _ORDER, _cue(F.concat(F.lit("<v "), _name(u), F.lit(">"), F.col("text")), "."), "vtt", "\n", "WEBVTT\n\n")


def utterances_markdown(u: DataFrame, title: str = "Transcript") -> DataFrame:
    """A heading only where the displayed name changes."""
    named = u.withColumn("_name", _name(u))
    last = F.lag("_name").over(Window.partitionBy("meeting_id").orderBy(*_ORDER))
    head = F.when(F.col("_last").isNull() | (F.col("_last") != F.col("_name")), F.concat(F.lit("**"), F.col("_name"), F.lit("** · "), tx.hms(F.col("start_ms")), F.lit("\n\n"))).otherwise("")
    return _joined(named.withColumn("_last", last), _ORDER, F.concat(head, F.col("text"), F.lit("\n")), "markdown", "\n", f"# {title}\n\n")


def _seconds(ms: Column) -> Column:
    return centiseconds(ms) / 100


def _percent(share: Column) -> Column:
    """Two decimals, half-even on the share's own digits: a hundred times the share may lie beside the half that it is."""
    return F.bround(F.bround(share, 4) * 100, 2)


def speakers_table(stats: DataFrame, utterances: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The export of speaker statistics: seconds and percentages with two decimals, languages as ``lang:pct;…``."""
    shares = language_totals(utterances, ["meeting_id", "speaker"]).groupBy("meeting_id", F.col("speaker").alias("speaker_label"))
    entry = F.struct("rank", F.concat("language", F.lit(":"), _percent(F.col("share")).cast("string")).alias("e"))
    langs = shares.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ";").alias("languages"))
    out = stats.join(langs, ["meeting_id", "speaker_label"], "left")
    if names is not None:
        out = out.join(names.select("meeting_id", "speaker_label", "display_name"), ["meeting_id", "speaker_label"], "left")
    else:
        out = out.withColumn("display_name", F.lit(None).cast("string"))
    pct = lambda c: _percent(F.col(c))
    return out.select(
        "meeting_id",
        F.col("speaker_label").alias("speaker"),
        F.coalesce("display_name", "speaker_label").alias("display_name"),
        _seconds(F.col("speaking_ms")).alias("speaking_time_seconds"),
        pct("share_of_speech").alias("speaking_time_percent_of_speech"),
        pct("share_of_meeting").alias("speaking_time_percent_of_meeting"),
        "num_segments",
        pct("segment_share").alias("segment_share_percent"),
        "num_turns",
        _seconds(F.col("avg_utterance_ms")).alias("avg_utterance_seconds"),
        _seconds(F.col("median_utterance_ms")).alias("median_utterance_seconds"),
        _seconds(F.col("longest_ms")).alias("longest_utterance_seconds"),
        _seconds(F.col("longest_start_ms")).alias("longest_utterance_start"),
        _seconds(F.col("longest_end_ms")).alias("longest_utterance_end"),
        "word_count",
        F.bround("words_per_minute", 2).alias("words_per_minute"),
        _seconds(F.col("first_spoke_ms")).alias("first_spoke_at"),
        _seconds(F.col("last_spoke_ms")).alias("last_spoke_at"),
        "interruptions_made",
        "interruptions_received",
        _seconds(F.col("overlap_ms")).alias("overlap_seconds"),
        "questions_asked",
        F.coalesce("languages", F.lit("")).alias("languages"),
    )


def write_speakers_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).csv(path)


def summary_rows(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """The search rows of summaries: one text for each of ``meetings`` (meeting_id, title, executive_summary), of its title, its
    summary, and of ``items`` (meeting_id, kind, idx, topic, text) the key points with their topic, decisions and actions;
    a line each, in order. Kinds and columns are those of the index: kind, meeting_id, ref, start_ms, speaker, text."""
    place = F.element_at(F.create_map(F.lit("key_point"), F.lit(1), F.lit("decision"), F.lit(2), F.lit("action_item"), F.lit(3)), F.col("kind"))
    line = F.when(F.col("kind") == "key_point", F.concat(F.coalesce("topic", F.lit("")), F.lit(". "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    told = items.withColumn("_place", place).filter(F.col("_place").isNotNull()).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("_place", "idx", line.alias("line")))).alias("_lines"))
    head = F.array(F.coalesce("title", F.lit("")), F.coalesce("executive_summary", F.lit("")))
    lines = F.coalesce(F.transform("_lines", lambda x: x["line"]), F.array().cast("array<string>"))
    out = meetings.join(told, "meeting_id", "left")
    return out.select(
        F.lit("summary").alias("kind"), "meeting_id", F.lit("summary").alias("ref"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("string").alias("speaker"), F.array_join(F.concat(head, lines), "\n").alias("text")
    )


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes ``df`` so that the partitions it holds replace those of the same keys, and others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
