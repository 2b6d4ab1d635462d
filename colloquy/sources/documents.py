"""Minutes and consolidated results as documents: nested structs, Markdown and JSON, a value per meeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import UNKNOWN, centiseconds

SCHEMA_VERSION = "1.0.0"


def minutes_document(meetings: DataFrame, stats: DataFrame, items: DataFrame, languages: DataFrame) -> DataFrame:
    """Per meeting (meeting_id, title): participants by talk time without Unknown, languages, and items by kind in order."""
    people = stats.filter(F.col("speaker_label") != UNKNOWN).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct((-centiseconds(F.col("speaking_ms"))).alias("c"), "speaker_label"))).alias("p"))
    entry = F.struct("idx", "kind", "text", "owner", "due", "quote")
    listed = items.groupBy("meeting_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    langs = languages.groupBy("meeting_id").agg(F.array_sort(F.array_compact(F.collect_set("language"))).alias("languages"))
    out = meetings.select("meeting_id", "title").join(people, "meeting_id", "left").join(listed, "meeting_id", "left").join(langs, "meeting_id", "left")
    own = lambda k: F.filter(F.coalesce("items", F.array()), lambda x: x["kind"] == k)
    return out.select(
        "meeting_id", "title", F.transform(F.coalesce("p", F.array()), lambda x: x["speaker_label"]).alias("participants"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
        own("key_point").alias("key_points"), own("decision").alias("decisions"), own("action_item").alias("action_items"), own("open_question").alias("open_questions"),
    )


def cell(text: Column) -> Column:
    """A table cell: pipes escaped, line ends as breaks."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("-")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def minutes_markdown(documents: DataFrame) -> DataFrame:
    table = lambda c: F.transform(c, lambda x: F.concat(F.lit("| "), cell(x["text"]), F.lit(" | "), cell(x["owner"]), F.lit(" | "), cell(x["due"]), F.lit(" |")))
    head = lambda a, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(a), F.lit("| --- | --- | --- |")), table(c))).otherwise(F.array().cast("array<string>"))
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), cell(x["text"])))
    return documents.select(
        "meeting_id",
        F.concat(
            F.lit("# "), "title", F.lit("\n\nParticipants: "), F.array_join("participants", ", "), F.lit("\nLanguages: "), F.array_join("languages", ", "), F.lit("\n"),
            _section("Key points", bullets(F.col("key_points"))), _section("Decisions", head("| Decision | By | Due |", F.col("decisions"))),
            _section("Action items", head("| Task | Owner | Due |", F.col("action_items"))), _section("Open questions", bullets(F.col("open_questions"))),
        ).alias("markdown"),
    )


def summary_markdown(documents: DataFrame, report: DataFrame) -> DataFrame:
    """With the quote behind each item, and how many citations were verified."""
    cited = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), cell(x["text"]), F.coalesce(F.concat(F.lit('\n  > "'), x["quote"], F.lit('"')), F.lit(""))))
    joined = documents.join(report.select("meeting_id", "checked", "passed"), "meeting_id", "left")
    foot = F.format_string("\n_%d of %d citations verified._\n", F.coalesce("passed", F.lit(0)), F.coalesce("checked", F.lit(0)))
    parts = [_section(t, cited(F.col(c))) for t, c in (("Key points", "key_points"), ("Decisions", "decisions"), ("Action items", "action_items"), ("Open questions", "open_questions"))]
    return joined.select("meeting_id", F.concat(F.lit("# "), "title", F.lit("\n"), *parts, foot).alias("markdown"))


def meeting_result(meetings: DataFrame, sections: dict[str, DataFrame], warnings: list[DataFrame]) -> DataFrame:
    """The consolidated document as JSON: one value per meeting and section (meeting_id, value), and warnings
    (meeting_id, warnings) in the order given."""
    out = meetings
    for name, df in sections.items():
        out = out.join(df.select("meeting_id", F.col("value").alias(name)), "meeting_id", "left")
    none = F.array().cast("array<string>")
    for i, df in enumerate(warnings):
        out = out.join(df.select("meeting_id", F.col("warnings").alias(f"_w{i}")), "meeting_id", "left")
    told = F.concat(*[F.coalesce(f"_w{i}", none) for i in range(len(warnings))]) if warnings else none
    return out.select("meeting_id", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *meetings.columns, *sections, told.alias("warnings"))).alias("result"))


#: Sections that can be left out, in their order.
SECTIONS = ("transcript", "analytics", "summary")


def whole_result(meetings: DataFrame, parts: dict[str, DataFrame], include: tuple[str, ...] = SECTIONS) -> DataFrame:
    """The consolidated document of each of ``meetings``, from what is known of them; all parts may be missing, and are then null.

    ``parts``: ``run`` (meeting_id, run_id, status, started_ms), one for each meeting; ``stages`` (run_id, stage_no, name, status,
    duration_ms, error); ``quality`` (meeting_id, value, warnings); ``languages`` (meeting_id, value); ``speakers``
    (meeting_id, label, display_name, stats); ``utterances`` (meeting_id, utterance_index, speaker, start_ms, end_ms, text);
    ``transcript`` (meeting_id, warnings); ``analytics`` and ``summary`` (meeting_id, value; the latter with report).

    Only a meeting with a run has stages, quality, languages and the sections of ``include``. Warnings come in order: failed
    stages, the audio's, the transcript's. Speakers' display names are put to utterances.
    """
    none, key = F.array().cast("array<string>"), "meeting_id"
    out = meetings
    have = {n: df for n, df in parts.items() if df is not None}
    told: list[Column] = []

    def add(df: DataFrame) -> None:
        nonlocal out
        out = out.join(df, key, "left")

    ran = have["run"]
    info = F.struct("run_id", "status", "started_ms", "stages").alias("processing")
    stages = have["stages"].groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stage_no", "name", "status", "duration_ms", "error"))).alias("stages"))
    failed = F.transform(F.filter(F.coalesce("stages", F.array()), lambda x: x["status"] == "failed"), lambda x: F.concat(x["name"], F.lit(" failed: "), F.coalesce(x["error"], F.lit("None"))))
    add(ran.join(stages, "run_id", "left").select(key, info, failed.alias("_failed")))
    told.append(F.coalesce("_failed", none))
    names = have["speakers"].filter("display_name <> ''").select(key, F.col("label").alias("speaker"), F.col("display_name").alias("speaker_name"))
    known = {"processing": "processing"}
    if "quality" in have:
        add(have["quality"].select(key, F.col("value").alias("audio_quality"), F.col("warnings").alias("_heard")))
        told.append(F.coalesce("_heard", none))
        known["audio_quality"] = "audio_quality"
    if "languages" in have:
        add(have["languages"].select(key, F.col("value").alias("languages")))
        known["languages"] = "languages"
    listed = have["speakers"].groupBy(key).agg(F.array_sort(F.collect_list(F.struct("label", "display_name", "stats"))).alias("speakers"))
    add(listed)
    if "transcript" in include and "utterances" in have:
        rows = have["utterances"].join(names, [key, "speaker"], "left")
        row = F.struct("utterance_index", "speaker", "speaker_name", "start_ms", "end_ms", "text")
        add(rows.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("transcript")))
        known["transcript"] = "transcript"
        if "transcript" in have:
            add(have["transcript"].select(key, F.col("warnings").alias("_written")))
            told.append(F.coalesce("_written", none))
    if "analytics" in include and "analytics" in have:
        add(have["analytics"].select(key, F.col("value").alias("analytics")))
        known["analytics"] = "analytics"
    if "summary" in include and "summary" in have:
        add(have["summary"].select(key, F.col("value").alias("summary"), F.col("report").alias("verification_report")))
        known |= {"summary": "summary", "verification_report": "verification_report"}
    has_run = F.col("processing").isNotNull()
    fields = [F.when(has_run, F.col(c)).alias(n) for n, c in known.items()]
    warnings = F.when(has_run, F.concat(*told)).otherwise(none).alias("warnings")
    included = F.array(*[F.lit(x) for x in SECTIONS if x in include]).alias("included")
    return out.select(
        key, F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*meetings.columns).alias("meeting"), *fields, F.coalesce("speakers", F.array()).alias("speakers"), warnings, included)).alias("result")
    )
