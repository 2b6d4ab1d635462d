"""Reads over stored results: filters, pages, default runs, search, names, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SUCCESS = ("completed", "completed_with_errors")


def encode_cursor(value: Column, key: Column) -> Column:
    """URL-safe base64 of a JSON object with the sort value and id of the last row."""
    return F.translate(F.base64(F.to_json(F.struct(value.alias("v"), key.alias("id")))), "+/\r\n", "-_")


def decode_cursor(cursor: Column, kind: str = "v double, id long") -> Column:
    return F.from_json(F.unbase64(F.translate(cursor, "-_", "+/")).cast("string"), kind)


def after(value: Column, key: Column, last_value, last_key, descending: bool = True) -> Column:
    """Rows behind the last one seen, ids going with the value's direction."""
    if descending:
        return (value < last_value) | ((value == last_value) & (key < last_key))
    return (value > last_value) | ((value == last_value) & (key > last_key))


def meeting_filter(m: DataFrame, status=None, language=None, created_from=None, created_to=None, min_speakers=None, max_speakers=None, owner=None) -> DataFrame:
    conditions = {
        "status": (status, lambda v: F.col("status") == v),
        "language": (language, lambda v: F.array_contains("detected_languages", v)),
        "from": (created_from, lambda v: F.col("created_ms") >= v),
        "to": (created_to, lambda v: F.col("created_ms") <= v),
        "min": (min_speakers, lambda v: F.col("num_speakers") >= v),
        "max": (max_speakers, lambda v: F.col("num_speakers") <= v),
        "owner": (owner, lambda v: F.col("owner") == v),
    }
    for value, condition in conditions.values():
        if value is not None:
            m = m.filter(condition(value))
    return m


def list_meetings(m: DataFrame, sort: str = "created_ms", descending: bool = True, cursor: tuple | None = None, limit: int = 20, **filters) -> DataFrame:
    """A page of meetings; a null duration sorts as -1. One row more than ``limit`` tells that there are more."""
    value = F.coalesce(F.col(sort), F.lit(-1))
    out = meeting_filter(m, **filters)
    if cursor:
        out = out.filter(after(value, F.col("meeting_id"), *cursor, descending))
    order = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return out.orderBy(order(value), order(F.col("meeting_id"))).limit(limit + 1)


def query_utterances(u: DataFrame, speaker=None, language=None, start_from=None, end_to=None, q=None) -> DataFrame:
    """Utterances that overlap [start_from, end_to], of a speaker, in a language, holding ``q`` in any case."""
    if speaker is not None:
        u = u.filter(F.col("speaker") == speaker)
    if language is not None:
        u = u.filter(F.col("primary_language") == language)
    if start_from is not None:
        u = u.filter(F.col("end_ms") >= start_from)
    if end_to is not None:
        u = u.filter(F.col("start_ms") <= end_to)
    return u.filter(F.lower("text").contains(q.lower())) if q else u


def ranked_runs(runs: DataFrame) -> DataFrame:
    """Adds is_default: the latest successful run of a meeting, else its latest."""
    good = F.col("status").isin(*SUCCESS)
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy(good.desc(), F.desc("started_ms"), "run_id"))
    return runs.withColumn("is_default", rank == 1)


def default_run(runs: DataFrame) -> DataFrame:
    return ranked_runs(runs).filter("is_default").drop("is_default")


def latest_summary(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("created_ms"), F.desc("id")))).filter("_r = 1").drop("_r")


def duplicate_uploads(files: DataFrame) -> DataFrame:
    """For every upload that repeats an owner's file: the oldest with that content."""
    w = Window.partitionBy("owner", "sha256")
    first = F.min(F.struct("created_ms", "meeting_id")).over(w)["meeting_id"]
    return files.withColumn("original_id", first).filter(F.col("original_id") != F.col("meeting_id"))


def retention_candidates(meetings: DataFrame, runs: DataFrame, cutoff_ms: int) -> DataFrame:
    """Keys to delete of recordings made before the cutoff: upload, processed audio, and that of every run."""
    old = meetings.filter((F.col("created_ms") < cutoff_ms) & F.coalesce(~F.col("purged"), F.lit(True)))
    own = old.join(runs.groupBy("meeting_id").agg(F.collect_set("run_id").alias("runs")), "meeting_id", "left")
    one = lambda t: F.concat(F.lit(f"{t}/"), F.col("meeting_id").cast("string"))
    every = F.transform(F.coalesce("runs", F.array().cast("array<bigint>")), lambda r: F.concat(F.lit("runs/"), r.cast("string"), F.lit(".wav")))
    return own.select("meeting_id", F.explode(F.array_distinct(F.concat(F.array(one("uploads"), one("processed")), every))).alias("key"))


def stuck_runs(runs: DataFrame, heartbeats: DataFrame, now_ms: int, limit_ms: int = 600_000) -> DataFrame:
    seen = runs.filter("status = 'processing'").join(heartbeats, "run_id", "left")
    return seen.withColumn("idle_ms", F.lit(now_ms) - F.coalesce("heartbeat_ms", "started_ms")).filter(F.col("idle_ms") > limit_ms)


def search(index: DataFrame, q: str, limit: int = 20, meeting_id=None) -> DataFrame:
    """Rows that hold ``q`` in any case, or one of its words; best first, then by start, rows without one first."""
    low, words = F.lower("text"), q.lower().split()
    score = F.size(F.filter(tx.tokens(low), lambda t: t.isin(*words)))
    hit = low.contains(q.lower())
    if len(q) >= 3:
        hit = hit | (score > 0)
    rows = index.filter(F.col("meeting_id") == meeting_id) if meeting_id is not None else index
    found = rows.withColumn("score", score).filter(hit)
    return found.orderBy(F.desc("score"), F.asc_nulls_first("start_ms"), "meeting_id", "ref").limit(limit)


def clean_name(name: Column) -> Column:
    kept = F.substring(tx.strip(name), 1, 100)
    return F.when(kept != "", kept)


def apply_display_names(rows: DataFrame, names: DataFrame, column: str = "speaker") -> DataFrame:
    """Adds speaker_name: the display name of a label, or the label."""
    table = names.select("meeting_id", F.col("label").alias(column), clean_name(F.col("display_name")).alias("_shown"))
    return rows.join(table, ["meeting_id", column], "left").withColumn("speaker_name", F.coalesce("_shown", column)).drop("_shown")


def unknown_labels(names: DataFrame, speakers: DataFrame) -> DataFrame:
    return names.join(speakers.select("meeting_id", "label"), ["meeting_id", "label"], "left_anti")


def parse_language_hints(hints: Column, supported: list[str]) -> tuple[Column, Column]:
    """Known and unknown codes of comma lists (array of strings), lowered, each once, in order."""
    each = F.array_distinct(F.array_remove(F.transform(F.flatten(F.transform(hints, lambda h: F.split(h, ","))), lambda x: F.lower(tx.strip(x))), ""))
    known = F.array(*map(F.lit, supported))
    return F.array_intersect(each, known), F.array_except(each, known)


def meeting_rollup(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    langs = utterances.groupBy("meeting_id").agg(F.array_sort(F.array_compact(F.collect_set("primary_language"))).alias("detected_languages"))
    n = speakers.groupBy("meeting_id").agg(F.count_distinct("label").alias("num_speakers"))
    return langs.join(n, "meeting_id", "left")


def speakers_view(turns: DataFrame) -> DataFrame:
    n = turns.groupBy("meeting_id").agg(F.count_distinct("speaker_label").cast("int").alias("num_speakers"), F.count("*").alias("num_turns"))
    return n.withColumn("speakers", F.transform(F.sequence(F.lit(1), F.col("num_speakers")), lambda i: F.concat(F.lit("Person "), i.cast("string"))))


def upsert_speakers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels of both; stats are replaced only where given, display names stay."""
    n = new.select("meeting_id", "label", F.col("stats").alias("_stats"))
    return old.join(n, ["meeting_id", "label"], "full").select("meeting_id", "label", "display_name", F.coalesce("_stats", "stats").alias("stats"))
