"""Readers of fixtures and evaluation files, all as distributed text, JSON or binary scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEETING = """title string, date string, utterances array<struct<id int, speaker string, start double, end double, lang string, text string>>,
gold struct<decisions array<struct<text string, made_by string>>, action_items array<struct<task string, owner string>>>"""
TRANSCRIPT = "utterances array<struct<id int, speaker string, start double, end double, text string, words array<struct<text string, start double, end double>>>>"


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def read_meeting_fixtures(spark: SparkSession, path: str, key: Callable[[Column], Column] = _stem) -> tuple[DataFrame, DataFrame]:
    """Utterances and gold items of JSON meetings; the file's stem, or another ``key`` of its path, is the meeting."""
    raw = spark.read.schema(MEETING).option("multiLine", True).json(path).withColumn("meeting_id", key(F.col("_metadata.file_path")))
    u = raw.select("meeting_id", F.explode("utterances").alias("u")).select("meeting_id", F.col("u.id").alias("utterance_index"), "u.speaker", ms(F.col("u.start")).alias("start_ms"), ms(F.col("u.end")).alias("end_ms"), F.col("u.lang").alias("primary_language"), "u.text")
    item = lambda kind, field, text, who: raw.select("meeting_id", F.lit(kind).alias("kind"), F.posexplode(f"gold.{field}").alias("idx", "g")).select("meeting_id", "kind", "idx", F.col(f"g.{text}").alias("text"), F.col(f"g.{who}").alias("owner"))
    return u, item("decision", "decisions", "text", "made_by").unionByName(item("action_item", "action_items", "task", "owner"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Speaker spans; other lines, and those with fewer than eight fields, are passed over."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).withColumn("f", f).filter((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    start, length = F.col("f")[3].cast("double"), F.col("f")[4].cast("double")
    return rows.select(F.col("f")[1].alias("meeting_id"), F.col("f")[7].alias("speaker_label"), ms(start).alias("start_ms"), ms(start + length).alias("end_ms"))


def read_reference_words(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated start, end, speaker, word; blank and shorter lines are passed over."""
    rows = spark.read.text(path).withColumn("meeting_id", _stem(F.col("_metadata.file_path"))).withColumn("f", F.split("value", "\t")).filter((F.size("f") >= 4) & (F.trim("value") != ""))
    return rows.select("meeting_id", F.col("f")[2].alias("speaker"), F.col("f")[3].alias("word"), ms(F.col("f")[0].cast("double")).alias("start_ms"), ms(F.col("f")[1].cast("double")).alias("end_ms"))


def flatten_transcript(spark: SparkSession, path: str, key: Callable[[Column], Column] = _stem) -> tuple[DataFrame, DataFrame]:
    """Utterance spans and attributed words of transcript documents."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).select(key(F.col("_metadata.file_path")).alias("meeting_id"), F.explode("utterances").alias("u"))
    spans = raw.select("meeting_id", F.col("u.speaker").alias("speaker_label"), ms(F.col("u.start")).alias("start_ms"), ms(F.col("u.end")).alias("end_ms"))
    words = raw.select("meeting_id", F.col("u.speaker").alias("speaker"), F.explode("u.words").alias("w")).select("meeting_id", "speaker", F.col("w.text").alias("word"), ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"))
    return spans, words


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _texts(spark: SparkSession, path: str, name: str, key: Callable[[Column], Column], language: Callable[[Column], Column]) -> DataFrame:
    p = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(key(p).alias("stem"), language(p).alias("language"), F.trim("value", F.lit(" \t\r\n")).alias(name))


def pair_by_stem(spark: SparkSession, hypotheses: str, references: str, key: Callable[[Column], Column] = _stem, language: Callable[[Column], Column] = _parent) -> tuple[DataFrame, DataFrame]:
    """Files of one stem in both folders, the language being the reference's parent folder; and the unpaired stems. ``key`` and
    ``language`` may read them from another part of the path."""
    h, r = _texts(spark, hypotheses, "hypothesis", key, language).drop("language"), _texts(spark, references, "reference", key, language)
    skipped = h.join(r, "stem", "left_anti").select("stem").unionByName(r.join(h, "stem", "left_anti").select("stem"))
    return r.join(h, "stem"), skipped


def read_language_spans(spark: SparkSession, path: str, key: Callable[[Column], Column] | None = None, pattern: str = "*.lang.json", bundled: bool = False) -> DataFrame:
    """Who speaks which language when, of files beside the references: stem, start_ms, end_ms, language. Each file is a JSON array of
    spans with start and end in seconds; spans without both, or without a language, are left out. ``bundled``: each line of a file
    is the stem (nothing if null), a tab and such an array, so that the number of files need not grow with that of recordings."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.lang\.json$", "")
    raw = spark.read.text(path, wholetext=not bundled, recursiveFileLookup=True, pathGlobFilter=pattern)
    stem, value = F.nullif(F.substring_index("value", "\t", 1), F.lit("")), F.col("value")
    if bundled:
        value = F.when(F.instr("value", "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    spans = F.from_json(value, "array<struct<start: double, end: double, language: string>>")
    each = raw.select((stem if bundled else key(F.col("_metadata.file_path")) if key else name).alias("stem"), F.explode(spans).alias("s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return each.select("stem", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.language").filter("start_ms IS NOT NULL AND end_ms IS NOT NULL AND language IS NOT NULL")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


LEGACY = """meeting_id string, runs array<struct<run_id string, status string, stages array<struct<name string, status string, duration_ms bigint>>>>,
turns array<struct<speaker string>>, transcript array<struct<id int, speaker string, start_ms bigint, end_ms bigint, text string, language string>>,
analytics array<struct<speaker string>>, names map<string,string>, summary struct<title string, text string>"""


def normalize_documents(docs: DataFrame, column: str = "document") -> dict[str, DataFrame]:
    """Tables of nested per-meeting documents (JSON text): runs, stages, utterances, speakers, summaries, search, rollup."""
    d = docs.select(F.from_json(column, LEGACY).alias("d")).select("d.*").filter("meeting_id IS NOT NULL")
    runs = d.select("meeting_id", F.explode("runs").alias("r")).select("meeting_id", "r.run_id", "r.status", "r.stages")
    u = d.select("meeting_id", F.explode("transcript").alias("u")).select("meeting_id", "u.*")
    label = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["speaker"])
    speakers = d.select("meeting_id", "names", F.explode(F.array_compact(F.array_union(F.array_union(label(F.col("turns")), label(F.col("transcript"))), F.array_union(label(F.col("analytics")), F.coalesce(F.map_keys("names"), F.array().cast("array<string>"))))))
        .alias("label")).filter("label <> 'Unknown'")
    named = speakers.select("meeting_id", "label", F.element_at("names", F.col("label")).alias("display_name"))
    said = u.select(F.lit("utterance").alias("kind"), "meeting_id", F.col("id").alias("ref"), "text")
    summed = d.filter("summary IS NOT NULL").select("meeting_id", "summary.title", "summary.text")
    return {
        "runs": runs.select("meeting_id", "run_id", "status"),
        "stages": runs.select("run_id", F.explode("stages").alias("s")).select("run_id", "s.*"),
        "utterances": u,
        "speakers": named,
        "summaries": summed,
        "search": said.unionByName(summed.select(F.lit("summary").alias("kind"), "meeting_id", F.lit(None).cast("int").alias("ref"), F.concat_ws("\n", "title", "text").alias("text"))),
        "rollup": u.groupBy("meeting_id").agg(F.array_sort(F.array_compact(F.collect_set("language"))).alias("detected_languages")).join(named.groupBy("meeting_id").agg(F.count("*").alias("num_speakers")), "meeting_id", "left"),
    }
