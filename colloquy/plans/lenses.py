"""The engine's input tables, seen in the driver's tables: each lens in Spark and as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000
#: Users whose events of a day are one meeting, so that meetings grow in number with the table; a meeting's clock runs faster by
#: ``PACE``, so that its turns overlap.
USERS, PACE = 15, 32
#: Documents of a source by id that make one meeting, so that meetings grow in number with the table and not in size.
BLOCK = 500


def _sources(docs: DataFrame) -> DataFrame:
    return docs.withColumn("meeting_id", F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / BLOCK).cast("string")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def meeting_of_event() -> Column:
    return (F.floor(epoch_ms("ts") / DAY) * 1_000_000 + F.floor(F.col("user_id") / USERS)).cast("long")


def meeting_clock() -> Column:
    return F.floor(epoch_ms("ts") % DAY / PACE).cast("long")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = meeting_clock()
    return table(spark, sf_dir, "events").select(
        meeting_of_event().alias("meeting_id"),
        F.col("event_id").alias("turn_id"),
        F.concat(F.lit("Person "), (F.col("user_id") % 5 + 1).cast("string")).alias("speaker_label"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 2000 + 0.5)).cast("long").alias("end_ms"),
    )


def one_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as turns of one meeting of months, whose clock runs as fast as that of ``turns``."""
    start = F.floor(epoch_ms("ts") / PACE).cast("long")
    return table(spark, sf_dir, "events").select(
        F.lit(0).cast("long").alias("meeting_id"),
        F.col("event_id").alias("turn_id"),
        F.concat(F.lit("Person "), (F.col("user_id") % 5 + 1).cast("string")).alias("speaker_label"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 2000 + 0.5)).cast("long").alias("end_ms"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    start = (60 * F.coalesce(F.sum(size).over(before), F.lit(0)) + 500 * F.col("turn")).cast("long")
    base = table(spark, sf_dir, "conversations").withColumn("start_ms", start).withColumn("text", F.coalesce("text", F.lit("")))
    words = F.array_remove(F.split(F.trim("text"), r"\s+"), "")
    return base.select(
        F.col("conv_id").alias("meeting_id"),
        F.col("turn").cast("long").alias("utterance_index"),
        F.col("role").alias("speaker"),
        "start_ms",
        (F.col("start_ms") + 60 * F.length("text")).cast("long").alias("end_ms"),
        "text",
        F.size(words).cast("long").alias("n_words"),
        F.when(F.length("text") % 3 == 0, "hi").when(F.length("text") % 7 == 0, "or").otherwise("en").alias("primary_language"),
    )


def lid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sources(table(spark, sf_dir, "documents")).withColumn("dur_ms", (F.col("n_chars") % 4000 + 200).cast("long"))
    before = Window.partitionBy("meeting_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    base = docs.withColumn("start_ms", F.coalesce(F.sum("dur_ms").over(before), F.lit(0)).cast("long"))
    conf = (F.col("doc_id") * 37 % 100) / 100
    return base.select(
        "meeting_id",
        F.col("doc_id").alias("seq"),
        "start_ms",
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("Person "), (F.col("doc_id") % 4 + 1).cast("string"))).alias("speaker"),
        F.col("lang").alias("language"),
        conf.alias("confidence"),
        (conf < 0.5).alias("uncertain"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments: the documents' texts as if recognised, 60 ms a character."""
    docs = _sources(table(spark, sf_dir, "documents")).withColumn("dur_ms", F.least(F.length("text") * 60, F.lit(30_000)).cast("long"))
    before = Window.partitionBy("meeting_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    base = docs.withColumn("start_ms", F.coalesce(F.sum("dur_ms").over(before), F.lit(0)).cast("long"))
    return base.select(
        "meeting_id",
        F.col("doc_id").alias("id"),
        "start_ms",
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        "text",
        F.col("lang").alias("language"),
        ((F.col("doc_id") * 37 % 100) / 100).alias("avg_confidence"),
        ((F.col("doc_id") * 53 % 100) / 100).alias("no_speech_prob"),
        (1 + (F.col("doc_id") * 29 % 30) / 10).alias("compression_ratio"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("completed_with_errors")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("run_id"), epoch_ms("o_orderdate").alias("started_ms"), status.alias("status"), "o_totalprice", "o_orderpriority"
    )


STAGES = ("preprocess", "diarize", "identify_languages", "transcribe", "align", "analytics", "summarize")


def stage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, STAGES)), F.col("l_linenumber").cast("int"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg((F.sum("l_quantity") * 1000).cast("long").alias("duration_ms"), F.max("l_returnflag").alias("flag"))
        .select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage_no"), name.alias("stage_name"), "duration_ms", F.when(F.col("flag") == "R", "failed").otherwise("completed").alias("status"))
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = runs(spark, sf_dir).groupBy("meeting_id").agg(F.min("started_ms").alias("created_ms"), F.max_by("status", F.struct("started_ms", "run_id")).alias("status"))
    return table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("meeting_id")).select(
        "meeting_id",
        F.col("c_name").alias("title"),
        F.col("c_nationkey").alias("owner"),
        "created_ms",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("duration_seconds"),
        "status",
        (F.col("meeting_id") % 5).alias("num_speakers"),
        F.when(F.col("meeting_id") % 3 == 0, F.array(F.lit("en"), F.lit("hi"))).otherwise(F.array(F.lit("en"))).alias("detected_languages"),
    )


EVENT_MEETING = f"((epoch_us(ts) // 1000) // {DAY} * 1000000 + user_id // {USERS})"
EVENT_CLOCK = f"((epoch_us(ts) // 1000) % {DAY} // {PACE})"

SQL = {
    "turns": f"""turns AS (SELECT {EVENT_MEETING} AS meeting_id, event_id AS turn_id, 'Person ' || (user_id % 5 + 1) AS speaker_label,
  {EVENT_CLOCK} AS start_ms, {EVENT_CLOCK} + floor(value * 2000 + 0.5)::BIGINT AS end_ms FROM events)""",
    "one_meeting": f"""turns AS (SELECT 0::BIGINT AS meeting_id, event_id AS turn_id, 'Person ' || (user_id % 5 + 1) AS speaker_label,
  epoch_us(ts) // 1000 // {PACE} AS start_ms, epoch_us(ts) // 1000 // {PACE} + floor(value * 2000 + 0.5)::BIGINT AS end_ms FROM events)""",
    "utterances": r"""utterances AS (SELECT conv_id AS meeting_id, turn::BIGINT AS utterance_index, role AS speaker, s AS start_ms, s + 60 * length(t) AS end_ms, t AS text,
  len(list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> ''))::BIGINT AS n_words,
  CASE WHEN length(t) % 3 = 0 THEN 'hi' WHEN length(t) % 7 = 0 THEN 'or' ELSE 'en' END AS primary_language
  FROM (SELECT *, coalesce(text, '') AS t, (60 * coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 500 * turn)::BIGINT AS s FROM conversations))""",
    "lid_windows": f"""lid_windows AS (SELECT source || '-' || (doc_id // {BLOCK}) AS meeting_id, doc_id AS seq, s AS start_ms, s + d AS end_ms,
  CASE WHEN doc_id % 11 <> 0 THEN 'Person ' || (doc_id % 4 + 1) END AS speaker, lang AS language, (doc_id * 37 % 100) / 100 AS confidence, (doc_id * 37 % 100) / 100 < 0.5 AS uncertain
  FROM (SELECT *, coalesce(sum(d) OVER (PARTITION BY source, doc_id // {BLOCK} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (SELECT *, n_chars % 4000 + 200 AS d FROM documents)))""",
    "segments": f"""segments AS (SELECT source || '-' || (doc_id // {BLOCK}) AS meeting_id, doc_id AS id, s AS start_ms, s + d AS end_ms, text, lang AS language, (doc_id * 37 % 100) / 100 AS avg_confidence,
  (doc_id * 53 % 100) / 100 AS no_speech_prob, 1 + (doc_id * 29 % 30) / 10 AS compression_ratio
  FROM (SELECT *, coalesce(sum(d) OVER (PARTITION BY source, doc_id // {BLOCK} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (SELECT *, least(length(text) * 60, 30000)::BIGINT AS d FROM documents)))""",
    "runs": """runs AS (SELECT o_custkey AS meeting_id, o_orderkey AS run_id, (epoch_us(o_orderdate) // 1000) AS started_ms,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'completed_with_errors' END AS status, o_totalprice, o_orderpriority FROM orders)""",
    "stage_results": f"""stage_results AS (SELECT l_orderkey AS run_id, l_linenumber AS stage_no, {list(STAGES)}[l_linenumber] AS stage_name, (sum(l_quantity) * 1000)::BIGINT AS duration_ms,
  CASE WHEN max(l_returnflag) = 'R' THEN 'failed' ELSE 'completed' END AS status FROM lineitem GROUP BY 1, 2)""",
    "meetings": """meetings AS (SELECT meeting_id, c_name AS title, c_nationkey AS owner, created_ms, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS duration_seconds, status, meeting_id % 5 AS num_speakers,
  CASE WHEN meeting_id % 3 = 0 THEN ['en', 'hi'] ELSE ['en'] END AS detected_languages
  FROM customer JOIN (SELECT meeting_id, min(started_ms) AS created_ms, arg_max(status, (started_ms, run_id)) AS status FROM runs GROUP BY 1) ON c_custkey = meeting_id)""",
}


def with_sql(*names: str) -> str:
    """WITH and the CTEs of these lenses."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
