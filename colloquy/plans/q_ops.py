"""Queries of reads, runs and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ops
from ..operators import search as se
from ..operators import trigrams as tg
from ..streaming import replay
from . import lenses as ln
from .q_analytics import w

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_M = (ln.SQL["runs"], ln.SQL["meetings"])
_R = ln.SQL["runs"]
_U = ln.SQL["utterances"]
_T = ln.SQL["turns"]
_G = ln.SQL["stage_results"]

query("Q1_list_meetings", w(*_M) + "SELECT meeting_id, title, coalesce(duration_seconds, -1) AS duration FROM meetings WHERE status = 'completed' AND list_contains(detected_languages, 'hi') AND num_speakers >= 2 ORDER BY coalesce(duration_seconds, -1) DESC, meeting_id DESC LIMIT 21")(
    lambda s, d: se.list_meetings(ln.meetings(s, d), "duration_seconds", status="completed", language="hi", min_speakers=2).select("meeting_id", "title", F.coalesce("duration_seconds", F.lit(-1.0)).alias("duration"))
)
query("Q2_keyset_page", w(*_M) + "SELECT meeting_id, created_ms FROM meetings WHERE created_ms < 852076800000 OR (created_ms = 852076800000 AND meeting_id < 700) ORDER BY created_ms DESC, meeting_id DESC LIMIT 51")(lambda s, d: se.list_meetings(ln.meetings(s, d), "created_ms", cursor=(852076800000, 700), limit=50).select("meeting_id", "created_ms"))
query("Q2_cursor_codec", w(*_M) + "SELECT meeting_id, created_ms AS v, meeting_id AS id FROM meetings")(lambda s, d: ln.meetings(s, d).select("meeting_id", se.decode_cursor(se.encode_cursor(F.col("created_ms"), F.col("meeting_id")), "v long, id long").alias("c")).select("meeting_id", "c.v", "c.id"))
query("Q3_query_utterances", w(_U) + "SELECT meeting_id, utterance_index, start_ms FROM utterances WHERE speaker = 'assistant' AND primary_language = 'en' AND end_ms >= 20000 AND start_ms <= 200000 AND contains(lower(text), 'the')")(lambda s, d: se.query_utterances(ln.utterances(s, d), "assistant", "en", 20_000, 200_000, "THE").select("meeting_id", "utterance_index", "start_ms"))
_DEF = "ranked AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY status IN ('completed', 'completed_with_errors') DESC, started_ms DESC, run_id) = 1 AS is_default FROM runs)"
query("Q4_default_run", w(_R, _DEF) + "SELECT meeting_id, run_id, status, started_ms FROM ranked WHERE is_default")(lambda s, d: se.default_run(ln.runs(s, d)).select("meeting_id", "run_id", "status", "started_ms"))
query("Q5_list_runs", w(_R, _DEF) + "SELECT meeting_id, run_id, started_ms, is_default FROM ranked")(lambda s, d: se.ranked_runs(ln.runs(s, d)).select("meeting_id", "run_id", "started_ms", "is_default").orderBy("meeting_id", F.desc("started_ms")))
query("Q6_latest_summary", w(_R) + "SELECT run_id, id, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_ms DESC, id DESC) AS k FROM (SELECT meeting_id AS run_id, run_id AS id, started_ms AS created_ms FROM runs)) WHERE k = 1")(lambda s, d: se.latest_summary(ln.runs(s, d).select(F.col("meeting_id").alias("run_id"), F.col("run_id").alias("id"), F.col("started_ms").alias("created_ms"))))
query("Q7_duplicate_uploads", "SELECT doc_id AS meeting_id, original_id FROM (SELECT doc_id, arg_min(doc_id, (n_chars, doc_id)) OVER (PARTITION BY lang, sha256(text)) AS original_id FROM documents) WHERE doc_id <> original_id")(
    lambda s, d: se.duplicate_uploads(ln.table(s, d, "documents").select(F.col("doc_id").alias("meeting_id"), F.col("lang").alias("owner"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("created_ms"))).select("meeting_id", "original_id")
)
query("Q8_retention_candidates", w(*_M, "old AS (SELECT * FROM meetings WHERE created_ms < 790000000000 AND meeting_id % 7 <> 0)") + "SELECT meeting_id, 'uploads/' || meeting_id AS key FROM old UNION ALL SELECT meeting_id, 'processed/' || meeting_id FROM old UNION ALL SELECT o.meeting_id, 'runs/' || run_id || '.wav' FROM old o JOIN (SELECT DISTINCT meeting_id, run_id FROM runs) r ON r.meeting_id = o.meeting_id")(
    lambda s, d: se.retention_candidates(ln.meetings(s, d).withColumn("purged", F.col("meeting_id") % 7 == 0), ln.runs(s, d), 790000000000)
)
query("Q9_stuck_runs", w(_R, "hb AS (SELECT l_orderkey AS run_id, epoch_us(max(l_shipdate)) // 1000 AS heartbeat_ms FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)") + "SELECT run_id, 912470400000 - coalesce(heartbeat_ms, started_ms) AS idle_ms FROM runs LEFT JOIN hb USING (run_id) WHERE status = 'processing' AND 912470400000 - coalesce(heartbeat_ms, started_ms) > 600000")(
    lambda s, d: se.stuck_runs(ln.runs(s, d), ln.table(s, d, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("run_id")).agg(ln.epoch_ms(F.max("l_shipdate")).alias("heartbeat_ms")), 912470400000).select("run_id", "idle_ms")
)


def _index(s, d):
    return ln.utterances(s, d).select("meeting_id", F.col("utterance_index").alias("ref"), "start_ms", "text")


query("Q10_search", w(_U) + "SELECT meeting_id, utterance_index AS ref, start_ms, score FROM (SELECT *, len(list_filter(regexp_split_to_array(trim(lower(text), e' \\n\\t'), '\\s+'), lambda t: t IN ('the', 'of')))::INT AS score FROM utterances) WHERE score > 0 OR contains(lower(text), 'the of') ORDER BY score DESC, start_ms NULLS FIRST, meeting_id, ref LIMIT 20")(lambda s, d: se.search(_index(s, d), "The of").select("meeting_id", "ref", "start_ms", "score"))


def _gram_index(s, d):
    """An index of the utterances that is written; a tenth of the meetings is then written again, without every third utterance
    and with words added to the others."""
    path, rows = replay.folder(s, "trigrams"), _index(s, d)
    tg.write(rows, path)
    tg.upsert(rows.filter("meeting_id % 10 = 3 AND ref % 3 <> 0").withColumn("text", F.concat("text", F.lit(" Addition The end"))), path)
    return path


_EDITED = "edited AS (SELECT meeting_id, utterance_index AS ref, CASE WHEN meeting_id % 10 = 3 THEN text || ' Addition The end' ELSE text END AS text FROM utterances WHERE meeting_id % 10 <> 3 OR utterance_index % 3 <> 0)"


@query("Q10_search_by_trigrams", w(_U, _EDITED) + "SELECT meeting_id, ref, md5(text) AS text FROM edited WHERE contains(lower(text), 'tion the')")
def _(s, d):
    return tg.lookup(s, _gram_index(s, d), "tion The").select("meeting_id", "ref", F.md5("text").alias("text"))


_NAMES = "(SELECT conv_id AS meeting_id, role AS label, nullif(left(trim(CASE WHEN conv_id % 3 = 0 THEN '  ' WHEN conv_id % 3 = 1 THEN ' ' || upper(role) || ' ' END), 100), '') AS shown FROM conversations GROUP BY 1, 2)"


def _names(s, d):
    base = ln.table(s, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("label")).distinct()
    return base.withColumn("display_name", F.when(F.col("meeting_id") % 3 == 0, "  ").when(F.col("meeting_id") % 3 == 1, F.concat(F.lit(" "), F.upper("label"), F.lit(" "))))


query("Q11_apply_display_names", w(_U) + f"SELECT u.meeting_id, utterance_index, coalesce(shown, speaker) AS speaker_name FROM utterances u LEFT JOIN {_NAMES} n ON n.meeting_id = u.meeting_id AND n.label = u.speaker")(lambda s, d: se.apply_display_names(ln.utterances(s, d), _names(s, d)).select("meeting_id", "utterance_index", "speaker_name"))
query("Q12_owner_scope", w(*_M) + "SELECT meeting_id, title FROM meetings WHERE owner = 7")(lambda s, d: se.meeting_filter(ln.meetings(s, d), owner=7).select("meeting_id", "title"))


@query("Q13_parse_language_hints", "SELECT doc_id, lang || CASE WHEN lang = 'en' THEN '' ELSE ',en' END AS known, 'xx' AS unknown FROM documents WHERE lang IN ('en', 'fr')")
def _(s, d):
    hints = F.array(F.concat(F.upper("lang"), F.lit(" , xx")), F.lit("en,XX, "))
    known, unknown = se.parse_language_hints(hints, ["en", "fr", "hi"])
    return ln.table(s, d, "documents").filter("lang IN ('en', 'fr')").select("doc_id", F.array_join(known, ",").alias("known"), F.array_join(unknown, ",").alias("unknown"))


query("Q14_meeting_rollup", w(_U) + "SELECT meeting_id, string_agg(DISTINCT primary_language, ',' ORDER BY primary_language) AS detected_languages, count(DISTINCT speaker) AS num_speakers FROM utterances GROUP BY 1")(
    lambda s, d: se.meeting_rollup(ln.utterances(s, d), ln.utterances(s, d).withColumnRenamed("speaker", "label")).withColumn("detected_languages", F.array_join("detected_languages", ","))
)
query("Q15_speakers_view", w(_T) + "SELECT meeting_id, count(DISTINCT speaker_label)::INT AS num_speakers, count(*) AS num_turns, array_to_string(list_transform(range(1, count(DISTINCT speaker_label) + 1), lambda i: 'Person ' || i), ',') AS speakers FROM turns GROUP BY 1")(lambda s, d: se.speakers_view(ln.turns(s, d)).withColumn("speakers", F.array_join("speakers", ",")))
query("S7_stages_wide", w(_R, _DEF, _G) + "SELECT meeting_id, " + ", ".join(f"any_value(g.status) FILTER (stage_name = '{n}') AS {n}" for n in ln.STAGES) + " FROM ranked r JOIN stage_results g USING (run_id) WHERE is_default GROUP BY 1")(
    lambda s, d: se.default_run(ln.runs(s, d)).select("meeting_id", "run_id").join(ln.stage_results(s, d), "run_id").groupBy("meeting_id").pivot("stage_name", list(ln.STAGES)).agg(F.first("status"))
)
query("S9_turns_from_utterances", w(_U) + "SELECT meeting_id, utterance_index AS turn_id, speaker AS speaker_label, start_ms, end_ms FROM utterances")(lambda s, d: ln.utterances(s, d).select("meeting_id", F.col("utterance_index").alias("turn_id"), F.col("speaker").alias("speaker_label"), "start_ms", "end_ms"))
query("K10_search_index", w(_U) + "SELECT 'utterance' AS kind, meeting_id, utterance_index AS ref, start_ms, speaker, text FROM utterances")(lambda s, d: ln.utterances(s, d).select(F.lit("utterance").alias("kind"), "meeting_id", F.col("utterance_index").alias("ref"), "start_ms", "speaker", "text"))
query("K11_upsert_speakers", "SELECT coalesce(o.meeting_id, n.meeting_id) AS meeting_id, coalesce(o.label, n.label) AS label, display_name, coalesce(n.stats, o.stats) AS stats FROM (SELECT DISTINCT conv_id AS meeting_id, role AS label, upper(role) AS display_name, 'old' AS stats FROM conversations WHERE conv_id % 2 = 0) o FULL JOIN (SELECT DISTINCT conv_id AS meeting_id, role AS label, CASE WHEN conv_id % 5 > 0 THEN 'new' END AS stats FROM conversations WHERE conv_id % 3 = 0) n ON o.meeting_id = n.meeting_id AND o.label = n.label")(
    lambda s, d: se.upsert_speakers(
        ln.table(s, d, "conversations").filter("conv_id % 2 = 0").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("label"), F.upper("role").alias("display_name"), F.lit("old").alias("stats")).distinct(),
        ln.table(s, d, "conversations").filter("conv_id % 3 = 0").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("label"), F.when(F.col("conv_id") % 5 > 0, "new").alias("stats")).distinct(),
    )
)

_OPT = "stage_name = 'summarize'"
query("O1_run_status", w(_G) + f"SELECT run_id, CASE WHEN bool_or(status = 'failed' AND NOT {_OPT}) THEN 'failed' WHEN bool_or(status = 'failed' AND {_OPT}) THEN 'completed_with_errors' ELSE 'completed' END AS status, coalesce(string_agg(stage_name || ' failed', '; ' ORDER BY stage_no) FILTER (status = 'failed'), '') AS error FROM stage_results GROUP BY 1")(lambda s, d: ops.run_status(ln.stage_results(s, d)))
_FP = """fp AS (WITH RECURSIVE n AS (SELECT run_id, stage_no, stage_name, duration_ms, row_number() OVER (PARTITION BY run_id ORDER BY stage_no) AS k FROM stage_results),
f AS (SELECT run_id, k, stage_no, stage_name, sha256(stage_name || '||' || duration_ms) AS fingerprint FROM n WHERE k = 1 UNION ALL SELECT n.run_id, n.k, n.stage_no, n.stage_name, sha256(n.stage_name || '|' || f.fingerprint || '|' || n.duration_ms) FROM n JOIN f ON n.run_id = f.run_id AND n.k = f.k + 1) SELECT * FROM f)"""


def _prints(s, d):
    return ops.stage_fingerprints(ln.stage_results(s, d), F.col("duration_ms").cast("string"))


query("O2_stage_fingerprints", w(_G, _FP) + "SELECT run_id, stage_no::INT AS stage_no, stage_name, fingerprint FROM fp")(_prints)
query("O2_stages_to_run", w(_G, _FP) + "SELECT run_id, stage_no::INT AS stage_no, stage_name FROM (SELECT *, max((run_id % 4 + 1 = k)::INT) OVER (PARTITION BY run_id ORDER BY stage_no ROWS UNBOUNDED PRECEDING) AS m FROM fp) WHERE m = 1")(
    lambda s, d: ops.stages_to_run(_prints(s, d), _prints(s, d).withColumn("k", F.expr("row_number() over (partition by run_id order by stage_no)")).filter("run_id % 4 + 1 <> k")).select("run_id", "stage_no", "stage_name")
)
_W = "CASE stage_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ops.WEIGHTS.items()) + " END"
query("O3_progress", w(_G, f"p AS (SELECT run_id, sum(CASE WHEN status = 'completed' THEN {_W} ELSE 0 END) AS done, sum(duration_ms)::BIGINT AS elapsed_ms, bool_or(status = 'failed') AS failed FROM stage_results GROUP BY 1), q AS (SELECT *, CASE WHEN done >= 100 OR failed THEN 1 ELSE least(done / 100, 0.99) END::DOUBLE AS fraction FROM p)") + "SELECT run_id, fraction, elapsed_ms, CASE WHEN fraction > 0.02 AND fraction < 1 THEN elapsed_ms * (1 - fraction) / fraction END AS eta_ms FROM q")(lambda s, d: ops.progress(ln.stage_results(s, d)))
query("O5_stage_histograms", w(_G) + "SELECT stage_name, CASE WHEN duration_ms <= 10000 THEN 10 WHEN duration_ms <= 25000 THEN 25 WHEN duration_ms <= 40000 THEN 40 ELSE 'infinity'::DOUBLE END::DOUBLE AS le, count(*) AS n FROM stage_results GROUP BY 1, 2")(lambda s, d: ops.histogram(ln.stage_results(s, d), ["stage_name"], F.col("duration_ms") / 1000, [10, 25, 40]))
query("O5_stage_percentiles", w(_G) + "SELECT stage_name, status, count(*) AS n, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95 FROM stage_results GROUP BY 1, 2")(lambda s, d: ln.stage_results(s, d).groupBy("stage_name", "status").agg(F.count("*").alias("n"), F.percentile("duration_ms", F.lit(0.5)).alias("p50"), F.percentile("duration_ms", F.lit(0.95)).alias("p95")))
query("O5_hourly_rollup", "SELECT (epoch_us(ts) // 3600000000) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")(lambda s, d: ln.table(s, d, "events").groupBy(F.floor(ln.epoch_ms("ts") / 3_600_000).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")))
# Audio of a run, from its price; model calls, from the conversations.
_AUDIO = "audio AS (SELECT run_id, status, (o_totalprice * 100)::BIGINT AS audio_ms FROM runs)"
_PRICES = {"user": 0.15, "assistant": 0.6}


def _audio(s, d):
    return ln.runs(s, d).select("run_id", "status", F.round(F.col("o_totalprice") * 100).cast("long").alias("audio_ms"))


def _calls(s, d):
    """Tokens of each turn, and their cost in units of a millionth."""
    price = F.create_map(*[F.lit(x) for kv in _PRICES.items() for x in kv])
    u = ln.utterances(s, d).select(F.col("speaker").alias("kind"), tx.estimate_tokens(F.col("text")).alias("tokens"))
    return u.withColumn("cost", F.round(F.col("tokens") * F.coalesce(F.element_at(price, F.col("kind")), F.lit(0.0)) * 100).cast("long"))


query("O5_factor_histogram", w(_R, _G, _AUDIO) + f"""SELECT stage_name, CASE {" ".join(f"WHEN f <= {b} THEN {b}" for b in ops.FACTORS)} ELSE 'infinity'::DOUBLE END::DOUBLE AS le, count(*) AS n
  FROM (SELECT stage_name, duration_ms / audio_ms AS f FROM stage_results JOIN audio USING (run_id) WHERE audio_ms > 0) GROUP BY 1, 2""")(lambda s, d: ops.factor_histogram(ln.stage_results(s, d), _audio(s, d)))
query("O5_run_measures", w(_R, _U, _AUDIO, r"calls AS (SELECT speaker AS kind, ceil((length(text) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) / 4)::BIGINT AS tokens FROM utterances)")
    + f"""SELECT 'runs' AS measure, status AS label, count(*)::DOUBLE AS value FROM audio GROUP BY 2 UNION ALL SELECT 'audio_minutes', 'completed', coalesce(sum(audio_ms), 0) / 60000 FROM audio WHERE starts_with(status, 'completed')
UNION ALL SELECT 'tokens', kind, sum(tokens)::DOUBLE FROM calls GROUP BY 2 UNION ALL SELECT 'cost', 'all', coalesce(sum(round(tokens * CASE kind WHEN 'user' THEN {_PRICES["user"]} WHEN 'assistant' THEN {_PRICES["assistant"]} ELSE 0 END * 100)::BIGINT), 0)::DOUBLE FROM calls""")(
    lambda s, d: ops.run_measures(_audio(s, d), _calls(s, d))
)


@query("O5_sketch_rollup", "SELECT event_type, epoch_us(ts) // 86400000000 * 86400000 AS start_ms, count(*) AS n, min(value) AS least, max(value) AS most, true AS p50_near, true AS p95_near, true AS users_near FROM events GROUP BY 1, 2")
def _(s, d):
    """Sketches of five minutes, written and merged to hours and then to days; of the estimates, whether they are as near to
    the exact ranks and counts as stated."""
    events = ln.table(s, d, "events").select("event_type", "user_id", "value", ln.epoch_ms("ts").alias("at_ms"))
    path, day = replay.folder(s, "sketches"), 86_400_000
    ops.window_sketches(events, ["event_type"], "value", "user_id").write.parquet(path)
    hours = ops.merge_sketches(s.read.parquet(path), ["event_type"], 3_600_000)
    days = ops.sketch_estimates(ops.merge_sketches(hours, ["event_type"], day), {"p50": 0.5, "p95": 0.95})
    key = ["event_type", "start_ms"]
    each = events.withColumn("start_ms", F.floor(F.col("at_ms") / day) * day).join(days.select(*key, "p50", "p95"), key)
    side = lambda p, sign: F.avg(F.when(F.col("value") < F.col(p) if sign else F.col("value") <= F.col(p), 1.0).otherwise(0.0))
    ranks = each.groupBy(*key).agg(*(side(p, sign).alias(f"{p}_{name}") for p in ("p50", "p95") for name, sign in (("below", 1), ("upto", 0))), F.count_distinct("user_id").alias("users"), F.count("*").alias("rows"))
    # A rank is a span where values tie; one row is the least that it can be off.
    slack = ops.RANK_ERROR * 1.5 + 1 / F.col("rows")
    near = lambda p, at: ((F.col(f"{p}_below") - slack <= at) & (F.col(f"{p}_upto") + slack >= at)).alias(f"{p}_near")
    users = (F.abs(F.col("n_distinct") - F.col("users")) <= F.greatest(4 * ops.COUNT_ERROR * F.col("users"), F.lit(1))).alias("users_near")
    return days.join(ranks, key).select(*key, "n", "least", "most", near("p50", 0.5), near("p95", 0.95), users)


query("O6_moving_window_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM events")(lambda s, d: ops.moving_window_counts(ln.table(s, d, "events").withColumn("epoch_s", F.floor(ln.epoch_ms("ts") / 1000)), ["user_id"], width_s=3600).select("event_id", "in_window"))
O7 = """event_id, event_type, c > 1 AS conflict, n AS events FROM (SELECT user_id, k, min((event_id, event_type)) AS f, count(DISTINCT event_type) AS c, count(*) AS n, f[1] AS event_id, f[2] AS event_type
  FROM (SELECT *, event_id // 100 AS k FROM events) GROUP BY 1, 2)"""
query("O7_dedupe_events", f"SELECT user_id, k, {O7}")(lambda s, d: ops.dedupe_events(ln.table(s, d, "events").withColumn("k", F.floor(F.col("event_id") / 100)), ["user_id", "k"], ["event_type"], ["event_id"]))
query("O8_latency_report", "SELECT coalesce(event_type, 'Aggregated') AS event_type, count(*) AS requests, count(*) FILTER (user_id % 10 = 0) AS failures, median(value) AS median, avg(value) AS mean, min(value) AS min, max(value) AS max, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY ROLLUP (event_type)")(lambda s, d: ops.latency_report(ln.table(s, d, "events"), "event_type", "value", F.col("user_id") % 10 == 0))
