"""Queries of intervals, turns and conversation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics as an
from ..operators import intervals as iv
from ..operators import turns as tn
from . import lenses as ln

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Reusable CTEs: merged spans by speaker, sweep, floor runs. Equal spans are one, as the order of equal rows may differ from window to window.
_MERGE = """
{out} AS (SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(CASE WHEN r IS NULL OR start_ms > r THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT DISTINCT {keys}, start_ms, end_ms FROM {src} WHERE end_ms > start_ms))) GROUP BY {keys}, g)"""
OWN = _MERGE.format(out="own", keys="meeting_id, speaker_label", src="turns")
UNION = _MERGE.format(out="merged", keys="meeting_id", src="turns")
SWEEP = """
num AS (SELECT *, dense_rank() OVER (PARTITION BY meeting_id ORDER BY speaker_label) AS no FROM own),
edge AS (SELECT meeting_id, start_ms AS t, 1 AS d, no FROM num UNION ALL SELECT meeting_id, end_ms, -1, no FROM num),
step AS (SELECT meeting_id, t, sum(d) AS d, sum(d * no) AS i FROM edge GROUP BY 1, 2),
swept AS (SELECT * FROM (SELECT meeting_id, t AS start_ms, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS end_ms, sum(d) OVER w AS active, sum(i) OVER w AS id_sum
  FROM step WINDOW w AS (PARTITION BY meeting_id ORDER BY t ROWS UNBOUNDED PRECEDING)) WHERE end_ms IS NOT NULL AND active > 0)"""
OVER = """
spk AS (SELECT meeting_id, speaker_label, no, sum(end_ms - start_ms)::BIGINT AS speaking_ms FROM num GROUP BY 1, 2, 3),
solo AS (SELECT meeting_id, id_sum AS no, sum(end_ms - start_ms)::BIGINT AS solo_ms FROM swept WHERE active = 1 GROUP BY 1, 2),
over AS (SELECT meeting_id, speaker_label, speaking_ms, coalesce(solo_ms, 0) AS solo_ms, speaking_ms - coalesce(solo_ms, 0) AS overlap_ms FROM spk LEFT JOIN solo USING (meeting_id, no))"""
RUNS = """
floor_runs AS (SELECT meeting_id, g AS run, any_value(speaker_label) AS speaker_label, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(CASE WHEN l IS NULL OR l <> speaker_label THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, speaker_label, end_ms, turn_id ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM (
  SELECT *, lag(speaker_label) OVER (PARTITION BY meeting_id ORDER BY start_ms, speaker_label, end_ms, turn_id) AS l FROM turns)) GROUP BY 1, 2)"""
CUTS = """
cuts AS (SELECT meeting_id, turn_id, speaker, victim, overlap_ms FROM (SELECT b.meeting_id, b.turn_id, b.speaker_label AS speaker, a.speaker_label AS victim, least(a.end_ms, b.end_ms) - b.start_ms AS overlap_ms,
    row_number() OVER (PARTITION BY b.meeting_id, b.turn_id ORDER BY least(a.end_ms, b.end_ms) - b.start_ms DESC, a.turn_id) AS k
  FROM turns b JOIN turns a ON a.meeting_id = b.meeting_id AND a.speaker_label <> b.speaker_label AND a.start_ms < b.start_ms AND b.start_ms < a.end_ms AND least(a.end_ms, b.end_ms) - b.start_ms > 500
  WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.meeting_id = b.meeting_id AND t.speaker_label = b.speaker_label AND t.turn_id <> b.turn_id AND t.start_ms <= b.start_ms AND b.start_ms < t.end_ms)) WHERE k = 1)"""
# Conversations get turns of their own: one per utterance.
UTURNS = "turns AS (SELECT meeting_id, utterance_index AS turn_id, speaker AS speaker_label, start_ms, end_ms FROM utterances)"
DUR = "durations AS (SELECT meeting_id, max(end_ms) AS duration_ms FROM (SELECT meeting_id, end_ms FROM turns UNION ALL SELECT meeting_id, end_ms FROM utterances) GROUP BY 1)"
STATS = r"""
said AS (SELECT meeting_id, speaker AS speaker_label, count(*) AS n, avg(end_ms - start_ms) AS a, median(end_ms - start_ms)::DOUBLE AS m, max((end_ms - start_ms, -start_ms, end_ms)) AS l, sum(n_words)::BIGINT AS w,
  count(*) FILTER (regexp_matches(text, '[?？]\s*$')) AS q FROM utterances WHERE speaker <> 'Unknown' GROUP BY 1, 2),
spoken AS (SELECT meeting_id, speaker_label, sum(end_ms - start_ms)::BIGINT AS s, min(start_ms) AS f, max(end_ms) AS e FROM own GROUP BY 1, 2),
speech AS (SELECT meeting_id, sum(end_ms - start_ms)::BIGINT AS t FROM merged GROUP BY 1),
base AS (SELECT meeting_id, speaker_label, coalesce(s, 0) AS speaking_ms, f, e, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(m, 0) AS m, l, coalesce(w, 0) AS w, coalesce(q, 0) AS q
  FROM spoken FULL JOIN said USING (meeting_id, speaker_label)),
stats AS (SELECT base.meeting_id, base.speaker_label, base.speaking_ms, CASE WHEN t > 0 THEN base.speaking_ms / t ELSE 0 END AS share_of_speech,
  CASE WHEN duration_ms > 0 THEN base.speaking_ms / duration_ms ELSE 0 END AS share_of_meeting, n AS num_segments,
  CASE WHEN sum(n) OVER (PARTITION BY base.meeting_id) > 0 THEN n / sum(n) OVER (PARTITION BY base.meeting_id) ELSE 0 END AS segment_share,
  coalesce((SELECT count(*) FROM floor_runs r WHERE r.meeting_id = base.meeting_id AND r.speaker_label = base.speaker_label), 0) AS num_turns,
  a AS avg_utterance_ms, m AS median_utterance_ms, -(l[2]) AS longest_start_ms, l[3] AS longest_end_ms, l[1] AS longest_ms, w AS word_count,
  CASE WHEN base.speaking_ms > 0 THEN w * 60000 / base.speaking_ms ELSE 0 END AS words_per_minute, f AS first_spoke_ms, e AS last_spoke_ms,
  coalesce((SELECT count(*) FROM cuts c WHERE c.meeting_id = base.meeting_id AND c.speaker = base.speaker_label), 0) AS interruptions_made,
  coalesce((SELECT count(*) FROM cuts c WHERE c.meeting_id = base.meeting_id AND c.victim = base.speaker_label), 0) AS interruptions_received,
  coalesce(overlap_ms, 0) AS overlap_ms, q AS questions_asked
  FROM base LEFT JOIN over USING (meeting_id, speaker_label) LEFT JOIN speech USING (meeting_id) LEFT JOIN durations USING (meeting_id))"""
GINI = """
cs AS (SELECT *, round_even(speaking_ms / 10, 0)::BIGINT AS x FROM stats),
gi AS (SELECT meeting_id, count(*) AS num_speakers, CASE WHEN sum(x) > 0 THEN sum(w)::BIGINT / (count(*) * sum(x)::BIGINT) ELSE 0 END AS gini FROM (
  SELECT *, (2 * row_number() OVER (PARTITION BY meeting_id ORDER BY x, speaker_label) - count(*) OVER (PARTITION BY meeting_id) - 1) * x AS w FROM cs) GROUP BY 1)"""
BALANCE = "CASE WHEN {n} < 2 THEN 'not applicable' WHEN {g} <= 0.2 THEN 'balanced' WHEN {g} >= 0.4 THEN 'dominated' ELSE 'moderately dominated' END"


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


_T = ln.SQL["turns"]
_U = ln.SQL["utterances"]


def _talk(spark, d):
    """Utterances of the conversations and a turn for each."""
    u = ln.utterances(spark, d)
    t = u.select("meeting_id", F.col("utterance_index").alias("turn_id"), F.col("speaker").alias("speaker_label"), "start_ms", "end_ms")
    return t, u


def _both(spark, d):
    """Meetings of the events' turns, with what the events say: their type once or more, what came with them, and a question
    mark at the end of some."""
    t = ln.turns(spark, d)
    text = F.concat(F.expr("repeat(concat(event_type, ' '), cast(user_id % 4 + 1 as int))"), F.coalesce("props", F.lit("-")), F.when(F.col("value") > 50, "?").otherwise(""))
    said = ln.table(spark, d, "events").select(F.col("event_id").alias("turn_id"), text.alias("text"))
    u = t.join(said, "turn_id").withColumn("n_words", F.size(tx.tokens(F.col("text"))).cast("long"))
    return t, u.select("meeting_id", F.col("turn_id").alias("utterance_index"), F.col("speaker_label").alias("speaker"), "start_ms", "end_ms", "text", "n_words", F.when(F.col("turn_id") % 3 == 0, "hi").otherwise("en").alias("primary_language"))


BOTH = """utterances AS (SELECT meeting_id, turn_id AS utterance_index, speaker_label AS speaker, start_ms, end_ms, text, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))::BIGINT AS n_words,
  CASE WHEN turn_id % 3 = 0 THEN 'hi' ELSE 'en' END AS primary_language FROM turns JOIN (SELECT event_id AS turn_id, repeat(event_type || ' ', user_id % 4 + 1) || coalesce(props, '-') || CASE WHEN value > 50 THEN '?' ELSE '' END AS text FROM events) USING (turn_id))"""
FULL = (_T, BOTH, OWN, UNION, SWEEP, OVER, RUNS, CUTS, DUR, STATS)

query("I1_merge_intervals", w(_T, UNION) + "SELECT * FROM merged")(lambda s, d: iv.merge_intervals(ln.turns(s, d), ["meeting_id"]))
query("I2_total_length", w(_T, UNION) + "SELECT meeting_id, sum(end_ms - start_ms)::BIGINT AS total_ms FROM merged GROUP BY 1")(lambda s, d: iv.total_length(iv.merge_intervals(ln.turns(s, d), ["meeting_id"]), ["meeting_id"]))


@query("I3_intersect_intervals", w(_T, _MERGE.format(out="a", keys="meeting_id", src="(SELECT * FROM turns WHERE speaker_label IN ('Person 1', 'Person 2'))"), _MERGE.format(out="b", keys="meeting_id", src="(SELECT * FROM turns WHERE speaker_label = 'Person 3')")) + "SELECT a.meeting_id, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms FROM a JOIN b ON a.meeting_id = b.meeting_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms")
def _(s, d):
    t = ln.turns(s, d)
    one, two = t.filter(F.col("speaker_label").isin("Person 1", "Person 2")), t.filter("speaker_label = 'Person 3'")
    return iv.intersect_intervals(iv.merge_intervals(one, ["meeting_id"]), iv.merge_intervals(two, ["meeting_id"]), ["meeting_id"])


query("I4_speaker_intervals", w(_T, OWN) + "SELECT * FROM own")(lambda s, d: iv.speaker_intervals(ln.turns(s, d)))
query("I5_overlap_by_speaker", w(_T, OWN, SWEEP, OVER) + "SELECT * FROM over")(lambda s, d: iv.overlap_by_speaker(ln.turns(s, d)))
REGIONS = """
sets AS (SELECT s.meeting_id, s.start_ms, s.end_ms, list(o.speaker_label ORDER BY o.speaker_label) AS speakers FROM swept s JOIN own o ON o.meeting_id = s.meeting_id AND o.start_ms < s.end_ms AND s.start_ms < o.end_ms WHERE s.active > 1 GROUP BY 1, 2, 3),
regions AS (SELECT meeting_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(speakers) AS speakers FROM (SELECT *, sum(CASE WHEN le IS NULL OR le <> start_ms OR ls <> speakers THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms) AS le, lag(speakers) OVER (PARTITION BY meeting_id ORDER BY start_ms) AS ls FROM sets)) GROUP BY meeting_id, g)"""
query("I6_overlap_regions", w(_T, OWN, SWEEP, REGIONS) + "SELECT meeting_id, start_ms, end_ms, array_to_string(speakers, ',') AS speakers FROM regions")(lambda s, d: iv.find_overlap_regions(ln.turns(s, d)).withColumn("speakers", F.array_join("speakers", ",")))
query(
    "I7_clip_non_overlapping",
    w(_T) + "SELECT meeting_id, turn_id, speaker_label, greatest(start_ms, coalesce(c, start_ms)) AS start_ms, end_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM turns) WHERE end_ms > greatest(start_ms, coalesce(c, start_ms))",
)(lambda s, d: iv.clip_non_overlapping(ln.turns(s, d), ["meeting_id"], ["start_ms", "turn_id"]))
GAPS = """gaps AS (SELECT meeting_id, speaker_label, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(CASE WHEN r IS NULL OR start_ms - r >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, speaker_label ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY meeting_id, speaker_label ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT DISTINCT meeting_id, speaker_label, start_ms, end_ms FROM turns))) GROUP BY meeting_id, speaker_label, g)"""
query("I8_gap_merge", w(_T, GAPS.format(gap=60000)) + "SELECT * FROM gaps")(lambda s, d: iv.gap_merge(ln.turns(s, d), ["meeting_id", "speaker_label"], 60_000))
_CHUNKS = """lens AS (SELECT meeting_id, max(end_ms) AS duration_ms FROM turns GROUP BY 1),
chunks AS (SELECT meeting_id, duration_ms, c AS chunk, (c * 1795000)::BIGINT AS start_ms, least(c * 1795000 + 1800000, duration_ms)::BIGINT AS end_ms
  FROM (SELECT *, unnest(range(0, greatest(ceil((duration_ms - 5000) / 1795000), 1)::BIGINT))::INT AS c FROM lens)),
owned AS (SELECT *, coalesce(floor((lag(end_ms) OVER w + start_ms) / 2)::BIGINT, start_ms) AS own_start_ms, coalesce(floor((end_ms + lead(start_ms) OVER w) / 2)::BIGINT, end_ms) AS own_end_ms FROM chunks WINDOW w AS (PARTITION BY meeting_id ORDER BY chunk))"""


def _chunks(s, d):
    lens = ln.turns(s, d).groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms"))
    return iv.plan_chunks(lens, 1_800_000, 5_000)


query("I9_plan_chunks", w(_T, _CHUNKS) + "SELECT * FROM chunks")(_chunks)
query("I10_chunk_ownership", w(_T, _CHUNKS) + "SELECT meeting_id, chunk, own_start_ms, own_end_ms FROM owned")(lambda s, d: iv.chunk_ownership(_chunks(s, d)).select("meeting_id", "chunk", "own_start_ms", "own_end_ms"))
_FRAMES = "frames AS (SELECT user_id % 20 AS meeting_id, (epoch_us(ts) // 1000) // 600000 AS frame, max(value) AS energy FROM events GROUP BY 1, 2)"
query(
    "I11_speech_regions",
    w(_FRAMES, """loud AS (SELECT *, lag(frame) OVER (PARTITION BY meeting_id ORDER BY frame) AS l FROM frames WHERE energy >= 40),
isl AS (SELECT meeting_id, min(frame) AS f, max(frame) + 1 AS t FROM (SELECT *, sum(CASE WHEN l IS NULL OR frame - l - 1 >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS g FROM loud) GROUP BY meeting_id, g HAVING max(frame) + 1 - min(frame) >= 3),
cut AS (SELECT *, ceil((t - f) / 30)::BIGINT AS p FROM isl), part AS (SELECT *, unnest(range(0, p)) AS k FROM cut)""")
    + "SELECT meeting_id, ((f + floor((t - f) * k / p)) * 10)::BIGINT AS start_ms, ((f + floor((t - f) * (k + 1) / p)) * 10)::BIGINT AS end_ms FROM part",
)(lambda s, d: iv.speech_regions(ln.table(s, d, "events").groupBy((F.col("user_id") % 20).alias("meeting_id"), F.floor(ln.epoch_ms("ts") / 600_000).alias("frame")).agg(F.max("value").alias("energy")), 40, 6, 3, 30))
_SIL = w(_T, OWN.replace("own AS", "sil AS"), "lens AS (SELECT meeting_id, max(end_ms) + 1000 AS duration_ms FROM turns GROUP BY 1)",
  """metrics AS (SELECT l.meeting_id, l.duration_ms, coalesce(sum(end_ms - start_ms), 0)::BIGINT AS silence_ms, coalesce(max(end_ms) FILTER (start_ms <= 50), 0) AS leading_ms,
  coalesce(max(end_ms - start_ms) FILTER (end_ms >= duration_ms - 50 AND NOT (start_ms <= 50 AND end_ms >= duration_ms - 50)), 0) AS trailing_ms FROM lens l LEFT JOIN sil ON sil.meeting_id = l.meeting_id AND speaker_label = 'Person 1' GROUP BY 1, 2)""")  # fmt: skip


def _silence(s, d):
    t = ln.turns(s, d)
    return iv.silence_metrics(iv.speaker_intervals(t).filter("speaker_label = 'Person 1'"), t.groupBy("meeting_id").agg((F.max("end_ms") + 1000).alias("duration_ms")))


query("I12_silence_metrics", _SIL + "SELECT *, CASE WHEN duration_ms <= 0 THEN 1 ELSE least(silence_ms / duration_ms, 1) END AS silence_ratio FROM metrics")(_silence)
query(
    "I13_quality_warnings",
    "SELECT user_id AS meeting_id, array_to_string(list_filter([CASE WHEN m IS NULL OR m < -40 THEN 'low_volume' END, CASE WHEN p >= -0.1 THEN 'clipping' END, CASE WHEN n < 2000 THEN 'too_short' END, CASE WHEN r > 0.8 THEN 'mostly_silent' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (SELECT user_id, min(value) - 42 AS m, max(value) - 300 AS p, count(*) * 30 AS n, min(value) / 2 AS r FROM events GROUP BY 1)",
)(lambda s, d: iv.quality_warnings(ln.table(s, d, "events").groupBy(F.col("user_id").alias("meeting_id")).agg((F.min("value") - 42).alias("mean_db"), (F.max("value") - 300).alias("peak_db"), (F.count("*") * 30).alias("duration_ms"), (F.min("value") / 2).alias("silence_ratio"))).select("meeting_id", F.array_join("warnings", ",").alias("warnings")))
query("I14_trim_window", _SIL + ", e AS (SELECT *, (leading_ms > 0 OR trailing_ms > 0) AND duration_ms - trailing_ms > leading_ms AS s FROM metrics) SELECT meeting_id, CASE WHEN s THEN leading_ms END AS trim_start_ms, CASE WHEN s THEN duration_ms - trailing_ms END AS trim_end_ms FROM e")(lambda s, d: iv.trim_window(_silence(s, d)).select("meeting_id", "trim_start_ms", "trim_end_ms"))

_R1 = """short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker_label ORDER BY end_ms - start_ms DESC, start_ms, end_ms) AS k, bool_or(end_ms - start_ms >= {least}) OVER (PARTITION BY meeting_id, speaker_label) AS anylong FROM {src}) WHERE end_ms - start_ms >= {least} OR (NOT anylong AND k = 1))"""
query("R1_drop_short_turns", w(_T, _R1.format(least=200000, src="turns")) + "SELECT meeting_id, turn_id, speaker_label, start_ms, end_ms FROM short")(lambda s, d: tn.drop_short_turns(ln.turns(s, d), 200_000))
_R2 = """named AS (SELECT t.*, t.speaker_label AS raw_label, 'Person ' || pk AS person FROM {src} t JOIN (SELECT meeting_id, speaker_label, row_number() OVER (PARTITION BY meeting_id ORDER BY min((start_ms, end_ms, speaker_label))) AS pk FROM {src} GROUP BY 1, 2) USING (meeting_id, speaker_label))"""
query("R2_first_appearance_labels", w(_T, _R2.format(src="turns")) + "SELECT meeting_id, turn_id, raw_label, person AS speaker_label, start_ms, end_ms FROM named")(lambda s, d: tn.first_appearance_labels(ln.turns(s, d)))
query(
    "R3_clean_turns",
    w(_T, GAPS.format(gap=500), _R1.format(least=300, src="gaps"), _R2.format(src="short"), "clean AS (SELECT meeting_id, person AS speaker_label, raw_label, start_ms, end_ms FROM named)", _MERGE.format(out="own", keys="meeting_id, speaker_label", src="clean"), SWEEP, REGIONS)
    + "SELECT *, EXISTS (SELECT 1 FROM regions r WHERE r.meeting_id = clean.meeting_id AND r.start_ms < clean.end_ms AND clean.start_ms < r.end_ms) AS is_overlap FROM clean",
)(lambda s, d: tn.clean_turns(ln.turns(s, d))[0])
query(
    "R4_cosine_similarity",
    "SELECT a.vec_id, round(CASE WHEN sa = 0 OR sb = 0 THEN 0 ELSE dot / (sqrt(sa) * sqrt(sb)) END, 6) AS cosine FROM (SELECT a.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot, list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS sa, list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a",
)(lambda s, d: ln.table(s, d, "embeddings").alias("a").join(ln.table(s, d, "embeddings").alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id"), F.round(tn.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine")))
def _chunked(s, d):
    """A hundred vectors make a meeting of ten chunks, with two segments for each."""
    n = F.col("vec_id")
    voices = ln.table(s, d, "embeddings").select(F.floor(n / 100).alias("meeting_id"), F.floor(n % 100 / 10).alias("chunk"), F.concat(F.lit("S"), (n % 10).cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("emb"), n)
    chunks = voices.select("meeting_id", "chunk").distinct().withColumn("start_ms", F.col("chunk") * 50_000).withColumn("end_ms", F.col("chunk") * 50_000 + 60_000)
    begins = F.explode(F.array(n % 10 * 2_000, n % 10 * 2_000 + 35_000))
    segments = voices.select("meeting_id", "chunk", "label", begins.alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 6_000)
    return chunks, segments, voices.drop("vec_id")


query("R5_relink_chunks")(lambda s, d: tn.relink_segments(*_chunked(s, d)))
query("V1_speaking_time", w(_T, OWN) + "SELECT meeting_id, speaker_label, sum(end_ms - start_ms)::BIGINT AS speaking_ms, min(start_ms) AS first_spoke_ms, max(end_ms) AS last_spoke_ms FROM own GROUP BY 1, 2")(lambda s, d: an.speaking_time(ln.turns(s, d)))
query("V2_floor_runs", w(_T, RUNS) + "SELECT * FROM floor_runs")(lambda s, d: an.floor_runs(ln.turns(s, d)))
query("V3_interruptions", w(_T, CUTS) + "SELECT * FROM cuts")(lambda s, d: an.interruptions(ln.turns(s, d)))
# Two fifths of the texts get a question word, with marks around it, in the middle of what is then said.
_KYA = "\u0915\u094d\u092f\u093e"
_ASKED = f"CASE doc_id % 5 WHEN 0 THEN text || ' ({_KYA}?), so it is' WHEN 1 THEN text || ' {_KYA}\u092a so' ELSE text END"


def _asked(s, d):
    n, text = F.col("doc_id") % 5, F.col("text")
    return ln.table(s, d, "documents").withColumn("t", F.when(n == 0, F.concat(text, F.lit(f" ({_KYA}?), so it is"))).when(n == 1, F.concat(text, F.lit(f" {_KYA}\u092a so"))).otherwise(text))


_EDGE = "[" + "".join("\\" + c if c.isascii() else c for c in tx.STRIPPED) + "]+"
_QWORDS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in tx.QUESTION_WORDS) + "]"
query("V4_is_question", rf"SELECT doc_id, regexp_matches(t, '[?？]\s*$') OR len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: list_contains({_QWORDS}, regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g')))) > 0 AS is_question FROM (SELECT doc_id, {_ASKED} AS t FROM documents)")(
    lambda s, d: _asked(s, d).select("doc_id", tx.is_question(F.col("t")).alias("is_question"))
)


def _listed(frame, column):
    """Languages as text, so that they compare."""
    return frame.withColumn(column, F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["language"], x["ms"].cast("string"), F.format_string("%.9f", F.bround(x["share"], 9)))), ","))


def _stats(s, d):
    t, u = _both(s, d)
    return an.speaker_stats(t, u, an.meeting_durations(t, u))


def half_even(part: str, total: str, digits: int) -> str:
    """SQL of a ratio of whole numbers in units of its last decimal, half-even on the ratio itself: ``printf`` and ``round_even`` go by
    the double next to it, which is not half where the ratio is."""
    q, r = f"(abs({part})::HUGEINT * {10**digits} // ({total}))", f"(abs({part})::HUGEINT * {10**digits} % ({total}))"
    return f"(sign({part})::HUGEINT * ({q} + CASE WHEN 2 * {r} > ({total}) OR 2 * {r} = ({total}) AND {q} % 2 = 1 THEN 1 ELSE 0 END))"


_NINE = half_even("ms", "t", 9)
_TEXT = f"CASE WHEN t > 0 THEN CASE WHEN {_NINE} < 0 THEN '-' ELSE '' END || abs({_NINE}) // 1000000000 || '.' || lpad((abs({_NINE}) % 1000000000)::VARCHAR, 9, '0') ELSE '0.000000000' END"
_SHARE = f"string_agg(language || ':' || ms || ':' || {_TEXT}, ',' ORDER BY ms DESC, language)"
_LB = f"lb AS (SELECT meeting_id, speaker AS speaker_label, {_SHARE} AS language_breakdown FROM (SELECT *, sum(ms) OVER (PARTITION BY meeting_id, speaker) AS t FROM (SELECT meeting_id, speaker, primary_language AS language, sum(end_ms - start_ms)::BIGINT AS ms FROM utterances WHERE speaker <> 'Unknown' AND primary_language IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1, 2)"
_LD = f"ld AS (SELECT meeting_id, {_SHARE} AS language_distribution FROM (SELECT *, sum(ms) OVER (PARTITION BY meeting_id) AS t FROM (SELECT meeting_id, primary_language AS language, sum(end_ms - start_ms)::BIGINT AS ms FROM utterances WHERE speaker <> 'Unknown' AND primary_language IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)"
_V5 = "SELECT stats.*, coalesce(language_breakdown, '') AS language_breakdown FROM stats LEFT JOIN lb USING (meeting_id, speaker_label)"
query("V5_speaker_stats", w(*FULL, _LB) + _V5)(lambda s, d: _listed(_stats(s, d), "language_breakdown"))
query("V5_speaker_stats_conversations", w(_U, UTURNS, OWN, UNION, SWEEP, OVER, RUNS, CUTS, DUR, STATS, _LB) + _V5)(lambda s, d: _listed(an.speaker_stats(*_talk(s, d), an.meeting_durations(*_talk(s, d))), "language_breakdown"))
query("V6_gini", w(*FULL, GINI) + "SELECT meeting_id, num_speakers, gini FROM gi")(lambda s, d: an.gini(_stats(s, d)))
query("V7_participation_balance", w(*FULL, GINI) + f"SELECT meeting_id, {BALANCE.format(n='num_speakers', g='gini')} AS balance FROM gi")(lambda s, d: an.gini(_stats(s, d)).select("meeting_id", an.participation_balance(F.col("gini"), F.col("num_speakers")).alias("balance")))
query(
    "V8_timeline",
    w(_T, BOTH, OWN, DUR, "grid AS (SELECT *, unnest(range(0, ceil(duration_ms / 3600000)::BIGINT)) AS b FROM durations WHERE duration_ms > 0)")
    + """SELECT g.meeting_id, p.speaker_label, g.b * 3600000 AS start_ms, least((g.b + 1) * 3600000, g.duration_ms) AS end_ms,
  coalesce((SELECT sum(least(o.end_ms, (g.b + 1) * 3600000, g.duration_ms) - greatest(o.start_ms, g.b * 3600000)) FROM own o WHERE o.meeting_id = g.meeting_id AND o.speaker_label = p.speaker_label AND o.start_ms < least((g.b + 1) * 3600000, g.duration_ms) AND o.end_ms > g.b * 3600000), 0)::BIGINT AS speaking_ms
FROM grid g JOIN (SELECT DISTINCT meeting_id, speaker_label FROM own) p USING (meeting_id)""",
)(lambda s, d: an.timeline(ln.turns(s, d), an.meeting_durations(*_both(s, d)), 3_600_000))
_SW = "sw AS (SELECT meeting_id, count(*) FILTER (l <> primary_language) AS switches FROM (SELECT *, lag(primary_language) OVER (PARTITION BY meeting_id ORDER BY start_ms, utterance_index) AS l FROM utterances WHERE primary_language IS NOT NULL AND speaker <> 'Unknown') GROUP BY 1)"
query("V9_language_switches", w(_U, _SW) + "SELECT * FROM sw")(lambda s, d: an.utterance_language_switches(ln.utterances(s, d)))
MSTATS = """
sp AS (SELECT meeting_id, sum(end_ms - start_ms)::BIGINT AS speech_ms, coalesce(sum(end_ms - start_ms) FILTER (active > 1), 0)::BIGINT AS overlap_ms, sum((end_ms - start_ms) * active)::BIGINT AS summed_ms FROM swept GROUP BY 1),
mo AS (SELECT meeting_id, count(*) - 1 AS turn_switches, max((end_ms - start_ms, -start_ms, speaker_label)) AS m FROM floor_runs GROUP BY 1),
sd AS (SELECT meeting_id, count(*) AS u, sum(n_words)::BIGINT AS w FROM utterances WHERE speaker <> 'Unknown' GROUP BY 1),
od AS (SELECT meeting_id, min((-x, speaker_label)) AS f, max((-x, speaker_label)) AS l FROM cs GROUP BY 1),
mstats AS (SELECT d.meeting_id, duration_ms, coalesce(speech_ms, 0) AS speech_ms, greatest(duration_ms - coalesce(speech_ms, 0), 0) AS silence_ms,
  CASE WHEN duration_ms > 0 THEN greatest(duration_ms - coalesce(speech_ms, 0), 0) / duration_ms ELSE 0 END AS silence_ratio, coalesce(num_speakers, 0) AS num_speakers, coalesce(u, 0) AS total_utterances, coalesce(w, 0) AS total_words,
  coalesce(turn_switches, 0) AS turn_switches, coalesce(overlap_ms, 0) AS overlap_ms, CASE WHEN speech_ms > 0 THEN overlap_ms / speech_ms ELSE 0 END AS overlap_ratio, greatest(coalesce(summed_ms, 0) - coalesce(speech_ms, 0), 0) AS double_counted_ms,
  coalesce(gini, 0) AS gini, {balance} AS balance, CASE WHEN f[1] < 0 THEN f[2] END AS dominant_speaker, CASE WHEN f[1] < 0 THEN l[2] END AS least_active_speaker, coalesce(switches, 0) AS language_switches,
  m[3] AS monologue_speaker, -(m[2]) AS monologue_start_ms, m[1] AS monologue_ms
  FROM durations d LEFT JOIN sp USING (meeting_id) LEFT JOIN mo USING (meeting_id) LEFT JOIN sd USING (meeting_id) LEFT JOIN od USING (meeting_id) LEFT JOIN gi USING (meeting_id) LEFT JOIN sw USING (meeting_id))""".replace("{balance}", BALANCE.format(n="coalesce(num_speakers, 0)", g="coalesce(gini, 0)"))


def _mstats(s, d):
    t, u = _both(s, d)
    return an.meeting_stats(t, u, an.meeting_durations(t, u))


_V10 = "SELECT mstats.*, coalesce(language_distribution, '') AS language_distribution FROM mstats LEFT JOIN ld USING (meeting_id)"
query("V10_meeting_stats", w(*FULL, GINI, _SW, MSTATS, _LD) + _V10)(lambda s, d: _listed(_mstats(s, d), "language_distribution"))
query("V10_meeting_stats_conversations", w(_U, UTURNS, OWN, UNION, SWEEP, OVER, RUNS, CUTS, DUR, STATS, GINI, _SW, MSTATS, _LD) + _V10)(lambda s, d: _listed(an.meeting_stats(*_talk(s, d), an.meeting_durations(*_talk(s, d))), "language_distribution"))


# Language regions of two thirds of the meetings, and of some of their speakers: turns, each in a language by its number.
_REGION = """rg AS (SELECT meeting_id, CASE WHEN turn_id % 7 > 0 THEN speaker_label END AS speaker, start_ms, end_ms, ['en', 'hi', 'or'][1 + turn_id % 3] AS language FROM turns WHERE meeting_id % 3 > 0 AND end_ms > start_ms AND speaker_label <> 'Person 2'),
rsw AS (SELECT meeting_id, count(*) FILTER (l <> language) AS n FROM (SELECT *, lag(language) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, language) AS l FROM rg) GROUP BY 1),
rs AS (SELECT meeting_id, speaker, language, sum(end_ms - start_ms)::BIGINT AS ms FROM rg GROUP BY 1, 2, 3),"""
_RLD = f"rld AS (SELECT meeting_id, {_SHARE} AS v FROM (SELECT *, sum(ms) OVER (PARTITION BY meeting_id) AS t FROM (SELECT meeting_id, language, sum(ms)::BIGINT AS ms FROM rs GROUP BY 1, 2)) GROUP BY 1), rlb AS (SELECT meeting_id, speaker, {_SHARE} AS v FROM (SELECT *, sum(ms) OVER (PARTITION BY meeting_id, speaker) AS t FROM rs WHERE speaker IS NOT NULL) GROUP BY 1, 2)"


def _report(s, d):
    t, u = _both(s, d)
    n = F.col("turn_id")
    rows = t.filter("meeting_id % 3 > 0 AND end_ms > start_ms AND speaker_label <> 'Person 2'")
    regions = rows.select("meeting_id", F.when(n % 7 > 0, F.col("speaker_label")).alias("speaker"), "start_ms", "end_ms", F.element_at(F.array(F.lit("en"), F.lit("hi"), F.lit("or")), (1 + n % 3).cast("int")).alias("language"))
    return an.conversation_analytics(t, u, regions=regions)


query("V11_conversation_analytics", w(*FULL, GINI, _SW, MSTATS, _LD, _REGION + _RLD) + """SELECT m.meeting_id, duration_ms, speech_ms, balance, coalesce(rsw.n, language_switches) AS language_switches, coalesce(rld.v, ld.language_distribution, '') AS language_distribution
FROM mstats m LEFT JOIN ld USING (meeting_id) LEFT JOIN rld USING (meeting_id) LEFT JOIN rsw USING (meeting_id)""")(
    lambda s, d: _listed(_report(s, d)["meetings"].select("meeting_id", "duration_ms", "speech_ms", "balance", "language_switches", "language_distribution"), "language_distribution")
)
query("V11_speaker_languages", w(*FULL, _LB, _REGION + _RLD) + """SELECT s.meeting_id, s.speaker_label, speaking_ms, num_turns, coalesce(rlb.v, lb.language_breakdown, '') AS language_breakdown
FROM stats s LEFT JOIN lb USING (meeting_id, speaker_label) LEFT JOIN rlb ON rlb.meeting_id = s.meeting_id AND rlb.speaker = s.speaker_label""")(
    lambda s, d: _listed(_report(s, d)["speakers"].select("meeting_id", "speaker_label", "speaking_ms", "num_turns", "language_breakdown"), "language_breakdown")
)


@query("V12_analytics_context", w(*FULL, GINI, _SW, MSTATS) + """SELECT m.meeting_id, printf('duration %.0fs, %d speakers, balance: %s, dominant speaker: %s', duration_ms / 1000, num_speakers, balance, coalesce(dominant_speaker, '-'))
|| coalesce((SELECT chr(10) || string_agg(printf('%s: %.0fs (%.0f%% of speech), %d words, %d questions', speaker_label, speaking_ms / 1000, 100 * share_of_speech, word_count, questions_asked), chr(10) ORDER BY -round_even(speaking_ms / 10, 0), speaker_label) FROM stats s WHERE s.meeting_id = m.meeting_id), '') AS context FROM mstats m""")
def _(s, d):
    t, u = _both(s, d)
    dur = an.meeting_durations(t, u)
    stats = an.speaker_stats(t, u, dur)
    return an.analytics_context(an.meeting_stats(t, u, dur, stats=stats), stats)

# All events as one meeting, scanned in slices; the SQL has one window over it.
_ONE, SLICE_MS = ln.SQL["one_meeting"], 600_000


def _sliced(f):
    return lambda s, d: f(ln.one_meeting(s, d))


query("I1_merge_intervals_one_meeting", w(_ONE, UNION) + "SELECT * FROM merged")(_sliced(lambda t: iv.merge_intervals(t, ["meeting_id"], slice_ms=SLICE_MS)))
query("I5_overlap_one_meeting", w(_ONE, OWN, SWEEP, OVER) + "SELECT * FROM over")(_sliced(lambda t: iv.overlap_by_speaker(t, slice_ms=SLICE_MS)))
query("I6_overlap_regions_one_meeting", w(_ONE, OWN, SWEEP, REGIONS) + "SELECT meeting_id, start_ms, end_ms, array_to_string(speakers, ',') AS speakers FROM regions")(
    _sliced(lambda t: iv.find_overlap_regions(t, slice_ms=SLICE_MS).withColumn("speakers", F.array_join("speakers", ",")))
)
query("I8_gap_merge_one_meeting", w(_ONE, GAPS.format(gap=60000)) + "SELECT * FROM gaps")(_sliced(lambda t: iv.gap_merge(t, ["meeting_id", "speaker_label"], 60_000, slice_ms=SLICE_MS)))
query("V2_floor_runs_one_meeting", w(_ONE, RUNS) + "SELECT * FROM floor_runs")(_sliced(lambda t: an.floor_runs(t, slice_ms=SLICE_MS)))
