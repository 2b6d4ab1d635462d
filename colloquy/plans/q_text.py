"""Queries of language smoothing, transcript cleaning and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import language as lg
from ..operators import transcript as tr
from ..sources import sinks as sk
from . import lenses as ln
from .q_analytics import BOTH, FULL, _both, _stats, half_even, w

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_L = ln.SQL["lid_windows"]
_S = ln.SQL["segments"]
_U = ln.SQL["utterances"]
_T = ln.SQL["turns"]
_lid = ln.lid_windows
_seg = ln.segments


def _scores(s, d):
    return ln.table(s, d, "documents").select("doc_id", "n_chars", F.create_map(F.lit("en"), (F.col("doc_id") % 7 - 2).cast("double"), F.lit("hi"), (F.col("doc_id") % 5 - 1).cast("double"), F.lit("fr"), F.lit(1.0)).alias("scores"))


_SC = "sc AS (SELECT doc_id, n_chars, greatest((doc_id % 7 - 2)::DOUBLE, 0) AS en, greatest((doc_id % 5 - 1)::DOUBLE, 0) AS hi FROM documents), rs AS (SELECT *, CASE WHEN en + hi > 0 THEN en / (en + hi) ELSE 0.5::DOUBLE END AS pe, CASE WHEN en + hi > 0 THEN hi / (en + hi) ELSE 0.5::DOUBLE END AS ph FROM sc)"
query("L1_restrict_scores", w(_SC) + "SELECT doc_id, pe AS en, ph AS hi FROM rs")(lambda s, d: _scores(s, d).withColumn("r", lg.restrict_scores(F.col("scores"), ["en", "hi"])).select("doc_id", F.col("r")[0]["score"].alias("en"), F.col("r")[1]["score"].alias("hi")))
query("L2_predict", w(_SC) + "SELECT doc_id, CASE WHEN n_chars < 400 OR pe >= ph THEN 'en' ELSE 'hi' END AS language, CASE WHEN n_chars < 400 THEN 0.5::DOUBLE ELSE greatest(pe, ph) END AS confidence, n_chars < 400 OR greatest(pe, ph) < 0.5 AS uncertain FROM rs")(lambda s, d: _scores(s, d).withColumn("p", lg.predict(lg.restrict_scores(F.col("scores"), ["en", "hi"]), F.col("n_chars"))).select("doc_id", "p.language", "p.confidence", "p.uncertain"))
query("L3_candidate_languages", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en,hi,fr' END AS candidates FROM documents")(lambda s, d: ln.table(s, d, "documents").select("doc_id", F.array_join(lg.candidate_languages(F.array("lang"), ["en", "hi", "fr"]), ",").alias("candidates")))
query(
    "L4_windows_from_turns",
    w(_T, "p AS (SELECT *, ceil((end_ms - start_ms) / 15000)::BIGINT AS parts FROM turns WHERE end_ms > start_ms), q AS (SELECT *, unnest(range(0, parts)) AS k FROM p)")
    + "SELECT meeting_id, speaker_label AS speaker, start_ms + floor((end_ms - start_ms) * k / parts + 0.5)::BIGINT AS start_ms, start_ms + floor((end_ms - start_ms) * (k + 1) / parts + 0.5)::BIGINT AS end_ms FROM q",
)(lambda s, d: lg.windows_from_turns(ln.turns(s, d), ln.turns(s, d).groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms"))))
_DOM = "dom AS (SELECT meeting_id, language, ms FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ms DESC, language) AS k FROM (SELECT meeting_id, language, sum(end_ms - start_ms)::BIGINT AS ms FROM {src} WHERE NOT uncertain AND language IS NOT NULL GROUP BY 1, 2)) WHERE k = 1)"
query("L5_dominant_language", w(_L, _DOM.format(src="lid_windows")) + "SELECT * FROM dom")(lambda s, d: lg.dominant_language(_lid(s, d), ["meeting_id"]))
_INH = """heir AS (SELECT meeting_id, seq, l FROM (SELECT b.meeting_id, b.seq, t.l, t.ms - CASE WHEN NOT b.uncertain AND b.language = t.l THEN b.end_ms - b.start_ms ELSE 0 END AS rest,
    row_number() OVER (PARTITION BY b.meeting_id, b.seq ORDER BY t.ms - CASE WHEN NOT b.uncertain AND b.language = t.l THEN b.end_ms - b.start_ms ELSE 0 END DESC, t.l) AS k
  FROM lid_windows b JOIN (SELECT meeting_id, speaker, language AS l, sum(end_ms - start_ms)::BIGINT AS ms FROM lid_windows WHERE NOT uncertain GROUP BY 1, 2, 3) t ON t.meeting_id = b.meeting_id AND t.speaker IS NOT DISTINCT FROM b.speaker
  WHERE b.end_ms - b.start_ms < 1500 AND b.confidence < 0.75 AND t.ms - CASE WHEN NOT b.uncertain AND b.language = t.l THEN b.end_ms - b.start_ms ELSE 0 END > 0) WHERE k = 1),
inh AS (SELECT b.meeting_id, b.seq, b.start_ms, b.end_ms, b.speaker, coalesce(h.l, b.language) AS language, b.confidence, CASE WHEN h.l IS NOT NULL THEN false ELSE b.uncertain END AS uncertain FROM lid_windows b LEFT JOIN heir h USING (meeting_id, seq))"""
query("L6_inherit_short_windows", w(_L, _INH) + "SELECT * FROM inh")(lambda s, d: lg.inherit_short_windows(_lid(s, d)))
def _laid(s, d):
    """Language windows of which some reach into those behind them."""
    return _lid(s, d).withColumn("end_ms", F.col("end_ms") + F.col("seq") % 4 * 6000)


_LAID = "lid_windows AS (SELECT * REPLACE (end_ms + seq % 4 * 6000 AS end_ms) FROM lid_bare)"
_LL = (_L.replace("lid_windows AS", "lid_bare AS", 1), _LAID)
# Of all confident windows of the speaker: the smallest gap, then those that begin before the window, then the first.
_RES = _DOM.format(src="inh") + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, seq) AS i, NOT uncertain AND language IS NOT NULL AS sure FROM inh),
near AS (SELECT meeting_id, seq, l FROM (SELECT u.meeting_id, u.seq, c.language AS l, row_number() OVER (PARTITION BY u.meeting_id, u.seq ORDER BY greatest(0, c.start_ms - u.end_ms, u.start_ms - c.end_ms), CASE WHEN c.start_ms < u.start_ms THEN 0 ELSE 1 END, c.i) AS k
  FROM pos u JOIN pos c ON c.meeting_id = u.meeting_id AND c.speaker IS NOT DISTINCT FROM u.speaker AND c.sure AND c.seq <> u.seq WHERE NOT u.sure) WHERE k = 1),
res AS (SELECT u.meeting_id, u.seq, u.start_ms, u.end_ms, u.speaker, CASE WHEN u.sure THEN u.language ELSE coalesce(n.l, d.language, 'en') END AS language, u.confidence, false AS uncertain FROM pos u LEFT JOIN near n USING (meeting_id, seq) LEFT JOIN dom d ON d.meeting_id = u.meeting_id)"""
query("L7_resolve_uncertain", w(*_LL, _INH, _RES) + "SELECT * FROM res")(lambda s, d: lg.resolve_uncertain(lg.inherit_short_windows(_laid(s, d))))
# Runs of one speaker and language are cut where the reach of the run so far ends too early, with confidences folded in order.
_FOLD = """, ord AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, seq) AS i FROM res),
fold AS (WITH RECURSIVE f AS (SELECT meeting_id, i, speaker, language, start_ms AS s, end_ms AS e, confidence::DOUBLE AS c, 1 AS g FROM ord WHERE i = 1 UNION ALL
  SELECT o.meeting_id, o.i, o.speaker, o.language, CASE WHEN j THEN f.s ELSE o.start_ms END, CASE WHEN j THEN greatest(f.e, o.end_ms) ELSE o.end_ms END,
    CASE WHEN NOT j THEN o.confidence::DOUBLE WHEN (f.e - f.s) + (o.end_ms - o.start_ms) > 0 THEN (f.c * (f.e - f.s) + o.confidence * (o.end_ms - o.start_ms)) / ((f.e - f.s) + (o.end_ms - o.start_ms)) ELSE o.confidence::DOUBLE END, CASE WHEN j THEN f.g ELSE f.g + 1 END
  FROM f JOIN (SELECT * FROM ord) o ON o.meeting_id = f.meeting_id AND o.i = f.i + 1, LATERAL (SELECT o.speaker IS NOT DISTINCT FROM f.speaker AND o.language = f.language AND o.start_ms - f.e <= 500) AS t(j)) SELECT * FROM f),
adj AS (SELECT meeting_id, speaker, language, s AS start_ms, e AS end_ms, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, g ORDER BY i DESC) AS k FROM fold) WHERE k = 1)"""
query("L8_merge_adjacent", w(*_LL, _INH, _RES + _FOLD) + "SELECT meeting_id, speaker, language, start_ms, end_ms, round(confidence, 6) AS confidence FROM adj")(lambda s, d: lg.smooth(_laid(s, d)).withColumn("confidence", F.round("confidence", 6)))
_REG = """, reg AS (SELECT meeting_id, speaker, language, greatest(start_ms, coalesce(c, start_ms)) AS start_ms, end_ms, confidence FROM (SELECT *, max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM adj) WHERE end_ms > greatest(start_ms, coalesce(c, start_ms)))"""
query("L9_smooth_regions", w(*_LL, _INH, _RES + _FOLD + _REG) + "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM reg")(lambda s, d: lg.regions(lg.smooth(_laid(s, d))).withColumn("confidence", F.round("confidence", 6)))
_SH = "SELECT meeting_id, language, ms, CASE WHEN sum(ms) OVER (PARTITION BY meeting_id) > 0 THEN ms / sum(ms) OVER (PARTITION BY meeting_id) ELSE 0 END AS share, row_number() OVER (PARTITION BY meeting_id ORDER BY ms DESC, language)::INT AS rank FROM (SELECT meeting_id, language, sum(end_ms - start_ms)::BIGINT AS ms FROM lid_windows GROUP BY 1, 2)"
query("L10_language_shares", w(_L) + _SH)(lambda s, d: lg.language_shares(_lid(s, d), ["meeting_id"]))
def _named(languages):
    return F.array_join(F.transform(languages, lambda x: F.concat(x["language"], F.lit(":"), x["ms"].cast("string"))), ",")


_SWP = "sp AS (SELECT * FROM (SELECT meeting_id, start_ms AS at_ms, lag(language) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, language NULLS FIRST, speaker NULLS FIRST) AS from_language, language AS to_language, speaker FROM lid_windows) WHERE from_language <> to_language)"
query("L11_switch_points", w(_L, _SWP) + "SELECT * FROM sp")(lambda s, d: lg.switch_points(_lid(s, d)))
_SPK = "sk AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY ms DESC, language) AS rank FROM (SELECT meeting_id, coalesce(speaker, 'unknown') AS speaker, language, sum(end_ms - start_ms)::BIGINT AS ms FROM lid_windows GROUP BY 1, 2, 3)), ss AS (SELECT meeting_id, string_agg(speaker || '=' || l, ';' ORDER BY coalesce(try_cast(nullif(regexp_extract(speaker, '([0-9]+)$', 1), '') AS INT), 1 << 30), speaker) AS speakers FROM (SELECT meeting_id, speaker, string_agg(language || ':' || ms, ',' ORDER BY rank) AS l FROM sk GROUP BY 1, 2) GROUP BY 1)"
query("L12_language_summary", w(_L, _SWP, f"sh AS ({_SH})", _SPK) + "SELECT s.meeting_id, any_value(language) FILTER (rank = 1) AS dominant, string_agg(language || ':' || ms, ',' ORDER BY rank) AS languages, list(round(share, 9) ORDER BY rank) AS shares, (SELECT count(*) FROM sp WHERE sp.meeting_id = s.meeting_id) AS num_switches, any_value(speakers) AS speakers FROM sh s JOIN ss ON ss.meeting_id = s.meeting_id GROUP BY 1")(
    lambda s, d: lg.language_summary(_lid(s, d)).select("meeting_id", "dominant", _named(F.col("languages")).alias("languages"), F.transform("languages", lambda x: F.round(x["share"], 9)).alias("shares"), "num_switches", F.array_join(F.transform("speakers", lambda x: F.concat(x["speaker"], F.lit("="), _named(x["languages"]))), ";").alias("speakers"))
)
# A batch takes the next region of its language while its span stays within 30 s; confidences are weighed by what regions last.
_BATCH = """, rn AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms) AS i FROM reg),
bat AS (WITH RECURSIVE f AS (SELECT meeting_id, i, language, start_ms AS s, end_ms AS e, confidence::DOUBLE AS c, (end_ms - start_ms)::DOUBLE AS wt, 1 AS b FROM rn WHERE i = 1 UNION ALL
  SELECT r.meeting_id, r.i, r.language, CASE WHEN j THEN f.s ELSE r.start_ms END, CASE WHEN j THEN greatest(f.e, r.end_ms) ELSE r.end_ms END, CASE WHEN j AND f.wt + (r.end_ms - r.start_ms) > 0 THEN (f.c * f.wt + r.confidence * (r.end_ms - r.start_ms)) / (f.wt + (r.end_ms - r.start_ms)) ELSE r.confidence::DOUBLE END,
    CASE WHEN j THEN f.wt + (r.end_ms - r.start_ms) ELSE (r.end_ms - r.start_ms)::DOUBLE END, CASE WHEN j THEN f.b ELSE f.b + 1 END
  FROM f JOIN (SELECT * FROM rn) r ON r.meeting_id = f.meeting_id AND r.i = f.i + 1, LATERAL (SELECT r.language = f.language AND r.end_ms - f.s <= 30000) AS t(j)) SELECT * FROM f)"""
query("L13_batch_regions", w(*_LL, _INH, _RES + _FOLD + _REG + _BATCH) + "SELECT meeting_id, language, s AS start_ms, e AS end_ms, round(c, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, b ORDER BY i DESC) AS k FROM bat) WHERE k = 1")(
    lambda s, d: lg.batch_regions(lg.regions(lg.smooth(_laid(s, d)))).withColumn("confidence", F.round("confidence", 6))
)
query("L14_route_by_language", w(_L) + "SELECT meeting_id, seq, CASE language WHEN 'en' THEN 'large' WHEN 'fr' THEN 'latin' ELSE 'general' END AS backend, language IN ('en', 'fr') AS supported FROM lid_windows")(lambda s, d: lg.route_by_language(_lid(s, d), {"en": "large", "fr": "latin"}, "general").select("meeting_id", "seq", "backend", "supported"))

query("T1_normalize_text", r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS h FROM documents")(lambda s, d: ln.table(s, d, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("h")))
_CMP = r"trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}]', ' ', 'g')), '\s+', ' ', 'g'))"
query("T2_comparable", f"SELECT doc_id, md5({_CMP}) AS h FROM documents")(lambda s, d: ln.table(s, d, "documents").select("doc_id", F.md5(tx.comparable(F.col("text"))).alias("h")))
query("T3_compression_ratio")(lambda s, d: ln.table(s, d, "documents").select("doc_id", tx.compression_ratio(F.col("text")).alias("ratio")))
_FILL = "[" + ", ".join(f"'{x}'" for x in tx.FILLERS) + "]"
_INVENT = "[" + ", ".join(f"'{x}'" for x in tx.INVENTED) + "]"
_ISFILL = f"(len(list_filter(string_split(c, ' '), lambda x: x <> '' AND NOT list_contains({_FILL}, x))) = 0 OR list_contains({_INVENT}, c))"
query("T4_is_filler_only", f"SELECT doc_id, {_ISFILL} AS filler FROM (SELECT doc_id, {_CMP} AS c FROM documents)")(lambda s, d: ln.table(s, d, "documents").select("doc_id", tx.is_filler_only(tx.comparable(F.col("text"))).alias("filler")))
query("T4_filler_lines", f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_ISFILL}) AS n_filler FROM (SELECT doc_id, {_CMP} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)) GROUP BY 1")(
    lambda s, d: ln.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", tx.is_filler_only(tx.comparable(F.col("line"))).alias("f")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("f"), 1)).alias("n_filler"))
)
_T5 = f"""t5a AS (SELECT *, {_CMP} AS c FROM segments),
t5b AS (SELECT *, CASE WHEN c = '' THEN 'empty' WHEN no_speech_prob >= 0.6 AND {_ISFILL} THEN 'filler_in_silence' WHEN compression_ratio > 2.4 AND length(text) >= 20 THEN 'compression_ratio' END AS r FROM t5a),
t5 AS (SELECT *, coalesce(r, CASE WHEN r IS NULL AND lag(c) OVER (PARTITION BY meeting_id, r IS NULL ORDER BY start_ms, end_ms, id) = c THEN 'repeated' END) AS dropped FROM t5b)"""
query("T5_filter_hallucinations", w(_S, _T5) + "SELECT meeting_id, id, dropped FROM t5")(lambda s, d: tr.filter_hallucinations(_seg(s, d)).select("meeting_id", "id", "dropped"))
query("T6_flag_low_confidence", w(_S) + "SELECT meeting_id, id, avg_confidence < 0.5 AS low_confidence FROM segments")(lambda s, d: tr.flag_low_confidence(_seg(s, d)).select("meeting_id", "id", "low_confidence"))
query("T7_shift", w(_S) + "SELECT meeting_id, id, start_ms + 5000 AS start_ms, end_ms + 5000 AS end_ms FROM segments")(lambda s, d: tr.shift(_seg(s, d), F.lit(5000)).select("meeting_id", "id", "start_ms", "end_ms"))


@query("T8_merge_chunk_transcripts")
def _(s, d):
    from ..operators import intervals as iv

    seg = _seg(s, d)
    chunks = iv.chunk_ownership(iv.plan_chunks(seg.groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms")), 600_000, 60_000))
    met = seg.join(chunks.select("meeting_id", "chunk", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce")), "meeting_id").filter("start_ms < ce AND cs < end_ms")
    return tr.merge_chunk_transcripts(met.select("meeting_id", "chunk", "id", "start_ms", "end_ms", "text"), chunks)


query("T9_renumber", w(_S) + "SELECT meeting_id, id, (row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, id) - 1)::INT AS new_id FROM segments")(lambda s, d: tr.renumber(_seg(s, d)).select("meeting_id", "id", "new_id"))
query("T10_language_durations", w(_S) + "SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ms DESC, language)::INT AS rank FROM (SELECT meeting_id, coalesce(language, 'unknown') AS language, sum(end_ms - start_ms)::BIGINT AS ms FROM segments GROUP BY 1, 2)")(lambda s, d: tr.language_durations(_seg(s, d)))
query(
    "T11_approximate_words",
    w(_S, r"""wd AS (SELECT meeting_id, id, start_ms AS s, end_ms AS e, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT *, list_filter(regexp_split_to_array(trim(text, e' \n\t'), '\s+'), lambda x: x <> '') AS l FROM segments WHERE end_ms > start_ms)),
ac AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY meeting_id, id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS u, sum(length(word) + 1) OVER (PARTITION BY meeting_id, id)::BIGINT AS t FROM wd)""")
    + "SELECT meeting_id, id, pos::INT AS pos, word, s + floor((e - s) * (u - length(word) - 1) / t + 0.5)::BIGINT AS start_ms, s + floor((e - s) * u / t + 0.5)::BIGINT AS end_ms FROM ac",
)(lambda s, d: tr.approximate_words(_seg(s, d), ["meeting_id", "id"]))
query("T12_finalize_transcript")(lambda s, d: tr.finalize_transcript(_seg(s, d)).drop("words"))


@query("T12_transcript_report")
def _(s, d):
    seg = _seg(s, d)
    return tr.transcript_report(seg, tr.finalize_transcript(seg)).withColumn("detected_languages", F.to_json("detected_languages"))



# A third of the documents is seen in Devanagari or Odia letters, word by word.
_ROMAN, _DEVA, _ORYA = "aeiounrtklm", "\u0905\u090f\u0907\u0913\u0909\u0928\u0930\u0924\u0915\u0932\u092e", "\u0b05\u0b0f\u0b07\u0b13\u0b09\u0b28\u0b30\u0b24\u0b15\u0b32\u0b2e"
_SEEN = f"CASE WHEN doc_id % 6 = 1 THEN translate(text, '{_ROMAN}', '{_DEVA}') WHEN doc_id % 6 = 2 THEN translate(text, '{_ROMAN}', '{_ORYA}') ELSE text END"
_WORDS = rf"docs AS (SELECT * REPLACE ({_SEEN} AS text) FROM documents), wd AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(text, e' \n\t'), '\s+'), lambda x: x <> '')) AS word FROM docs)"
_LATN = r"length(regexp_replace(word, '[^\p{Latin}]', '', 'g'))"
_DEV = r"length(regexp_replace(regexp_replace(word, '[^\x{0900}-\x{097F}]', '', 'g'), '[^\p{L}\p{M}]', '', 'g'))"
_ORI = r"length(regexp_replace(regexp_replace(word, '[^\x{0B00}-\x{0B7F}]', '', 'g'), '[^\p{L}\p{M}]', '', 'g'))"
_LM = r"length(regexp_replace(word, '[^\p{L}\p{M}]', '', 'g'))"
_SCRIPT = f"sc AS (SELECT *, CASE WHEN lm = 0 THEN NULL WHEN dv = top THEN 'Deva' WHEN la = top THEN 'Latn' WHEN ori = top THEN 'Orya' ELSE 'Other' END AS script FROM (SELECT *, greatest(dv, la, ori, lm - dv - la - ori) AS top FROM (SELECT *, {_LM} AS lm, {_DEV} AS dv, {_LATN} AS la, {_ORI} AS ori FROM wd)))"


def _seen(s, d):
    n, text = F.col("doc_id") % 6, F.col("text")
    return ln.table(s, d, "documents").withColumn("text", F.when(n == 1, F.translate(text, _ROMAN, _DEVA)).when(n == 2, F.translate(text, _ROMAN, _ORYA)).otherwise(text)).withColumnRenamed("lang", "language")


query("C1_script_of", w(_WORDS, _SCRIPT) + "SELECT doc_id, script, count(*) AS n FROM sc GROUP BY 1, 2")(lambda s, d: _seen(s, d).select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("word")).select("doc_id", tx.script_of(F.col("word")).alias("script")).groupBy("doc_id", "script").agg(F.count("*").alias("n")))
_HI = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys(tx.ROMAN_HINDI)) + "]"
_OR = "[" + ", ".join(f"'{x}'" for x in tx.ROMAN_ODIA) + "]"
_KEY = r"lower(regexp_replace(word, '\P{L}', '', 'g'))"
_TAG = _SCRIPT + f", tg AS (SELECT *, CASE script WHEN 'Deva' THEN 'hi' WHEN 'Orya' THEN 'or' WHEN 'Latn' THEN CASE WHEN list_contains({_HI}, {_KEY}) THEN 'hi-Latn' WHEN list_contains({_OR}, {_KEY}) THEN 'or-Latn' ELSE 'en' END END AS tag FROM sc)"
query("C2_word_language", w(_WORDS, _TAG) + "SELECT doc_id, coalesce(tag, '-') AS tag, count(*) AS n FROM tg GROUP BY 1, 2")(lambda s, d: tr.tagged_words(_seen(s, d), ["doc_id"]).groupBy("doc_id", F.coalesce("word_language", F.lit("-")).alias("tag")).agg(F.count("*").alias("n")))
_MIX = """ct AS (SELECT doc_id, split_part(tag, '-', 1) AS lang, count(*) AS n FROM tg WHERE tag IS NOT NULL GROUP BY 1, 2),
mx AS (SELECT d.doc_id, any_value(d.lang) AS fallback, min((-n, NOT coalesce(ct.lang = d.lang, false), ct.lang)) FILTER (ct.lang IS NOT NULL) AS b, list(ct.lang ORDER BY ct.lang) FILTER (ct.lang IS NOT NULL) AS langs, sum(n)::BIGINT AS t FROM documents d LEFT JOIN ct ON ct.doc_id = d.doc_id GROUP BY 1),
cm AS (SELECT doc_id, coalesce(b[3], fallback) AS primary_language, array_to_string(coalesce(langs, [fallback]), ',') AS languages_present, coalesce(len(langs), 0) > 1 AS is_code_mixed, CASE WHEN t > 0 THEN 1 + b[1] / t ELSE 0 END AS code_mix_ratio FROM mx)"""


def _mix(s, d):
    docs = _seen(s, d)
    return tr.code_mix(tr.tagged_counts(docs, ["doc_id"]), docs, ["doc_id"]).withColumn("languages_present", F.array_join("languages_present", ","))


query("C3_code_mix_stats", w(_WORDS, _TAG, _MIX) + "SELECT * FROM cm")(_mix)
query("C4_tag_segment", w(_WORDS, _TAG, _MIX) + "SELECT doc_id, source, primary_language, is_code_mixed FROM documents JOIN cm USING (doc_id)")(lambda s, d: tr.tag_segments(_seen(s, d), ["doc_id"]).select("doc_id", "source", "primary_language", "is_code_mixed"))
# Punctuation is set apart first, so that joining has something to do.
query("A6_join_words", r"""SELECT doc_id, md5(array_to_string(list_transform(l, lambda x, i: CASE WHEN i > 1 AND NOT regexp_full_match(x, '\p{P}+') THEN ' ' || x ELSE x END), '')) AS h
FROM (SELECT doc_id, list_filter(string_split(regexp_replace(replace(text, chr(10), ' '), '([.,;:!?])', ' \1 ', 'g'), ' '), lambda x: x <> '') AS l FROM documents)""")(
    lambda s, d: ln.table(s, d, "documents").select("doc_id", F.md5(tx.join_words(F.split(F.regexp_replace(F.translate("text", "\n", " "), "([.,;:!?])", " $1 "), " "))).alias("h"))
)
query("A7_ends_sentence", r"""SELECT doc_id, regexp_matches(text, '[.?!।॥]["'')\]}»”’]*$') AS ends FROM documents""")(lambda s, d: ln.table(s, d, "documents").select("doc_id", tx.ends_sentence(F.col("text")).alias("ends")))

_TS = "lpad((greatest({0}, 0) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((greatest({0}, 0) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((greatest({0}, 0) // 1000 % 60)::VARCHAR, 2, '0') || '{1}' || lpad((greatest({0}, 0) % 1000)::VARCHAR, 3, '0')"
_HMS = "left(" + _TS.format("{0}", ",") + ", 8)"
query("K2_format_timestamp", w(_T) + f"SELECT turn_id, {_TS.format('start_ms - 1000', ',')} AS srt, {_TS.format('end_ms', '.')} AS vtt, {_HMS.format('end_ms')} AS hms FROM turns")(lambda s, d: ln.turns(s, d).select("turn_id", tx.timestamp(F.col("start_ms") - 1000).alias("srt"), tx.timestamp(F.col("end_ms"), ".").alias("vtt"), tx.hms(F.col("end_ms")).alias("hms")))
_CUE = "k || chr(10) || " + _TS.format("start_ms", ",") + " || ' --> ' || " + _TS.format("greatest(end_ms, start_ms + 1)", ",") + " || chr(10) || {body} || chr(10)"
query("K3_segments_srt", w(_S) + f"SELECT meeting_id, md5(string_agg({_CUE.format(body='text')}, chr(10) ORDER BY k)) AS srt FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, id) AS k FROM segments) GROUP BY 1")(lambda s, d: sk.segments_srt(_seg(s, d)).withColumn("srt", F.md5("srt")))
query("K3_segments_text", w(_S) + f"SELECT meeting_id, md5(string_agg('[' || {_TS.format('start_ms', '.')} || '] (' || language || ') ' || text || chr(10), '' ORDER BY start_ms, id)) AS text FROM segments GROUP BY 1")(lambda s, d: sk.segments_text(_seg(s, d)).withColumn("text", F.md5("text")))
query("K4_utterances_text", w(_U) + f"SELECT meeting_id, md5(string_agg('[' || {_HMS.format('start_ms')} || ' - ' || {_HMS.format('end_ms')} || '] ' || speaker || ': ' || text || chr(10), '' ORDER BY start_ms, utterance_index)) AS text FROM utterances GROUP BY 1")(lambda s, d: sk.utterances_text(ln.utterances(s, d)).withColumn("text", F.md5("text")))
_NUM = "(SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, utterance_index) AS k FROM utterances)"
_BODY = "speaker || ': ' || text"
query("K4_utterances_srt", w(_U) + f"SELECT meeting_id, md5(string_agg({_CUE.format(body=_BODY)}, chr(10) ORDER BY k)) AS srt FROM {_NUM} GROUP BY 1")(lambda s, d: sk.utterances_srt(ln.utterances(s, d)).withColumn("srt", F.md5("srt")))
_VTT = _TS.format("start_ms", ".") + " || ' --> ' || " + _TS.format("greatest(end_ms, start_ms + 1)", ".") + " || chr(10) || '<v ' || speaker || '>' || text || chr(10)"
query("K4_utterances_vtt", w(_U) + f"SELECT meeting_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg({_VTT}, chr(10) ORDER BY k)) AS vtt FROM {_NUM} GROUP BY 1")(lambda s, d: sk.utterances_vtt(ln.utterances(s, d)).withColumn("vtt", F.md5("vtt")))
query(
    "K5_utterances_markdown",
    w(_U) + f"SELECT meeting_id, md5('# Transcript' || chr(10) || chr(10) || string_agg(CASE WHEN l IS NULL OR l <> speaker THEN '**' || speaker || '** · ' || {_HMS.format('start_ms')} || chr(10) || chr(10) ELSE '' END || text || chr(10), chr(10) ORDER BY k)) AS markdown FROM (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY k) AS l FROM {_NUM}) GROUP BY 1",
)(lambda s, d: sk.utterances_markdown(ln.utterances(s, d)).withColumn("markdown", F.md5("markdown")))
# Seconds and percentages are half-even on their two decimals, percentages by the whole numbers that they are ratios of.
_SEC = lambda c: f"round_even({c} / 10, 0) / 100"
_PCT = lambda a, b: f"CASE WHEN {b} > 0 THEN {half_even(a, b, 4)}::DOUBLE / 100 ELSE 0 END"
_LANGS = f"string_agg(language || ':' || {_PCT('ms', 't')}, ';' ORDER BY ms DESC, language)"
_KL = f"kl AS (SELECT meeting_id, speaker AS speaker_label, {_LANGS} AS languages FROM (SELECT *, sum(ms) OVER (PARTITION BY meeting_id, speaker) AS t FROM (SELECT meeting_id, speaker, primary_language AS language, sum(end_ms - start_ms)::BIGINT AS ms FROM utterances WHERE primary_language IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1, 2)"
query("K1_speakers_csv", w(*FULL, _KL) + f"""SELECT meeting_id, speaker_label AS speaker, speaker_label AS display_name, {_SEC('speaking_ms')} AS speaking_time_seconds, {_PCT('speaking_ms', 'speech.t')} AS speaking_time_percent_of_speech, {_PCT('speaking_ms', 'duration_ms')} AS speaking_time_percent_of_meeting,
num_segments, {_PCT('num_segments', 'sum(num_segments) OVER (PARTITION BY meeting_id)')} AS segment_share_percent, num_turns, {_SEC('longest_ms')} AS longest_utterance_seconds, {_SEC('longest_start_ms')} AS longest_utterance_start, {_SEC('longest_end_ms')} AS longest_utterance_end, word_count,
{_SEC('first_spoke_ms')} AS first_spoke_at, {_SEC('last_spoke_ms')} AS last_spoke_at, interruptions_made, interruptions_received, {_SEC('overlap_ms')} AS overlap_seconds, questions_asked, coalesce(languages, '') AS languages FROM stats LEFT JOIN kl USING (meeting_id, speaker_label) LEFT JOIN speech USING (meeting_id) LEFT JOIN durations USING (meeting_id)""")(
    lambda s, d: sk.speakers_table(_stats(s, d), _both(s, d)[1]).drop("avg_utterance_seconds", "median_utterance_seconds", "words_per_minute")
)
