"""The per-row expressions as SQL functions of a session, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import strings as st
from . import text as tx


def _words(values) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def _tested(patterns: tuple[tuple[str, str], ...]) -> str:
    return " ".join(f"WHEN rlike(lower(nfc(text)), r'(?U){p}') THEN '{name}'" for name, p in patterns)


_SCRIPTS = (("Deva", r"[\x{0900}-\x{097F}&&[\p{L}\p{M}]]"), ("Latn", r"[\p{IsLatin}&&[\p{L}]]"), ("Orya", r"[\x{0B00}-\x{0B7F}&&[\p{L}\p{M}]]"))

#: What is stripped around a word, as a class of a pattern.
_EDGE = "[" + "".join("\\" + c for c in tx.STRIPPED) + "]+"

#: Functions with a body in SQL: name and parameters, type, body.
NATIVE = (
    ("colloquy_timestamp(ms BIGINT, marker STRING)", "STRING", "concat(CASE WHEN greatest(ms, 0) < 360000000 THEN lpad(string(greatest(ms, 0) div 3600000), 2, '0') ELSE string(greatest(ms, 0) div 3600000) END, ':', lpad(string(greatest(ms, 0) div 60000 % 60), 2, '0'), ':', lpad(string(greatest(ms, 0) div 1000 % 60), 2, '0'), marker, lpad(string(greatest(ms, 0) % 1000), 3, '0'))"),
    ("normalize_text(text STRING)", "STRING", r"regexp_replace(regexp_replace(nfc(text), r'(?U)\s+', ' '), r'(?U)^\s+|\s+$', '')"),
    ("comparable_text(text STRING)", "STRING", r"regexp_replace(regexp_replace(lower(regexp_replace(text, r'[^\p{L}\p{M}\p{N}]', ' ')), r'(?U)\s+', ' '), r'(?U)^\s+|\s+$', '')"),
    ("is_filler_only(text STRING)", "BOOLEAN", f"forall(array_remove(split(text, ' '), ''), w -> w IN ({_words(tx.FILLERS)})) OR text IN ({_words(tx.INVENTED)})"),
    ("estimate_tokens(text STRING)", "BIGINT", r"ceil((length(text) + regexp_count(text, r'[^\x00-\x7F]')) / 4)"),
    ("word_script(word STRING)", "STRING", "CASE WHEN regexp_count(word, r'[\\p{L}\\p{M}]') = 0 THEN NULL " + " ".join(f"WHEN regexp_count(word, r'{p}') >= greatest({', '.join(f'regexp_count(word, {chr(114)}{chr(39)}{q}{chr(39)})' for _, q in _SCRIPTS)}, regexp_count(word, r'[\\p{{L}}\\p{{M}}]') - {' - '.join(f'regexp_count(word, {chr(114)}{chr(39)}{q}{chr(39)})' for _, q in _SCRIPTS)}) THEN '{name}'" for name, p in _SCRIPTS) + " ELSE 'Other' END"),
    ("word_language(word STRING)", "STRING", f"CASE word_script(word) WHEN 'Deva' THEN 'hi' WHEN 'Orya' THEN 'or' WHEN 'Latn' THEN CASE WHEN lower(regexp_replace(word, r'\\P{{L}}', '')) IN ({_words(tx.ROMAN_HINDI)}) THEN 'hi-Latn' WHEN lower(regexp_replace(word, r'\\P{{L}}', '')) IN ({_words(tx.ROMAN_ODIA)}) THEN 'or-Latn' ELSE 'en' END END"),
    ("is_question(text STRING)", "BOOLEAN", f"coalesce(rlike(text, r'[?？](?U)\\s*$') OR exists(transform(split(text, r'(?U)\\s+'), w -> regexp_replace(w, r'^{_EDGE}|{_EDGE}$', '')), w -> w IN ({_words(tx.QUESTION_WORDS)})), false)"),
    ("injection_pattern(text STRING)", "STRING", f"CASE {_tested(tx.INJECTIONS)} END"),
)
#: Functions that run as Arrow-batched Python.
PYTHON = {"nfc": tx._nfc, "compression_ratio": tx.compression_ratio, "token_set_similarity": st.token_set_similarity, "partial_similarity": st.partial_similarity, "word_edits": st.word_edits}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, f in PYTHON.items():
        spark.udf.register(name, f)
    for head, kind, body in NATIVE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [*PYTHON, *(head.split("(")[0] for head, _, _ in NATIVE)]
