"""Text expressions on columns. Word lists, patterns and formats are fixed values that results depend on."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fillers, and phrases that recognisers invent over silence.
FILLERS = ("uh", "um", "umm", "hmm", "hm", "mm", "mhm", "ah", "eh", "oh", "er", "हम्म", "उम्म", "अं", "हूं", "ହଁ", "ହମ୍")
INVENTED = ("thanks for watching", "thank you for watching", "please subscribe", "subscribe to my channel", "like and subscribe", "subtitles by the amaraorg community")

# Frequent romanized words.
ROMAN_HINDI = """
hai hain tha thi hoga hogi honge kya kyun kyon kaise kaisa kab kahan kaun
nahi nahin mat aur lekin magar ya phir abhi kal parso aaj kyunki isliye
mein mujhe mera meri mere hum humein hamara aap aapka aapki tum tumhara
yeh woh wahi yahi kuch sab sabhi bahut bohot zyada kam thoda accha acha
achha theek thik haan ji karo karna karenge karega karegi kiya kiye raha
rahe rahi gaya gayi gaye chahiye sakte sakta sakti baje wala wali wale
matlab chalo dekho bolo samjha samjhe samajh kaam paisa paise log baat
bataiye batao dijiye kijiye hoon hua hui hue lagta lagti jaldi abhi
""".split()
ROMAN_ODIA = """
mu mote mora tume tumara apana apananka ame amara tanka kemiti
kana kahinki kebe kouthi achi achhi achhe nahanti heba hela hebani
karibi karibe karuchi karuchhi kariba jiba jibi asiba asuchi bhala kichhi
sabu ebe kalire aji sathire pakhare bhitare upare kahuchi kahibe
dekhibe bujhila bujhili hau
""".split()

# Question words, and what is stripped around a word.
QUESTION_WORDS = (
    "क्या", "क्यों", "कैसे", "कब", "कहाँ", "कहां", "कौन", "कौनसा", "कितना", "कितने", "कितनी",
    "କଣ", "କ'ଣ", "କ’ଣ", "କି", "କାହିଁକି", "କିପରି", "କେମିତି", "କେବେ", "କେଉଁଠି", "କିଏ", "କେତେ",
)
STRIPPED = '.,;:!?"()[]“”‘।॥'

# Injection patterns, first match wins. They look at NFC text in lower case.
INJECTIONS = (
    ("en_ignore_instructions", r"\b(ignore|disregard|forget|override)\b.{0,30}\b(previous|prior|above|earlier|all|your)\b.{0,20}\b(instructions?|prompts?|rules)\b"),
    ("en_system_prompt", r"\b(system|developer|hidden)\s+(prompt|message|instructions?)"),
    ("en_role_change", r"\b(you are now|act as|pretend to be|jailbreak|dan mode)\b"),
    ("en_output_control", r"\b(respond|reply|output|return)\b.{0,20}\b(only|exactly)\b.{0,30}\b(json|text|with)\b"),
    ("hi_ignore_instructions", r"(पिछले|पुराने|सभी|ऊपर के)?\s*(निर्देश|निर्देशों|आदेश)\S*\s*(को\s*)?(अनदेखा|नज़रअंदाज़|नजरअंदाज|भूल)"),
    ("hi_system_prompt", r"सिस्टम\s*(प्रॉम्प्ट|प्रांप्ट|संदेश)"),
    ("hi_romanized", r"\b(pichhle|pichle|saare|sabhi)\s+(instructions?|nirdesh)\b.{0,20}\b(ignore|bhool|bhul)|\b(instructions?|nirdesh)\s+(ko\s+)?(ignore|bhool|bhul)\s*(karo|kar do|jao)"),
    ("or_ignore_instructions", r"(ପୂର୍ବ|ପୂର୍ବର|ସମସ୍ତ)?\s*ନିର୍ଦ୍ଦେଶ\S*\s*(କୁ\s*)?(ଅଣଦେଖା|ଉପେକ୍ଷା|ଭୁଲି)"),
    ("or_system_prompt", r"ସିଷ୍ଟମ\s*(ପ୍ରମ୍ପ୍ଟ|ପ୍ରମ୍ପଟ|ବାର୍ତ୍ତା)"),
)

# Cues of the rule-based extractor.
DECISION = r"(?iU)\b(agreed|decided|final)\b|सहमत|तय|ରାଜି|ସ୍ଥିର"
ACTION = r"(?iU)\b(will|i'll|going to)\b|करेंगे|करूंगा|करूँगा|भेजूंगा|भेज दूंगा|କରିବି|ପଠାଇବି|କରିବେ"
DUE = r"(?iU)(\b(?:tomorrow|today|kal|parso|agle hafte|next week|by eod|eod|monday|tuesday|wednesday|thursday|friday)\b|कल|परसों|अगले हफ्ते|शुक्रवार|ଆସନ୍ତାକାଲି|ଶୁକ୍ରବାର)"
TOPIC = r"(?iU)\b(item|agenda|topic)\b|मुद्दा|ବିଷୟ"

_SPACES = r"(?U)\s+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(strip(text), _SPACES), "")


#: Texts that are Python strings at a time; a batch of long texts has many times its size as such.
_AT_ONCE = 128


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    """Most texts are in NFC as they are, and pass as Arrow memory."""
    parts = []
    for i in range(0, len(text), _AT_ONCE):
        part = text.slice(i, _AT_ONCE)
        plain = part.to_pylist()
        if not all(t is None or unicodedata.is_normalized("NFC", t) for t in plain):
            part = pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in plain], part.type)
        parts.append(part)
    return pa.concat_arrays(parts) if parts else text


def nfc(text: Column) -> Column:
    """NFC; Python sees only texts with characters beyond ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, _SPACES, " "))


def normalize(text: Column) -> Column:
    """NFC with white space collapsed and stripped; the script stays."""
    return squeeze(nfc(text))


def comparable(text: Column) -> Column:
    """Letters, marks and digits in lower case; everything else is white space."""
    return squeeze(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]", " ")))


@F.pandas_udf(T.ArrayType(T.LongType()))
def running_sums(values: pd.Series) -> pd.Series:
    """Sums of each array up to each of its elements, which are longs."""
    return values.map(lambda v: None if v is None else np.cumsum(v, dtype=np.int64))


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Bytes over zlib-compressed bytes; 0 for no text."""
    data = text.fillna("").map(lambda t: t.encode())
    return data.map(lambda b: len(b) / len(zlib.compress(b)) if b else 0.0)


def is_filler_only(comparable_text: Column) -> Column:
    words = tokens(comparable_text)
    return F.forall(words, lambda w: w.isin(*FILLERS)) | comparable_text.isin(*INVENTED)


def _count(word: Column, pattern: str) -> Column:
    return F.regexp_count(word, F.lit(pattern))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def script_of(word: Column) -> Column:
    """Script of most letters and marks (the first by name on ties); null without any. ASCII words need no counting."""
    counts = F.struct(
        _count(word, r"[\x{0900}-\x{097F}&&[\p{L}\p{M}]]").alias("deva"),
        _count(word, r"[\x{0B00}-\x{0B7F}&&[\p{L}\p{M}]]").alias("orya"),
        _count(word, r"[\p{IsLatin}&&[\p{L}]]").alias("latn"),
        _count(word, r"[\p{L}\p{M}]").alias("all"),
    )
    return F.when(is_ascii(word), F.when(F.upper(word) != F.lower(word), "Latn")).otherwise(_let(counts, _script))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _script(c: Column) -> Column:
    other = c["all"] - c["deva"] - c["orya"] - c["latn"]
    best = F.greatest(c["deva"], c["orya"], c["latn"], other)
    return F.when(best > 0, F.when(c["deva"] == best, "Deva").when(c["latn"] == best, "Latn").when(c["orya"] == best, "Orya").otherwise("Other"))


#: ASCII characters that are no letters.
_NO_LETTERS = "".join(c for c in map(chr, range(128)) if not c.isalpha())


def _roman(word: Column) -> Column:
    """Language of a word in Latin script, by its letters alone."""
    plain = F.translate(F.lower(word), _NO_LETTERS, "")
    key = F.when(is_ascii(word), plain).otherwise(F.lower(F.regexp_replace(word, r"\P{L}", "")))
    return F.when(key.isin(*ROMAN_HINDI), "hi-Latn").when(key.isin(*ROMAN_ODIA), "or-Latn").otherwise("en")


def word_language(word: Column, script: Column | None = None) -> Column:
    """``script``: where it is a column already; it is worked out for words beyond ASCII only."""
    if script is not None:
        return F.when(script == "Deva", "hi").when(script == "Orya", "or").when(script == "Latn", _roman(word))
    return _word_language(word)


# Letters in Latin script, first and last of each range.
_RANGES = (
    (0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2B8), (0x2E0, 0x2E4), (0x1D00, 0x1D25), (0x1D2C, 0x1D5C), (0x1D62, 0x1D65), (0x1D6B, 0x1D77),
    (0x1D79, 0x1DBE), (0x1E00, 0x1EFF), (0x2071, 0x2071), (0x207F, 0x207F), (0x2090, 0x209C), (0x212A, 0x212B), (0x2132, 0x2132), (0x214E, 0x214E), (0x2183, 0x2184), (0x2C60, 0x2C7F),
    (0xA722, 0xA787), (0xA78B, 0xA7BF), (0xA7C2, 0xA7CA), (0xA7F5, 0xA7FF), (0xAB30, 0xAB5A), (0xAB5C, 0xAB64), (0xAB66, 0xAB69), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A),
)
_LATIN = frozenset(chr(c) for a, b in _RANGES for c in range(a, b + 1))

_HINDI, _ODIA, _DROPPED = frozenset(ROMAN_HINDI), frozenset(ROMAN_ODIA), {ord(c): None for c in _NO_LETTERS}


class _Classes(dict):
    """What a character counts as: letters and marks by script (d, o, l, and x for others; a mark of Latin is other), the rest not at all."""

    def __missing__(self, o: int) -> str | None:
        c = chr(o)
        kind = unicodedata.category(c)[0]
        of = None if kind not in "LM" else "d" if 0x900 <= o <= 0x97F else "o" if 0xB00 <= o <= 0xB7F else "l" if kind == "L" and c in _LATIN else "x"
        self[o] = of
        return of


_CLASSES = _Classes()
#: Words beyond ASCII whose language is kept.
_KEPT = 1 << 16


@lru_cache(_KEPT)
def _language_beyond_ascii(word: str) -> str | None:
    classes = word.translate(_CLASSES)
    counts = [classes.count(x) for x in "dlox"]
    best = max(counts)
    script = "dlox"[counts.index(best)] if best else "x"
    if script == "l":
        key = "".join(c for c in word if unicodedata.category(c)[0] == "L").lower()
        return "hi-Latn" if key in _HINDI else "or-Latn" if key in _ODIA else "en"
    return {"d": "hi", "o": "or"}.get(script)


def language_of(word: str) -> str | None:
    """Language of a word by its letters: as ``_roman`` of the ``script_of`` a word in Latin script."""
    if not word.isascii():
        return _language_beyond_ascii(word)
    key = word.lower().translate(_DROPPED)
    return None if not key else "hi-Latn" if key in _HINDI else "or-Latn" if key in _ODIA else "en"


#: White space of ``str.split`` that is none of ``tokens``; it has no letters, so that it may be any other sign.
_NO_SPACE = re.compile(r"[\x1c-\x1f]")
#: What is no letter of an ASCII text, but for its white space.
_SPACED = {o: None for o in _DROPPED if not chr(o).isspace() or 0x1C <= o <= 0x1F}


def _counts(text: str) -> dict[str, int]:
    """How many words are of each language; words in ASCII are told all at once."""
    beyond: Counter = Counter()
    if not text.isascii():
        words = _NO_SPACE.sub("_", text).split()
        beyond.update(map(_language_beyond_ascii, (w for w in words if not w.isascii())))
        text = " ".join(w for w in words if w.isascii())
    keys = text.lower().translate(_SPACED).split()
    hindi, odia = sum(map(_HINDI.__contains__, keys)), sum(map(_ODIA.__contains__, keys))
    beyond.update({"hi-Latn": hindi, "or-Latn": odia, "en": len(keys) - hindi - odia})
    return {k: n for k, n in beyond.items() if n and k is not None}


@F.arrow_udf(T.StringType())
def _word_language(word: pa.Array) -> pa.Array:
    return pa.array([None if w is None else language_of(w) for w in word.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("word_language", T.StringType()), T.StructField("n", T.LongType())])))
def language_counts(text: pa.Array) -> pa.Array:
    """How many of a text's ``tokens`` are of each ``word_language``; those of none are left out."""
    kind = pa.list_(pa.struct([("word_language", pa.string()), ("n", pa.int64())]))
    parts = []
    for i in range(0, len(text), _AT_ONCE):
        counts = (_counts(t) if t else {} for t in text.slice(i, _AT_ONCE).to_pylist())
        parts.append(pa.array([[{"word_language": k, "n": n} for k, n in c.items()] for c in counts], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def is_question(text: Column) -> Column:
    """Ends in a question mark, or holds a Hindi or Odia question word."""
    bare = strip(text)
    edge = "[" + "".join("\\" + c for c in STRIPPED) + "]+"
    words = F.transform(F.split(bare, _SPACES), lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", ""))
    return F.coalesce(bare.rlike("[?？]$") | F.exists(words, lambda w: w.isin(*QUESTION_WORDS)), F.lit(False))


def join_words(words: Column) -> Column:
    """Words with spaces between, but none before punctuation."""
    return F.regexp_replace(F.array_join(F.array_remove(words, ""), " "), r" (\p{P}+)(?= |$)", "$1")


def ends_sentence(word: Column) -> Column:
    return word.rlike(r"[.?!।॥][\"')\]}»”’]*$")


def timestamp(ms: Column, marker: str = ",") -> Column:
    """HH:MM:SS,mmm; negative times are 0."""
    t = F.greatest(ms.cast("long"), F.lit(0))
    part = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    hours = F.floor(t / 3_600_000)
    shown = F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("long").cast("string"))
    return F.concat(shown, F.lit(":"), part(F.floor(t / 60_000) % 60, 2), F.lit(":"), part(F.floor(t / 1000) % 60, 2), F.lit(marker), part(t % 1000, 3))


def hms(ms: Column) -> Column:
    return F.regexp_replace(timestamp(ms), r",\d+$", "")


def sanitize(text: Column) -> Column:
    """One line without angle brackets."""
    return squeeze(F.translate(text, "<>", "‹›"))


def format_line(utterance_id: Column, start_ms: Column, speaker: Column, language: Column, text: Column) -> Column:
    return F.concat(F.lit("[u"), utterance_id.cast("string"), F.lit("]["), hms(start_ms), F.lit("]["), speaker, F.lit("]["), F.coalesce(language, F.lit("-")), F.lit("] "), sanitize(text))


def estimate_tokens(text: Column) -> Column:
    """A quarter token for an ASCII character, a half for others, rounded up."""
    other = F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))
    return F.ceil((F.length(text) + other) / 4)


def injection(text: Column) -> Column:
    """The first injection pattern that a text matches; null if none."""
    low = F.lower(nfc(text))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(INJECTIONS):
        out = F.when(low.rlike("(?U)" + pattern), name).otherwise(out)
    return out


def short(text: Column, n: int) -> Column:
    """The first ``n`` words without end marks."""
    return F.regexp_replace(F.array_join(F.slice(tokens(text), 1, n), " "), "[.,।?!]+$", "")
