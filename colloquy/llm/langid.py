"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, each rotated by its
place; a text's vector bundles (adds) those of its trigrams, a language's prototype those of its texts. A text has
the language whose prototype is nearest by cosine.

Letters are lower-cased; runs of other characters are one boundary letter. Letters beyond a-z and Latin-1 share
``SLOTS - 60`` vectors by their code point.

Learning uses at most about ``PER_LANGUAGE`` labelled texts of a language, drawn by a hash of doc_id (the bound that
keeps the fit small), each with the same weight. Prediction runs over every row.

Edge cases: text that is null or has no letter is ``und`` with score 0, as is all text when nothing was learned;
equal cosines go to the first language by name; a negative cosine scores 0. Null labels and rows without doc_id are
not learned from. Repeated rows count each time. Columns besides stay; a result name that is taken gets underscores
in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, small_batches

#: Components of a vector; letter vectors; the seed that both sides of a run share.
DIM, SLOTS, SEED = 512, 128, 20_240_607
#: Labelled texts of a language to learn from, on average at most.
PER_LANGUAGE = 4_000
#: Trigram vectors that a worker keeps; others are made anew for each text.
KEPT = 8_192


@cache
def _known() -> np.ndarray:
    """The letter vector of each code point met so far, 0 for the boundary; -1 where it is not worked out yet."""
    return np.full(0x110000, -1, dtype=np.int16)


def _slots(points: np.ndarray) -> np.ndarray:
    known = _known()
    out = known[points]
    if (out < 0).any():
        for cp in np.unique(points[out < 0]).tolist():
            letter = not 0xD800 <= cp < 0xE000 and chr(cp).isalpha()
            known[cp] = 0 if not letter else cp - 96 if 97 <= cp <= 122 else 27 + cp - 0xDF if 0xDF <= cp <= 0xFF else 60 + cp * 2654435761 % (1 << 32) % (SLOTS - 60)
        out = known[points]
    return out.astype(np.int32)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.float32), (SLOTS, DIM))
    return np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one


def vectors(codes: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return first[codes // (SLOTS * SLOTS)] * second[codes // SLOTS % SLOTS] * third[codes % SLOTS]


def trigrams(text: str | None) -> np.ndarray:
    """Codes of all trigrams of a text, a boundary at either end; none if it has no letter."""
    s = _slots(np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4"))
    if not s.any():
        return np.zeros(0, dtype=np.int32)
    s = np.concatenate([[0], s, [0]])
    s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
    return s[:-2] * (SLOTS * SLOTS) + s[1:-1] * SLOTS + s[2:]


class Bundler:
    """Bundles trigram counts into text vectors and keeps the vectors of the first ``KEPT`` trigrams that it meets."""

    def __init__(self) -> None:
        self.codes = np.zeros(0, dtype=np.int32)  # sorted
        self.rows = np.zeros(0, dtype=np.int32)
        self.table = np.zeros((0, DIM), dtype=np.float32)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code in the table, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rows[at], -1)

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at = self._places(codes)
        new = codes[at < 0][: KEPT - len(self.codes)]
        if len(new):
            n = len(self.codes)
            if n + len(new) > len(self.table):
                more = np.zeros((min(KEPT, max(2 * (n + len(new)), 1024)), DIM), dtype=np.float32)
                more[:n] = self.table[:n]
                self.table = more
            self.table[n : n + len(new)] = vectors(new)
            both = np.concatenate([self.codes, new.astype(np.int32)])
            order = np.argsort(both, kind="stable")
            self.rows = np.concatenate([self.rows, np.arange(n, n + len(new), dtype=np.int32)])[order]
            self.codes = both[order]
            at = self._places(codes)
        known = at >= 0
        out = weights[known] @ self.table[at[known]]
        if not known.all():
            rest, w = codes[~known], weights[~known]
            for k in range(0, len(rest), 4096):
                out = out + w[k : k + 4096] @ vectors(rest[k : k + 4096])
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes by language: of each, ``DIM`` numbers reach the driver."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull())
    sizes = rows.groupBy(lang_col).count().collect()
    if not sizes:
        return {}
    part = F.create_map(*[x for r in sizes for x in (F.lit(r[lang_col]), F.lit(min(1.0, per_language / r["count"])))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part[F.col(lang_col)] * (1 << 30)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes = trigrams(text)
                if len(codes):
                    seen, n = np.unique(codes, return_counts=True)
                    held.setdefault(lang, []).append((seen, np.rint(1e6 * n / len(codes)).astype(np.int64)))  # whole numbers: sums do not depend on order
            for lang, own in held.items():
                seen, place = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
                sums = np.zeros(len(seen), dtype=np.int64)
                np.add.at(sums, place, np.concatenate([n for _, n in own]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(sums, pa.int64())], names=["lang", "code", "n"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, codes, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "code", "n"))
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                for k in range(0, len(own), 4096):
                    some = own[k : k + 4096]
                    sums[lang] = sums.get(lang, 0.0) + n[some].astype(np.float64) @ vectors(codes[some])  # whole numbers, exact
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(range(DIM), pa.int32()), pa.array(np.rint(own).astype(np.int64))], names=["lang", "place", "n"])

    totals = drawn.mapInArrow(give_back(count), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = totals.mapInArrow(give_back(bundle), "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    out: dict[str, np.ndarray] = {}
    for r in got:
        out.setdefault(r["lang"], np.zeros(DIM))[r["place"]] = r["n"]
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language and the cosine of every whole text."""
    lang_out, score_out = (free_name(docs.columns, n) for n in (lang_out, score_out))
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    unit = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]).reshape(len(names), DIM)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(text_col).to_pylist():
                codes = trigrams(text)
                lang, score = "und", 0.0
                if len(codes) and names:
                    seen, n = np.unique(codes, return_counts=True)
                    own = bundler.bundle(seen, n.astype(np.float32)).astype(np.float64)
                    cosines = unit @ own / (np.linalg.norm(own) or 1)
                    best = int(np.argmax(cosines))
                    lang, score = names[best], float(min(1.0, max(0.0, cosines[best])))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(give_back(run), schema)
