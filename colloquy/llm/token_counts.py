"""Token counts of parts of documents by offset-mapped attribution.

Each whole text is encoded once. The tokens' spans are joined with the spans of the document's sections by binary
search, and a token that crosses a boundary is allotted by one of these rules:

* ``start``: to the sections that hold its first byte's character;
* ``most``: to the sections that hold its middle, so to the one that holds most of it (a tie goes to the later one);
* ``share``: to each section by the part of its bytes that lies there (counts are then fractions).

Without a sections column the sections are the lines, each with the line feed that ends it, so that they cover the
document and their counts add up to its tokens.

Edge cases: a null or empty text is one empty line without tokens; null or empty section lists give no rows, spans
are cut to the text and null ends count as its end; sections may overlap; every input row counts by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import default_path, vocabulary
from .common import give_back, small_batches

RULES = ("start", "most", "share")


def allot(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [start, end); all in bytes of the text."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    if rule == "share":
        upto = lambda x: np.interp(x, bounds, np.arange(len(bounds)))
        return upto(ends) - upto(starts)
    at = 2 * bounds[:-1] + (lengths if rule == "most" else 0)
    return np.searchsorted(at, 2 * ends) - np.searchsorted(at, 2 * starts)


def attribute(docs: DataFrame, text_col: str = "text", sections_col: str | None = None, rule: str = "start", path: str | None = None) -> DataFrame:
    """Per document and section: doc_id, section (from 0), start and end (characters), n_tokens.

    ``sections_col`` is an array of structs with ``start`` and ``end`` in characters.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    path = path or default_path()
    kind = T.DoubleType() if rule == "share" else T.LongType()
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", kind)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            sections = batch.column(sections_col).to_pylist() if sections_col else None
            parts: list[tuple[np.ndarray, ...]] = []
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                text = text or ""
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                firsts = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each character
                if sections is None:
                    ends = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
                    starts = np.append(0, ends[:-1])
                    chars = np.searchsorted(firsts, np.stack([starts, ends]))
                else:
                    own = sections[i] or []
                    n = len(firsts)
                    chars = np.array([[min(max(s["start"] or 0, 0), n) for s in own], [n if s["end"] is None else min(max(s["end"], 0), n) for s in own]], dtype=np.int64)
                    chars[1] = np.maximum(chars[0], chars[1])
                    starts, ends = np.append(firsts, len(raw))[chars]
                parts.append((np.full(len(starts), i), np.arange(len(starts)), chars[0], chars[1], allot(bpe.lengths[bpe.encode(text)], starts, ends, rule)))
            if not parts:
                continue
            row, section, start, end, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(section, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                    pa.array(n, pa.float64() if rule == "share" else pa.int64()),
                ],
                names=schema.names,
            )

    return docs.select("doc_id", text_col, *([sections_col] if sections_col else [])).mapInArrow(give_back(run), schema)
