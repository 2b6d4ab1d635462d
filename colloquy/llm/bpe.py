"""BPE encoding and decoding of whole documents.

Texts up to ``leaf`` characters are encoded as they are. A longer one is cut into leaves, which are dealt to
tasks and encoded in parallel; then neighbours are joined pairwise, up a tree. What a cut may have changed lies
around it: a window over the last tokens of the left and the first of the right side is encoded again and grows
until its ends agree with the tokens that both sides have there. Two facts make the join exact:

* The pattern that splits text into pieces scans from left to right and looks one character ahead, so only the
  last piece before a cut can change; the scan goes on from there until it meets a piece start of the right side.
* Inside a piece a token sequence is the BPE encoding if every adjacent pair is its own encoding. A window whose
  first and last tokens are those of the sides leaves only pairs that occur in an encoding.

Edge cases: a null or empty text has no tokens and decodes to the empty text; null rows, repeated rows and rows
without doc_id stay, one result row for each; columns that the input has besides stay as they are, and a result
column whose name is taken gets underscores in front until it is free.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, small_batches

#: Characters of a leaf. Longer texts are cut.
LEAF = 32_768
#: Cells over which the copies of one long text are dealt.
CELLS = 64
#: The byte-level splitting pattern, in a form without backtracking.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: The same for the regex module, for scans around a join.
SCAN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file; ids are those of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        added = spec["added_tokens"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take surrounding characters are not supported")
        letter = _byte_letters()
        ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in added}
        ranks = {k: i for k, i in ranks.items() if i not in set(self.special.values())}
        self.core = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = max(max(ranks.values()), *self.special.values(), 0) + 1
        self.tokens = [b""] * self.size
        for k, i in ranks.items():
            self.tokens[i] = k
        for k, i in self.special.items():
            self.tokens[i] = k.encode()
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.scan = regex.compile(SCAN)
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, dtype=np.uint32)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        table = self.tokens
        return b"".join([table[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        """Whole text; bytes that are no UTF-8 become U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", errors="replace")

    def cuts(self, text: str, leaf: int) -> list[int]:
        """Where to cut: multiples of ``leaf``, moved out of added tokens."""
        at = list(range(leaf, len(text), leaf))
        if not self._special or not at:
            return at
        spans = [m.span() for m in self._special.finditer(text)]
        starts = np.array([s for s, _ in spans], dtype=np.int64)
        out = []
        for c in at:
            k = int(np.searchsorted(starts, c, side="left")) - 1
            out.append(spans[k][1] if k >= 0 and spans[k][0] < c < spans[k][1] else c)
        return sorted({c for c in out if 0 < c < len(text)})

    def leaves(self, text: str, leaf: int) -> list[str]:
        ends = [0, *self.cuts(text, leaf), len(text)]
        return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    # -- joins -----------------------------------------------------------------

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        """Spans of added tokens and of pattern pieces, in order."""
        out, at = [], 0
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            end = m.start() if m else len(text)
            # endpos would hide the text behind from the look-ahead as well, as the library does at an added token
            out += [(a.start(), a.end()) for a in self.scan.finditer(text, at, end)]
            if m:
                out.append(m.span())
                at = m.end()
        return out

    def _tail(self, ids: np.ndarray) -> tuple[int, list[tuple[str, np.ndarray]]]:
        """The last two pieces of a side with their tokens, after so many tokens of pieces that no cut changes.

        Two, since an apostrophe is a piece of its own until the two letters behind it are seen.
        """
        k = 64
        while True:
            k = min(k, len(ids))
            own = ids[len(ids) - k :]
            raw, starts = self.bytes_of(own), np.cumsum(self.lengths[own]) - self.lengths[own]
            skip = 0
            if k < len(ids):  # begin at a space between two other characters: a piece starts there in any context
                skip = next((i for i in starts.tolist() if 0 < i < len(raw) - 1 and raw[i] == 32 and 32 < raw[i - 1] < 127 and 32 < raw[i + 1] < 127), -1)
            if skip >= 0:
                text = raw[skip:].decode()
                spans = self._pieces(text)
                if len(spans) > 1 or k == len(ids):
                    out, end = [], len(own)
                    for x, y in spans[: -3 if len(spans) > 2 else None : -1]:
                        at = int(np.searchsorted(starts, len(raw) - len(text[x:].encode())))
                        out.insert(0, (text[x:y], own[at:end]))
                        end = at
                    return len(ids) - len(own) + end, out
            k *= 4

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of the text of ``left`` followed by that of ``right``."""
        if not len(left) or not len(right):
            return left if len(left) else right
        keep, last = self._tail(left)
        before = "".join(t for t, _ in last)
        k = 64
        while True:  # as much of the right side as it takes until both scans meet
            k = min(k, len(right))
            raw = self.bytes_of(right[:k])
            text = raw.decode("utf-8", errors="ignore") if k < len(right) else raw.decode()
            if met := self._meet(before, text, whole=k == len(right)):
                break
            k *= 4
        spans, his, size = met
        head = int(np.searchsorted(np.cumsum(self.lengths[right]), len(text[:size].encode()))) + 1 if size else 0
        known = {(len(before) - len(last[-1][0]), len(before)): last[-1][1]} | ({(0, len(last[0][0])): last[0][1]} if len(last) > 1 else {})
        middle, both = [], before + text
        for x, y in spans:
            if (x, y) in known:
                middle.append(known[x, y])
            elif x == len(before) - len(last[-1][0]) and y - len(before) == size and his == (0, size):
                middle.append(self._join_piece(last[-1][1], right[:head]))
            elif both[x:y] in self.special:
                middle.append(np.array([self.special[both[x:y]]], dtype=np.uint32))
            else:
                middle.append(np.array(self.core._encode_single_piece(both[x:y]), dtype=np.uint32))
        return np.concatenate([left[:keep], *middle, right[head:]]).astype(np.uint32)

    def _meet(self, before: str, text: str, whole: bool) -> tuple[list[tuple[int, int]], tuple[int, int], int] | None:
        """The pieces that a scan of both has up to where it meets a piece start of the scan of ``text`` alone, the
        first piece of that one, and how far into ``text`` they meet."""
        mine, his = self._pieces(before + text), self._pieces(text)
        if not whole:  # the last pieces may change with what follows
            mine, his = mine[:-2], his[:-2]
        starts = {a for a, _ in his} | ({len(text)} if whole else set())
        for i, (_, end) in enumerate(mine):
            if end >= len(before) and end - len(before) in starts:
                return mine[: i + 1], his[0] if his else (0, 0), end - len(before)
        return None

    def _join_piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Both are encodings of halves of one piece: windows around the cut grow until both ends agree."""
        k = 4
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = np.array(self.core._encode_single_piece(self.bytes_of(left[len(left) - a :]) + self.bytes_of(right[:b])), dtype=np.uint32)
            if (a == len(left) or window[0] == left[len(left) - a]) and (b == len(right) or window[-1] == right[b - 1]):
                return np.concatenate([left[: len(left) - a], window, right[b:]])
            k *= 2

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """Joins the encodings of consecutive leaves pairwise until one is left."""
        parts = [p for p in parts if len(p)] or [np.zeros(0, dtype=np.uint32)]
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


@cache
def vocabulary(path: str) -> ByteBpe:
    """One for each worker and file."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _slices(batch: pa.RecordBatch, sizes: list[int], most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, leaf: int = LEAF, keep_text: bool = True) -> DataFrame:
    """``docs`` with the token ids of each whole text (``array<int>``), for every row; ``keep_text`` false leaves out the text."""
    if leaf < 1:
        raise ValueError("leaf must be positive")
    ids_col = free_name(docs.columns, ids_col)
    small_batches(docs.sparkSession)
    path = path or default_path()
    names = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for a, b in _slices(batch, [len(t or "") for t in texts]):
                ids = lists([bpe.encode(t or "") for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), ids], names=[*names, ids_col])

    is_long = F.coalesce(F.length(text_col) > leaf, F.lit(False))
    out = docs.filter(~is_long).mapInArrow(give_back(short), schema)

    # Long texts: each distinct one is cut and grown once, in a group of its own; its copies take the ids by a join.
    # The join is dealt by the copies' other columns too, so that copies of one text spread; ids go only where copies are.
    taken = [*docs.columns, ids_col]
    key, no, part, cell = (free_name(taken, n) for n in ("leaf_key", "leaf_no", "leaf_text", "copy_cell"))
    keyed = docs.filter(is_long).withColumn(key, F.sha2(F.col(text_col), 256))
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own = [quoted(c) for c in docs.columns if c != text_col and isinstance(docs.schema[c].dataType, T.AtomicType)]
    copies = keyed.withColumn(cell, F.pmod(F.xxhash64(*own), F.lit(CELLS)) if own else F.lit(0).cast("long")).drop(text_col)
    cut_schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(no, T.IntegerType()), T.StructField(part, T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for name, text in zip(batch.column(key).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                leaves = bpe.leaves(text, leaf)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(leaves), pa.string()), pa.array(range(len(leaves)), pa.int32()), pa.array(leaves, pa.string())], names=[key, no, part])

    coded_schema = T.StructType([*cut_schema.fields[:2], T.StructField(ids_col, T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        kind = np.dtype("<u2") if bpe.size <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            ids = [bpe.encode(t).astype(kind).tobytes() for t in batch.column(part).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(no), pa.array(ids, pa.binary())], names=[key, no, ids_col])

    grown_schema = T.StructType([cut_schema.fields[0], *([T.StructField(text_col, T.StringType())] if keep_text else []), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def grow(group: pa.Table) -> pa.Table:
        bpe = vocabulary(path)
        kind = np.dtype("<u2") if bpe.size <= 1 << 16 else np.dtype("<u4")
        by_no = dict(zip(group.column(no).to_pylist(), group.column(ids_col).to_pylist(), strict=True))
        ids = bpe.tree([np.frombuffer(by_no[i], dtype=kind).astype(np.uint32) for i in sorted(by_no)])
        text = {text_col: pa.array([bpe.bytes_of(ids).decode()], pa.string())} if keep_text else {}
        return pa.table({key: pa.array([group.column(key)[0].as_py()], pa.string())} | text | {ids_col: lists([ids])})

    leaves = keyed.select(key, text_col).mapInArrow(give_back(cut), cut_schema).dropDuplicates([key, no])
    grown = leaves.mapInArrow(give_back(code), coded_schema).groupBy(key).applyInArrow(grow, grown_schema)
    spread = copies.select(key, cell).distinct().join(grown, key)
    return out.unionByName(copies.join(spread, [key, cell]).drop(key, cell))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of each row's ids; null ids are no tokens. Ids outside the vocabulary fail."""
    out_col = free_name(df.columns, out_col)
    small_batches(df.sparkSession)
    path = path or default_path()
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            column = batch.column(ids_col)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            for a, b in _slices(batch, np.diff(offsets).tolist()):
                texts = [bpe.decode(flat[offsets[i] : offsets[i + 1]]) if valid[i] else "" for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(give_back(run), schema)
