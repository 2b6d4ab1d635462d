"""String similarities that Spark has no function for, as Arrow-batched UDFs.

Similarity is 100 * 2 * LCS / (length of both), from the longest common subsequence.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a, b) -> int:
    """Length of the longest common subsequence, by bits of one machine integer of any size."""
    if len(a) < len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    rows, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = rows & where.get(y, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


#: Parts of a text that are scored at once.
PARTS = 256


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part of y that begins at 1 - len(x) and on: how many characters it has in common with x at most, and its length."""
    n, m = len(x), len(y)
    begin = np.clip(np.arange(1 - n, m), 0, m)
    end = np.clip(np.arange(1, m + n), 0, m)
    shared = np.zeros(len(begin), dtype=np.int64)
    for c, k in zip(*np.unique(x, return_counts=True), strict=True):
        seen = np.concatenate([[0], np.cumsum(y == c)])
        shared += np.minimum(seen[end] - seen[begin], k)
    return shared, end - begin


def _lcs_of_parts(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """LCS of x with each part of y that begins at ``at`` and is as long as x, all at once: a bit for each character of x, in
    machine words; an addition passes its carry on to the next word. What is outside y matches nothing."""
    n, words = len(x), -(-len(x) // 64)
    kinds, of_x = np.unique(x, return_inverse=True)
    masks = np.zeros((len(kinds) + 1, words), dtype=np.uint64)
    for i, k in enumerate(of_x.ravel()):
        masks[k, i // 64] |= np.uint64(1 << i % 64)
    found = np.searchsorted(kinds, y)
    of_y = np.where(kinds[np.minimum(found, len(kinds) - 1)] == y, found, len(kinds))
    padded = np.concatenate([np.full(n, len(kinds)), of_y, np.full(n, len(kinds))])
    rows = np.full((words, len(at)), ~np.uint64(0))
    for j in range(n):
        hit = masks[padded[at + n + j]]
        carry = np.zeros(len(at), dtype=np.uint64)
        for k in range(words):
            own, u = rows[k], rows[k] & hit[:, k]
            part = own + u
            total = part + carry
            rows[k] = total | (own - u)
            carry = ((part < u) | (total < carry)).astype(np.uint64)
    rows[-1] |= ~np.uint64((1 << (n - 1) % 64 + 1) - 1)  # what is beyond x
    return np.bitwise_count(~rows).sum(axis=0).astype(np.int64)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any part of that length of the longer (shorter parts at the ends too).

    Parts are tried some hundred at once, in order of the characters that they have in common with the shorter text, which bounds
    their ratio.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    x, y = _codes(a), _codes(b)
    shared, length = _bounds(x, y)
    bounds = 200.0 * shared / (len(x) + length)
    order, best = np.argsort(-bounds, kind="stable"), 0.0
    for i in range(0, len(order), PARTS):
        some = order[i : i + PARTS]
        some = some[bounds[some] > best]
        if not len(some):
            break
        best = max(best, float((200.0 * _lcs_of_parts(x, y, some + 1 - len(x)) / (len(x) + length[some])).max()))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The best of: what both share with what either has besides, by sorted words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(sorted(s)) for s in (x - y, y - x))
    # Both texts begin with the common words, which are thus in any LCS and are all that the words alone have in common with either.
    head = len(both) + 1 if both else 0
    n = 2 * head + len(one) + len(two)
    best = 200.0 * len(both) / (len(both) + head + min(len(one), len(two)))
    if 200.0 * (head + min(len(one), len(two))) / n <= best:
        return best
    return max(best, 200.0 * (head + lcs(one, two)) / n)


def edits(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, a column of the table at a time: its steps up and down are the bits of two
    machine integers of any size. Equal beginnings and ends are left out."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for y in b:
        x = where.get(y, 0) | down
        same = (((x & up) + up) ^ up) | x
        fewer, more = up & same, down | (full & ~(up | same))
        out += (more & top > 0) - (fewer & top > 0)
        more = more << 1 | 1
        down = more & same & full
        up = (fewer << 1 | ~(more | same)) & full
    return out


@F.pandas_udf(T.DoubleType())
def token_set_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


#: So marked, Spark computes it once a pair; else a filter on it computes it again.
token_set_similarity = token_set_similarity.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def partial_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.LongType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])


#: Letter counts of ``letter_bits``: longs, classes of characters, and most of a class by bits.
LETTER_LONGS, LETTER_CLASSES, LETTER_MOST = 6, 32, 12


def letter_counts(text: str) -> list[int]:
    """Counts of characters as bits, one for each occurrence, in ``LETTER_LONGS`` longs, then how many are beyond ``LETTER_MOST``.

    Common bits and the smaller excess are at least the number of common characters: classes only add to it.
    """
    seen, beyond, bits = [0] * LETTER_CLASSES, 0, 0
    for x, n in Counter(text).items():
        o = ord(x)
        seen[o - 97 if 97 <= o <= 122 else 26 if o == 32 else 27 + o % (LETTER_CLASSES - 27)] += n
    for at, n in enumerate(seen):
        bits |= (1 << min(n, LETTER_MOST)) - 1 << at * LETTER_MOST
        beyond += max(n - LETTER_MOST, 0)
    longs = [bits >> 64 * k & (1 << 64) - 1 for k in range(LETTER_LONGS)]
    return [*(x - (1 << 64) if x >> 63 else x for x in longs), beyond]


@F.pandas_udf(T.ArrayType(T.LongType()))
def letter_bits(text: pd.Series) -> pd.Series:
    return pd.Series([letter_counts(x or "") for x in text], dtype=object)


#: So marked, Spark leaves it where it is; else it is computed for all rows once more, to tell nulls before a join.
letter_bits = letter_bits.asNondeterministic()
