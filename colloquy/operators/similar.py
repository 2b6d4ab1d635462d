"""Pairs of similar texts: bounds that keep every pair at the threshold are part of the join, the rest is verified.

With s the distinct words of a text, sorted and joined, the token-set ratio is at least t only if either

* 200 * LCS(s1, s2) >= t * (|s1| + |s2|), as both orders of words have the letters of s1 and s2, or
* both share words of w characters, joined, with 2 * w / (w + |s|) * 100 >= t for one of them; this is enough as well.

LCS is at most the number of letters that both have, counted by bits. No pair needs a common word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as st

#: Rows of a side that meet in one cell; larger groups are dealt over more cells, not cut.
BLOCK = 1000


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: Column | float, where: Column | None = None, equal: bool = False, exact: bool = False) -> DataFrame:
    """Pairs of ``left`` (keys, i, i_c, ...) and ``right`` (keys, j, j_c, ...) of equal keys that score ``least`` or more.

    ``where``: what a pair must fulfil besides; ``equal``: equal texts are similar, empty ones too. ``score`` is exact
    if asked for, else null where the bounds decide.
    """
    t = least if isinstance(least, Column) else F.lit(float(least))
    one, two, met, helpers = _dealt(left, right, keys, _traits)

    i_n, j_n = F.col("i_n"), F.col("j_n")
    shared = sum((F.bit_count(F.col("i_b")[k].bitwiseAND(F.col("j_b")[k])) for k in range(st.LETTER_LONGS)), F.least(F.col("i_b")[st.LETTER_LONGS], F.col("j_b")[st.LETTER_LONGS]))
    short = t * F.least(i_n, j_n) - 1e-6
    common = F.array_intersect("i_w", "j_w")
    words = F.length(F.array_join(common, " "))
    letters = 200 * shared >= t * (i_n + j_n) - 1e-6
    maybe = ((200 - t) * shared >= short) & (letters | ((200 - t) * words >= short))
    same = F.col("i_c") == F.col("j_c")
    met = met & ((same | maybe) if equal else maybe)
    # The bound on common words is enough by itself, with room for rounding, and the score is 100 where one side has all words of
    # the other; only other texts go through Python.
    sure = (words > 0) & ((200 - t) * words >= short + 2e-6)
    whole = (words > 0) & (F.size(common) == F.least(F.size("i_w"), F.size("j_w")))
    pairs = one.join(two, met if where is None else met & where).withColumn("sure", whole if exact else (same | sure) if equal else sure).withColumn("least", t)
    pairs = pairs.drop(*helpers, *(f"{x}_{c}" for x in "ij" for c in ("n", "b", "w")))
    scored = pairs.withColumn("score", st.token_set_similarity(F.when(~F.col("sure"), F.col("i_c")), F.when(~F.col("sure"), F.col("j_c"))))
    known = F.lit(100.0) if exact else F.lit(None).cast("double")
    return scored.filter("sure OR score >= least").withColumn("score", F.when(F.col("sure"), known).otherwise(F.col("score"))).drop("sure", "least")


def whole_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ``left`` and ``right`` (as in ``similar_pairs``) that score 100, which are those where one side has all words of
    the other and neither is empty; the texts are left out."""
    # Without nulls there is nothing that Spark would tell for all rows before the join.
    traits = lambda df, x: _with_words(df.withColumn(f"{x}_c", F.coalesce(f"{x}_c", F.lit(""))), x).drop(f"{x}_c")
    one, two, met, helpers = _dealt(left, right, keys, traits)
    missing = F.when(F.size("i_w") < F.size("j_w"), F.array_except("i_w", "j_w")).otherwise(F.array_except("j_w", "i_w"))
    some = F.least(F.size("i_w"), F.size("j_w")) > 0
    return one.join(two, met & some & (F.size(missing) == 0)).drop(*helpers, "i_w", "j_w")


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], traits: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, Column, list[str]]:
    """Both sides dealt over cells, the condition by which each pair of equal keys meets once, and the columns added for it.
    Only rows whose keys are on both sides are given their ``traits``."""
    n_i, n_j = (df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias(x)) for df, x in ((left, "i_cells"), (right, "j_cells")))
    cells = n_i.join(n_j, keys)
    other = {k: f"j_key_{k}" for k in keys}
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda x: F.pmod(F.xxhash64(x), F.col(f"{x}_cells"))
    one = traits(left.join(cells, keys), "i").withColumn("i_own", own("i")).withColumn("i_at", every("j_cells")).drop("i_cells", "j_cells")
    two = traits(right.join(cells, keys), "j").withColumn("j_own", own("j")).withColumn("j_at", every("i_cells")).drop("i_cells", "j_cells").withColumnsRenamed(other)
    met = (F.col("i_own") == F.col("j_at")) & (F.col("i_at") == F.col("j_own"))
    for k in keys:
        met = met & (F.col(k) == F.col(other[k]))
    return one, two, met, [*other.values(), "i_own", "i_at", "j_own", "j_at"]


def _with_words(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn(f"{x}_w", F.array_remove(F.array_distinct(F.split(f"{x}_c", " ")), ""))


def _traits(df: DataFrame, x: str) -> DataFrame:
    """Distinct words, their joined length and letters."""
    out = _with_words(df, x)
    return out.withColumn(f"{x}_n", F.length(F.array_join(f"{x}_w", " "))).withColumn(f"{x}_b", st.letter_bits(F.array_join(f"{x}_w", " ")))
