"""Quality metrics over files, meetings and languages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings as st
from ..functions import text as tx
from . import intervals as iv
from .similar import similar_pairs, whole_pairs


def edit_counts(pairs: DataFrame) -> DataFrame:
    """Adds word and character edits and lengths of (reference, hypothesis)."""
    r, h = tx.comparable(F.col("reference")), tx.comparable(F.col("hypothesis"))
    out = pairs.withColumn("_r", r).withColumn("_h", h)
    bare = lambda c: F.regexp_replace(c, " ", "")
    return (
        out.withColumn("char_edits", F.levenshtein(bare(F.col("_r")), bare(F.col("_h"))).cast("long"))
        .withColumn("chars", F.length(bare(F.col("_r"))).cast("long"))
        .withColumn("word_edits", st.word_edits("_r", "_h"))
        .withColumn("words", F.size(tx.tokens(F.col("_r"))).cast("long"))
        .drop("_r", "_h")
    )


def error_rates(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of edits over sums of lengths; files with empty references are left out."""
    sums = counted.filter("words > 0").groupBy(*keys).agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("word_edits", "words", "char_edits", "chars")])
    return sums.withColumn("wer", F.col("word_edits") / F.col("words")).withColumn("cer", F.when(F.col("chars") > 0, F.col("char_edits") / F.col("chars")))


def lid_confusion(predicted: DataFrame, reference: DataFrame, width: int = 60_000) -> DataFrame:
    """Milliseconds by reference and predicted language."""
    ref = reference.select("meeting_id", F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"), F.col("language").alias("reference"))
    pairs = iv.interval_join(predicted.select("meeting_id", "start_ms", "end_ms", F.col("language").alias("predicted")), ref, ["meeting_id"], width)
    return pairs.groupBy("reference", "predicted").agg(F.sum(F.least("end_ms", "b_end_ms") - F.greatest("start_ms", "b_start_ms")).alias("ms"))


def lid_accuracy(confusion: DataFrame) -> DataFrame:
    return confusion.agg((F.sum(F.when(F.col("reference") == F.col("predicted"), F.col("ms")).otherwise(0)) / F.sum("ms")).alias("accuracy"))


def match_words(reference: DataFrame, hypothesis: DataFrame, tolerance_ms: int = 500, width: int = 10_000) -> DataFrame:
    """Each reference word (word_id) with the hypothesis word of largest overlap, else the nearest middle within the tolerance."""
    ref = reference.select("meeting_id", "word_id", F.col("speaker").alias("ref_speaker"), (F.col("start_ms") - tolerance_ms).alias("start_ms"), (F.col("end_ms") + tolerance_ms).alias("end_ms"))
    hyp = hypothesis.select("meeting_id", F.col("speaker").alias("hyp_speaker"), F.col("start_ms").alias("b_start_ms"), F.greatest("end_ms", F.col("start_ms") + 1).alias("b_end_ms"))
    pairs = iv.interval_join(ref, hyp, ["meeting_id"], width)
    overlap = F.greatest(F.least(F.col("end_ms") - tolerance_ms, F.col("b_end_ms")) - F.greatest(F.col("start_ms") + tolerance_ms, F.col("b_start_ms")), F.lit(0))
    distance = F.abs(F.col("start_ms") + F.col("end_ms") - F.col("b_start_ms") - F.col("b_end_ms"))
    near = pairs.withColumn("o", overlap).withColumn("d", distance).filter((F.col("o") > 0) | (F.col("d") <= 2 * tolerance_ms))
    best = near.groupBy("meeting_id", "word_id", "ref_speaker").agg(F.min(F.struct((-F.col("o")).alias("o"), "d", "hyp_speaker")).alias("b"))
    return best.select("meeting_id", "word_id", "ref_speaker", F.col("b.hyp_speaker").alias("hyp_speaker"))


def map_speakers(counts: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs of labels by co-occurrence (meeting_id, ref_speaker, hyp_speaker, n): a tiny matrix a meeting."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        used_r, used_h, out = set(), set(), []
        for r in g.sort_values(["n", "ref_speaker", "hyp_speaker"], ascending=[False, True, True]).itertuples(index=False):
            if r.ref_speaker not in used_r and r.hyp_speaker not in used_h:
                used_r.add(r.ref_speaker)
                used_h.add(r.hyp_speaker)
                out.append((r.meeting_id, r.ref_speaker, r.hyp_speaker))
        return pd.DataFrame(out, columns=["meeting_id", "ref_speaker", "hyp_speaker"])

    kind = counts.schema["meeting_id"].dataType.simpleString()
    return counts.groupBy("meeting_id").applyInPandas(fold, f"meeting_id {kind}, ref_speaker string, hyp_speaker string")


def wder(matched: DataFrame) -> DataFrame:
    """Share of matched words whose speaker, under the best mapping, is another."""
    counts = matched.groupBy("meeting_id", "ref_speaker", "hyp_speaker").agg(F.count("*").alias("n"))
    right = counts.join(map_speakers(counts), ["meeting_id", "ref_speaker", "hyp_speaker"]).groupBy("meeting_id").agg(F.sum("n").alias("right"))
    total = counts.groupBy("meeting_id").agg(F.sum("n").alias("words"))
    return total.join(right, "meeting_id", "left").select("meeting_id", "words", (1 - F.coalesce("right", F.lit(0)) / F.col("words")).alias("wder"))


def cp_error_rate(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Word edits of speakers' joined texts (meeting_id, speaker, text) under the best assignment, over reference words."""
    r = reference.select("meeting_id", F.col("speaker").alias("rs"), tx.comparable(F.col("text")).alias("rt"))
    h = hypothesis.select("meeting_id", F.col("speaker").alias("hs"), tx.comparable(F.col("text")).alias("ht"))
    scored = r.join(h, "meeting_id").withColumn("edits", st.word_edits("rt", "ht")).select("meeting_id", "rs", "hs", "edits")
    size = lambda c: F.size(tx.tokens(F.col(c))).cast("long")
    alone = r.select("meeting_id", "rs", F.lit(None).cast("string").alias("hs"), size("rt").alias("edits")).unionByName(h.select("meeting_id", F.lit(None).cast("string").alias("rs"), "hs", size("ht").alias("edits")))

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        cost = {(x.rs, x.hs): x.edits for x in g.itertuples(index=False)}
        rs = sorted(x for x in g["rs"].dropna().unique())
        hs = sorted(x for x in g["hs"].dropna().unique())
        n = max(len(rs), len(hs))
        rs, hs = rs + [None] * (n - len(rs)), hs + [None] * (n - len(hs))
        price = lambda a, b: cost.get((a, b), 0)
        best = _assignment([[price(a, b) for b in hs] for a in rs])
        words = sum(price(a, None) for a in rs if a is not None)
        return pd.DataFrame([(g["meeting_id"].iloc[0], best, words)], columns=["meeting_id", "edits", "words"])

    kind = reference.schema["meeting_id"].dataType.simpleString()
    out = scored.unionByName(alone).groupBy("meeting_id").applyInPandas(assign, f"meeting_id {kind}, edits long, words long")
    return out.withColumn("cp_wer", F.when(F.col("words") > 0, F.col("edits") / F.col("words")))


def _assignment(cost: list[list[int]]) -> int:
    """Least total of a one-to-one assignment, by shortest augmenting paths over a square matrix."""
    n, inf = len(cost), float("inf")
    row_of, left, right = [-1] * n, [0] * n, [0] * n
    for start in range(n):
        best, back, done, column, row = [inf] * n, [-1] * n, [False] * n, -1, start
        while True:
            step, following = inf, -1
            for j in range(n):
                if not done[j]:
                    slack = cost[row][j] - left[row] - right[j]
                    if slack < best[j]:
                        best[j], back[j] = slack, column
                    if best[j] < step:
                        step, following = best[j], j
            left[start] += step
            for j in range(n):
                if done[j]:
                    left[row_of[j]] += step
                    right[j] -= step
                else:
                    best[j] -= step
            column = following
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        while column >= 0:
            before = back[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    return sum(cost[row_of[j]][j] for j in range(n))


def _edges(spans: DataFrame, side: str) -> DataFrame:
    """Begins and ends of spans, counted on one of the sides r, h and x."""
    edge = lambda t, d: F.struct(F.col(t).alias("t"), F.lit(d).alias("d"))
    each = spans.select("meeting_id", F.explode(F.array(edge("start_ms", 1), edge("end_ms", -1))).alias("e"))
    return each.select("meeting_id", "e.t", *[(F.col("e.d") if s == side else F.lit(0)).alias(s) for s in ("r", "h", "x")])


def collars(reference: DataFrame, collar_ms: int) -> DataFrame:
    """Spans of ``collar_ms`` around every begin and end of a reference turn, half on each side, as a union."""
    half = collar_ms // 2
    ends = reference.filter("end_ms > start_ms").select("meeting_id", F.explode(F.array("start_ms", "end_ms")).alias("t"))
    return iv.merge_intervals(ends.select("meeting_id", (F.col("t") - half).alias("start_ms"), (F.col("t") + half).alias("end_ms")), ["meeting_id"])


def der(reference: DataFrame, hypothesis: DataFrame, collar_ms: int = 0, width: int = 60_000) -> DataFrame:
    """Diarization error per meeting: missed, false and confused speaker time over reference speaker time.

    Elementary segments of both sides are swept, without those in collars around the reference's boundaries; overlaps are
    scored. Labels are mapped one to one so that the time in common is largest.
    """
    ref, hyp = iv.speaker_intervals(reference), iv.speaker_intervals(hypothesis)
    out_of = collars(reference, collar_ms) if collar_ms else None
    edges = _edges(ref, "r").unionByName(_edges(hyp, "h"))
    if out_of is not None:
        edges = edges.unionByName(_edges(out_of, "x"))
    steps = edges.groupBy("meeting_id", "t").agg(*[F.sum(c).alias(c) for c in ("r", "h", "x")])
    w = Window.partitionBy("meeting_id").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = steps.select("meeting_id", (F.lead("t").over(w) - F.col("t")).alias("d"), *[F.sum(c).over(run).alias(c) for c in ("r", "h", "x")]).withColumn("d", F.when(F.col("x") == 0, F.col("d")).otherwise(0))
    total = lambda n: F.sum(F.col("d") * n)
    sums = seg.groupBy("meeting_id").agg(
        total(F.col("r")).alias("total"), total(F.greatest(F.col("r") - F.col("h"), F.lit(0))).alias("missed"), total(F.greatest(F.col("h") - F.col("r"), F.lit(0))).alias("false_alarm"), total(F.least("r", "h")).alias("both")
    )
    other = hyp.select("meeting_id", F.col("speaker_label").alias("hyp_speaker"), F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"))
    met = iv.interval_join(ref.withColumnRenamed("speaker_label", "ref_speaker"), other, ["meeting_id"], width)
    met = met.select("meeting_id", "ref_speaker", "hyp_speaker", F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms"))
    key = ["meeting_id", "ref_speaker", "hyp_speaker"]
    counts = met.groupBy(*key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("n"))
    if out_of is not None:
        inside = iv.interval_join(met, out_of.withColumnsRenamed({"start_ms": "b_start_ms", "end_ms": "b_end_ms"}), ["meeting_id"], width)
        less = inside.groupBy(*key).agg(F.sum(F.least("end_ms", "b_end_ms") - F.greatest("start_ms", "b_start_ms")).alias("less"))
        counts = counts.join(less, key, "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")
    right = best_common(counts)
    out = sums.join(right, "meeting_id", "left").withColumn("confusion", F.greatest(F.col("both") - F.coalesce("right", F.lit(0)), F.lit(0)))
    return out.select("meeting_id", "total", "missed", "false_alarm", "confusion", F.when(F.col("total") > 0, (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.col("total")).alias("der"))


def best_common(counts: DataFrame) -> DataFrame:
    """Per meeting the largest total of ``n`` under a one-to-one map of labels (meeting_id, ref_speaker, hyp_speaker, n)."""

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        n = {(r.ref_speaker, r.hyp_speaker): int(r.n) for r in g.itertuples(index=False)}
        rs, hs = sorted({r for r, _ in n}), sorted({h for _, h in n})
        size = max(len(rs), len(hs))
        cost = [[-n.get((rs[i], hs[j]), 0) if i < len(rs) and j < len(hs) else 0 for j in range(size)] for i in range(size)]
        return pd.DataFrame([(g["meeting_id"].iloc[0], -_assignment(cost))], columns=["meeting_id", "right"])

    kind = counts.schema["meeting_id"].dataType.simpleString()
    return counts.groupBy("meeting_id").applyInPandas(assign, f"meeting_id {kind}, right long")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def one_to_one(left: pd.Series, right: pd.Series) -> pd.Series:
    """Which pairs of ids of each row are taken, in order, if an id of either side is in one pair at most."""

    def fold(i: np.ndarray, j: np.ndarray) -> list[bool]:
        used_i, used_j, out = set(), set(), []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            out.append(a not in used_i and b not in used_j)
            if out[-1]:
                used_i.add(a)
                used_j.add(b)
        return out

    return pd.Series([fold(i, j) for i, j in zip(left, right, strict=True)], dtype=object)


def _taken(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs (keys, i, j, score, same) that match one to one, the best first, on ties those of larger ids."""
    ranked = F.sort_array(F.collect_list(F.struct("score", "i", "j", "same")), asc=False)
    rows = pairs.groupBy(*keys).agg(ranked.alias("p")).withColumn("taken", one_to_one("p.i", "p.j"))
    return rows.select(*keys, F.explode(F.filter(F.arrays_zip("p", "taken"), lambda x: x["taken"])).alias("x")).select(*keys, "x.p.i", "x.p.j", "x.p.same")


def precision_recall(gold: DataFrame, found: DataFrame, least: float = 60.0, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Per meeting and kind, of items (meeting_id, kind, idx, text, owner): gold, found, hits, precision, recall, owner_hits.

    Items match one to one, the most similar pairs first (on ties those of larger idx); ratios over nothing are 1. Owner
    accuracy is owner_hits / hits.

    Pairs that score 100 come before all others and are told by their words alone, so they are matched first; only items that
    are left are compared by characters. ``keep`` gets those matches and a name, as they are read three times: it may write them
    and return what was written.
    """
    side = lambda df, x: df.select("meeting_id", "kind", F.col("idx").cast("long").alias(x), F.coalesce("owner", F.lit("")).alias(f"{x}_owner"), tx.squeeze(F.lower("text")).alias(f"{x}_c"))
    key = ["meeting_id", "kind"]
    rows = lambda pairs, score: pairs.select(*key, "i", "j", score.alias("score"), (F.col("i_owner") == F.col("j_owner")).alias("same"))
    whole = keep(_taken(rows(whole_pairs(side(gold, "i"), side(found, "j"), key), F.lit(100.0)), key), "whole")
    left = lambda df, x: side(df.join(whole.select(*key, F.col(x).alias("idx")), [*key, "idx"], "left_anti"), x)
    rest = _taken(rows(similar_pairs(left(gold, "i"), left(found, "j"), key, least, exact=True), F.col("score")), key)
    matched = whole.unionByName(rest).groupBy(*key).agg(F.count("*").alias("hits"), F.count(F.when(F.col("same"), 1)).alias("owner_hits"))
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    out = count(gold, "gold").join(count(found, "found"), key, "full").join(matched, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return _rates(out.select(*key, z("gold"), z("found"), z("hits"), z("owner_hits")))


def _rates(counts: DataFrame) -> DataFrame:
    rate = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(1.0)
    return counts.withColumn("precision", rate("hits", "found")).withColumn("recall", rate("hits", "gold"))


def overall_scores(scores: DataFrame, reports: DataFrame) -> DataFrame:
    """Over all meetings, by kind: precision, recall and owner accuracy (null without hits), and the grounding rate of the
    reports (evidence_checked, evidence_passed; 1 without evidence)."""
    sums = _rates(scores.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("gold", "found", "hits", "owner_hits")]))
    sums = sums.withColumn("owner_accuracy", F.when(F.col("hits") > 0, F.col("owner_hits") / F.col("hits")))
    total = reports.agg(F.sum("evidence_passed").alias("p"), F.sum("evidence_checked").alias("n"))
    return sums.crossJoin(F.broadcast(total.select(F.when(F.col("n") > 0, F.col("p") / F.col("n")).otherwise(1.0).alias("grounding_rate"))))  # one row


def meeting_scores(scores: DataFrame, keys: list[str], metrics: list[str], right: Column) -> DataFrame:
    """Means of metrics by key (a source, say), with the share of meetings whose speaker count is right. With wall_ms,
    duration_ms and status there: the mean real-time factor of the meetings that completed, and their number."""
    aggs = [F.count("*").alias("meetings"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], F.avg(right.cast("double")).alias("speaker_count_accuracy")]
    if {"wall_ms", "duration_ms", "status"} <= set(scores.columns):
        factor = F.when(F.col("status").startswith("completed") & (F.col("duration_ms") > 0), F.col("wall_ms") / F.col("duration_ms"))
        aggs += [F.avg(factor).alias("rtf"), F.count(factor).alias("completed")]
    return scores.groupBy(*keys).agg(*aggs)
