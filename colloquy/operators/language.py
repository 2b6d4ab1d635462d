"""Language-ID output smoothed and summarised. Null speakers are a speaker of their own (null-safe everywhere)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from . import slices as sl


def restrict_scores(scores: Column, allowed: list[str]) -> Column:
    """Scores (map) of the allowed languages, negatives at 0, made to add up to 1; even if all are 0."""
    own = F.transform(F.array(*map(F.lit, allowed)), lambda c: F.struct(c.alias("language"), F.greatest(F.coalesce(F.element_at(scores, c), F.lit(0.0)), F.lit(0.0)).alias("score")))
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["score"])
    return F.transform(own, lambda x: F.struct(x["language"].alias("language"), F.when(total > 0, x["score"] / total).otherwise(1.0 / len(allowed)).alias("score")))


def predict(ranked: Column, duration_ms: Column, min_confidence: float = 0.5) -> Column:
    """Language, confidence, the three best, and whether it is uncertain; below 0.4 s all are equal and uncertain."""
    n = F.size(ranked)
    even = F.transform(ranked, lambda x: F.struct((-(F.lit(1.0) / n)).alias("s"), x["language"].alias("language")))
    own = F.transform(ranked, lambda x: F.struct((-x["score"]).alias("s"), x["language"].alias("language")))
    brief = duration_ms < 400
    top = F.slice(F.array_sort(F.when(brief, even).otherwise(own)), 1, 3)
    first = F.when(n > 0, top[0]).otherwise(F.raise_error(F.lit("no candidate languages")))
    return F.struct(first["language"].alias("language"), (-first["s"]).alias("confidence"), F.transform(top, lambda x: x["language"]).alias("top_k"), (brief | (-first["s"] < min_confidence)).alias("uncertain"))


def candidate_languages(hints: Column, supported: list[str]) -> Column:
    known = F.array(*map(F.lit, supported))
    own = F.array_intersect(known, F.coalesce(hints, F.array().cast("array<string>")))
    return F.when(F.size(own) > 0, own).otherwise(known)


def windows_from_turns(turns: DataFrame, durations: DataFrame, most_ms: int = 15_000) -> DataFrame:
    """Turns divided evenly into windows of at most ``most_ms``; recordings without turns are divided whole."""
    bare = durations.join(turns.select("meeting_id").distinct(), "meeting_id", "left_anti").select("meeting_id", F.lit(None).cast("string").alias("speaker"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    spans = turns.select("meeting_id", F.col("speaker_label").alias("speaker"), "start_ms", "end_ms").unionByName(bare).filter("end_ms > start_ms")
    parts = F.ceil((F.col("end_ms") - F.col("start_ms")) / most_ms)
    cut = spans.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("parts") + 0.5).cast("long")
    return cut.select("meeting_id", "speaker", at(F.col("part")).alias("start_ms"), at(F.col("part") + 1).alias("end_ms"))


def _confident(windows: DataFrame) -> DataFrame:
    return windows.filter(~F.col("uncertain") & F.col("language").isNotNull())


def dominant_language(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The language with most confident time, the first by name on ties."""
    sums = _confident(windows).groupBy(*keys, "language").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ms"), "language"))
    return sums.withColumn("_rank", rank).filter("_rank = 1").select(*keys, "language", "ms")


def inherit_short_windows(windows: DataFrame, least_ms: int = 1_500, sure: float = 0.75) -> DataFrame:
    """A short, unsure window takes the language that dominates its speaker's other confident windows."""
    sums = _confident(windows).groupBy("meeting_id", F.col("speaker").alias("s"), F.col("language").alias("l")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    d = F.col("end_ms") - F.col("start_ms")
    brief = windows.filter((d < least_ms) & (F.coalesce("confidence", F.lit(0.0)) < sure))
    met = brief.select("meeting_id", "seq", "speaker", "language", "uncertain", d.alias("own_ms")).join(sums.withColumnRenamed("meeting_id", "m"), (F.col("meeting_id") == F.col("m")) & F.col("speaker").eqNullSafe(F.col("s")))
    mine = ~F.col("uncertain") & (F.col("language") == F.col("l"))
    others = met.withColumn("ms", F.col("ms") - F.when(F.coalesce(mine, F.lit(False)), F.col("own_ms")).otherwise(0)).filter("ms > 0")
    rank = F.row_number().over(Window.partitionBy("meeting_id", "seq").orderBy(F.desc("ms"), "l"))
    best = others.withColumn("_rank", rank).filter("_rank = 1").select("meeting_id", "seq", F.col("l").alias("heir"))
    out = windows.join(best, ["meeting_id", "seq"], "left")
    return out.withColumn("language", F.coalesce("heir", "language")).withColumn("uncertain", F.when(F.col("heir").isNotNull(), False).otherwise(F.col("uncertain"))).drop("heir")


def resolve_uncertain(windows: DataFrame, fallback: str = "en", width: int = 60_000) -> DataFrame:
    """An uncertain window takes the language of its speaker's nearest confident one, else the meeting's dominant one,
    else ``fallback``; all are certain then.

    Nearest is the smallest gap, then what begins earlier than the window, then the first in order of time. Where no
    confident window overlaps or touches it, that is the one with the latest end before or the earliest start after.
    """
    sure = F.coalesce(~F.col("uncertain") & F.col("language").isNotNull(), F.lit(False))
    own = Window.partitionBy("meeting_id", "speaker").orderBy("start_ms", "end_ms", "seq")
    entry = F.when(sure, F.struct("end_ms", (-F.col("start_ms")).alias("s"), (-F.col("seq")).alias("seq"), "language"))
    before = F.max(entry).over(own.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(F.when(sure, F.struct("start_ms", "language")), ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    near = windows.withColumn("_sure", sure).withColumn("_before", before).withColumn("_after", behind)
    gap_b, gap_a = F.col("start_ms") - F.col("_before.end_ms"), F.col("_after.start_ms") - F.col("end_ms")
    pick = F.when(F.col("_after").isNull() | (F.col("_before").isNotNull() & (gap_b <= gap_a)), F.col("_before.language")).otherwise(F.col("_after.language"))

    # Spans an end longer, so that those that touch meet as well.
    named = windows.withColumn("_sure", sure).withColumn("_speaker", F.struct(F.col("speaker").isNull().alias("none"), F.coalesce("speaker", F.lit("")).alias("name")))
    open_ = named.filter("NOT _sure").select("meeting_id", "_speaker", "seq", "start_ms", (F.col("end_ms") + 1).alias("end_ms"))
    known = named.filter("_sure").select("meeting_id", "_speaker", F.col("seq").alias("b_seq"), F.col("start_ms").alias("b_start_ms"), (F.col("end_ms") + 1).alias("b_end_ms"), "language")
    met = iv.interval_join(open_, known, ["meeting_id", "_speaker"], width)
    first = F.min(F.struct((F.col("b_start_ms") >= F.col("start_ms")).alias("later"), "b_start_ms", "b_end_ms", "b_seq", "language"))
    over = met.groupBy("meeting_id", "seq").agg(first.alias("_over")).select("meeting_id", "seq", F.col("_over.language").alias("_over"))

    top = dominant_language(windows, ["meeting_id"]).select("meeting_id", F.col("language").alias("_top"))
    out = near.join(over, ["meeting_id", "seq"], "left").join(top, "meeting_id", "left")
    found = F.coalesce("_over", pick, F.col("_top"), F.lit(fallback))
    return out.withColumn("language", F.when(F.col("_sure"), F.col("language")).otherwise(found)).withColumn("uncertain", F.lit(False)).drop("_sure", "_before", "_after", "_over", "_top")


def merge_adjacent(windows: DataFrame, gap_ms: int = 500, slice_ms: int | None = None) -> DataFrame:
    """Neighbours in order of time with equal speaker and language, no further apart than ``gap_ms``, become one.

    The confidence is a running mean in which the merged span so far, gaps included, has its length as weight.
    """
    keys, order = ["meeting_id"], ["start_ms", "end_ms", "seq"]
    here = F.struct("speaker", "language")
    new = F.col("_prior").isNull() | ~F.col("_prior.speaker").eqNullSafe(F.col("speaker")) | ~F.coalesce(F.col("_prior.language") == F.col("language"), F.lit(False))
    late = F.col("_reach").isNull() | (F.col("start_ms") - F.col("_reach") > gap_ms)
    if slice_ms is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        runs = iv.islands(windows.withColumn("_prior", F.lag(here).over(w)), keys, order, new, "_run")
        far = runs.withColumn("_reach", iv.reach([*keys, "_run"], order))
        numbered = iv.islands(far, [*keys, "_run"], order, late, "_island")
    else:
        prior = sl.Scan(keys, order).last_before("_prior", here).over(sl.cut(windows, keys, "start_ms", slice_ms))
        runs = sl.Scan(keys, order).sum_upto("_run", F.when(new, 1).otherwise(0)).over(prior)
        far = sl.Scan([*keys, "_run"], order).max_before("_reach", F.col("end_ms")).over(runs)
        numbered = sl.Scan([*keys, "_run"], order).sum_upto("_island", F.when(late, 1).otherwise(0)).over(far)
    parts = numbered.groupBy("meeting_id", "_run", "_island").agg(
        F.first("speaker").alias("speaker"), F.first("language").alias("language"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "seq", "confidence"))).alias("parts"),
    )
    seed = F.struct(F.col("parts")[0]["start_ms"].alias("s"), F.col("parts")[0]["start_ms"].alias("e"), F.lit(0.0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        span, own = (a["e"] - a["s"]).cast("double"), (x["end_ms"] - x["start_ms"]).cast("double")
        mean = F.when(span + own > 0, (a["c"] * span + x["confidence"] * own) / (span + own)).otherwise(x["confidence"])
        return F.struct(a["s"].alias("s"), F.greatest(a["e"], x["end_ms"]).alias("e"), mean.alias("c"))

    return parts.withColumn("confidence", F.aggregate("parts", seed, step)["c"]).drop("parts", "_run", "_island")


def smooth(windows: DataFrame, least_ms: int = 1_500, fallback: str = "en", gap_ms: int = 500) -> DataFrame:
    return merge_adjacent(resolve_uncertain(inherit_short_windows(windows, least_ms), fallback), gap_ms)


def regions(smoothed: DataFrame) -> DataFrame:
    return iv.clip_non_overlapping(smoothed, ["meeting_id"], ["start_ms", "end_ms", "language"])


def language_shares(spans: DataFrame, keys: list[str]) -> DataFrame:
    sums = spans.groupBy(*keys, "language").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    total = F.sum("ms").over(Window.partitionBy(*keys))
    return sums.withColumn("share", F.when(total > 0, F.col("ms") / total).otherwise(0.0)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ms"), "language")))


def switch_points(spans: DataFrame, order: tuple[str, ...] = ("start_ms", "end_ms", "language", "speaker")) -> DataFrame:
    last = F.lag("language").over(Window.partitionBy("meeting_id").orderBy(*order))
    return spans.withColumn("from_language", last).filter("from_language <> language").select("meeting_id", F.col("start_ms").alias("at_ms"), "from_language", F.col("language").alias("to_language"), "speaker")


def language_summary(spans: DataFrame) -> DataFrame:
    """Per meeting: languages (array of structs, longest first), dominant one, switches, and the speakers' languages."""
    shares = language_shares(spans, ["meeting_id"])
    entry = F.struct("rank", "language", "ms", "share")
    total = shares.groupBy("meeting_id").agg(F.array_sort(F.collect_list(entry)).alias("languages"))
    named = spans.withColumn("speaker", F.coalesce("speaker", F.lit("unknown")))
    own = language_shares(named, ["meeting_id", "speaker"]).groupBy("meeting_id", "speaker").agg(F.array_sort(F.collect_list(entry)).alias("languages"))
    number = F.coalesce(F.expr("try_cast(regexp_extract(speaker, '([0-9]+)$', 1) as int)"), F.lit(1 << 30))
    speakers = own.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "speaker", "languages"))).alias("speakers"))
    switches = switch_points(spans).groupBy("meeting_id").agg(F.count("*").alias("num_switches"))
    out = total.join(speakers, "meeting_id").join(switches, "meeting_id", "left")
    return out.select("meeting_id", "languages", F.col("languages")[0]["language"].alias("dominant"), F.coalesce("num_switches", F.lit(0)).alias("num_switches"), "speakers")


def batch_regions(spans: DataFrame, most_ms: int = 30_000) -> DataFrame:
    """Consecutive regions of one language joined until their span would exceed ``most_ms``. Where a batch begins
    depends on the one before, so each run of one language is folded in order."""
    w = Window.partitionBy("meeting_id").orderBy("start_ms", "end_ms")
    last = F.lag("language").over(w)
    runs = iv.islands(spans.withColumn("_new", last.isNull() | (last != F.col("language"))), ["meeting_id"], ["start_ms", "end_ms"], F.col("_new"), "_run")
    kind = "array<struct<start_ms:bigint,end_ms:bigint,confidence:double,weight:double>>"
    rows = runs.groupBy("meeting_id", "_run", "language").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", F.col("confidence").cast("double").alias("confidence")))).alias("r"))

    def step(a: Column, x: Column) -> Column:
        own = (x["end_ms"] - x["start_ms"]).cast("double")
        end = F.element_at(a, -1)
        joined = F.struct(
            end["start_ms"].alias("start_ms"), F.greatest(end["end_ms"], x["end_ms"]).alias("end_ms"),
            F.when(end["weight"] + own > 0, (end["confidence"] * end["weight"] + x["confidence"] * own) / (end["weight"] + own)).otherwise(x["confidence"]).alias("confidence"), (end["weight"] + own).alias("weight"),
        )
        fresh = F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["confidence"].alias("confidence"), own.alias("weight"))
        fits = (F.size(a) > 0) & (x["end_ms"] - F.element_at(F.when(F.size(a) > 0, a), -1)["start_ms"] <= most_ms)
        return F.when(fits, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(fresh))).cast(kind)

    return rows.select("meeting_id", "language", F.explode(F.aggregate("r", F.array().cast(kind), step)).alias("b")).select("meeting_id", "language", "b.start_ms", "b.end_ms", "b.confidence")


def route_by_language(spans: DataFrame, mapping: dict[str, str], default: str) -> DataFrame:
    """The backend that each region's language is sent to, and whether the language is supported."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.element_at(table, F.col("language"))
    return spans.withColumn("backend", F.coalesce(found, F.lit(default))).withColumn("supported", found.isNotNull())
