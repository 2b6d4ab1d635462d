"""Runs and stages: status, incremental work, progress, histograms, rate limits, deduplication, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the stages in a run's progress.
WEIGHTS = {"preprocess": 5, "diarize": 25, "identify_languages": 10, "transcribe": 40, "align": 5, "analytics": 5, "summarize": 10}
OPTIONAL = ("summarize",)


def run_status(stages: DataFrame) -> DataFrame:
    """Per run: failed if a required stage failed, completed_with_errors if an optional one did; errors joined in order."""
    bad = F.col("status") == "failed"
    need = ~F.col("stage_name").isin(*OPTIONAL)
    out = stages.groupBy("run_id").agg(
        F.max(bad & need).alias("required"), F.max(bad & ~need).alias("optional"), F.max(F.col("status") == "cancelled").alias("cancelled"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("stage_no", "stage_name")))).alias("e"),
    )
    status = F.when(F.col("required"), "failed").when(F.col("cancelled"), "cancelled").when(F.col("optional"), "completed_with_errors").otherwise("completed")
    return out.select("run_id", status.alias("status"), F.array_join(F.transform("e", lambda x: F.concat(x["stage_name"], F.lit(" failed"))), "; ").alias("error"))


def stage_fingerprints(stages: DataFrame, config: Column) -> DataFrame:
    """A sha256 for each stage, chained over stage name, the one before, and its configuration."""
    rows = stages.withColumn("_config", config).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stage_no", "stage_name", "_config"))).alias("s"))
    seed = F.struct(F.lit("").alias("h"), F.array().cast("array<struct<stage_no:int,stage_name:string,fingerprint:string>>").alias("r"))

    def step(a: Column, x: Column) -> Column:
        h = F.sha2(F.concat_ws("|", x["stage_name"], a["h"], x["_config"]), 256)
        row = F.struct(x["stage_no"].cast("int").alias("stage_no"), x["stage_name"].alias("stage_name"), h.alias("fingerprint"))
        return F.struct(h.alias("h"), F.concat(a["r"], F.array(row)).alias("r"))

    return rows.select("run_id", F.explode(F.aggregate("s", seed, step)["r"]).alias("x")).select("run_id", "x.*")


def stages_to_run(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Stages from the first whose fingerprint is not among a run's finished ones."""
    have = done.select("run_id", "stage_name", F.col("fingerprint").alias("_have"))
    missing = wanted.join(have, ["run_id", "stage_name"], "left").withColumn("_miss", (F.col("_have").isNull() | (F.col("_have") != F.col("fingerprint"))).cast("int"))
    w = Window.partitionBy("run_id").orderBy("stage_no").rowsBetween(Window.unboundedPreceding, 0)
    return missing.withColumn("_from", F.max("_miss").over(w)).filter("_from = 1").select("run_id", "stage_no", "stage_name", "fingerprint")


def progress(stages: DataFrame) -> DataFrame:
    """Weighted share of finished stages, at most 0.99 until all have ended; with elapsed time and what remains."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("stage_name"))
    out = stages.groupBy("run_id").agg(F.sum(F.when(F.col("status") == "completed", weight).otherwise(0)).alias("done"), F.sum("duration_ms").alias("elapsed_ms"), F.max(F.col("status") == "failed").alias("failed"))
    total = sum(WEIGHTS.values())
    part = F.when((F.col("done") >= total) | F.col("failed"), 1.0).otherwise(F.least(F.col("done") / total, F.lit(0.99)))
    eta = F.when((F.col("fraction") > 0.02) & (F.col("fraction") < 1), F.col("elapsed_ms") * (1 - F.col("fraction")) / F.col("fraction"))
    return out.withColumn("fraction", part).select("run_id", "fraction", "elapsed_ms", eta.alias("eta_ms"))


def histogram(df: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Counts by the smallest bound that is not below the value; infinity for the rest."""
    le = F.lit(float("inf"))
    for b in sorted(bounds, reverse=True):
        le = F.when(value <= b, float(b)).otherwise(le)
    return df.groupBy(*keys, le.alias("le")).agg(F.count("*").alias("n"))


def moving_window_counts(events: DataFrame, keys: list[str], second: str = "epoch_s", width_s: int = 60) -> DataFrame:
    """Events of the key in the ``width_s`` seconds that end with each event's."""
    w = Window.partitionBy(*keys).orderBy(second).rangeBetween(-(width_s - 1), 0)
    return events.withColumn("in_window", F.count("*").over(w))


def dedupe_events(events: DataFrame, keys: list[str], shape: list[str], order: list[str]) -> DataFrame:
    """The first event of each key, and whether later ones differ from it in ``shape``."""
    out = events.groupBy(*keys).agg(F.min(F.struct(*order, *shape)).alias("f"), F.count_distinct(F.struct(*shape)).alias("n"), F.count("*").alias("events"))
    return out.select(*keys, *[F.col(f"f.{c}").alias(c) for c in dict.fromkeys([*order, *shape])], (F.col("n") > 1).alias("conflict"), "events")


def latency_report(requests: DataFrame, name: str, value: str, failed: Column, accuracy: int | None = None) -> DataFrame:
    """Per endpoint, and for all together: count, failures, median, mean, min, max and percentiles.

    Exact percentiles hold the distinct values of an endpoint in one task; with ``accuracy`` they are approximate, with a
    relative error in rank of 1 / accuracy at most, and their size is bounded.
    """
    at = lambda p: F.percentile_approx(value, F.lit(p), F.lit(accuracy)) if accuracy else F.percentile(value, F.lit(p))
    return (
        requests.withColumn("_failed", failed)
        .rollup(name)
        .agg(
            F.count("*").alias("requests"), F.count(F.when(F.col("_failed"), 1)).alias("failures"), at(0.5).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
            at(0.95).alias("p95"), at(0.99).alias("p99"), F.grouping(name).alias("_g"),
        )
        .withColumn(name, F.when(F.col("_g") == 1, "Aggregated").otherwise(F.col(name)))
        .drop("_g")
    )


#: Bounds of the real-time factor's buckets.
FACTORS = (0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 1, 2, 5)


def factor_histogram(stages: DataFrame, runs: DataFrame) -> DataFrame:
    """Stages (run_id, stage_name, duration_ms) by the time that they took over that of their run's audio (run_id, audio_ms), in
    buckets; runs without audio are left out."""
    known = stages.join(runs.filter("audio_ms > 0").select("run_id", "audio_ms"), "run_id")
    return histogram(known, ["stage_name"], F.col("duration_ms") / F.col("audio_ms"), list(FACTORS))


def run_measures(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Totals as measure, label and value: runs by status, minutes of audio of runs (status, audio_ms) that completed, tokens by
    kind of model calls (kind, tokens, cost), and their cost."""
    row = lambda df, name, label, value: df.select(F.lit(name).alias("measure"), label.alias("label"), value.cast("double").alias("value"))
    done = runs.filter(F.col("status").startswith("completed"))
    parts = [
        row(runs.groupBy("status").count(), "runs", F.col("status"), F.col("count")),
        row(done.agg(F.coalesce(F.sum("audio_ms"), F.lit(0)).alias("ms")), "audio_minutes", F.lit("completed"), F.col("ms") / 60_000),
        row(calls.groupBy("kind").agg(F.sum("tokens").alias("n")), "tokens", F.col("kind"), F.col("n")),
        row(calls.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("c")), "cost", F.lit("all"), F.col("c")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- sketches that merge -----------------------------------------------------------------

#: Sizes of the quantile and distinct sketches. A quantile's rank is off by at most ``RANK_ERROR`` (with 99 % confidence), a
#: distinct count by about ``COUNT_ERROR`` (one standard error), however often sketches were merged.
QUANTILE_K, COUNT_LOG_K = 400, 12
RANK_ERROR, COUNT_ERROR = 2.296 / QUANTILE_K**0.9723, 1.04 / 2 ** (COUNT_LOG_K / 2)


def window_sketches(events: DataFrame, keys: list[str], value: str, distinct: str, at: str = "at_ms", width_ms: int = 300_000) -> DataFrame:
    """Per key and window of ``width_ms``: start_ms, n, least, most, and sketches of the values (q) and of the distinct ones (d)
    of another column. A window is a row of some kilobytes, however many events it has; to be stored once and merged."""
    start = (F.floor(F.col(at) / width_ms) * width_ms).alias("start_ms")
    x = F.col(value).cast("double")
    return events.groupBy(*keys, start).agg(F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, F.lit(QUANTILE_K)).alias("q"), F.hll_sketch_agg(distinct, F.lit(COUNT_LOG_K)).alias("d"))


def merge_sketches(sketches: DataFrame, keys: list[str], width_ms: int | None = None) -> DataFrame:
    """Sketches of wider windows, or of all time, and of fewer keys."""
    by = [*keys] if width_ms is None else [*keys, (F.floor(F.col("start_ms") / width_ms) * width_ms).alias("start_ms")]
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("q").alias("q"), F.hll_union_agg("d").alias("d"))


def sketch_estimates(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """What sketches tell: quantiles by name, and n_distinct; instead of the sketches."""
    quantiles = [F.kll_sketch_get_quantile_double("q", F.lit(float(p))).alias(name) for name, p in points.items()]
    return sketches.select(*(c for c in sketches.columns if c not in ("q", "d")), *quantiles, F.hll_sketch_estimate("d").alias("n_distinct"))
