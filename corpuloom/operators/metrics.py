"""Cost metrics of model calls, weighted scores, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values. Weights of the probes of a model check.
PROFILES = {
    "default": {"P1": 10, "P2": 15, "P3": 15, "P4": 20, "P5": 10, "P6": 20, "P7": 5, "P8": 5, "P9": 0},
    "p1-heavy": {"P1": 20, "P2": 15, "P3": 15, "P4": 15, "P5": 10, "P6": 15, "P7": 5, "P8": 5, "P9": 0},
}


def _median(c: Column, where: Column, digits: int = 1) -> Column:
    return F.round(F.percentile(F.when(where, c.cast("double")), 0.5), digits)


def by_model(records: DataFrame) -> DataFrame:
    """One row a model: attempts, calls in flight, failures, and medians over usable calls.

    A start row without an end of the same model and time is in flight. Torn,
    failed and empty calls are counted and left out of the medians; a missing
    timing stays unknown.
    """
    rows = records.withColumn("model", F.coalesce("model", F.lit("unknown")))
    ends = rows.where(F.coalesce("kind", F.lit("end")) != "start")
    starts = rows.where("kind = 'start'").join(ends.select("model", "started_at"), ["model", "started_at"], "left_anti")
    flying = starts.groupBy("model").agg(F.count(F.lit(1)).alias("in_flight"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    ok = ~failed & ~yes("torn") & ~yes("empty")
    served = F.col("server").isNotNull()
    sec = F.when(ok, F.coalesce("seconds", F.lit(0.0)))
    done = ends.groupBy("model").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("usable"), F.count_if(failed).alias("failed"), F.count_if(yes("torn")).alias("torn"),
        F.count_if(yes("empty")).alias("empty"), F.count_if(yes("boilerplate")).alias("boilerplate"), F.count_if(yes("cap_hit")).alias("cap_hits"),
        _median(F.col("seconds"), ok).alias("seconds_median"), F.round(F.min(sec), 1).alias("seconds_min"), F.round(F.max(sec), 1).alias("seconds_max"), F.round(F.sum(sec), 1).alias("seconds_total"),
        F.count_if(ok & served).alias("server_calls"), _median(F.coalesce("server.prompt_ms", F.lit(0.0)), ok & served).alias("prompt_ms_median"),
        _median(F.coalesce("server.predicted_ms", F.lit(0.0)), ok & served).alias("predicted_ms_median"), _median(F.col("client_residual_seconds"), ok).alias("residual_seconds_median"),
        _median(F.col("input_chars"), ok).alias("input_chars_median"), _median(F.col("output_chars"), ok).alias("output_chars_median"), _median(F.col("compression"), ok, 4).alias("compression_median"),
        _median(F.col("groundedness"), ok, 3).alias("groundedness_median"), F.round(F.min(F.when(ok, F.col("groundedness"))), 3).alias("groundedness_min"),
        F.count_if(ok & (F.col("groundedness") < 0.5)).alias("groundedness_below_half"),
    )
    out = done.join(flying, "model", "full").withColumn("in_flight", F.coalesce("in_flight", F.lit(0)))
    per = F.round(F.col("seconds_median") / F.greatest(F.col("input_chars_median") / 1024, F.lit(1e-9)), 1)
    return out.withColumn("seconds_per_kib", F.when(F.col("input_chars_median") > 0, per))


def projection(models: DataFrame, documents: int) -> DataFrame:
    """Hours that ``documents`` would take at each model's median."""
    return models.select("model", F.round(documents * F.col("seconds_median") / 3600, 2).alias("hours"))


def weighted_scores(probes: DataFrame, weights: DataFrame, by: str = "model") -> DataFrame:
    """(by, score, verdict) of rows (by, probe, score, max_score): shares weighed over the probes present; suitable from 75, marginal from 50."""
    rows = probes.join(weights, "probe")
    score = F.round(F.lit(100.0) * F.sum(F.col("score") / F.col("max_score") * F.col("weight")) / F.sum("weight"), 1)
    out = rows.groupBy(by).agg(score.alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") >= 75, "SUITABLE").when(F.col("score") >= 50, "MARGINAL").otherwise("NOT SUITABLE"))


def trial_score(trials: DataFrame, by: str = "model") -> DataFrame:
    """(by, score, passed): 15 points shared over trials, a forced one worth 8 of 15; passed if most are voluntary."""
    n = F.count(F.lit(1))
    voluntary, forced = F.count_if(F.col("outcome") == "voluntary"), F.count_if(F.col("outcome") == "forced")
    return trials.groupBy(by).agg(F.round(F.lit(15.0) * (voluntary + F.lit(8.0) / F.lit(15.0) * forced) / n, 1).alias("score"), (voluntary > n / 2).alias("passed"))


def evaluate(answers: DataFrame, tasks: DataFrame) -> DataFrame:
    """(suite, passed, total, score): answers that match their task's pattern. A missing answer fails."""
    rows = tasks.join(answers, ["suite", "name"], "left")
    met = F.coalesce(F.regexp_like("answer", "expected_pattern"), F.lit(False))
    out = rows.groupBy("suite").agg(F.count_if(met).alias("passed"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("score", F.col("passed") / F.col("total"))


def gate(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(accepted): better on train and not worse on held-out; rows (split, score)."""
    rows = candidate.join(baseline.withColumnRenamed("score", "was"), "split")
    return rows.agg(F.bool_and(F.when(F.col("split") == "train", F.col("score") > F.col("was")).otherwise(F.col("score") >= F.col("was"))).alias("accepted"))


def percentile(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.agg(*[F.percentile(column, s).alias(f"p{round(100 * s)}") for s in shares])


def few_shots(candidates: DataFrame, most: int) -> DataFrame:
    """The first ``most`` passing candidates in order, the shortest answers first."""
    return candidates.where("passed").orderBy("place").limit(most).orderBy(F.length("answer"), "place")
