"""One-row metrics of scored examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.order import quantiles


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, truth: str = "ground_truth", prediction: str = "prediction", error: str | None = None) -> DataFrame:
    """Counts and scores; an INVALID prediction is an error on either truth. A zero denominator scores 0."""
    yes = F.col(truth) == "MATCH"
    said = F.col(prediction)
    counts = df.agg(
        F.count("*").alias("total_examples"), F.count_if(yes & (said == "MATCH")).alias("true_positives"), F.count_if(~yes & (said == "NO_MATCH")).alias("true_negatives"),
        F.count_if(~yes & (said != "NO_MATCH")).alias("false_positives"), F.count_if(yes & (said != "MATCH")).alias("false_negatives"),
        F.count_if(said == "INVALID").alias("invalid_count"), (F.count_if(F.col(error).isNotNull()) if error else F.lit(0).cast("long")).alias("request_error_count"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    scored = counts.withColumns({"accuracy": _ratio(tp + F.col("true_negatives"), F.col("total_examples")), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "invalid_rate": _ratio(F.col("invalid_count"), F.col("total_examples"))})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def latencies(df: DataFrame, column: str = "latency_seconds") -> DataFrame:
    """Mean, median and 95th percentile, exact, interpolated; nulls are left out. Quantiles come from passes that count bins,
    so no task holds the values."""
    half, p95 = (F.lit(q).cast("double") for q in quantiles(df, column, [0.5, 0.95]))
    return df.agg(F.avg(column).alias("average_latency_seconds")).select("*", half.alias("median_latency_seconds"), p95.alias("p95_latency_seconds"))


def tokens(df: DataFrame, seconds: float) -> DataFrame:
    """Token sums, null if any example lacks a count, and rates, null if no time has passed."""
    lost = F.coalesce(F.bool_or(F.col("input_tokens").isNull() | F.col("output_tokens").isNull()), F.lit(False))
    sums = df.agg(F.count("*").alias("n"), lost.alias("lost"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    known = lambda c: F.when(~F.col("lost"), c)
    rate = lambda c: F.when(F.lit(seconds) != 0, c / F.lit(float(seconds)))
    return sums.select(known(F.col("i")).alias("total_input_tokens"), known(F.col("o")).alias("total_output_tokens"), known(F.col("i") + F.col("o")).alias("total_tokens"),
                       rate(F.col("n")).alias("examples_per_second"), known(rate(F.col("i") + F.col("o"))).alias("tokens_per_second"))


def full_metrics(df: DataFrame, seconds: float, scored_now: DataFrame | None = None) -> dict:
    """All metrics of a scored table as a dictionary; raises for an empty one. Rates are those of the rows scored within the
    seconds: scored_now, or all."""
    out = confusion(df, error="request_error").first().asDict()
    if not out["total_examples"]:
        raise ValueError("no examples were scored")
    sums = tokens(df, seconds).first().asDict()
    if scored_now is not None:
        sums |= {k: v for k, v in tokens(scored_now, seconds).first().asDict().items() if k.endswith("_per_second")}
    return out | latencies(df).first().asDict() | sums
