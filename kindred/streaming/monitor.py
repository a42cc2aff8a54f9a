"""Request monitoring over batch or streaming tables of events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.functions.features import lexical_features
from kindred.functions.text import clean_text

BOUNDS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)  # histogram, ms


def request_rates(events: DataFrame, time: str, by: Sequence[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests and requests per second by window; with a stream, windows close ``late`` after their end."""
    seconds = F.col("window.end").cast("timestamp").cast("long") - F.col("window.start").cast("timestamp").cast("long")
    watched = events.withWatermark(time, late) if events.isStreaming else events
    counted = watched.groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n", (F.col("n") / seconds).alias("rate"))


def latency_bucket(ms: Column, bounds: Sequence[float] = BOUNDS) -> Column:
    """The index of the first bound that is at least ``ms``; len(bounds) beyond the last."""
    return F.aggregate(F.lit([float(b) for b in bounds]), F.lit(0), lambda n, b: n + (ms > b).cast("int"))


def latency_histogram(events: DataFrame, ms: str, by: Sequence[str], bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """(by, bucket, upper, n): counts per bucket; upper is null beyond the last bound. Null values are left out."""
    at = latency_bucket(F.col(ms), bounds)
    counted = events.where(F.col(ms).isNotNull()).groupBy(*by, at.alias("bucket")).agg(F.count("*").alias("n"))
    return counted.select(*by, "bucket", F.get(F.lit([float(b) for b in bounds]), F.col("bucket")).alias("upper"), "n")


def histogram_quantiles(histogram: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95), bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """(by, quantile, value): linear within the bucket that holds the quantile, the last bound beyond it."""
    order = Window.partitionBy(*by).orderBy("bucket")
    whole = Window.partitionBy(*by)
    lower = F.when(F.col("bucket") == 0, 0.0).otherwise(F.get(F.lit([float(b) for b in bounds]), F.col("bucket") - 1))
    run = histogram.withColumns({"_to": F.sum("n").over(order), "_all": F.sum("n").over(whole), "_low": lower})
    asked = run.withColumn("quantile", F.explode(F.lit([float(q) for q in quantiles]))).withColumn("_at", F.col("quantile") * F.col("_all"))
    held = asked.where((F.col("_to") >= F.col("_at")) & (F.col("_to") - F.col("n") < F.col("_at")))
    inside = F.col("_low") + (F.col("upper") - F.col("_low")) * (F.col("_at") - (F.col("_to") - F.col("n"))) / F.col("n")
    return held.select(*by, "quantile", F.coalesce(inside, F.lit(float(bounds[-1]))).alias("value"))


def feature_drift_windows(pairs: DataFrame, time: str, reference: dict[str, float], window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, n, max_shift and the shift of each reference feature) of lexical pair features by window."""
    known = {"jaccard", "len_ratio", "abs_len_diff", "len_sum"} & set(reference)
    values = {n: v for n, v in lexical_features(clean_text(F.col("question1")), clean_text(F.col("question2"))).items() if n in known}
    watched = pairs.withWatermark(time, late) if pairs.isStreaming else pairs
    means = watched.select(time, *[v.alias(n) for n, v in values.items()]).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in values])
    shifts = {n: F.abs(F.col(n) - reference[n]) / max(abs(reference[n]), 1e-9) for n in values}
    largest = F.greatest(*shifts.values(), F.lit(0.0)) if shifts else F.lit(0.0)
    return means.select(F.col("window.start").alias("window_start"), "n", largest.alias("max_shift"), *[s.alias(f"{n}_shift") for n, s in shifts.items()])


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch scored as a batch and appended; a batch that is run again replaces its own output only."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
