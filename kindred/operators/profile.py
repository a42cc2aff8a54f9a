"""Timing of scoring and retrieval jobs in batches by length, with deadlines."""

from __future__ import annotations

import resource
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.text import length_bucket, token_count
from kindred.operators.ranking import latency_summary


def batch_numbers(df: DataFrame, key: str, bucket: str, batch_size: int, buckets: int = 64) -> DataFrame:
    """``df`` with ``batch``: consecutive numbers of at most ``batch_size`` rows of one bucket each.

    Rows are dealt to hash ranges of the key first, so a bucket with most rows is numbered by many tasks; only
    the last batch of each (bucket, range) can be smaller.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    ranged = df.withColumn("_r", F.pmod(F.xxhash64(key), F.lit(buckets)))
    at = F.row_number().over(Window.partitionBy(bucket, "_r").orderBy(key)) - 1
    return ranged.withColumn("batch", F.concat_ws("-", "_r", F.floor(at / batch_size).cast("long"))).drop("_r")


def pair_strata(pairs: DataFrame, left: str = "question1", right: str = "question2") -> DataFrame:
    """``pairs`` with tokens of the longer side and its bucket."""
    n = F.greatest(token_count(F.col(left)), token_count(F.col(right)))
    return pairs.withColumn("tokens", n).withColumn("bucket", length_bucket(F.col("tokens")))


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancels the Spark jobs started inside after so many seconds; they then raise."""
    group = uuid.uuid4().hex
    context = spark.sparkContext
    context.setJobGroup(group, "with deadline", interruptOnCancel=True)
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def timed_runs(run: Callable[[DataFrame], DataFrame], df: DataFrame, bucket: str, repeats: int = 3, warmups: int = 1) -> DataFrame:
    """(bucket, repeat, n, ms, per_second): wall time of ``run`` over each length bucket; the buckets are the three of the text functions."""
    spark = df.sparkSession
    sizes = {r[bucket]: r["n"] for r in df.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count("*").alias("n")).collect()}
    samples = []
    for name in sorted(sizes):
        part = df.where(F.col(bucket) == name)
        for repeat in range(-warmups, repeats):
            began = time.perf_counter()
            run(part).write.format("noop").mode("overwrite").save()
            ms = (time.perf_counter() - began) * 1000
            if repeat >= 0:
                samples.append((name, repeat, sizes[name], ms, sizes[name] / ms * 1000))
    return spark.createDataFrame(samples, "bucket string, repeat int, n long, ms double, per_second double")


def profile(run: Callable[[DataFrame], DataFrame], df: DataFrame, bucket: str, repeats: int = 3) -> dict:
    """The latency of whole runs, overall and by bucket, and the peak memory of the driver."""
    samples = timed_runs(run, df, bucket, repeats)
    strata = {r["bucket"]: {k: v for k, v in r.asDict().items() if k != "bucket"} for r in latency_summary(samples, "ms", ["bucket"]).collect()}
    whole = latency_summary(samples, "ms").first()
    return {"latency": whole.asDict() if whole else {}, "strata": strata, "peak_rss_bytes": peak_rss()}


def peak_rss() -> int:
    """Peak resident bytes of the driver's Python process."""
    used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return used if sys.platform == "darwin" else used * 1024
