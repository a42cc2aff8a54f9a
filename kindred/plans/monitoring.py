"""Queries on request events, latencies and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import duck
from kindred.functions.features import lexical_features
from kindred.functions.text import clean_text, length_bucket, token_count
from kindred.operators.ranking import latency_summary as summary
from kindred.operators.ranking import mean_shift
from kindred.plans.texts import table
from kindred.streaming import monitor

_FEATURES = ["jaccard", "len_ratio", "abs_len_diff", "len_sum"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(summary(table(spark, sf, "events"), "value", ["event_type"]))


def latency_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Text sizes of documents by the length bucket of their text, as a stand-in for stage times."""
    docs = table(spark, sf, "documents").select(token_count(F.col("text")).alias("n"), F.col("n_chars").cast("double").alias("ms")).where("n > 0")
    strata = docs.withColumn("bucket", length_bucket(F.col("n")))
    spans = strata.groupBy("bucket").agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.count("*") / F.sum("ms") * 1000).alias("throughput"))
    return _rounded(summary(strata, "ms", ["bucket"]).join(spans, "bucket"))


def request_rates_5m(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(monitor.request_rates(table(spark, sf, "events"), "ts", ["event_type"]))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.latency_histogram(table(spark, sf, "events"), "value", ["event_type"])


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(monitor.histogram_quantiles(latency_histogram(spark, sf), ["event_type"]))


def feature_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Feature means of the final holdout against those of the train split."""
    pairs = table(spark, sf, "smoke_pairs").select("split", clean_text(F.col("question1")).alias("a"), clean_text(F.col("question2")).alias("b"))
    features = pairs.select("split", *[v.cast("double").alias(n) for n, v in lexical_features(F.col("a"), F.col("b")).items()])
    return _rounded(mean_shift(features.where("split = 'train'"), features.where("split = 'final_holdout'"), _FEATURES))


QUERIES = {f.__name__: f for f in (latency_summary, latency_strata, request_rates_5m, latency_histogram, latency_quantiles, feature_drift)}

_SUMMARY = lambda v: f"""count(*) AS n, round(avg({v}), 6) AS mean_ms, round(quantile_cont({v}, 0.5), 6) AS p50_ms, round(quantile_cont({v}, 0.95), 6) AS p95_ms,
  round(quantile_cont({v}, 0.99), 6) AS p99_ms, max({v}) AS max_ms"""  # noqa: E731
_BOUNDS = f"[{', '.join(map(str, monitor.BOUNDS))}]"
_HISTOGRAM = f"""SELECT event_type, len(list_filter({_BOUNDS}, lambda b: value > b))::INT AS bucket, {_BOUNDS}[len(list_filter({_BOUNDS}, lambda b: value > b)) + 1]::DOUBLE AS upper, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY ALL"""
_LEX = f"""WITH {duck.macros()}, texts AS (SELECT split, {duck.clean("question1")} AS a, {duck.clean("question2")} AS b FROM smoke_pairs CROSS JOIN compat),
counts AS (SELECT split, {duck.jaccard("a", "b")} AS j, len(list_filter(string_split(a, ' '), lambda w: w <> '')) AS n, len(list_filter(string_split(b, ' '), lambda w: w <> '')) AS m FROM texts),
features AS (SELECT split, unnest(['jaccard', 'len_ratio', 'abs_len_diff', 'len_sum']) AS feature, unnest([j::DOUBLE, least(n, m) / greatest(n, m, 1), abs(n - m)::DOUBLE, (n + m)::DOUBLE]) AS v FROM counts),
means AS (SELECT feature, avg(v) FILTER (split = 'train') AS r, avg(v) FILTER (split = 'final_holdout') AS c FROM features GROUP BY feature)"""

SQL = {
    "latency_summary": f"SELECT event_type, {_SUMMARY('value')} FROM events WHERE value >= 0 GROUP BY event_type",
    "latency_strata": f"""WITH sizes AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '{duck.SPACE}+'), lambda w: w <> ''))::INT AS k, n_chars::DOUBLE AS ms FROM documents)
SELECT CASE WHEN k <= 5 THEN 'short' WHEN k <= 15 THEN 'medium' ELSE 'long' END AS bucket, {_SUMMARY("ms")}, min(k) AS least, max(k) AS most, round(count(*) / sum(ms) * 1000, 6) AS throughput
FROM sizes WHERE k > 0 GROUP BY 1""",
    "request_rates_5m": """SELECT time_bucket(INTERVAL '5 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(count(*) / 300, 6) AS rate
FROM events GROUP BY ALL""",
    "latency_histogram": _HISTOGRAM,
    "latency_quantiles": f"""WITH h AS ({_HISTOGRAM}), runs AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS all_ FROM h),
asked AS (SELECT *, q * all_ AS at_ FROM runs, (SELECT unnest([0.5, 0.95])::DOUBLE AS q))
SELECT event_type, q AS quantile, round(coalesce(low + (upper - low) * (at_ - (upto - n)) / n, {monitor.BOUNDS[-1]}), 6) AS value
FROM (SELECT *, CASE WHEN bucket = 0 THEN 0 ELSE {_BOUNDS}[bucket] END AS low FROM asked) WHERE upto >= at_ AND upto - n < at_""",
    "feature_drift": f"{_LEX} SELECT feature, round(r, 6) AS reference_mean, round(c, 6) AS current_mean, round(abs(c - r) / greatest(abs(r), 1e-9), 6) AS shift FROM means",
}
