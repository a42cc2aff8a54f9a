"""Ranked retrieval measured against judgments, and latency summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judgment_problems(qrels: DataFrame, catalog_ids: DataFrame | None = None) -> DataFrame:
    """(problem, n): rows of qrels (query, question_id, relevance) that break the contract.

    null_relevance, negative_relevance, blank_query, blank_id, repeated (all rows of a repeated (query, id)), unknown_id.
    """
    relevance = F.col("relevance")
    missing = relevance.isNull() | F.isnan(relevance)
    blank = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    facts = qrels.agg(
        n(missing).alias("null_relevance"), n(~missing & (relevance < 0)).alias("negative_relevance"), n(blank("query")).alias("blank_query"), n(blank("question_id")).alias("blank_id")
    )
    names = ["null_relevance", "negative_relevance", "blank_query", "blank_id"]
    rows = facts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in names])))
    repeated = qrels.groupBy("query", "question_id").agg(F.count("*").alias("c")).agg(n(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n"))
    rows = rows.unionByName(repeated.select(F.lit("repeated").alias("problem"), "n"))
    if catalog_ids is not None:
        unknown = qrels.join(catalog_ids.select("question_id").distinct(), "question_id", "left_anti").agg(F.count("*").alias("n"))
        rows = rows.unionByName(unknown.select(F.lit("unknown_id").alias("problem"), "n"))
    return rows


def clean_judgments(qrels: DataFrame, catalog_ids: DataFrame | None = None) -> DataFrame:
    """(query, question_id, relevance) that can be used: known ids, finite gains of at least 0, the highest of repeated rows.

    Queries without any gain above 0 are left out.
    """
    good = qrels.where("relevance is not null and not isnan(relevance) and relevance >= 0 and trim(query) <> '' and trim(question_id) <> ''")
    if catalog_ids is not None:
        good = good.join(catalog_ids.select("question_id").distinct(), "question_id", "left_semi")
    each = good.groupBy("query", "question_id").agg(F.max("relevance").alias("relevance"))
    useful = each.groupBy("query").agg(F.max("relevance").alias("best")).where("best > 0").select("query")
    return each.join(useful, "query", "left_semi")


def ranking_metrics(rankings: DataFrame, judgments: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, n_queries, recall, mrr, ndcg (macro means over the judged queries) from (query, question_id, rank) and judgments.

    Gains are 2^g - 1 with discount log2(rank + 1); the ideal takes all judged ids; a query without ranking scores 0.
    """
    cutoffs = sorted(set(ks))
    if not cutoffs or cutoffs[0] < 1:
        raise ValueError("cutoffs must be at least 1")
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    discounted = lambda g, rank: gain(g) / F.log2(rank + 1.0)
    ideal_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "question_id"))
    judged = judgments.withColumn("_ideal", ideal_rank)
    met = judged.join(rankings.select("query", "question_id", "rank"), ["query", "question_id"], "left")
    hit: Column = (F.col("relevance") > 0) & F.col("rank").isNotNull()
    sums = []
    for k in cutoffs:
        inside = F.col("rank") <= k
        sums += [
            F.sum((hit & inside).cast("double")).alias(f"hits_{k}"),
            F.min(F.when(hit & inside, F.col("rank"))).alias(f"first_{k}"),
            F.coalesce(F.sum(F.when(inside, discounted(F.col("relevance"), F.col("rank")))), F.lit(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when(F.col("_ideal") <= k, discounted(F.col("relevance"), F.col("_ideal"))).otherwise(0.0)).alias(f"idcg_{k}"),
        ]
    per_query = met.groupBy("query").agg(F.sum((F.col("relevance") > 0).cast("double")).alias("relevant"), *sums)
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("k"), (F.col(f"hits_{k}") / F.col("relevant")).alias("r"), F.coalesce(1.0 / F.col(f"first_{k}"), F.lit(0.0)).alias("m"),
            F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0).alias("n"), (F.col(f"hits_{k}") > 0).cast("double").alias("h"),
        )
        for k in cutoffs
    ])
    return per_query.select(F.inline(rows)).groupBy("k").agg(
        F.count("*").alias("n_queries"), F.avg("r").alias("recall"), F.avg("m").alias("mrr"), F.avg("n").alias("ndcg"), F.avg("h").alias("hit_rate")
    )


def latency_summary(samples: DataFrame, ms: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean_ms, p50_ms, p95_ms, p99_ms (linear interpolation), max_ms; null, NaN and negative samples raise nothing but are left out."""
    good = samples.where(F.col(ms).isNotNull() & ~F.isnan(ms) & (F.col(ms) >= 0))
    tiles = {f"p{q}_ms": F.percentile(ms, q / 100).alias(f"p{q}_ms") for q in (50, 95, 99)}
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), *tiles.values(), F.max(ms).alias("max_ms"))


def mean_shift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, reference_mean, current_mean, shift): |cur - ref| / max(|ref|, 1e-9); null means are left out."""
    def means(df: DataFrame, name: str) -> DataFrame:
        sums = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
        return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in columns]))).where(F.col(name).isNotNull())

    both = means(reference, "reference_mean").join(means(current, "current_mean"), "feature")
    return both.withColumn("shift", F.abs(F.col("current_mean") - F.col("reference_mean")) / F.greatest(F.abs("reference_mean"), F.lit(1e-9)))
