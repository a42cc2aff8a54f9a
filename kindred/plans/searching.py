"""Queries on retrieval, reranking, judgments and mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import duck
from kindred.functions.features import word_jaccard
from kindred.functions.text import clean_text
from kindred.operators import mining, ranking, retrieval
from kindred.plans.texts import table


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "retrieval_catalog").select("question_id", "question")


def _hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return retrieval.tfidf_search(table(spark, sf, "retrieval_qrels").select("query"), _catalog(spark, sf), k)


def catalog_problems(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.catalog_problems(_catalog(spark, sf))


def qrels_problems(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.judgment_problems(table(spark, sf, "retrieval_qrels"), _catalog(spark, sf))


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best catalogue entries for every judged query."""
    return _hits(spark, sf, 10).select("query", "question_id", "rank", F.round("score", 6).alias("score"))


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best of 50 candidates by word similarity of query and entry."""
    entries = retrieval.usable_catalog(_catalog(spark, sf)).select("question_id", clean_text(F.col("question")).alias("entry"))
    asked = table(spark, sf, "retrieval_qrels").select("query").distinct().select("query", clean_text(F.col("query")).alias("asked"))
    hits = _hits(spark, sf, 50).join(entries, "question_id").join(asked, "query")  # each text is cleaned once

    def similarity(df: DataFrame) -> Column:
        return word_jaccard(df["asked"], df["entry"])

    best = retrieval.rerank(hits, similarity, 10, 50)
    return best.select("query", "question_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    hits = retrieval.dense_search(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding")
    return hits.select("query", "question_id", "rank", F.round("score", 6).alias("score"))


def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    judged = ranking.clean_judgments(table(spark, sf, "retrieval_qrels"), _catalog(spark, sf))
    found = ranking.ranking_metrics(_hits(spark, sf, 10), judged, [1, 5, 10])
    return found.select("k", "n_queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg", "hit_rate")])


def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "smoke_pairs").where("split = 'train'")
    return mining.hard_negatives(pairs)


def hard_negative_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """How many candidates each positive row has from each side."""
    pairs = table(spark, sf, "smoke_pairs").where("split = 'train'")
    return mining.candidate_counts(pairs)


QUERIES = {f.__name__: f for f in (catalog_problems, qrels_problems, tfidf_topk, rerank_topk, dense_topk, ranking_metrics, hard_negatives, hard_negative_candidates)}

_STRIP = lambda c: f"regexp_replace({c}, '^{duck.SPACE}+|{duck.SPACE}+$', '', 'g')"
_SEARCH = f"""{duck.macros()},
entries AS MATERIALIZED (SELECT question_id, min(q) AS question FROM (SELECT trim(question_id) AS question_id, {_STRIP("question")} AS q FROM retrieval_catalog)
  WHERE question_id <> '' AND q <> '' GROUP BY question_id),
cleaned AS MATERIALIZED (SELECT question_id, coalesce(nullif({duck.clean("question")}, ''), 'empty') AS c FROM entries CROSS JOIN compat),
asked AS MATERIALIZED (SELECT DISTINCT query FROM retrieval_qrels WHERE query IS NOT NULL),
asked_clean AS MATERIALIZED (SELECT query, {duck.clean("query")} AS c FROM asked CROSS JOIN compat),
total AS (SELECT count(*) AS n FROM entries),
entry_terms AS MATERIALIZED (SELECT question_id AS id, unnest({duck.terms("c")}) AS term FROM cleaned),
vocabulary AS (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM entry_terms GROUP BY term ORDER BY tf DESC, term LIMIT 4096),
idfs AS MATERIALIZED (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocabulary, total),
ew AS (SELECT id, term, count(*) * any_value(idf) AS w FROM entry_terms JOIN idfs USING (term) GROUP BY id, term),
en AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM ew),
query_terms AS (SELECT query AS id, unnest({duck.terms("c")}) AS term FROM asked_clean),
qw AS (SELECT id, term, count(*) * any_value(idf) AS w FROM query_terms JOIN idfs USING (term) GROUP BY id, term),
qn AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM qw),
dots AS MATERIALIZED (SELECT qn.id AS query, en.id AS question_id, sum(qn.w * en.w) AS s FROM qn JOIN en USING (term) GROUP BY ALL),
full_ AS (SELECT query, question_id, round(coalesce(s, 0), 9) AS score FROM asked CROSS JOIN entries LEFT JOIN dots USING (query, question_id)),
ranked AS MATERIALIZED (SELECT query, question_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, question_id) AS rank FROM full_ QUALIFY rank <= 50)"""
_JUDGED = """good AS (SELECT query, question_id, max(relevance) AS g FROM retrieval_qrels WHERE relevance IS NOT NULL AND NOT isnan(relevance) AND relevance >= 0
  AND trim(query) <> '' AND trim(question_id) <> '' AND question_id IN (SELECT question_id FROM retrieval_catalog) GROUP BY ALL),
judged AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY g DESC, question_id) AS ideal FROM good
  WHERE query IN (SELECT query FROM good WHERE g > 0))"""

SQL = {
    "catalog_problems": """SELECT 'blank_id' AS problem, count(*) FILTER (coalesce(trim(question_id), '') = '') AS n FROM retrieval_catalog
UNION ALL SELECT 'blank_text', count(*) FILTER (coalesce(trim(question), '') = '') FROM retrieval_catalog
UNION ALL SELECT 'repeated_id', count(*) FILTER (c > 1) FROM (SELECT count(*) AS c FROM retrieval_catalog GROUP BY question_id)""",
    "qrels_problems": """SELECT 'null_relevance' AS problem, count(*) FILTER (relevance IS NULL OR isnan(relevance)) AS n FROM retrieval_qrels
UNION ALL SELECT 'negative_relevance', count(*) FILTER (NOT isnan(relevance) AND relevance < 0) FROM retrieval_qrels
UNION ALL SELECT 'blank_query', count(*) FILTER (coalesce(trim(query), '') = '') FROM retrieval_qrels
UNION ALL SELECT 'blank_id', count(*) FILTER (coalesce(trim(question_id), '') = '') FROM retrieval_qrels
UNION ALL SELECT 'repeated', coalesce(sum(c) FILTER (c > 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM retrieval_qrels GROUP BY query, question_id)
UNION ALL SELECT 'unknown_id', count(*) FROM retrieval_qrels WHERE NOT EXISTS (SELECT 1 FROM retrieval_catalog c WHERE c.question_id = retrieval_qrels.question_id)""",
    "tfidf_topk": f"WITH {_SEARCH} SELECT query, question_id, rank::INT AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "rerank_topk": f"""WITH {_SEARCH}, rescored AS (SELECT query, question_id, score, {duck.jaccard("a", "b")} AS r FROM (
  SELECT ranked.query, ranked.question_id, score, asked_clean.c AS a, {duck.clean("question")} AS b FROM ranked JOIN asked_clean USING (query) JOIN entries USING (question_id) CROSS JOIN compat))
SELECT query, question_id, row_number() OVER (PARTITION BY query ORDER BY r DESC, score DESC, question_id)::INT AS rank, round(r, 6) AS rerank_score, round(score, 6) AS score
FROM rescored QUALIFY rank <= 10""",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT q.vec_id AS query, v.vec_id AS question_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, question_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, question_id)::INT AS rank, round(score, 6) AS score FROM sims QUALIFY rank <= 10""",
    "ranking_metrics": f"""WITH {_SEARCH}, {_JUDGED}, ks AS (SELECT unnest([1, 5, 10])::INT AS k),
met AS (SELECT k, judged.query, g, ideal, rank FROM judged LEFT JOIN ranked ON ranked.query = judged.query AND ranked.question_id = judged.question_id AND rank <= 10, ks),
per_query AS (SELECT k, query, count(*) FILTER (g > 0 AND rank <= k) / count(*) FILTER (g > 0) AS r, coalesce(1 / min(rank) FILTER (g > 0 AND rank <= k), 0) AS m,
  coalesce(sum((2 ** g - 1) / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg, sum((2 ** g - 1) / log2(ideal + 1)) FILTER (ideal <= k) AS idcg,
  (count(*) FILTER (g > 0 AND rank <= k) > 0)::INT AS h FROM met GROUP BY k, query)
SELECT k, count(*) AS n_queries, round(avg(r), 6) AS recall, round(avg(m), 6) AS mrr, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg, round(avg(h), 6) AS hit_rate
FROM per_query GROUP BY k""",
}
