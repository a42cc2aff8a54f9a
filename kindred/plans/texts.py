"""Queries on texts and pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import duck
from kindred.functions.features import dense_features, lexical_features
from kindred.functions.text import clean_text, length_bucket, token_count, tokens, words
from kindred.operators.model import corpus
from kindred.operators.tfidf import fit_vocabulary, pair_cosines
from kindred.session import Scratch, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def clean_text_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", clean_text(F.col("text")).alias("c"))
    return docs.select("doc_id", token_count(F.col("text")).alias("n_raw"), F.size(tokens(F.col("c"))).alias("n_tokens"), F.size(words(F.col("c"))).alias("n_words"))


def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by the longer side; pairs without any token are left out."""
    n = F.greatest(token_count(F.col("question1")), token_count(F.col("question2")))
    pairs = table(spark, sf, "smoke_pairs").select(n.alias("n")).where("n > 0")
    return pairs.groupBy(length_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_pairs"), F.min("n").alias("least"), F.max("n").alias("most"))


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "smoke_pairs").select("row_id", clean_text(F.col("question1")).alias("a"), clean_text(F.col("question2")).alias("b"))
    return pairs.select("row_id", *[F.round(v, 6).alias(n) for n, v in lexical_features(F.col("a"), F.col("b")).items()])


def pair_lexical_features(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf)


def explain_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The features of each pair as named values."""
    names = ["jaccard", "len_ratio", "abs_len_diff", "len_sum"]
    values = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return _lexical(spark, sf).select("row_id", F.inline(values))


def tfidf_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = fit_vocabulary(corpus(table(spark, sf, "smoke_pairs")))
    return vocabulary.select("term", "tf", "df", F.round("idf", 6).alias("idf"))


def tfidf_pair_cosine(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "smoke_pairs").select("row_id", *[F.coalesce(c, F.lit("nan")).alias(c) for c in ("question1", "question2")])
    vocabulary = Scratch(spark).save(fit_vocabulary(corpus(pairs)).select("term", "idf"))
    return pair_cosines(pairs, vocabulary, "row_id", "question1", "question2").select("row_id", F.round("cos", 6).alias("cos"))


def embedding_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next one."""
    vectors = table(spark, sf, "embeddings")
    a = vectors.select("vec_id", F.col("embedding").alias("a"))
    b = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", *[F.round(v, 6).alias(n) for n, v in dense_features(F.col("a"), F.col("b")).items()])


QUERIES = {
    f.__name__: f
    for f in (clean_text_docs, token_stats, length_buckets, pair_lexical_features, explain_pairs, tfidf_vocabulary, tfidf_pair_cosine, embedding_pair_features)
}

_RAW = lambda c: f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '{duck.SPACE}+'), lambda w: w <> ''))"
_CLEAN = f"""WITH {duck.macros()},
texts AS MATERIALIZED (SELECT row_id, is_duplicate, lang, source, {duck.clean("question1")} AS a, {duck.clean("question2")} AS b FROM smoke_pairs CROSS JOIN compat)"""
_LEXICAL = f"""{_CLEAN}, counts AS (SELECT row_id, {duck.jaccard("a", "b")} AS j, len(list_filter(string_split(a, ' '), lambda w: w <> '')) AS n,
  len(list_filter(string_split(b, ' '), lambda w: w <> '')) AS m FROM texts),
features AS (SELECT row_id, round(j, 6) AS jaccard, round(least(n, m) / greatest(n, m, 1), 6) AS len_ratio, abs(n - m)::DOUBLE AS abs_len_diff, (n + m)::DOUBLE AS len_sum FROM counts)"""
NAN = lambda c: f"coalesce({c}, 'nan')"
VOCABULARY = f"""{duck.macros()},
corpus AS MATERIALIZED (SELECT row_number() OVER () AS id, {duck.clean("t")} AS c
  FROM (SELECT {NAN("question1")} AS t FROM smoke_pairs UNION ALL SELECT {NAN("question2")} FROM smoke_pairs) CROSS JOIN compat),
total AS (SELECT count(*) AS n FROM corpus WHERE c <> ''),
found AS (SELECT id, unnest({duck.terms("c")}) AS term FROM corpus WHERE c <> ''),
vocabulary AS MATERIALIZED (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM found GROUP BY term ORDER BY tf DESC, term LIMIT 4096),
idfs AS MATERIALIZED (SELECT term, tf, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocabulary, total)"""

SQL = {
    "clean_text_docs": f"WITH {duck.macros()} SELECT doc_id, {duck.clean('text')} AS clean FROM documents CROSS JOIN compat",
    "token_stats": f"""WITH {duck.macros()}, texts AS (SELECT doc_id, text, {duck.clean('text')} AS c FROM documents CROSS JOIN compat)
SELECT doc_id, {_RAW("text")}::INT AS n_raw, len(list_filter(string_split(c, ' '), lambda w: w <> ''))::INT AS n_tokens, len({duck.words("c")})::INT AS n_words FROM texts""",
    "length_buckets": f"""WITH sizes AS (SELECT greatest({_RAW("question1")}, {_RAW("question2")})::INT AS n FROM smoke_pairs)
SELECT CASE WHEN n <= 5 THEN 'short' WHEN n <= 15 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n_pairs, min(n) AS least, max(n) AS most FROM sizes WHERE n > 0 GROUP BY 1""",
    "pair_lexical_features": f"{_LEXICAL} SELECT * FROM features",
    "explain_pairs": f"{_LEXICAL} SELECT row_id, feature, value FROM (UNPIVOT features ON jaccard, len_ratio, abs_len_diff, len_sum INTO NAME feature VALUE value)",
    "tfidf_vocabulary": f"WITH {VOCABULARY} SELECT term, tf, df, round(idf, 6) AS idf FROM idfs",
    "tfidf_pair_cosine": f"""WITH {VOCABULARY},
texts AS MATERIALIZED (SELECT row_id, {duck.clean(NAN("question1"))} AS a, {duck.clean(NAN("question2"))} AS b FROM smoke_pairs CROSS JOIN compat),
sides AS (SELECT row_id, 1 AS s, unnest({duck.terms("a")}) AS term FROM texts UNION ALL SELECT row_id, 2, unnest({duck.terms("b")}) FROM texts),
weights AS (SELECT row_id, term, count(*) FILTER (s = 1) * any_value(idf) AS x, count(*) FILTER (s = 2) * any_value(idf) AS y FROM sides JOIN idfs USING (term) GROUP BY ALL),
sums AS (SELECT row_id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM weights GROUP BY row_id)
SELECT row_id, round(coalesce(CASE WHEN xx > 0 AND yy > 0 THEN xy / sqrt(xx) / sqrt(yy) ELSE 0 END, 0), 6) AS cos FROM texts LEFT JOIN sums USING (row_id)""",
    "embedding_pair_features": """WITH pairs AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
sums AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa,
  list_sum(list_transform(b, lambda x: x * x)) AS bb, list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dd,
  list_avg(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) AS mad FROM pairs)
SELECT vec_id, round(ab / (sqrt(aa) * sqrt(bb)), 6) AS cos, round(sqrt(dd), 6) AS l2, round(mad, 6) AS mad FROM sums""",
}
