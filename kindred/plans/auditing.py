"""Queries that audit the pair table and its id graph, and the splits built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import duck
from kindred.functions.text import clean_text
from kindred.operators import audit
from kindred.operators.graph import connected_components
from kindred.operators.split import four_roles, role_statistics, row_components, shared_ids, train_eval
from kindred.plans.texts import table
from kindred.session import Scratch

FRACTIONS = {"final_holdout": 0.1, "calibration": 0.1, "tuning": 0.1}


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "smoke_pairs").select("row_id", "qid1", "qid2", "question1", "question2", "is_duplicate", "split")


def audit_labels(spark: SparkSession, sf: str) -> DataFrame:
    return audit.label_summary(_pairs(spark, sf)).withColumn("positive_rate", F.round("positive_rate", 6))


def audit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return audit.pair_summary(_pairs(spark, sf))


def audit_ids(spark: SparkSession, sf: str) -> DataFrame:
    return audit.id_summary(_pairs(spark, sf))


def audit_checks(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_checks(_pairs(spark, sf))


def question_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.question_texts(_pairs(spark, sf), "row_id", [("qid1", "question1"), ("qid2", "question2")], clean_text)


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("qid1 is not null and qid2 is not null").select(F.col("qid1").alias("src"), F.col("qid2").alias("dst"))


def question_components(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(_edges(_pairs(spark, sf)))


def positive_components(spark: SparkSession, sf: str) -> DataFrame:
    """Positive edges only; all other questions are groups of their own."""
    pairs = _pairs(spark, sf)
    return connected_components(_edges(pairs.where("is_duplicate = 1")), pairs.select(F.explode(F.array("qid1", "qid2")).alias("node")))


def _roles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark)
    rows = scratch.save(row_components(_pairs(spark, sf), "row_id", scratch=scratch))
    return four_roles(rows, "row_id", FRACTIONS, scratch=scratch), rows


def role_split(spark: SparkSession, sf: str) -> DataFrame:
    return _roles(spark, sf)[0]


def role_split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    assigned, rows = _roles(spark, sf)
    stats = role_statistics(assigned, rows.join(_pairs(spark, sf).select("row_id", "is_duplicate"), "row_id"), "row_id", "is_duplicate")
    return stats.withColumn("observed_fraction", F.round("observed_fraction", 6))


def holdout_by_component(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark)
    return train_eval(scratch.save(row_components(_pairs(spark, sf), "row_id", scratch=scratch)), "row_id", 0.2, scratch=scratch)


def holdout_by_row(spark: SparkSession, sf: str) -> DataFrame:
    return train_eval(_pairs(spark, sf).select("row_id"), "row_id", 0.2)


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return shared_ids(_pairs(spark, sf), "split", ["qid1", "qid2"])


QUERIES = {
    f.__name__: f
    for f in (
        audit_labels, audit_pairs, audit_ids, audit_checks, question_dictionary, question_components, positive_components, role_split, role_split_statistics, holdout_by_component,
        holdout_by_row, split_leakage,
    )
}

_BARE = lambda c: f"regexp_replace(coalesce({c}, ''), '^{duck.SPACE}+|{duck.SPACE}+$', '', 'g')"
_LABELS = """SELECT count(*) AS n_rows, count(*) FILTER (is_duplicate = 0) AS n_negative, count(*) FILTER (is_duplicate = 1) AS n_positive,
  count(*) FILTER (is_duplicate IS NULL OR is_duplicate NOT IN (0, 1)) AS n_invalid, round(count(*) FILTER (is_duplicate = 1) / count(*), 6) AS positive_rate FROM smoke_pairs"""
_PAIR_FACTS = f"""SELECT sum(e1)::BIGINT AS empty_question1, sum(e2)::BIGINT AS empty_question2, coalesce(sum(n) FILTER (lo = hi), 0)::BIGINT AS identical_rows,
  coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_pairs
FROM (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, count(*) FILTER (a = '') AS e1, count(*) FILTER (b = '') AS e2
  FROM (SELECT {_BARE("question1")} AS a, {_BARE("question2")} AS b FROM smoke_pairs) GROUP BY ALL)"""
_ID_CTES = f"""bare_ids AS MATERIALIZED (SELECT {_BARE("qid1")} AS src, {_BARE("qid2")} AS dst FROM smoke_pairs),
{duck.components("SELECT src, dst FROM bare_ids WHERE src <> '' AND dst <> ''")},
each_id AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM bare_ids UNION ALL SELECT dst FROM bare_ids) WHERE node <> '' GROUP BY node),
id_facts AS (SELECT (SELECT count(*) FROM bare_ids WHERE src <> '' AND dst <> '') AS complete_rows, count(*) AS unique_ids, count(*) FILTER (n > 1) AS repeated_ids,
  count(DISTINCT coalesce(label, node)) AS components FROM each_id LEFT JOIN grouped USING (node))"""
_RAW_EDGES = "SELECT qid1 AS src, qid2 AS dst FROM smoke_pairs WHERE qid1 IS NOT NULL AND qid2 IS NOT NULL"
_PERM = "('0x' || substr(md5({} || ':42'), 1, 8))::BIGINT"
_ROLES = f"""{duck.components(_RAW_EDGES)},
rows_ AS MATERIALIZED (SELECT row_id, is_duplicate, label AS component FROM smoke_pairs JOIN grouped ON node = qid1 WHERE qid2 IS NOT NULL),
sizes AS (SELECT component, count(*) AS size FROM rows_ GROUP BY component),
ordered AS MATERIALIZED (SELECT component, size, sum(size) OVER (ORDER BY {_PERM.format("component")}, component) AS upto FROM sizes),
total AS (SELECT sum(size) AS n, greatest(1, floor(sum(size) * 0.1)) AS part FROM sizes),
e1 AS (SELECT min(upto) AS e FROM ordered, total WHERE upto >= part),
e2 AS (SELECT min(upto) AS e FROM ordered, total, e1 WHERE upto >= e1.e + part),
e3 AS (SELECT min(upto) AS e FROM ordered, total, e2 WHERE upto >= e2.e + part),
roles AS (SELECT component, CASE WHEN upto <= e1.e THEN 'final_holdout' WHEN upto <= e2.e THEN 'calibration' WHEN upto <= e3.e THEN 'tuning' ELSE 'train' END AS role FROM ordered, e1, e2, e3)"""

SQL = {
    "audit_labels": _LABELS,
    "audit_pairs": _PAIR_FACTS,
    "audit_ids": f"WITH RECURSIVE {_ID_CTES} SELECT * FROM id_facts",
    "audit_checks": f"""WITH RECURSIVE {_ID_CTES}, labels AS ({_LABELS}), pairs AS ({_PAIR_FACTS}), facts AS (SELECT * FROM labels, pairs, id_facts)
SELECT 'non_empty' AS "check", CASE WHEN n_rows = 0 THEN 'fail' ELSE 'pass' END AS status, n_rows AS observed FROM facts
UNION ALL SELECT 'binary_labels', CASE WHEN n_invalid > 0 THEN 'fail' ELSE 'pass' END, n_invalid FROM facts
UNION ALL SELECT 'both_classes', CASE WHEN least(n_positive, n_negative) = 0 THEN 'fail' ELSE 'pass' END, least(n_positive, n_negative) FROM facts
UNION ALL SELECT 'question_text', CASE WHEN empty_question1 + empty_question2 > 0 THEN 'warn' ELSE 'pass' END, empty_question1 + empty_question2 FROM facts
UNION ALL SELECT 'question_ids', CASE WHEN n_rows > complete_rows THEN 'warn' ELSE 'pass' END, n_rows - complete_rows FROM facts
UNION ALL SELECT 'repeated_pairs', CASE WHEN duplicate_rows > 0 THEN 'warn' ELSE 'pass' END, duplicate_rows FROM facts""",
    "question_dictionary": f"""WITH {duck.macros()}, every AS (SELECT row_id AS k, 0 AS side, qid1 AS qid, {_BARE("question1")} AS question FROM smoke_pairs
  UNION ALL SELECT row_id, 1, qid2, {_BARE("question2")} FROM smoke_pairs)
SELECT qid, arg_min(question, k * 2 + side) AS question, count(DISTINCT {duck.clean("question")}) AS n_texts FROM every CROSS JOIN compat WHERE qid IS NOT NULL GROUP BY qid""",
    "question_components": f"WITH RECURSIVE {duck.components(_RAW_EDGES)} SELECT node, label AS \"group\" FROM grouped",
    "positive_components": f"""WITH RECURSIVE {duck.components(_RAW_EDGES + " AND is_duplicate = 1")}, every AS (SELECT qid1 AS node FROM smoke_pairs UNION SELECT qid2 FROM smoke_pairs)
SELECT node, coalesce(label, node) AS "group" FROM every LEFT JOIN grouped USING (node) WHERE node IS NOT NULL""",
    "role_split": f"WITH RECURSIVE {_ROLES} SELECT row_id, role FROM rows_ JOIN roles USING (component)",
    "role_split_statistics": f"""WITH RECURSIVE {_ROLES} SELECT role, count(*) AS n_rows, count(DISTINCT component) AS components, count(*) FILTER (is_duplicate = 0) AS negatives,
  count(*) FILTER (is_duplicate = 1) AS positives, round(count(*) / any_value(n), 6) AS observed_fraction FROM rows_ JOIN roles USING (component), total GROUP BY role""",
    "holdout_by_component": f"""WITH RECURSIVE {_ROLES}, goal AS (SELECT greatest(1, least(floor(n * 0.2), n - 1)) AS g, n FROM total)
SELECT row_id, CASE WHEN upto - size < g AND upto < n THEN 'eval' ELSE 'train' END AS part FROM rows_ JOIN ordered USING (component), goal""",
    "holdout_by_row": f"""WITH ranked AS (SELECT row_id, row_number() OVER (ORDER BY {_PERM.format("row_id::VARCHAR")}, row_id::VARCHAR) AS k, count(*) OVER () AS n FROM smoke_pairs)
SELECT row_id, CASE WHEN k <= greatest(1, least(floor(n * 0.2), n - 1)) THEN 'eval' ELSE 'train' END AS part FROM ranked""",
    "split_leakage": """WITH each_id AS (SELECT DISTINCT split, id FROM (SELECT split, qid1 AS id FROM smoke_pairs UNION ALL SELECT split, qid2 FROM smoke_pairs)
  WHERE split IS NOT NULL AND trim(id) <> '')
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_ids FROM each_id a JOIN each_id b ON a.id = b.id AND a.split < b.split GROUP BY ALL""",
}
