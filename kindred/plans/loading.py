"""Queries that load delivered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.functions.duck import SPACE
from kindred.operators.parse import HEADER, failed_records, parse_pair_records, valid_pairs


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return parse_pair_records(spark.read.parquet(f"{sf}/smoke_pairs_raw.parquet").select("raw_id", "raw_line"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return failed_records(_raw(spark, sf))


def p2_rows(spark: SparkSession, sf: str) -> DataFrame:
    return valid_pairs(_raw(spark, sf))


QUERIES = {"p2_found": p2_found, "p2_rows": p2_rows}

_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_PARSED = f"""WITH lines AS (SELECT raw_id, regexp_replace(coalesce(raw_line, ''), '\\r\\z', '') AS t FROM smoke_pairs_raw),
checked AS (SELECT raw_id, t, regexp_full_match(t, '{_FIELD}(,{_FIELD})*') AS quoted FROM lines WHERE t <> '{HEADER}'),
fields AS (SELECT raw_id, quoted, list_transform(regexp_extract_all(',' || t, ',{_FIELD}', 1),
  lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM checked),
parsed AS (SELECT raw_id, f, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 6 THEN 'column_count'
  WHEN NOT regexp_full_match(f[1], '[0-9]+') OR regexp_full_match(f[4], '{SPACE}*')
    OR regexp_replace(f[6], '^{SPACE}+|{SPACE}+$', '', 'g') NOT IN ('0', '1') THEN 'value' END AS reason FROM fields)"""

SQL = {
    "p2_found": f"{_PARSED} SELECT raw_id, reason FROM parsed WHERE reason IS NOT NULL",
    "p2_rows": f"""{_PARSED} SELECT raw_id, try_cast(f[1] AS BIGINT) AS row_id, CASE WHEN try_cast(f[1] AS BIGINT) IS NULL THEN f[1] END AS long_id, nullif(f[2], '') AS qid1, nullif(f[3], '') AS qid2, f[4] AS question1,
  nullif(f[5], '') AS question2, regexp_replace(f[6], '^{SPACE}+|{SPACE}+$', '', 'g')::INT AS is_duplicate FROM parsed WHERE reason IS NULL""",
}
