"""SQL (DuckDB) that gives the same rows as the queries of this subpackage."""

from __future__ import annotations

from kindred.functions import duck

_TEXTS = f"""WITH {duck.macros()},
texts AS MATERIALIZED (SELECT row_id, split, source, {duck.clean('question1')} AS c1, {duck.clean('question2')} AS c2 FROM smoke_pairs CROSS JOIN compat)"""

_OVERLAPS = f"""{_TEXTS},
sets AS MATERIALIZED (SELECT row_id, split, split = 'train' AS train, {duck.words("c1 || ' ' || c2")} AS ws FROM texts WHERE split IS NOT NULL),
elements AS (SELECT row_id, train, len(ws) AS n, unnest(ws) AS w FROM sets),
common AS (
  SELECT a.row_id AS train_key, b.row_id AS other_key, a.n AS n, b.n AS m, count(*) AS both_
  FROM elements a JOIN elements b ON a.w = b.w AND a.train AND NOT b.train AND b.n >= 0.8 * a.n AND a.n >= 0.8 * b.n
  GROUP BY ALL
),
pairs AS (SELECT train_key, other_key, both_ / (n + m - both_) AS similarity FROM common WHERE both_ / (n + m - both_) >= 0.8 - 1e-9)"""


_IDS = f"SELECT row_id, is_duplicate, {duck.clean_id('qid1')} AS a, {duck.clean_id('qid2')} AS b FROM smoke_pairs"

_COPIES = f"""{_TEXTS},
keys AS (SELECT row_id, least(c1, c2) AS lo, greatest(c1, c2) AS hi FROM texts),
firsts AS (SELECT row_id, min(row_id) OVER (PARTITION BY lo, hi) AS kept, count(*) OVER (PARTITION BY lo, hi) AS n FROM keys)"""

SQL = {
    "p1_found": """WITH given AS (SELECT question_id, embedding::DOUBLE[] AS e, len(embedding) AS n FROM catalog_vectors WHERE question_id IS NOT NULL AND embedding IS NOT NULL),
width AS (SELECT n FROM given GROUP BY n ORDER BY count(*) DESC, n LIMIT 1),
v AS MATERIALIZED (SELECT question_id, e FROM given JOIN width USING (n) WHERE list_inner_product(e, e) > 0 AND isfinite(list_inner_product(e, e))),
placed AS (SELECT a.question_id AS x, b.question_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.question_id <> b.question_id
  QUALIFY row_number() OVER (PARTITION BY a.question_id ORDER BY c DESC, b.question_id) <= 10)
SELECT DISTINCT least(x, y) AS question_id_a, greatest(x, y) AS question_id_b FROM placed WHERE c >= 0.85""",
    "p3_found": f"{_OVERLAPS} SELECT least(train_key, other_key) AS row_id_a, greatest(train_key, other_key) AS row_id_b FROM pairs",
    "p3_report": f"""{_OVERLAPS}, best AS (SELECT other_key, count(*) AS n, max(similarity) AS s FROM pairs GROUP BY other_key)
SELECT split, lower(trim(source)) AS source, sum(n)::BIGINT AS n_pairs, count(*) AS n_records, count(*) FILTER (s > 1 - 1e-9) AS n_same
FROM best JOIN texts ON row_id = other_key GROUP BY ALL""",
    "p4_found": f"""WITH RECURSIVE ids AS MATERIALIZED ({_IDS}),
{duck.components("SELECT coalesce(a, b) AS src, coalesce(b, a) AS dst FROM ids WHERE coalesce(a, b) IS NOT NULL")}
SELECT row_id, label AS group_qid FROM ids JOIN grouped ON node = coalesce(a, b)""",
    "p5_found": f"{_COPIES} SELECT kept AS row_id_kept, row_id AS row_id_copy FROM firsts WHERE row_id <> kept",
    "p5_collapsed": f"{_COPIES} SELECT row_id, n AS n_copies FROM firsts WHERE row_id = kept",
    "p6_found": f"""WITH RECURSIVE ids AS MATERIALIZED ({_IDS}),
{duck.components("SELECT a AS src, b AS dst FROM ids WHERE is_duplicate = 1 AND a <> b")}
SELECT node AS qid, label AS group_qid FROM grouped""",
    "p7_found": f"""WITH {duck.macros()},
recs AS (SELECT 'c:' || question_id AS rec, question AS t FROM retrieval_catalog UNION ALL SELECT 'p:' || row_id, question1 FROM smoke_pairs),
texts AS MATERIALIZED (SELECT min(rec) AS rec, c FROM (SELECT rec, {duck.clean("t")} AS c FROM recs CROSS JOIN compat) WHERE c <> '' GROUP BY c),
elements AS MATERIALIZED (SELECT rec, len(ws) AS n, unnest(ws) AS w FROM (SELECT rec, {duck.words("c")} AS ws FROM texts)),
common AS (SELECT a.rec AS rec_a, b.rec AS rec_b, a.n AS n, b.n AS m, count(*) AS both_ FROM elements a JOIN elements b
  ON a.w = b.w AND a.rec < b.rec AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY ALL)
SELECT rec_a, rec_b FROM common WHERE both_ / (n + m - both_) >= 0.7 - 1e-9""",
}
