"""Top-k retrieval of catalogue entries for all queries at once, and reranking.

Sparse search keeps the semantics of a full ranking by (-score, id), zero scores included: entries that share no term with a query
all score 0, so only the k smallest ids of the catalogue can fill up its list. The stated queries meet all entries in blocks, and only
k hits a query leave a pair of blocks. The frequent parts of vectors are multiplied once for each pair of their patterns, of which there
are few; postings are read only of rare terms. The work still grows with the product of queries and entries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.text import strip_space
from kindred.operators.tfidf import MAX_FEATURES, fit_vocabulary, idf_table, text_vectors
from kindred.session import Scratch

BLOCK_ROWS = 8192
DIGITS = 9  # scores are rounded before they are ranked, so sums in another order rank alike


def catalog_problems(catalog: DataFrame) -> DataFrame:
    """(problem, n): blank_id, repeated_id (ids that occur more than once), blank_text."""
    blank = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    facts = catalog.agg(n(blank("question_id")).alias("blank_id"), n(blank("question")).alias("blank_text"))
    repeated = catalog.groupBy("question_id").agg(F.count("*").alias("c")).agg(n(F.col("c") > 1).alias("repeated_id"))
    both = facts.crossJoin(repeated)  # one row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in ("blank_id", "blank_text", "repeated_id")])))


def usable_catalog(catalog: DataFrame) -> DataFrame:
    """Entries with an id and a text; text without white space at its ends."""
    rows = catalog.select(F.trim("question_id").alias("question_id"), strip_space(F.col("question")).alias("question"))
    return rows.where("question_id <> '' and question <> ''")


def best_per_query(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """``hits`` with rank by (-score, question_id), the first k of each query."""
    order = Window.partitionBy("query").orderBy(F.desc(score), "question_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FREQUENT = 25  # a term in more than one of so many entries is frequent


def _patterns(ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern of each row, length of its frequent part, the patterns as unit rows over the frequent terms).

    ``column``: the place of a term among the frequent ones, or -1. Rows whose frequent parts point the same way have one pattern.
    """
    n = len(ends) - 1
    row = np.repeat(np.arange(n), np.diff(ends))
    some = column[terms] >= 0
    row, col, weight = row[some], column[terms[some]], weights[some]
    ends = np.searchsorted(row, np.arange(n + 1))
    length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
    key = np.empty((len(row), 2))
    key[:, 0], key[:, 1] = col, np.round(weight / weight[ends[row]], 12)
    raw, at = key.tobytes(), (ends * 16).tolist()
    seen: dict[bytes, int] = {}
    pattern = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(at, at[1:])), np.int64, n)  # noqa: B905
    first = np.full(len(seen), n)
    np.minimum.at(first, pattern, np.arange(n))
    units = np.zeros((len(seen), int(column.max(initial=-1)) + 1))
    own = first[pattern[row]] == row
    units[pattern[row[own]], col[own]] = weight[own] / length[row[own]]
    return pattern, length, units


def _search_blocks(k: int, width: int):
    def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = table[name].combine_chunks()
        ends = lists.offsets.to_numpy()
        return ends - ends[0], lists.flatten().to_numpy(zero_copy_only=False)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries ``left`` (id, terms, weights) against entries ``right`` (terms, weights, places, tags).

        A score is the product of the frequent parts, which is computed once for each pair of patterns, and what rare terms add. So the k best of
        a query are among the k best of its pattern by frequent terms alone and the entries that share a rare term with it.
        """
        if not left.num_rows or not right.num_rows:
            return _hit_table([], [], [], [], [])
        ends, terms = flat(right, "terms")
        weights = flat(right, "weights")[1]
        asked_ends, asked_terms = flat(left, "terms")
        asked_weights = flat(left, "weights")[1]
        n = len(ends) - 1
        column = np.full(width, -1)
        frequent = np.flatnonzero(np.bincount(terms, minlength=width) * FREQUENT > n)
        column[frequent] = np.arange(len(frequent))
        pattern, length, units = _patterns(ends, terms, weights, column)
        # entries are numbered by pattern from here on
        order = np.argsort(pattern, kind="stable")
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        copies, length = np.bincount(pattern), length[order]
        longest = np.maximum.reduceat(length, np.cumsum(copies) - copies)
        owner = number[np.repeat(np.arange(n), np.diff(ends))]
        rare = column[terms] < 0
        owner, rare_terms, rare_weights = owner[rare], terms[rare], weights[rare]
        by_term = np.argsort(rare_terms, kind="stable")
        owner, rare_weights = owner[by_term], rare_weights[by_term]
        bounds = np.searchsorted(rare_terms[by_term], np.arange(width + 1)).tolist()
        member_ends, places = flat(right, "places")
        tags = flat(right, "tags")[1]
        begin, size = member_ends[:-1][order], np.diff(member_ends)[order]

        asked_pattern, asked_length, asked_units = _patterns(asked_ends, asked_terms, asked_weights, column)
        asked_length = np.where(asked_length > 0, asked_length, 1.0)
        by_pattern = np.argsort(asked_pattern, kind="stable")
        groups = np.searchsorted(asked_pattern[by_pattern], np.arange(len(asked_units) + 1))
        ids = left["id"].to_numpy()
        out_q, out_n, out_s, out_p, out_t = [], [], [], [], []
        of_entry, base, scores = pattern[order], np.empty(n), np.empty(n)
        for start in range(0, len(asked_units), 256):
            products = asked_units[start : start + 256] @ units.T
            for g, product in enumerate(products, start):
                np.take(product, of_entry, out=base, mode="clip")
                base *= length
                rows = by_pattern[groups[g] : groups[g + 1]]
                slack = 2 * 10.0**-DIGITS / asked_length[rows].min()  # what rounding may move
                # the k-th of the patterns' best is at most the k-th of all entries
                top = product * longest
                least = np.partition(top, len(top) - k)[len(top) - k] if len(top) > k else 0.0
                listed = np.flatnonzero(base >= max(least - slack, 1e-300))
                if len(listed):
                    listed = listed[np.argsort(-base[listed], kind="stable")]
                    full = np.searchsorted(np.cumsum(size[listed]), k)
                    least = base[listed[full]] if full < len(listed) else 0.0
                    listed = listed[base[listed] >= least - slack]
                else:
                    least = 0.0
                np.copyto(scores, base)
                for r in rows:
                    f = asked_length[r]
                    met = []
                    for t, w in zip(asked_terms[asked_ends[r] : asked_ends[r + 1]].tolist(), (asked_weights[asked_ends[r] : asked_ends[r + 1]] / f).tolist(), strict=True):
                        a, b = bounds[t], bounds[t + 1]
                        if a < b:
                            held = owner[a:b]
                            scores[held] += w * rare_weights[a:b]  # an entry holds a term once
                            met.append(held)
                    found, values, limit = [listed], [scores[listed]], least - slack
                    for held in met:
                        value = scores[held]
                        keep = np.flatnonzero(value >= limit)
                        held, value = held[keep], value[keep]
                        if len(value) > 2 * k:
                            limit = max(limit, np.partition(value, len(value) - k)[len(value) - k] - slack)  # k different entries reach that
                        found.append(held)
                        values.append(value)
                    some, value = np.concatenate(found), np.concatenate(values)
                    if met:
                        keep = np.flatnonzero(value >= limit)
                        some, first = np.unique(some[keep], return_index=True)
                        value = value[keep[first]]
                    rounded = np.round(value * f, DIGITS)
                    for held in met:
                        scores[held] = base[held]
                    if not len(some):
                        continue
                    best = np.argsort(-rounded, kind="stable")
                    some, rounded = some[best], rounded[best]
                    full = np.searchsorted(np.cumsum(size[some]), k)
                    cut = np.searchsorted(-rounded, -max(rounded[full] if full < len(some) else 0.0, 10.0**-DIGITS / 2), side="right")
                    some, rounded = some[:cut], rounded[:cut]
                    n_each = size[some]
                    total = np.cumsum(n_each)
                    at = np.arange(total[-1] if cut else 0) + np.repeat(begin[some] - total + n_each, n_each)
                    score, place = np.repeat(rounded, n_each), places[at]
                    best = np.lexsort((place, -score))[:k]
                    if len(best):
                        out_q.append(ids[r])
                        out_n.append(len(best))
                        out_s.append(score[best])
                        out_p.append(place[best])
                        out_t.append(tags[at[best]])
        return _hit_table(out_q, out_n, out_s, out_p, out_t)

    return search


_HITS = "array<struct<score: double, place: bigint, tag: bigint>>"


def _hit_table(queries: list, sizes: list, scores: list, places: list, tags: list) -> pa.Table:
    joined = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
    hits = pa.StructArray.from_arrays([joined(scores, np.float64), joined(places, np.int64), joined(tags, np.int64)], ["score", "place", "tag"])
    ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
    return pa.table({"first": pa.array(queries, pa.int64()), "hits": pa.ListArray.from_arrays(ends, hits)})


@dataclass
class TfidfIndex:
    """A fitted catalogue: the vocabulary, and a table of vectors (question_id, terms, weights) of all usable entries."""

    idf: dict[str, float]
    entries: DataFrame
    size: int

    def save(self, path: str) -> None:
        spark = self.entries.sparkSession
        spark.createDataFrame(list(self.idf.items()), "term string, idf double").write.mode("errorifexists").parquet(f"{path}/vocabulary")
        self.entries.write.mode("errorifexists").parquet(f"{path}/entries")


def load_index(spark: SparkSession, path: str) -> TfidfIndex:
    entries = spark.read.parquet(f"{path}/entries")
    return TfidfIndex(idf_table(spark.read.parquet(f"{path}/vocabulary")), entries, entries.count())


def fit_index(catalog: DataFrame, max_features: int = MAX_FEATURES, scratch: Scratch | None = None) -> TfidfIndex:
    """The index of a catalogue (question_id, question): null and blank ids or texts are left out, a text without tokens counts as the
    text "empty". Entries with a repeated id count once, by the smallest text.
    """
    scratch = scratch or Scratch(catalog.sparkSession)
    entries, size = scratch.save_counted(usable_catalog(catalog).groupBy("question_id").agg(F.min("question").alias("question")))
    idf = idf_table(fit_vocabulary(entries, "question", max_features, keep_blank=True))
    return TfidfIndex(idf, scratch.save(text_vectors(entries, idf, "question_id", "question", "empty")), size)


def tfidf_search(
    queries: DataFrame, catalog: DataFrame | TfidfIndex, k: int = 10, max_features: int = MAX_FEATURES, block_rows: int = BLOCK_ROWS, scratch: Scratch | None = None
) -> DataFrame:
    """(query, question_id, score, rank) for every distinct query text: the k entries of highest cosine, zero scores included.

    ``queries``: (query); null queries are left out, blank ones score 0 everywhere. ``catalog``: an index, or what ``fit_index`` takes. An
    empty catalogue gives no hits.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    scratch = scratch or Scratch(queries.sparkSession)
    index = catalog if isinstance(catalog, TfidfIndex) else fit_index(catalog, max_features, scratch)
    numbered = index.entries.orderBy("question_id").select("*", F.monotonically_increasing_id().alias("place"), F.lit(0).cast("long").alias("tag"))
    entries = scratch.save(numbered)
    asked, lists = hit_lists(queries, index, entries, k, block_rows, scratch)
    each = lists.select("first", F.posexplode("hits").alias("at", "hit")).select("first", "hit.place", "hit.score", (F.col("at") + 1).alias("rank"))
    named = each.join(entries.select("place", "question_id"), "place")
    return named.join(asked, "first").select("query", "question_id", "score", "rank")


def hit_lists(queries: DataFrame, index: TfidfIndex, entries: DataFrame, k: int, block_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(query, first) and (first, hits): the list of each distinct query vector, which the queries with the same ``first`` share.

    ``entries``: those of the index with ``place``, a long in the order of question_id, and ``tag``, a long that comes with each hit. Hits are (score, place, tag), best first, zero scores included.
    """
    asked = scratch.save(queries.select("query").where("query is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    vectors = text_vectors(asked, index.idf, "id", "query")
    of_vector = Window.partitionBy("terms", "weights")
    # equal vectors are one row before anything is compared: a query stands for all of its vector, and an entry for the k smallest ids of its own
    alike, n_asked = scratch.save_counted(_once(vectors.withColumn("first", F.min("id").over(of_vector)), "id"), F.col("id") == F.col("first"))
    placed = entries.where(F.size("terms") > 0).withColumn("_n", F.row_number().over(of_vector.orderBy("place"))).where(F.col("_n") <= k)
    own = placed.groupBy("terms", "weights").agg(F.array_sort(F.collect_list(F.struct("place", "tag"))).alias("own"))
    right, n_entries = scratch.save_counted(own.select("terms", "weights", F.col("own.place").alias("places"), F.col("own.tag").alias("tags")))
    scratch.release()
    # a task builds its part of the index anew, so entries come in large blocks; queries with the same frequent terms come together
    n_left, n_right = max(1, -(-n_asked // (2 * block_rows))), max(1, -(-n_entries // (32 * block_rows)))
    frequent = [i for i, idf in enumerate(index.idf.values()) if idf < 1 + np.log(FREQUENT)]
    pattern = F.xxhash64(F.array_intersect("terms", F.lit(frequent)) if frequent else F.lit(0))
    left = alike.where((F.col("id") == F.col("first")) & (F.size("terms") > 0)).select("id", "terms", "weights", pattern.alias("pattern"))
    left = scratch.save(left.repartitionByRange(n_left, "pattern", "id").select(F.spark_partition_id().alias("a"), "id", "terms", "weights")) if n_left > 1 else left.select(F.lit(0).alias("a"), "id", "terms", "weights")
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = left.select("a", each("b", n_right), "id", "terms", "weights")
    right = right.select(each("a", n_left), F.pmod(F.xxhash64(F.col("places")[0]), F.lit(n_right)).cast("int").alias("b"), "terms", "weights", "places", "tags")
    search = _search_blocks(k, len(index.idf))
    columns = ["id", "terms", "weights"], ["terms", "weights", "places", "tags"]
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(lambda x, y: search(x.select(columns[0]), y.select(columns[1])), f"first long, hits {_HITS}")
    if n_right > 1:
        order = lambda h: F.struct((-h["score"]).alias("score"), h["place"].alias("place"), h["tag"].alias("tag"))
        both = F.slice(F.array_sort(F.transform(F.flatten(F.collect_list("hits")), order)), 1, k)
        met = met.groupBy("first").agg(F.transform(both, order).alias("hits"))
    met = scratch.save(met)
    scratch.release()
    # only lists that aren't full need entries of score 0, and only the k smallest ids of the catalogue can be among those
    least = entries.select("place", "tag").orderBy("place").limit(k).collect()
    if not least:
        return asked.select("query", F.col("id").alias("first")), met.limit(0)
    zero = F.array(*[F.struct(F.lit(0.0).alias("score"), F.lit(r["place"]).cast("long").alias("place"), F.lit(r["tag"]).cast("long").alias("tag")) for r in least])
    every = alike.where("id = first").select("first").join(met, "first", "left").withColumn("hits", F.coalesce("hits", F.array().cast(_HITS)))
    fill = F.filter(zero, lambda h: ~F.array_contains("known", h["place"]))
    filled = F.when(F.size("hits") < len(least), F.slice(F.concat("hits", fill), 1, k)).otherwise(F.col("hits"))
    lists = every.withColumn("known", F.col("hits.place")).select("first", filled.alias("hits"))
    return asked.join(alike.select("id", "first"), "id").select("query", "first"), lists


def _once(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, terms, weights): a vector stands only with the first of its keys."""
    own = F.col(key) == F.col("first")
    return rows.select(key, "first", F.when(own, F.col("terms")).alias("terms"), F.when(own, F.col("weights")).alias("weights"))


def dense_search(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10, block_rows: int = 8192) -> DataFrame:
    """(query, question_id, score, rank): the k vectors of highest cosine for each query vector, its own key left out.

    Both tables: (key, vector); vectors of one length. Null vectors are left out, all-zero ones score 0. The query set meets the
    collection in blocks of a matrix product each.
    """
    def prepared(df: DataFrame, blocks: int) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
        return rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    n_left, n_right = (max(1, -(-df.count() // block_rows)) for df in (queries, vectors))
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = prepared(queries, n_left).select(F.col("block").alias("a"), each("b", n_right), "id", "v")
    right = prepared(vectors, n_right).select(each("a", n_left), F.col("block").alias("b"), "id", "v")

    def unit(rows: pd.DataFrame) -> np.ndarray:
        x = np.stack(rows["v"].to_numpy())
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]

    kind = dict(vectors.dtypes)[key]

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"query": x["id"][:0], "question_id": y["id"][:0], "score": pd.Series(dtype=float)})
        y = y.sort_values("id", kind="stable")
        qs, ids = x["id"].to_numpy(), y["id"].to_numpy()
        scores = np.round(unit(x) @ unit(y).T, DIGITS)
        scores[qs[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, best, 1)
        keep = np.isfinite(found)
        return pd.DataFrame({"query": np.repeat(qs, best.shape[1])[keep.ravel()], "question_id": ids[best][keep], "score": found[keep]})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(search, f"query {kind}, question_id {kind}, score double")
    return best_per_query(met, k)


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], Column], k: int, candidate_k: int) -> DataFrame:
    """The first ``candidate_k`` hits of each query ordered anew by (-rerank_score, -score, question_id), the first k kept.

    ``scorer`` gives a column from the hits (built-in functions or a vectorised UDF); a null or non-finite score raises when read.
    """
    if not 1 <= k <= candidate_k:
        raise ValueError("candidate_k must be at least k, and k at least 1")
    value = scorer(hits)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    scored = hits.where(F.col("rank") <= candidate_k).withColumn("rerank_score", F.when(finite, value).otherwise(F.raise_error(F.lit("the reranker gave no finite score"))))
    order = Window.partitionBy("query").orderBy(F.desc("rerank_score"), F.desc("score"), "question_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
