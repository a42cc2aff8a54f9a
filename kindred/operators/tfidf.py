"""TF-IDF over unigrams and bigrams: vocabulary, document vectors, pair cosines.

Terms are word runs of at least two characters of the clean text, and adjacent pairs of them. The vocabulary keeps the
``max_features`` most frequent terms (ties by term), with idf = ln((1 + n) / (1 + df)) + 1; vectors are raw counts times idf,
divided by their length. The vocabulary is bounded by ``max_features``, so it is broadcast; texts are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kindred.functions.text import bigrams, clean_text, tokens

MAX_FEATURES = 4096


def terms(clean: Column) -> Column:
    long = F.filter(tokens(clean), lambda w: F.length(w) >= 2)
    return F.concat(long, bigrams(long))


def fit_vocabulary(texts: DataFrame, column: str = "text", max_features: int = MAX_FEATURES, keep_blank: bool = False) -> DataFrame:
    """(term, tf, df, idf) from a column of raw texts, repetitions counted.

    Texts without any token are left out, or count as the text "empty" with ``keep_blank`` (as a catalogue does). A corpus without
    any text is the one text "empty".
    """
    clean = texts.select(clean_text(F.col(column)).alias("c"))
    clean = clean.select(F.when(F.col("c") == "", "empty").otherwise(F.col("c")).alias("c")) if keep_blank else clean.where("c <> ''")
    distinct = clean.groupBy("c").agg(F.count("*").alias("copies"))  # equal texts are taken apart once
    found = terms(F.col("c"))
    parts = F.array(F.struct(found.alias("ts"), F.lit(1).alias("tf"), F.lit(0).alias("df")), F.struct(F.array_distinct(found).alias("ts"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    each = distinct.select("copies", F.inline(parts)).select("copies", "tf", "df", F.explode("ts").alias("term"))
    counted = each.groupBy("term").agg(F.sum(F.col("tf") * F.col("copies")).alias("tf"), F.sum(F.col("df") * F.col("copies")).alias("df"))
    total = clean.agg(F.count("*").alias("docs"))
    fallback = total.where("docs = 0").select(F.lit("empty").alias("term"), F.lit(1).cast("long").alias("tf"), F.lit(1).cast("long").alias("df"))
    top = counted.unionByName(fallback).orderBy(F.desc("tf"), "term").limit(max_features)
    idf = F.log((1 + F.greatest("docs", F.lit(1))) / (1 + F.col("df"))) + 1
    return top.crossJoin(F.broadcast(total)).select("term", "tf", "df", idf.alias("idf"))  # one row of totals


Vocabulary = DataFrame | dict[str, float]


def idf_table(vocabulary: Vocabulary) -> dict[str, float]:
    """Term to idf in the order of terms; at most ``max_features`` entries."""
    return vocabulary if isinstance(vocabulary, dict) else {r["term"]: r["idf"] for r in vocabulary.select("term", "idf").orderBy("term").collect()}


class TermWeights:
    """Vectors of batches of clean texts, all of a batch at once: no loop over rows."""

    def __init__(self, idf: dict[str, float]):
        self.names = pa.array(list(idf), pa.string())
        self.idf = np.fromiter(idf.values(), dtype=np.float64, count=len(idf))

    def __call__(self, clean: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of the normalised vectors, ordered by row and term."""
        split = pc.split_pattern(clean, " ")
        words, row = split.flatten(), pc.list_parent_indices(split)
        long = pc.greater_equal(pc.utf8_length(words), 2)
        words, row = words.filter(long), row.filter(long).to_numpy(zero_copy_only=False)
        found, rows = [pc.index_in(words, value_set=self.names)], [row]
        if len(words) > 1:
            same = pa.array(row[1:] == row[:-1])
            pairs = pc.binary_join_element_wise(words[:-1].filter(same), words[1:].filter(same), " ")
            found.append(pc.index_in(pairs, value_set=self.names))
            rows.append(row[:-1][same.to_numpy(zero_copy_only=False)])
        term = np.concatenate([pc.fill_null(f, -1).to_numpy(zero_copy_only=False) for f in found])
        row = np.concatenate(rows)
        known = term >= 0
        code, n = np.unique(row[known].astype(np.int64) * max(1, len(self.idf)) + term[known], return_counts=True)
        row, term = np.divmod(code, max(1, len(self.idf)))
        weight = n * self.idf[term]
        length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(clean)))
        return row, term, weight / length[row] if len(row) else weight


def _arrow(texts: pd.Series) -> pa.Array:
    return pa.Array.from_pandas(texts, type=pa.string())


def text_vectors(texts: DataFrame, vocabulary: Vocabulary, key: str, column: str, blank: str | None = None) -> DataFrame:
    """(key, terms, weights): the normalised vector of each raw text, entries other than 0, terms by their place in the sorted vocabulary.

    ``blank``: what a text without tokens counts as. Texts without a known term have empty arrays. The vocabulary goes to every
    executor, so a text is taken apart where it lies, without a shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf_table(vocabulary))
    clean = clean_text(F.col(column))
    if blank:
        clean = F.when(clean == "", blank).otherwise(clean)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = TermWeights(shared.value)
        for batch in batches:
            row, term, weight = weigh(batch.column(1).cast(pa.string()))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term.astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["k", "terms", "weights"])

    given = texts.select(F.col(key).alias("k"), clean.alias("c"))
    return given.mapInArrow(vectors, f"k {dict(given.dtypes)['k']}, terms array<int>, weights array<double>").withColumnRenamed("k", key)


def weighted_terms(texts: DataFrame, vocabulary: DataFrame, key: str, column: str, blank: str | None = None) -> DataFrame:
    """(key, term, weight): the entries of ``text_vectors`` as rows."""
    idf = idf_table(vocabulary)
    names = F.lit(list(idf)) if idf else F.array().cast("array<string>")
    entries = text_vectors(texts, idf, key, column, blank).select(key, F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    return entries.select(key, F.get(names, F.col("e.terms")).alias("term"), F.col("e.weights").alias("weight"))


def pair_cosine(vocabulary: Vocabulary, left: Column, right: Column) -> Column:
    """Cosine of two clean texts of a row; 0 if either has no known term."""
    shared = SparkSession.active().sparkContext.broadcast(idf_table(vocabulary))

    def cosines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weigh = TermWeights(shared.value)
        width = max(1, len(shared.value))
        for a, b in batches:
            (ra, ta, wa), (rb, tb, wb) = weigh(_arrow(a)), weigh(_arrow(b))
            _, i, j = np.intersect1d(ra * width + ta, rb * width + tb, assume_unique=True, return_indices=True)
            yield pd.Series(np.bincount(ra[i], weights=wa[i] * wb[j], minlength=len(a)))

    return F.pandas_udf(cosines, DoubleType())(left, right)


def pair_cosines(pairs: DataFrame, vocabulary: Vocabulary, key: str, left: str, right: str) -> DataFrame:
    """(key, cos) of two raw text columns, scored where the rows lie, without a shuffle."""
    texts = pairs.select(key, clean_text(F.col(left)).alias("_a"), clean_text(F.col(right)).alias("_b"))
    return texts.select(key, pair_cosine(vocabulary, F.col("_a"), F.col("_b")).alias("cos"))
