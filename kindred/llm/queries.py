"""Queries of the training-data operators over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import clean_id
from kindred.llm.copies import collapse, formatting_copies
from kindred.llm.edits import near_texts
from kindred.llm.grouping import match_groups
from kindred.llm.mixing import mix
from kindred.llm.overlap import overlap_report, split_overlaps
from kindred.llm.packing import fill_report, pack
from kindred.llm.personal import personal_passages, redact
from kindred.llm.roles import assign_roles, linked_groups
from kindred.llm.similar import nearest_vectors
from kindred.llm.sizes import token_counts
from kindred.llm.sql import SQL
from kindred.session import Scratch, spread


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = nearest_vectors(_table(spark, sf, "catalog_vectors"), "question_id", "embedding", k=10, least=0.85, recall=0.999, shortlist=64)
    pair = found.select(F.least("query", "neighbor").alias("question_id_a"), F.greatest("query", "neighbor").alias("question_id_b"))
    return pair.distinct()


_OVERLAP = ["question1", "question2"]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = split_overlaps(_table(spark, sf, "smoke_pairs").select("row_id", "split", *_OVERLAP), "row_id", "split", _OVERLAP)
    return pairs.select(F.least("train_key", "other_key").alias("row_id_a"), F.greatest("train_key", "other_key").alias("row_id_b"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_report(_table(spark, sf, "smoke_pairs").select("row_id", "split", "source", *_OVERLAP), "row_id", "split", "source", _OVERLAP)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _table(spark, sf, "smoke_pairs").select("row_id", "qid1", "qid2")
    return linked_groups(pairs, "row_id", ["qid1", "qid2"]).withColumnRenamed("group", "group_qid")


def p4_roles(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _table(spark, sf, "smoke_pairs").select("row_id", "qid1", "qid2", "is_duplicate")
    targets = {r["role_name"]: r["fraction"] for r in _table(spark, sf, "role_targets").collect()}
    groups = linked_groups(pairs, "row_id", ["qid1", "qid2"])
    return assign_roles(pairs.join(groups, "row_id", "left"), "row_id", "group", "is_duplicate", targets)


_FIELDS = {"question1": "question", "question2": "question"}


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _table(spark, sf, "smoke_pairs").select("row_id", "question1", "question2")
    return formatting_copies(pairs, "row_id", _FIELDS).select(F.col("kept").alias("row_id_kept"), F.col("copy").alias("row_id_copy"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapse(_table(spark, sf, "smoke_pairs"), "row_id", _FIELDS).select("row_id", "n_copies")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _table(spark, sf, "smoke_pairs").where("is_duplicate = 1")
    edges = pairs.select(clean_id(F.col("qid1")).alias("src"), clean_id(F.col("qid2")).alias("dst")).where("src <> dst")
    return match_groups(edges).select(F.col("node").alias("qid"), F.col("group").alias("group_qid"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    catalog = _table(spark, sf, "retrieval_catalog").select(F.concat(F.lit("c:"), "question_id").alias("rec"), F.col("question").alias("text"))
    pairs = _table(spark, sf, "smoke_pairs").select(F.concat(F.lit("p:"), "row_id").alias("rec"), F.col("question1").alias("text"))
    return near_texts(catalog.unionByName(pairs)).select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(_table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in the containers of every spec; each spec is a task of its own."""
    scratch = Scratch(spark)
    sizes = scratch.save(_sizes(spark, sf))
    specs = _table(spark, sf, "pack_spec").orderBy("spec_id").collect()
    packed = [pack(sizes, "doc_id", "n_tokens", s["capacity_tokens"], scratch).withColumn("spec_id", F.lit(s["spec_id"])) for s in specs]
    return reduce(DataFrame.unionByName, packed)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark)
    sizes = scratch.save(_sizes(spark, sf))
    specs = _table(spark, sf, "pack_spec").orderBy("spec_id").collect()
    reports = [fill_report(pack(sizes, "doc_id", "n_tokens", s["capacity_tokens"], scratch), s["capacity_tokens"]).withColumn("spec_id", F.lit(s["spec_id"])) for s in specs]
    return reduce(DataFrame.unionByName, reports)


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = token_counts(_table(spark, sf, "documents").select("doc_id", "source", "text"), "text").drop("text")
    return mix(docs, "doc_id", "source", "n_tokens", _table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_passages(_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _table(spark, sf, "known_names"))
    return found.select("doc_id", "kind", "found_text").distinct()


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact(_table(spark, sf, "documents").select("doc_id", "text"), "text", _table(spark, sf, "known_names")).select("doc_id", "redacted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_report, p4_found, p4_roles, p5_found, p5_collapsed, p6_found, p7_found, p8_packed, p8_report, p9_mix, p9_report, p10_found, p10_redacted)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
