"""Audits of labelled pair tables: label, pair and id summaries, and the named checks built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import strip_space
from kindred.operators.graph import connected_components
from kindred.session import Scratch


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0))


def bare(column: str) -> Column:
    """Text without white space at its ends; null counts as empty."""
    return strip_space(F.coalesce(F.col(column).cast("string"), F.lit("")))


def label_summary(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """rows, negatives, positives, invalid (null or not 0/1), positive_rate over all rows (0 for none)."""
    y = F.col(label)
    counts = df.agg(F.count("*").alias("n_rows"), _count(y == 0).alias("n_negative"), _count(y == 1).alias("n_positive"))
    invalid = F.col("n_rows") - F.col("n_negative") - F.col("n_positive")
    return counts.withColumn("n_invalid", invalid).withColumn("positive_rate", F.col("n_positive") / F.greatest("n_rows", F.lit(1)))


def pair_summary(df: DataFrame, left: str = "question1", right: str = "question2") -> DataFrame:
    """empty texts per side, rows with equal sides, rows in repeated unordered pairs (all members), repeated pairs."""
    a, b = bare(left), bare(right)
    pairs = df.select(a.alias("a"), b.alias("b")).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(
        F.count("*").alias("n"), F.sum((F.col("a") == "").cast("long")).alias("empty1"), F.sum((F.col("b") == "").cast("long")).alias("empty2")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pairs.agg(
        zero("empty1").alias("empty_question1"), zero("empty2").alias("empty_question2"), zero(F.when(F.col("lo") == F.col("hi"), F.col("n"))).alias("identical_rows"),
        zero(F.when(F.col("n") > 1, F.col("n"))).alias("duplicate_rows"), _count(F.col("n") > 1).alias("duplicate_pairs"),
    )


def id_summary(df: DataFrame, id1: str = "qid1", id2: str = "qid2", scratch: Scratch | None = None) -> DataFrame:
    """complete_rows (both ids there), unique_ids, repeated_ids, components over the edges of complete rows."""
    scratch = scratch or Scratch(df.sparkSession)
    ids = scratch.save(df.select(bare(id1).alias("src"), bare(id2).alias("dst")))
    complete = ids.where("src <> '' and dst <> ''")
    each = ids.select(F.explode(F.array("src", "dst")).alias("node")).where("node <> ''").groupBy("node").agg(F.count("*").alias("n"))
    groups = connected_components(complete, each.select("node"), scratch)
    parts = [
        complete.agg(F.count("*").alias("complete_rows")), each.agg(F.count("*").alias("unique_ids"), _count(F.col("n") > 1).alias("repeated_ids")),
        groups.where("node = group").agg(F.count("*").alias("components")),  # a group's smallest node is in it
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def audit_checks(df: DataFrame, require_ids: bool = False, require_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(check, status, observed): pass, warn or fail.

    Rows and labels fail, texts and ids warn unless required, repeated pairs only ever warn.
    """
    facts = label_summary(df).crossJoin(pair_summary(df)).crossJoin(id_summary(df, scratch=scratch))  # one row each
    status = lambda bad, word: F.when(bad, word).otherwise("pass")
    empty = F.col("empty_question1") + F.col("empty_question2")
    missing = F.col("n_rows") - F.col("complete_rows")
    checks = [
        ("non_empty", status(F.col("n_rows") == 0, "fail"), F.col("n_rows")), ("binary_labels", status(F.col("n_invalid") > 0, "fail"), F.col("n_invalid")),
        ("both_classes", status((F.col("n_positive") == 0) | (F.col("n_negative") == 0), "fail"), F.least("n_positive", "n_negative")),
        ("question_text", status(empty > 0, "fail" if require_text else "warn"), empty), ("question_ids", status(missing > 0, "fail" if require_ids else "warn"), missing),
        ("repeated_pairs", status(F.col("duplicate_rows") > 0, "warn"), F.col("duplicate_rows")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status"), o.cast("long").alias("observed")) for n, s, o in checks])
    return facts.select(F.inline(rows))


def question_texts(df: DataFrame, key: str, sides: list[tuple[str, str]], clean) -> DataFrame:
    """(qid, question, n_texts): the first text of each id by row and side, and how many different clean texts it has."""
    rows = [df.select(F.col(key).alias("k"), F.lit(i).alias("side"), F.col(q).alias("qid"), bare(t).alias("question")) for i, (q, t) in enumerate(sides)]
    every = rows[0]
    for other in rows[1:]:
        every = every.unionByName(other)
    given = every.where("qid is not null").withColumn("_c", clean(F.col("question")))
    return given.groupBy("qid").agg(F.min_by("question", F.struct("k", "side")).alias("question"), F.count_distinct("_c").alias("n_texts"))
