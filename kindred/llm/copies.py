"""Duplicates hidden by formatting: one record per multiset of normalised field values.

Each (field name, clean value) pair is hashed twice with different seeds and the hashes are added, so the
fingerprint doesn't depend on field order; fields that share a name are interchangeable. Records meet by
fingerprint, and each is then compared with the group's first record, value by value and without sorting.
Records that only share the fingerprint are grouped again by their exact values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import clean_text
from kindred.session import Scratch


def fingerprint(named: list[tuple[str, Column]], seed: int) -> Column:
    """Sum of the hashes of (name, value); each hash loses as many bits as keep the sum within a long."""
    spare = max(1, (len(named) - 1).bit_length()) + 1
    total = F.lit(0).cast("long")
    for name, value in named:
        total = total + F.shiftrightunsigned(F.xxhash64(F.lit(name), value, F.lit(seed)), spare)
    return total


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often."""
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: F.size(F.filter(a, lambda y: y == x)) == F.size(F.filter(b, lambda y: y == x)))


def formatting_copies(df: DataFrame, key: str, fields: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """(kept, copy): every record beyond the one with the smallest key of its group, with that key.

    ``fields`` maps columns to field names. Null and blank values count as empty text; records that are empty in
    all fields are copies of each other. Keys must be unique; rows with a null key are left out. Empty tables
    give empty results. Texts of any length are compared whole.
    """
    scratch = scratch or Scratch(df.sparkSession)
    cleaned = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[clean_text(F.col(c)).alias(f"_c{i}") for i, c in enumerate(fields)])
    named = [(name, F.col(f"_c{i}")) for i, name in enumerate(fields.values())]
    value = F.array(*[F.concat(F.lit(name + ":"), c) for name, c in named])
    rows = cleaned.select("_key", value.alias("_values"), fingerprint(named, 1).alias("_f1"), fingerprint(named, 2).alias("_f2"))
    groups = rows.groupBy("_f1", "_f2").agg(F.count("*").alias("_n"), F.min(F.struct("_key", "_values")).alias("_first"))
    groups = scratch.save(groups.where("_n > 1").drop("_n"))
    met = rows.join(groups, ["_f1", "_f2"]).where(F.col("_key") != F.col("_first._key"))
    equal = same_multiset(F.col("_values"), F.col("_first._values"))
    met = met.select(F.col("_first._key").alias("kept"), F.col("_key").alias("copy"), F.when(~equal, F.array_sort("_values")).alias("_other"))
    met = scratch.save(met)
    others = met.where("_other is not null")  # they share only a fingerprint
    first = others.groupBy("_other").agg(F.min("copy").alias("kept"))
    again = others.select("copy", "_other").join(first, "_other").where("copy <> kept").select("kept", "copy")
    return met.where("_other is null").select("kept", "copy").unionByName(again)


def collapse(df: DataFrame, key: str, fields: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """The first record of every group, all its columns kept, with ``n_copies`` (the record itself included)."""
    scratch = scratch or Scratch(df.sparkSession)
    pairs = scratch.save(formatting_copies(df, key, fields, scratch))
    counts = pairs.groupBy(F.col("kept").alias("_kept")).agg(F.count("*").alias("_more"))
    firsts = df.where(F.col(key).isNotNull()).join(pairs.select(F.col("copy").alias(key)), key, "left_anti")
    joined = firsts.join(counts, F.col(key) == F.col("_kept"), "left")
    return joined.withColumn("n_copies", F.lit(1) + F.coalesce("_more", F.lit(0))).drop("_kept", "_more")
