"""Document contracts, comparisons and the timing harness."""

import time

import pytest
from pyspark.sql import functions as F

from kindred.operators import profile
from kindred.plans import contracts


def test_profiles(spark):
    pairs = spark.createDataFrame([(i, "w " * (1 + i % 20), "x") for i in range(60)], "row_id long, question1 string, question2 string")
    strata = profile.pair_strata(pairs)
    found = profile.profile(lambda df: df.select(F.length("question1")), strata, "bucket", repeats=2)
    assert set(found["strata"]) == {"short", "medium", "long"} and found["latency"]["n"] == 6
    assert contracts.problems("profile", found) == []
    found["strata"]["short"]["n"] = 9
    found["strata"]["long"]["p50_ms"] = 1e9
    assert len(contracts.problems("profile", found)) == 2
    sizes = profile.batch_numbers(strata, "row_id", "bucket", 2, buckets=3).groupBy("bucket", "batch").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[:] == (2, 60)


def test_deadline(spark):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    with pytest.raises(Exception), profile.deadline(spark, 1):
        spark.range(2).select(slow("id")).collect()
    assert spark.range(3).count() == 3


def test_rules():
    good = {"source": {"sha256": "0" * 64, "rows": 3}, "columns": {"lang": {"labeling_method": "x", "description": "y"}}}
    assert contracts.problems("slices", good) == []
    assert contracts.problems("slices", {"source": {"sha256": "Z", "rows": True}, "columns": {"lang": {}}}) == [
        "source.sha256 must be a SHA-256", "source.rows must be a whole number of at least 0", "columns.lang: labeling_method is missing", "columns.lang: description is missing"
    ]
    roles = {r: {"sha256": "0" * 64, "fraction": 0.25} for r in ("train", "tuning", "calibration", "final_holdout")}
    assert contracts.problems("protocol", {"roles": roles, "split": {"seed": 1}}) == [", ".join(f"roles.{r}.sha256" for r in roles) + " must differ"]
    with pytest.raises(ValueError):
        contracts.problems("?", {})


def test_differences():
    assert contracts.differences({"a": [1.0, "x"], "b": None}, {"a": [1.0005, "x"], "b": None}) == []
    assert contracts.differences({"a": 1, "c": 2}, {"a": 2}) == [".c stands on one side only", ".a: 1 and 2"]


def test_light_command():
    assert contracts.light_command(["run", "--csv", "/a/b.csv", "--out=/c/d/", "--k", "3"], ["--csv", "--out"]) == ["run", "--csv", "<b.csv>", "--out=<d>", "--k", "3"]
    assert contracts.commit("/nowhere") is None
