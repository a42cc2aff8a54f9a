"""Running totals within groups of any size, without one task holding a group.

A group is cut into hash buckets; each (group, bucket) is ordered on its own and shifted by the total of the
buckets before it. A group that holds a third of all rows is thus spread over ``buckets`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: str, order: list[str], amount: Column, out: str, seed: int = 0, buckets: int = 256) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows of the same group that come before this one.

    The order is the seeded hash of ``order`` (which should be unique in a group), ties by ``order`` itself. A null group is a
    group of its own; a null amount counts as 0.
    """
    hashed = F.xxhash64(*order, F.lit(seed))
    df = df.withColumns({"_h": hashed, "_b": F.pmod(F.shiftright(hashed, 32), F.lit(buckets)), "_a": F.coalesce(amount.cast("long"), F.lit(0))})
    within = Window.partitionBy(group, "_b").orderBy("_h", *order)
    rows = df.withColumn("_r", F.sum("_a").over(within) - F.col("_a"))
    across = Window.partitionBy(group).orderBy("_b")
    sums = df.groupBy(group, "_b").agg(F.sum("_a").alias("_s"))
    shift = sums.withColumn("_o", F.sum("_s").over(across) - F.col("_s")).select(F.col(group).alias("_g"), F.col("_b").alias("_b2"), "_o")
    joined = rows.join(shift, rows[group].eqNullSafe(shift["_g"]) & (rows["_b"] == shift["_b2"]))
    return joined.withColumn(out, F.col("_r") + F.col("_o")).drop("_h", "_b", "_a", "_r", "_g", "_b2", "_o")
