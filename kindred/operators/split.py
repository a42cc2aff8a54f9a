"""Train/evaluation and four-role splits that keep question components together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import strip_space
from kindred.operators.graph import connected_components
from kindred.session import Scratch

ROLES = ("final_holdout", "calibration", "tuning", "train")


def seeded_rank(value: Column, seed: int) -> Column:
    """A permutation key: 32 bits of the MD5 of value and seed, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", value.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def ids_complete(df: DataFrame, id1: str = "qid1", id2: str = "qid2") -> bool:
    """Whether no row lacks an id (blank counts as missing)."""
    missing = lambda c: F.coalesce(strip_space(F.col(c).cast("string")), F.lit("")) == ""
    return df.where(missing(id1) | missing(id2)).limit(1).isEmpty()


def row_components(df: DataFrame, key: str, id1: str = "qid1", id2: str = "qid2", scratch: Scratch | None = None) -> DataFrame:
    """(key, component): the smallest id linked to the row's first id; only rows with both ids."""
    scratch = scratch or Scratch(df.sparkSession)
    rows = df.select(key, F.col(id1).cast("string").alias("src"), F.col(id2).cast("string").alias("dst")).where("src is not null and dst is not null")
    groups = scratch.save(connected_components(rows.select("src", "dst"), scratch=scratch))
    return rows.join(groups.withColumnRenamed("node", "src"), "src").select(key, F.col("group").alias("component"))


def four_roles(
    rows: DataFrame, key: str, fractions: dict[str, float], seed: int = 42, scratch: Scratch | None = None
) -> DataFrame:
    """(key, role) of rows (key, component): final_holdout, calibration, tuning take components in a seeded order until they have
    their rows (at least max(1, int(n * fraction))), train gets the rest.

    Components are cut by running sums over hash ranges of the seeded order, so no task holds them all. Raises if a role stays
    without a component.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    for role in ROLES[:3]:
        if not 0 < fractions.get(role, -1) < 1:
            raise ValueError(f"{role} needs a fraction between 0 and 1")
    sizes = scratch.save(rows.groupBy("component").agg(F.count("*").alias("size")).withColumn("perm", seeded_rank(F.col("component"), seed)))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ordered = _before(sizes)
    start, cuts = 0, []
    for role in ROLES[:3]:
        goal = start + max(1, int(total * fractions[role]))
        # the first component at whose end the role has its rows
        end = ordered.where(F.col("before") + F.col("size") >= goal).agg(F.min(F.col("before") + F.col("size"))).first()[0]
        if end is None or end >= total:
            raise ValueError(f"too few components for {role} and the roles after it")
        cuts.append((role, start, end))
        start = end
    role = F.lit("train")
    for name, a, b in cuts:
        role = F.when((F.col("before") >= a) & (F.col("before") < b), name).otherwise(role)
    assigned = scratch.save(ordered.select("component", role.alias("role")))
    return rows.join(assigned, "component").select(key, "role")


def _before(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``before``: rows of the components that come earlier by (perm, component)."""
    ranged = sizes.withColumn("_r", F.shiftright("perm", 24))  # 256 ranges of the 32-bit order
    inner = Window.partitionBy("_r").orderBy("perm", "component")
    outer = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_r").agg(F.sum("size").alias("_s")).select("_r", F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_o"))  # 256 rows
    return ranged.withColumn("before", F.sum("size").over(inner) - F.col("size")).join(F.broadcast(starts), "_r").withColumn("before", F.col("before") + F.col("_o")).drop("_r", "_o")


def train_eval(rows: DataFrame, key: str, eval_fraction: float, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(key, part) of rows (key[, component]): part is eval or train.

    No evaluation part for a fraction of 0 or fewer than 20 rows. With components, whole ones in a seeded order make up the
    evaluation part until it has max(1, min(int(n * fraction), n - 1)) rows, and one that would leave nothing to train on is
    skipped; without, the first rows in a seeded order.
    """
    if not 0 <= eval_fraction < 1:
        raise ValueError("eval_fraction must be at least 0 and below 1")
    scratch = scratch or Scratch(rows.sparkSession)
    total = rows.count()
    if eval_fraction == 0 or total < 20:
        return rows.select(key, F.lit("train").alias("part"))
    goal = max(1, min(int(total * eval_fraction), total - 1))
    single = rows if "component" in rows.columns else rows.withColumn("component", F.col(key).cast("string"))
    sizes = scratch.save(single.groupBy("component").agg(F.count("*").alias("size")).withColumn("perm", seeded_rank(F.col("component"), seed)))
    if sizes.limit(2).count() < 2:
        raise ValueError("one component holds all rows")
    ordered = _before(sizes)
    # a component that takes all that is left is the last one, or alone larger than the rest: only the former can come up before the goal is met
    chosen = ordered.where((F.col("before") < goal) & (F.col("before") + F.col("size") < total)).select("component", F.lit("eval").alias("part"))
    return single.join(chosen, "component", "left").select(key, F.coalesce("part", F.lit("train")).alias("part"))


def role_statistics(assigned: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """role, rows, components, negatives, positives, observed_fraction."""
    joined = assigned.join(rows.select(key, "component", label), key)
    per_component = joined.groupBy("role", "component").agg(
        F.count("*").alias("n"), F.sum((F.col(label) == 0).cast("long")).alias("n0"), F.sum((F.col(label) == 1).cast("long")).alias("n1")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    stats = per_component.groupBy("role").agg(F.sum("n").alias("n_rows"), F.count("*").alias("components"), zero("n0").alias("negatives"), zero("n1").alias("positives"))
    total = stats.agg(F.sum("n_rows").alias("_all"))  # one row
    return stats.crossJoin(F.broadcast(total)).withColumn("observed_fraction", F.col("n_rows") / F.col("_all")).drop("_all")


def shared_ids(df: DataFrame, split: str, ids: list[str]) -> DataFrame:
    """(split_a, split_b, n_ids): ids that stand in two splits; pairs of splits without common id have no row."""
    each = df.where(F.col(split).isNotNull()).select(F.col(split).alias("s"), F.explode(F.array(*ids)).alias("id")).where("id is not null and trim(id) <> ''")
    sets = each.groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("ss"))  # a set holds at most the few splits
    a = sets.where(F.size("ss") > 1).select(F.explode("ss").alias("split_a"), "ss").select("split_a", F.explode("ss").alias("split_b"))
    return a.where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("n_ids"))
