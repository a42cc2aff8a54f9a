"""Splits that keep linked records together and stay near the wanted shares, overall and by label.

Groups are the components of the bipartite record-entity graph, found by minimum-label propagation: in a round every record takes the
least label of its entities and every entity the least of its records. Records with equal entities are one vertex.

Roles are then given to whole groups. Groups so large that they move a role's share by themselves (at most 4096)
are placed one by one where the deviation from the wanted label counts grows least; all others are ordered by
a seeded hash within strata of equal label profile, and each stratum is cut at shares of its own, which together leave every label
of every role as near to what is still open as the strata allow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import clean_id
from kindred.operators.graph import HUB_EDGES
from kindred.operators.ordering import running_total
from kindred.session import Scratch


def _ranked(entity: Column, level: int, seed: int) -> Column:
    return F.struct(F.xxhash64(entity, F.lit(level), F.lit(seed)).alias("rank"), entity.alias("entity"))


def bipartite_components(records: DataFrame, scratch: Scratch, rounds: int = 3, seed: int = 0, cap: int = HUB_EDGES, max_levels: int = 200) -> DataFrame:
    """(entity, root) of the entities of ``records`` (entities: array<string> of at least two distinct ones); equal root means linked.

    A row is a record vertex, its array its edges. A round has two steps: every record takes the least label of its entities, every entity the
    least of its records. After ``rounds`` rounds, entities with the same label contract to one, records keep the distinct labels of their
    entities, and those with a single one are done. Labels are ordered by a seeded hash, anew on every level, so that long paths shrink fast.
    An entity in more than ``cap`` records is split into parts, which records of their own link to the first.
    """
    current, count = scratch.save_counted(records.select("entities").distinct().withColumn("rec", F.monotonically_increasing_id()))
    levels: list[DataFrame] = []
    for level in range(max_levels):
        if not count:
            break
        edges = current.select("rec", F.explode("entities").alias("entity"))
        many = edges.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > cap)
        hubs, n = scratch.save_counted(many.select(F.col("entity").alias("hub"), F.ceil(F.col("n") / cap).cast("long").alias("parts"))) if count > cap else (None, 0)
        if n:
            part = lambda number: F.when(number > 0, F.concat(F.lit("#"), number, F.col("hub"))).otherwise(F.col("hub"))
            own = edges.join(hubs, F.col("entity") == F.col("hub"), "left").select("rec", F.coalesce(part(F.pmod(F.xxhash64("rec"), F.col("parts"))), "entity").alias("entity"))
            links = hubs.select("hub", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("i")).withColumn("rec", -1 - F.monotonically_increasing_id())
            links = links.select("rec", F.explode(F.array(F.col("hub"), part(F.col("i")))).alias("entity"))
            edges = scratch.save(own.unionByName(links))
        labelled = edges.withColumn("label", _ranked(F.col("entity"), level, seed))  # the first round needs no join
        for _ in range(rounds):
            least = labelled.groupBy("rec").agg(F.min("label").alias("label"), F.collect_list("entity").alias("to"))  # a record's own entities
            labels = least.select("label", F.explode("to").alias("entity")).groupBy("entity").agg(F.min("label").alias("label"))
            labelled = edges.join(labels, "entity")
        found = scratch.save(labels.select("entity", F.col("label.entity").alias("center")))
        levels.append(found)
        moved = edges.join(found, "entity").groupBy("rec").agg(F.collect_set("center").alias("entities")).where(F.size("entities") > 1)
        following = moved.select(F.sort_array("entities").alias("entities")).distinct()
        current, count = scratch.save_counted(following.withColumn("rec", F.monotonically_increasing_id()))
    else:
        raise RuntimeError(f"records are left after {max_levels} levels")
    if not levels:
        return records.select(F.explode("entities").alias("entity"), F.lit("").alias("root"))
    roots = levels[-1].toDF("entity", "root")
    for found in reversed(levels[:-1]):
        roots = found.join(roots.toDF("center", "root"), "center", "left").select("entity", F.coalesce("root", "center").alias("root"))
    return roots


def linked_groups(df: DataFrame, key: str, entities: list[str], scratch: Scratch | None = None) -> DataFrame:
    """(key, group) for every record with at least one entity: the smallest clean id linked to it.

    Ids are compared trimmed and in lower case; null and blank ones are missing. A record links all its entities,
    whatever its other columns hold. Records without any entity are left out. Repeated records keep a row each.
    """
    scratch = scratch or Scratch(df.sparkSession)
    ids = F.sort_array(F.array_distinct(F.array_compact(F.array(*[clean_id(F.col(c)) for c in entities]))))
    rows = scratch.save(df.select(F.col(key), ids.alias("_ids")).where(F.size("_ids") > 0))
    # names begin with "=", parts of hubs don't, so ids may hold any character
    records = rows.where(F.size("_ids") > 1).select(F.transform("_ids", lambda e: F.concat(F.lit("="), e)).alias("entities"))
    roots = scratch.save(bipartite_components(records, scratch).where(F.col("entity").startswith("=")).select(F.substr("entity", F.lit(2)).alias("node"), "root"))
    least = scratch.save(roots.groupBy("root").agg(F.min("node").alias("group")))
    groups = scratch.save(roots.join(least, "root").select("node", "group"))
    first = rows.select(key, F.get("_ids", F.lit(0)).alias("node"))  # an entity without partner is its own group
    return first.join(groups, "node", "left").select(key, F.coalesce("group", "node").alias("group"))


def stratum_shares(held: np.ndarray, open_: np.ndarray, rounds: int = 200) -> np.ndarray:
    """(strata, roles): which share of each stratum a role gets, so that the labels the roles get are near ``open_`` (roles, labels).

    ``held``: records by stratum and label. Shares start equal in all strata and are scaled in turn towards the labels still open and back to a sum of 1.
    """
    total = np.where(open_.sum(axis=1) > 0, open_.sum(axis=1), 0.0)
    start = total / total.sum() if total.sum() else np.full(len(open_), 1 / len(open_))
    shares = np.tile(start, (len(held), 1))
    profile = held / np.maximum(held.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        got = shares.T @ held
        ratio = np.where(got > 0, open_ / np.maximum(got, 1e-12), 1.0)
        shares = shares * np.maximum(profile @ ratio.T, 1e-12)
        shares /= shares.sum(axis=1, keepdims=True)
    return shares


def assign_roles(
    records: DataFrame, key: str, group: str, label: str, targets: dict[str, float], seed: int = 0, scratch: Scratch | None = None
) -> DataFrame:
    """(key, role): all records of a group in one role; a record with a null group is a group of its own.

    ``targets`` holds the wanted shares (normalised to sum 1; negative or all-zero ones raise). Shares are met for
    each label value up to the size of one group. Null labels are a label of their own.
    """
    names = sorted(targets)
    share = np.array([targets[n] for n in names], dtype=float)
    if not len(names) or (share < 0).any() or share.sum() <= 0:
        raise ValueError("targets need non-negative shares with a positive sum")
    share /= share.sum()
    scratch = scratch or Scratch(records.sparkSession)
    alone = F.concat(F.lit("\x00"), F.col(key).cast("string"))
    state = F.when(F.col(label) == 1, 0).when(F.col(label) == 0, 1).otherwise(2)
    rows = records.select(key, F.coalesce(F.col(group).cast("string"), alone).alias("_group"), state.alias("_state"))
    counts = [F.sum((F.col("_state") == i).cast("long")).alias(f"_n{i}") for i in range(3)]
    groups = scratch.save(rows.groupBy("_group").agg(*counts).withColumn("_size", F.col("_n0") + F.col("_n1") + F.col("_n2")))
    total = groups.agg(*[F.coalesce(F.sum(f"_n{i}"), F.lit(0)) for i in range(3)]).first()
    all_counts = np.array(total, dtype=float)
    floor = max(1, int(all_counts.sum()) // 4096)
    wanted = share[:, None] * all_counts[None, :]
    placed = np.zeros_like(wanted)
    large = groups.where(F.col("_size") > floor).orderBy(F.desc("_size"), "_group").collect()
    chosen = []
    for row in large:
        add = np.array([row[f"_n{i}"] for i in range(3)], dtype=float)
        growth = ((placed + add - wanted) ** 2 - (placed - wanted) ** 2).sum(axis=1)
        role = int(np.argmin(growth))
        placed[role] += add
        chosen.append((row["_group"], names[role]))
    spark = records.sparkSession
    fixed = spark.createDataFrame(chosen, "_group string, role string")
    profile = F.concat_ws("/", F.floor(10 * F.col("_n0") / F.col("_size")), F.floor(10 * F.col("_n1") / F.col("_size")))
    rest = groups.where(F.col("_size") <= floor).withColumn("_stratum", profile)
    strata = rest.groupBy("_stratum").agg(F.sum("_size").alias("_all"), *[F.sum(f"_n{i}").alias(f"_s{i}") for i in range(3)]).orderBy("_stratum").collect()  # at most 121 rows
    held = np.array([[r[f"_s{i}"] for i in range(3)] for r in strata], dtype=float).reshape(len(strata), 3)
    cuts = np.cumsum(stratum_shares(held, np.maximum(wanted - placed, 0)), axis=1)
    table = [(r["_stratum"], r["_all"], c[:-1].tolist()) for r, c in zip(strata, cuts, strict=True)]
    cut_at = spark.createDataFrame(table, "_stratum string, _all long, _cuts array<double>")
    ordered = running_total(rest, "_stratum", ["_group"], F.col("_size"), "_before", seed).join(F.broadcast(cut_at), "_stratum")
    place = (F.col("_before") + F.col("_size") / 2) / F.col("_all")
    role = F.get(F.lit(names), F.size(F.filter("_cuts", lambda c: c < place)))
    assigned = scratch.save(ordered.select("_group", role.alias("role")).unionByName(fixed))
    return rows.join(assigned, "_group").select(key, "role")
