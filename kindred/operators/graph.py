"""Connected components over edge tables of any size.

The engine works in levels. On a level every vertex has a start value; for a few rounds it takes the smallest
(arrival, centre) among its own and its neighbours', an arrival growing by the round's hop length. Vertices with
the same centre then become one super-vertex, edges inside vanish, equal ones merge, and the next level works on
what is left. At the end the levels' assignments are composed. Start values come from hashes, so the rounds
shrink chains, stars and meshes alike, and a rerun gives the same table.

Vertices with very many edges are split into parts before the rounds (each part keeps a share of the edges and
a link to the first part), so no join key holds many more than ``cap`` edges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import Scratch

HUB_EDGES = 20_000


def named(node: Column) -> Column:
    """The name of a vertex in the engine; parts of hubs have names that begin with another character, so no id can be taken for one."""
    return F.concat(F.lit("="), node.cast("string"))


def uniform(node: Column, level: int, seed: int) -> Column:
    """A number in (0, 1) from the hash of a vertex."""
    bits = F.xxhash64(node, F.lit(level), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _part(name: Column, number: Column) -> Column:
    """Part 0 keeps the name; the others are told apart by their number before it."""
    return F.when(number > 0, F.concat(F.lit("#"), number, name)).otherwise(name)


def split_hubs(edges: DataFrame, scratch: Scratch, cap: int = HUB_EDGES) -> tuple[DataFrame, bool]:
    """Directed edges (src, dst), both directions present, with hubs split into parts of about ``cap`` edges; and whether there were any.

    The hubs are a table that is joined, small or large: there are at most as many as edges divided by ``cap``.
    """
    many = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > cap)
    hubs, n = scratch.save_counted(many.select(F.col("src").alias("hub"), F.ceil(F.col("n") / cap).cast("long").alias("parts")))
    if not n:
        return edges, False

    def parted(df: DataFrame, name: str, other: str) -> DataFrame:
        joined = df.join(hubs, F.col(name) == F.col("hub"), "left")
        return joined.withColumn(name, _part(F.col(name), F.pmod(F.xxhash64(other), F.col("parts")))).drop("hub", "parts")

    spread = parted(parted(edges.withColumn("_dst", F.col("dst")), "dst", "src"), "src", "_dst").drop("_dst")
    links = hubs.where("parts > 1").select("hub", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("i"))
    links = links.select(F.col("hub").alias("src"), _part(F.col("hub"), F.col("i")).alias("dst"))
    return spread.unionByName(links).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), True


def _round(labels: DataFrame, edges: DataFrame, hop: float) -> DataFrame:
    """Every vertex takes the smallest of its own label and its neighbours'."""
    sent = edges.join(labels, edges["src"] == labels["node"]).select(
        F.col("dst").alias("node"), F.struct((F.col("label.at") + hop).alias("at"), F.col("label.center").alias("center")).alias("label")
    )
    return labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("label"))


def both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(ends)).distinct()


def contract_components(
    edges: DataFrame, scratch: Scratch, start: Callable[[Column, int], Column], hops: Sequence[float], max_levels: int = 200, cap: int = HUB_EDGES
) -> DataFrame:
    """(node, root) for every vertex of ``edges`` (src, dst: strings without null); equal root means linked.

    Loops and repeated edges are allowed, ids may hold any character; an empty table gives an empty one. Raises if edges are
    left after ``max_levels`` levels, which hashed start values make all but impossible.
    """
    given = edges.select(named(F.col("src")).alias("src"), named(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
    first, count = scratch.save_counted(both_ways(given), F.col("src") != F.col("dst"))
    loops = first.where("src = dst").select(F.col("src").alias("node"))
    current = first.where("src <> dst")
    label = lambda c, level: F.struct(start(c, level).alias("at"), c.alias("center"))
    levels: list[DataFrame] = []
    for level in range(max_levels):
        if not count:
            break
        spread, hubs = split_hubs(current, scratch, cap) if count > cap else (current, False)
        if hubs:
            spread = scratch.save(spread)
        # the first round needs no join: a neighbour's start value follows from its name
        come = F.min(F.struct((start(F.col("src"), level) + hops[0]).alias("at"), F.col("src").alias("center")))
        labels = spread.groupBy(F.col("dst").alias("node")).agg(come.alias("label"))
        labels = labels.select("node", F.least("label", label(F.col("node"), level)).alias("label"))
        for hop in hops[1:]:
            labels = _round(labels, spread, hop)
        found = scratch.save(labels.select("node", F.col("label.center").alias("center")))
        levels.append(found)
        left, right = found.toDF("src", "a"), found.toDF("dst", "b")
        crossing = spread.where("src < dst").join(left, "src").join(right, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        following, count = scratch.save_counted(both_ways(crossing))
        if hubs:
            scratch.drop(spread)
        if level:
            scratch.drop(current)
        current = following
    else:
        raise RuntimeError(f"edges are left after {max_levels} levels")
    bare = lambda c: F.substr(c, F.lit(2))
    if not levels:
        return loops.select(bare("node").alias("node"), bare("node").alias("root"))
    roots = levels[-1].toDF("node", "root")
    for found in reversed(levels[:-1]):
        above = roots.toDF("center", "root")
        roots = found.join(above, "center", "left").select("node", F.coalesce("root", "center").alias("root"))
    alone = loops.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = roots.where(F.col("node").startswith("=")).unionByName(alone)
    return every.select(bare("node").alias("node"), "root")


def smallest_labels(roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, group): roots replaced by the smallest node of their component, by code point.

    Both sides of the join are written tables, so a component with a large share of all vertices is split by the
    adaptive skew join.
    """
    members = scratch.save(roots)
    least = scratch.save(members.groupBy("root").agg(F.min("node").alias("group")))
    return members.join(least, "root").select("node", "group")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, scratch: Scratch | None = None, seed: int = 0) -> DataFrame:
    """(node, group) with the smallest node as group, by minimum-label rounds over randomly ranked vertices.

    ``nodes`` (node) adds vertices without edges as groups of their own; null nodes are left out.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    roots = contract_components(edges, scratch, lambda node, level: uniform(node, level, seed), (0.0, 0.0, 0.0))
    groups = smallest_labels(roots, scratch)
    if nodes is None:
        return groups
    every = nodes.select(F.col("node").cast("string")).where("node is not null").distinct()
    return every.join(groups, "node", "left").select("node", F.coalesce("group", "node").alias("group"))
