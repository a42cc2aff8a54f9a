"""A mix of sources with given shares of all tokens.

Documents of a source lie in a seeded order and are cut into blocks of equal tokens, up to a document at the borders. The size of the mix
is the largest for which no source needs more than its tokens times its repeats; Sainte-Lague apportionment (highest
quotients share / (2 q + 1)) gives each source its whole number of blocks. The blocks of every source are dealt to the shards
in equal parts, again by highest quotients, so that each shard is a mix of its own. Which blocks
a source gives beyond whole rounds is decided by the seed.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.ordering import running_total
from kindred.session import Scratch


def sainte_lague(shares: dict[str, float], seats: int, most: dict[str, int] | None = None) -> dict[str, int]:
    """Seats by highest quotients share / (2 q + 1); ``most`` caps what a name can take; ties go to the smaller name.

    A start below the fair quota skips the first quotients, which are all higher than those that decide.
    """
    total = sum(shares.values())
    if seats < 0 or total <= 0 or min(shares.values()) < 0:
        raise ValueError("seats must not be negative; shares need a positive sum and no negative one")
    cap = lambda n: most[n] if most else seats
    got = {n: min(cap(n), max(0, int(seats * s / total) - len(shares))) if s > 0 else 0 for n, s in shares.items()}
    heap = [(-s / (2 * got[n] + 1), n) for n, s in shares.items() if s > 0 and got[n] < cap(n)]
    heapq.heapify(heap)
    left = seats - sum(got.values())
    while left > 0 and heap:
        _, n = heapq.heappop(heap)
        got[n] += 1
        left -= 1
        if got[n] < cap(n):
            heapq.heappush(heap, (-shares[n] / (2 * got[n] + 1), n))
    return got


def shard_quotas(quota: dict[str, int], shards: int) -> dict[str, list[int]]:
    """Blocks of each source in each shard: shards get equal numbers of blocks, up to one, and each is a mix as near to the whole as whole numbers allow.

    A shard is apportioned on what the earlier ones left, so rounding doesn't add up and every block has a place.
    """
    left = dict(quota)
    out: dict[str, list[int]] = {n: [] for n in quota}
    for shard in range(shards):
        total = sum(left.values())
        seats = -(-total // (shards - shard))
        got = sainte_lague({n: float(v) for n, v in left.items()}, seats, left) if total else dict.fromkeys(left, 0)
        for n in quota:
            out[n].append(got[n])
            left[n] -= got[n]
    return out


def mix(
    docs: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, block_tokens: int = 512, shards: int = 8, seed: int = 17, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """The mix (key, source, n_tokens, repeat, shard) and the report (source, target_share, ...).

    ``targets``: (source, target_share, max_repeats), at most a few thousand rows. Sources compare trimmed and in lower case;
    documents of a null source or one without target, with a null key or without tokens are not used. A document stands in the mix
    at most max_repeats times, repeat counts from 1. Empty tables give an empty mix and a report of zeros. The shares are
    met up to a block per source; a source without documents leaves its share to the others, which the report shows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    name = lambda c: F.lower(F.trim(c))
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(name(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("share"), F.max("max_repeats").alias("times")
    ).collect()
    share = {r["source"]: float(r["share"]) for r in wanted}
    times = {r["source"]: int(r["times"]) for r in wanted}
    used = docs.where(F.col(key).isNotNull() & (F.col(tokens) > 0)).select(F.col(key).alias("_key"), name(F.col(source)).alias("source"), F.col(tokens).cast("long").alias("n_tokens"))
    used = scratch.save(used.where(F.col("source").isin(list(share))) if share else used.limit(0))  # read three times, sized once
    ordered = scratch.save(running_total(used, "source", ["_key"], F.col("n_tokens"), "_before", seed))
    tokens_of = {r["source"]: r["t"] for r in ordered.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # at most the targets
    stock = {s: (max(1, round(t / block_tokens)), t) for s, t in tokens_of.items()}
    sizes = spark.createDataFrame([(s, n, t) for s, (n, t) in sorted(stock.items())], "source string, _n long, _t long")
    at = F.floor((F.col("_before") + F.col("n_tokens") / 2) * F.col("_n") / F.col("_t"))
    blocks = ordered.join(F.broadcast(sizes), "source").select("_key", "source", "n_tokens", F.least(at, F.col("_n") - 1).alias("block"))
    live = {s: v for s, v in share.items() if s in stock}
    plan, places = [], []
    if live:
        total = sum(live.values())
        seats = int(min(stock[s][1] * times[s] * total / v for s, v in live.items()) / block_tokens)
        quota = sainte_lague(live, seats, {s: stock[s][0] * times[s] for s in live})
        plan = [(s, quota[s], quota[s] // stock[s][0], quota[s] % stock[s][0], stock[s][0]) for s in sorted(quota)]
        for s, per_shard in shard_quotas(quota, shards).items():
            ends = [sum(per_shard[: i + 1]) for i in range(shards)]
            places.append((s, ends))
    quotas = spark.createDataFrame(plan, "source string, quota long, rounds long, rest long, blocks long")
    ends = spark.createDataFrame(places, "source string, ends array<long>")  # a row per source
    # a seeded rotation of the blocks decides which stand in the last, partial round
    turn = F.pmod(F.xxhash64("source", F.lit(seed)), F.greatest("blocks", F.lit(1)))
    at = F.pmod(F.col("block") + turn, F.col("blocks"))
    repeats = F.col("rounds") + (at < F.col("rest")).cast("long")
    chosen = blocks.join(F.broadcast(quotas), "source").join(F.broadcast(ends), "source").withColumn("_repeats", repeats).where("_repeats > 0")
    spread = chosen.select("_key", "source", "n_tokens", "quota", "ends", at.alias("_at"), "blocks", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_repeats"))).alias("repeat"))
    # the copies of a source's blocks in one order, rounds one after the other, and the shard in whose quota each place lies
    place = (F.col("repeat") - 1) * F.col("blocks") + F.col("_at")
    shard = F.size(F.filter("ends", lambda e: e <= place))
    mixed = scratch.save(spread.select(F.col("_key").alias(key), "source", "n_tokens", F.col("repeat").cast("int").alias("repeat"), shard.alias("shard")))
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeat").alias("most_repeats"))
    names = spark.createDataFrame([(s, share[s], times[s]) for s in sorted(share)], "source string, target_share double, max_repeats int")
    report = names.join(F.broadcast(reached), "source", "left").crossJoin(F.broadcast(reached.agg(F.sum("tokens").alias("_all"))))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return mixed, report.select(
        "source", "target_share", (zero("tokens") / F.greatest(zero("_all"), F.lit(1))).alias("reached_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"),
        zero("most_repeats").alias("most_repeats"), "max_repeats",
    )
