"""Items of varying size into containers of fixed capacity.

Items of equal size are interchangeable, so the plan is made on the counts per size: at most ``capacity`` numbers, whatever
the number of items. First dominance reduction fixes containers that are in some best packing: an
item alone if nothing fits beside it, with its exact complement, with the largest item that fits if no two can, or with the two that dominate all
others where no three fit. What is left is packed best fit, largest sizes first, whole runs of equal items and equal containers at a time. The plan, a list of
runs (sizes, how often), is then applied to the items by their place among the items of equal size.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.ordering import running_total
from kindred.session import Scratch

Plan = list[tuple[tuple[int, ...], int]]


class _Sizes:
    """Counts by size, with the distinct sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def fitting(self, most: int) -> int | None:
        at = bisect.bisect_right(self.order, most)
        return self.order[at - 1] if at else None

    def give(self, size: int) -> None:
        if size not in self.n:
            self.n[size] = 0
            bisect.insort(self.order, size)
        self.n[size] += 1

    def smallest(self, count: int) -> int | None:
        """The least sum of ``count`` items."""
        total = 0
        for size in self.order:
            some = min(count, self.n[size])
            total += some * size
            count -= some
            if not count:
                return total
        return None

    def best_smaller(self, room: int) -> int:
        """The largest possible smaller item of two that fit into ``room`` together; 0 if no two do."""
        at = bisect.bisect_right(self.order, room // 2) - 1
        if at < 0:
            return 0
        size = self.order[at]
        if self.n[size] > 1 or (at + 1 < len(self.order) and size + self.order[at + 1] <= room):
            return size
        return self.order[at - 1] if at else 0


def _dominating(sizes: _Sizes, room: int) -> tuple[int, ...] | None:
    """The items that, beside an item which leaves ``room``, dominate every other choice; None if no one, two or none of them surely do.

    * Nothing fits: the item stays alone.
    * One item fills the room, or no two fit together: the largest that fits.
    * No three fit together: the largest that fits, c, with the largest that fits beside it, d, if in no pair that fits the smaller item
      is larger than d. Then of every pair the larger can be exchanged for c and the smaller for d, and a single item for c.
    """
    first = sizes.fitting(room)
    if first is None:
        return ()
    pair = sizes.smallest(2)
    if first == room or pair is None or pair > room:
        return (first,)
    triple = sizes.smallest(3)
    if triple is not None and triple <= room:
        return None
    sizes.take(first, 1)
    second = sizes.fitting(room - first)
    sizes.give(first)
    if second is None or sizes.best_smaller(room) > second:
        return None
    return (first, second)


def reduce_by_dominance(sizes: _Sizes, capacity: int) -> Plan:
    """Containers that some best packing holds; their items are taken out of ``sizes``.

    From the largest item down, each is given the one or two items that dominate all other choices beside it, if there are such. Taking
    items away leaves fewer choices, so a container repeats as long as its sizes last. After a full pass nothing more is tried: what
    is left is packed best fit.
    """
    plan: Plan = []
    at = len(sizes.order) - 1
    while at >= 0:
        a = sizes.order[at]
        sizes.take(a, 1)
        beside = _dominating(sizes, capacity - a)
        sizes.give(a)
        if beside is None:
            at -= 1
            continue
        held = Counter((a, *beside))
        times = min(sizes.n[s] // c for s, c in held.items())
        for s, c in held.items():
            sizes.take(s, c * times)
        plan.append(((a, *beside), times))
        at = bisect.bisect_left(sizes.order, a) - (a not in sizes.n)
    return plan


def best_fit(sizes: _Sizes, capacity: int) -> Plan:
    """Largest sizes first, each into the fullest containers that have room; runs of equal containers move together."""
    open_: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, held: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            bisect.insort(rooms, room)
        open_[room][held] += times

    for size in reversed(list(sizes.order)):
        left = sizes.n[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                # new containers with as many of this size as fit; the last may be less full
                each = capacity // size
                times, rest = divmod(left, each)
                if times:
                    put(capacity - each * size, (size,) * each, times)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                left = 0
                continue
            room = rooms[at]
            held, times = next(iter(open_[room].items()))
            each = min(room // size, left)
            moved = min(times, left // each)
            open_[room][held] -= moved
            if not open_[room][held]:
                del open_[room][held]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            put(room - each * size, held + (size,) * each, moved)
            left -= moved * each
    return [(held, times) for room in rooms for held, times in open_[room].items()]


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    sizes = _Sizes(counts)
    fixed = reduce_by_dominance(sizes, capacity)
    return fixed + best_fit(sizes, capacity)


def _slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size: first place and its container of each run, in order of places.

    A run of ``times`` equal containers gives places p, p + 1, ... to containers c, c + 1, ...
    """
    out: dict[int, list[tuple[int, int]]] = {}
    place: Counter = Counter()
    container = 0
    for held, times in plan:
        for size in held:
            out.setdefault(size, []).append((place[size], container))
            place[size] += times
        container += times
    return {s: (np.array([p for p, _ in runs]), np.array([c for _, c in runs])) for s, runs in out.items()}


def pack(items: DataFrame, key: str, size: str, capacity: int, scratch: Scratch | None = None, seed: int = 5) -> DataFrame:
    """(key, piece, start, length, container): where each item goes; containers are numbered from 0.

    An item larger than ``capacity`` is cut into full pieces and a rest, and only such an item; ``start`` is the piece's
    offset in it. Items with null or non-positive size, and those with a null key, take no room and are left
    out. Keys should be unique. An empty table gives an empty result. Each container's sizes sum to at most ``capacity``.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    scratch = scratch or Scratch(items.sparkSession)
    given = items.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size"))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / capacity))
    cut = given.select("_key", "_size", F.explode(parts).alias("_piece")).withColumn("_start", F.col("_piece") * capacity)
    cut = scratch.save(cut.select("_key", "_piece", "_start", F.least(F.col("_size") - F.col("_start"), F.lit(capacity)).alias("_length")))
    counts = {r["_length"]: r["n"] for r in cut.groupBy("_length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = items.sparkSession.sparkContext.broadcast(_slots(plan_containers(counts, capacity)))
    placed = running_total(cut, "_length", ["_key", "_piece"], F.lit(1), "_place", seed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = slots.value
        for batch in batches:
            container = np.empty(len(batch), dtype=np.int64)
            for length, own in batch.groupby("_length").indices.items():
                first, start = runs[length]
                place = batch["_place"].to_numpy()[own]
                run = np.searchsorted(first, place, side="right") - 1
                container[own] = start[run] + place - first[run]
            yield batch[["_key", "_piece", "_start", "_length"]].assign(container=container)

    kind = dict(cut.dtypes)["_key"]
    done = placed.select("_key", "_piece", "_start", "_length", "_place").mapInPandas(assign, f"_key {kind}, _piece long, _start long, _length long, container long")
    return done.toDF(key, "piece", "start", "length", "container")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, tokens, share of the room in use, and the least number of containers there could be."""
    used = packed.groupBy("container").agg(F.sum("length").alias("used"), F.count("*").alias("n"))
    return used.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"), F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).alias("least_containers"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
    )
