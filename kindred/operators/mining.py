"""Hard negatives: retrieval neighbours of positive pairs outside their positive component.

Every positive row takes its best candidates that no earlier row has taken. This serial order is computed in rounds:
rows choose within tasks, a pair keeps the earliest row that ever chose it, and rows that lose a pair choose anew. Once no row
loses one, the choices are the result of the serial order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import clean_text
from kindred.operators.audit import question_texts
from kindred.operators.graph import connected_components
from kindred.operators.retrieval import BLOCK_ROWS, TfidfIndex, fit_index, hit_lists
from kindred.operators.split import seeded_rank
from kindred.session import Scratch


def sampled_rows(rows: DataFrame, key: str, most: int | None, seed: int) -> DataFrame:
    """``rows``, or the ``most`` first in a seeded order."""
    if most is None:
        return rows
    if most < 1:
        raise ValueError("the number of rows must be at least 1")
    return rows.orderBy(seeded_rank(F.col(key), seed), key).limit(most)


def _lists(
    df: DataFrame, key: str, candidate_k: int, max_positive_rows: int | None, seed: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors (row, anchor_side, anchor, text, own, tag, first), lists (first, hits) of their texts, the catalogue (question_id, question, place).

    Ids and groups are numbers: ``own`` is the place of the anchor, ``tag`` the place of the smallest id of a component. Anchors with texts of
    equal vectors share one list, so candidates are rows only when they are asked for.
    """
    inner = Scratch(df.sparkSession)  # what only leads to the three tables
    given = df.where("trim(qid1) <> '' and trim(qid2) <> '' and trim(question1) <> '' and trim(question2) <> '' and is_duplicate in (0, 1)")
    rows = inner.save(given.select(F.col(key).alias("row"), F.trim("qid1").alias("qid1"), F.trim("qid2").alias("qid2"), "question1", "question2", "is_duplicate"))
    texts = question_texts(rows, "row", [("qid1", "question1"), ("qid2", "question2")], clean_text).select(F.col("qid").alias("question_id"), "question")
    catalog = scratch.save(texts.orderBy("question_id").withColumn("place", F.monotonically_increasing_id()))
    inner.release()
    positive = rows.where("is_duplicate = 1")
    edges = positive.select(F.col("qid1").alias("src"), F.col("qid2").alias("dst"))
    groups = connected_components(edges, catalog.select(F.col("question_id").alias("node")), inner)
    members = groups.select(F.col("node").alias("question_id"), "group").join(catalog.select("question_id", "place"), "question_id")
    ids = inner.save(members.join(catalog.select(F.col("question_id").alias("group"), F.col("place").alias("tag")), "group").select("question_id", "place", "tag"))
    inner.release()
    index = fit_index(catalog, scratch=inner)
    entries = inner.save(index.entries.join(ids, "question_id"))
    inner.drop(index.entries)
    index = TfidfIndex(index.idf, entries, index.size)
    inner.release()
    sides = F.array(*[F.struct(F.lit(f"qid{i}").alias("anchor_side"), F.col(f"qid{i}").alias("anchor"), F.col(f"question{i}").alias("text")) for i in (1, 2)])
    anchors = sampled_rows(positive, "row", max_positive_rows, seed).select("row", F.inline(sides))
    asked, lists = hit_lists(anchors.select(F.col("text").alias("query")), index, entries, candidate_k, BLOCK_ROWS, inner)
    lists = scratch.save(lists)
    named = ids.select(F.col("question_id").alias("anchor"), F.col("place").alias("own"), "tag")
    anchors = scratch.save(anchors.join(asked.withColumnRenamed("query", "text"), "text").join(named, "anchor"))
    inner.release()
    inner.close()
    return anchors, lists, catalog


def _eligible(anchors: DataFrame, lists: DataFrame) -> DataFrame:
    """``anchors`` with ``found``: the hits (rank, score, place) outside their component."""
    ranked = F.transform("hits", lambda h, i: F.struct((i + 1).alias("rank"), h["score"].alias("score"), h["place"].alias("place"), h["tag"].alias("tag")))
    return anchors.join(lists, "first").withColumn("found", F.filter(ranked, lambda h: h["tag"] != F.col("tag"))).drop("hits")


def candidate_pairs(
    df: DataFrame, key: str = "row_id", candidate_k: int = 50, max_positive_rows: int | None = None, seed: int = 42, scratch: Scratch | None = None
) -> DataFrame:
    """(row, anchor_side, qid1, qid2, question1, question2, rank, score): all eligible candidates of the positive rows.

    ``df``: (key, qid1, qid2, question1, question2, is_duplicate); rows without both ids or texts or a 0/1 label take no part. The catalogue
    holds the first text of each id. With ``max_positive_rows`` only so many positive rows, drawn by ``seed``, are anchors; catalogue and components hold all. The rank is that of the whole hit list, before entries of the anchor's positive component are dropped.
    """
    anchors, lists, catalog = _lists(df, key, candidate_k, max_positive_rows, seed, scratch or Scratch(df.sparkSession))
    met = _eligible(anchors, lists).select("row", "anchor_side", "anchor", "text", F.inline("found")).drop("tag").join(catalog, "place")
    return met.select(
        "row", "anchor_side", F.col("anchor").alias("qid1"), F.col("question_id").alias("qid2"), F.col("text").alias("question1"), F.col("question").alias("question2"), "rank", "score"
    )


def candidate_counts(
    df: DataFrame, key: str = "row_id", candidate_k: int = 50, max_positive_rows: int | None = None, seed: int = 42, scratch: Scratch | None = None
) -> DataFrame:
    """(row, anchor_side, n, best_rank): how many ``candidate_pairs`` there are and their smallest rank, without a row for each."""
    anchors, lists, _ = _lists(df, key, candidate_k, max_positive_rows, seed, scratch or Scratch(df.sparkSession))
    found = _eligible(anchors, lists).where(F.size("found") > 0).select("row", "anchor_side", F.size("found").alias("n"), F.array_min("found.rank").alias("rank"))
    return found.groupBy("row", "anchor_side").agg(F.sum("n").alias("n"), F.min("rank").alias("best_rank"))


def _choose(n: int, columns: list[str]):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The serial choice among the rows of a partition."""
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        wishes = table["wishes"].combine_chunks()
        ends, entries = wishes.offsets.to_pylist(), wishes.values
        lo, hi = entries.field("lo"), entries.field("hi")
        rows = table["row"].to_pylist()
        taken, owner, chosen = set(), [], []
        for i in sorted(range(len(rows)), key=rows.__getitem__):
            left = n
            for j in range(ends[i], ends[i + 1]):
                pair = lo[j].as_py(), hi[j].as_py()
                if pair not in taken:
                    taken.add(pair)
                    owner.append(i)
                    chosen.append(j)
                    left -= 1
                    if not left:
                        break
        found = entries.take(pa.array(chosen, pa.int64()))
        yield pa.RecordBatch.from_arrays([table["row"].combine_chunks().take(pa.array(owner, pa.int64())), *[found.field(c) for c in columns]], ["row", *columns])

    return choose


def _serial(wishes: DataFrame, n: int, scratch: Scratch, max_rounds: int) -> DataFrame:
    """``serial_choice`` of (row, near, wishes): arrays of (at, lo, hi), best first. Rows of one ``near`` choose in one task.

    Every task lets its rows choose in their order; each pair goes to the earliest row that any task gave it to. Rows that lose a pair choose
    anew, without the pairs of earlier rows. A row asks for a pair only after its better ones went to earlier rows, so whoever asks
    first, the end is that of the serial order.
    """
    given = scratch.save(wishes)
    kinds = dict(given.select("row", F.inline("wishes")).dtypes)
    choose = _choose(n, ["at", "lo", "hi"])
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("row", "at", "lo", "hi"))
    ask = lambda rows: rows.repartition("near").select("row", "wishes").mapInArrow(choose, schema)
    held = scratch.save(ask(given))
    for _ in range(max_rounds):
        holders = held.groupBy("lo", "hi").agg(F.min("row").alias("holder"))
        lost, count = scratch.save_counted(held.join(holders, ["lo", "hi"]).where(F.col("row") > F.col("holder")).select("row").distinct())
        if not count:
            return held
        again = given.join(lost, "row").select("row", "near", F.posexplode("wishes").alias("_i", "w")).select("row", "near", "_i", "w.*")
        free = again.join(holders, ["lo", "hi"], "left").where(F.col("holder").isNull() | (F.col("row") <= F.col("holder")))
        entry = F.struct("_i", *[F.col(c) for c in ("at", "lo", "hi")])
        rest = free.groupBy("row", "near").agg(F.array_sort(F.collect_list(entry)).alias("wishes"))
        following = scratch.save(held.join(lost, "row", "left_anti").unionByName(ask(rest)))
        scratch.drop(held)
        scratch.drop(lost)
        held = following
    raise RuntimeError("the rounds did not end")


def serial_choice(candidates: DataFrame, n: int, scratch: Scratch, max_rounds: int = 10_000) -> DataFrame:
    """(row, lo, hi, at): each row's first ``n`` entries (at: its order) that no earlier row has taken."""
    wishes = candidates.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))).alias("wishes"))
    return _serial(wishes.select("row", F.col("wishes")[0]["lo"].alias("near"), "wishes"), n, scratch, max_rounds).select("row", "lo", "hi", "at")


def hard_negatives(
    df: DataFrame, key: str = "row_id", candidate_k: int = 50, negatives_per_positive: int = 1, max_positive_rows: int | None = None, seed: int = 42, scratch: Scratch | None = None
) -> DataFrame:
    """Mined rows (question1, question2, is_duplicate = 0, qid1, qid2, source_row, anchor_side, rank, score); no pair of ids twice."""
    if candidate_k < 1 or negatives_per_positive < 1:
        raise ValueError("candidate_k and negatives_per_positive must be positive")
    scratch = scratch or Scratch(df.sparkSession)
    anchors, lists, catalog = _lists(df, key, candidate_k, max_positive_rows, seed, scratch)
    # rows of one component choose together, those of a large one in parts
    parts = anchors.groupBy("tag").agg(F.ceil(F.count("*") / 20_000).alias("parts"))
    ids = anchors.select("row", "anchor_side", "first", "own", "tag").join(parts, "tag")
    # at: (-score, rank, side) is the order, and with the anchor tells the hit
    entry = lambda h: F.struct((-h["score"]).alias("s"), h["rank"].alias("rank"), F.col("anchor_side").alias("side"), F.col("own").alias("own"), h["place"].alias("place"))
    asked = _eligible(ids, lists).where(F.size("found") > 0).select("row", "tag", "parts", F.transform("found", entry).alias("found"))
    merged = asked.groupBy("row").agg(F.min("tag").alias("tag"), F.min("parts").alias("parts"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    wish = lambda h: F.struct(F.struct(h["rank"].alias("rank"), h["side"].alias("side"), (h["own"] > h["place"]).alias("up")).alias("at"), F.least(h["own"], h["place"]).alias("lo"), F.greatest(h["own"], h["place"]).alias("hi"))
    near = F.xxhash64("tag", F.pmod(F.xxhash64("row"), F.col("parts")))
    chosen = _serial(merged.select("row", near.alias("near"), F.transform("found", wish).alias("wishes")), negatives_per_positive, scratch, 10_000)
    scratch.release()
    own, place = F.when(F.col("at.up"), F.col("hi")).otherwise(F.col("lo")), F.when(F.col("at.up"), F.col("lo")).otherwise(F.col("hi"))
    picked = chosen.select("row", F.col("at.rank").alias("rank"), F.col("at.side").alias("anchor_side"), own.alias("own"), place.alias("place"))
    mined = picked.join(anchors, ["row", "anchor_side", "own"]).dropDuplicates(["row", "anchor_side", "own", "place"])
    mined = mined.join(lists, "first").withColumn("score", F.col("hits")[F.col("rank") - 1]["score"]).drop("hits", "tag").join(catalog, "place")
    return mined.select(
        F.col("text").alias("question1"), F.col("question").alias("question2"), F.lit(0).alias("is_duplicate"), F.col("anchor").alias("qid1"), F.col("question_id").alias("qid2"),
        F.col("row").alias("source_row"), "anchor_side", "rank", "score",
    )
