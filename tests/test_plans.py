"""Queries do the whole job of their operators."""

import inspect
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import edits, overlap
from kindred.operators import calibration, mining, model, retrieval
from kindred.operators.tfidf import text_vectors
from kindred.plans import scoring, searching
from kindred.session import Scratch


def test_mining_meets_fifty_candidates(spark, tmp_path):
    """30 positive rows of one component fill the first 31 ranks; their negatives stand behind."""
    data = [(i, "hot", f"a{i:02}", "red fox runs", "red fox runs", 1, "train") for i in range(30)]
    data += [(30 + i, f"b{i:02}", f"c{i:02}", f"red bird w{i}", f"green bird w{i}", 0, "train") for i in range(30)]
    schema = "row_id long, qid1 string, qid2 string, question1 string, question2 string, is_duplicate int, split string"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "smoke_pairs.parquet"))
    mined = searching.hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(r["source_row"] for r in mined) == list(range(30)) and {r["rank"] for r in mined} == {32}
    sides = searching.hard_negative_candidates(spark, str(tmp_path)).collect()
    assert len(sides) == 60 and {(r["n"], r["best_rank"]) for r in sides} == {(19, 32)}


def test_trees_stop_by_patience_alone(spark, monkeypatch):
    """200 trees at most, in the query too; the first trees of a longer fit are the shorter fit."""
    assert inspect.signature(model.train).parameters["trees"].default == 200
    given = {}
    monkeypatch.setattr(scoring, "table", lambda *_: spark.range(1).selectExpr("'train' split"))
    monkeypatch.setattr(scoring, "train", lambda *_, **options: given.update(options) or 1 / 0)
    try:
        scoring.trained_scores(spark, "")
    except ZeroDivisionError:
        pass
    assert set(given) == {"evaluation"}
    down = [1 - i / 100 for i in range(50)]
    assert model.best_round(down) == 50
    assert model.best_round(down + [0.9] * 19 + [0.1]) == 70
    assert model.best_round(down + [0.9] * 20 + [0.1]) == 50
    data = [(i, f"a b c{i % 7}", f"a b c{i % 5} d" if i % 3 else f"x c{i % 4}", int(i % 3 > 0) if i % 11 else 0) for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, question1 string, question2 string, is_duplicate int").coalesce(1)
    long, short = (model.train(df, trees=n, depth=2).trees for n in (6, 3))
    cut = model.first_trees(long, 3)
    assert cut.getNumTrees == 3 and cut.toDebugString.split("\n")[1:] == short.toDebugString.split("\n")[1:] and cut.treeWeights == short.treeWeights


def test_scores_clean_each_text_once(spark, tmp_path):
    """Inside the similarity a text was cleaned for every time it is named."""
    schema = "row_id long, question1 string, question2 string, is_duplicate int, lang string, source string"
    spark.createDataFrame([(1, "a b", "B, a", 1, "en", "forum"), (2, "a b", "c", 0, "en", "forum")], schema).write.parquet(str(tmp_path / "smoke_pairs.parquet"))
    scores = scoring.scored(spark, str(tmp_path))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2
    assert {r["row_id"]: r["p"] for r in scores.collect()} == {1: 1.0, 2: 0.0}


def test_a_fit_reads_its_scores_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            read.add(1)
            yield r

    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i % 2, ((i * 7) % 20 + i % 2) / 21) for i in range(100)], 2).mapPartitions(seen), "y int, p double")
    calibration.fit_sigmoid(rows, "y", "p")
    assert read.value == 100
    calibration.fit_isotonic(rows, "y", "p")
    assert read.value == 200


def test_release_frees_shuffle_files(spark):
    """The files of finished jobs went only when the driver happened to collect its garbage."""
    tracker = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    scratch = Scratch(spark)
    kept = scratch.save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert tracker().shuffleStatuses().size() > 0
    scratch.release()
    after = tracker().shuffleStatuses().size()
    for _ in range(50):
        if not (after := tracker().shuffleStatuses().size()):
            break
        time.sleep(0.1)
    assert after == 0 and kept.count() == 7


def test_word_groups_broadcast_nothing(spark):
    sets = spark.createDataFrame([(i, f"a\tb\tw{i}") for i in range(50)], "set_id long, shingles string")
    broadcasts = []
    was, F.broadcast = F.broadcast, lambda df: broadcasts.append(df) or was(df)
    try:
        assert edits.word_groups(sets, edits.word_counts(sets)).items() == {"b": "a"}.items()
    finally:
        F.broadcast = was
    assert not broadcasts


def test_near_texts_do_each_step_once(spark):
    """A condition on clean text had every text cleaned twice, one on the similarity had the words of a pair compared again for every time it names them."""
    plans = []

    class Seen(Scratch):
        def save(self, df):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().save(df)

    data = [("p:1", "a b c d e"), ("p:2", "A b, c d e!"), ("p:3", "a b c d f e"), ("p:4", None), ("p:5", "?"), ("p:6", "x y")]
    found = edits.near_texts(spark.createDataFrame(data, "rec string, text string"), scratch=Seen(spark)).collect()
    assert [(r["a"], r["b"], round(r["similarity"], 4)) for r in found] == [("p:1", "p:3", 0.8333)]
    assert sum(p.count("regexp_replace(") for p in plans) == 1
    assert sum(p.count("array_intersect(") for p in plans) <= 1


def test_key_counts_are_summed_up_in_their_task(spark):
    """Every key left its task to be counted; now only counters do."""
    sets = spark.createDataFrame([(i, "\t".join(f"w{j}" for j in range(i % 9, i % 9 + 3 + i % 5))) for i in range(300)], "set_id long, shingles string").repartition(3)
    how = edits.Partitions(0.7, {"w2": "w1"})
    want = np.zeros(edits.COUNTERS, dtype=np.float32)
    for r in edits.all_keys(sets, how, want.copy()).where("set_id >= 0").collect():
        want[r["probe"] & (edits.COUNTERS - 1)] += 1
    got = edits.key_counts(sets, how)
    assert got.dtype == want.dtype and (got == want).all() and want.sum() > 1000


def test_similar_pairs_are_those_of_brute_force(spark):
    rnd = random.Random(8)
    words = [sorted(rnd.sample([f"w{i}" for i in range(14)], rnd.randrange(1, 12))) for _ in range(60)]
    sets = edits.sketched(spark.createDataFrame([(i, "\t".join(w)) for i, w in enumerate(words)], "set_id long, shingles string"))
    every = [(i, j) for i in range(60) for j in range(i)]
    similarity = {(i, j): len({*words[i]} & {*words[j]}) / len({*words[i]} | {*words[j]}) for i, j in every}
    for threshold in (0.25, 0.5, 0.75):
        got = edits.similar_pairs(spark.createDataFrame(every, "a long, b long"), sets, threshold).collect()
        want = {p: s for p, s in similarity.items() if s >= threshold - 1e-9}
        assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and want


@pytest.mark.parametrize("chunk, block", [(1 << 18, 1 << 17), (40, 64), (40, 1 << 17)])
def test_meetings_are_those_of_brute_force(monkeypatch, chunk, block):
    """Hot keys in blocks, cold ones in slices; pieces cut no key."""
    monkeypatch.setattr(edits, "CHUNK", chunk)
    monkeypatch.setattr(edits, "BLOCK", block)
    rng = np.random.default_rng(4)
    n, low = 900, (1 << edits.SKETCH_BITS) - 1
    probe = np.sort(np.r_[rng.integers(-9, 9, n - 200), np.full(120, 4), rng.integers(100, 999, 80)])
    ids = rng.integers(0, 150, n) * rng.choice([1, -1], n)
    ids = np.where(rng.random(n) < 0.5, np.abs(ids), ~np.abs(ids))
    size = rng.choice([1, 4, 5, 6, 7, 8, 90, edits.LARGEST], n)
    sketch = lambda: np.bitwise_xor.reduce(np.left_shift(np.int64(1), rng.integers(0, 9, (2, n))), axis=0)
    info, more = (size.astype(np.uint64) << np.uint64(edits.SKETCH_BITS)).view(np.int64) | sketch(), sketch()
    want = set()
    for x in np.flatnonzero(ids < 0):
        for y in np.flatnonzero((ids >= 0) & (probe == probe[x])):
            bits = max(((int(info[x]) ^ int(info[y])) & low).bit_count(), (int(more[x]) ^ int(more[y])).bit_count())
            tau = (size[x] + size[y]) * 0.3 / 1.7 + 1e-9
            if ~ids[x] != ids[y] and size[x] >= size[y] and (size[x] >= edits.LARGEST or bits <= tau >= size[x] - size[y]):
                want.add((int(~ids[x]), int(ids[y])))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in (probe, ids, info, more)], ["probe", "set_id", "info", "more"]) for i in range(0, n, 7)]
    pieces = list(edits._whole_keys(iter(batches)))
    assert np.concatenate([p[0] for p in pieces]).tolist() == probe.tolist() and all(p[0][-1] != q[0][0] for p, q in zip(pieces, pieces[1:]))
    assert (len(pieces) > 3) == (chunk < n)
    assert {(int(a), int(b)) for p in pieces for found in edits._meetings(*p, 0.3 / 1.7) for a, b in zip(*found)} == want and len(want) > 500
    assert not list(edits._whole_keys(iter([])))


def test_overlaps_leave_two_tables(spark):
    """What later steps don't read is dropped on the way."""
    scratch = Scratch(spark)
    data = [(1, "train", "a b c d e"), (2, "test", "a b c d e"), (3, "test", "x y")]
    found = overlap.split_overlaps(spark.createDataFrame(data, "id long, split string, q string"), "id", "split", ["q"], scratch=scratch).collect()
    assert [(r["train_key"], r["other_key"]) for r in found] == [(1, 2)]
    assert len(os.listdir(scratch.root.removeprefix("file://"))) == 2


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """20 entries and 10 queries of one vector meet as one of each; lists and ties are those of a full ranking."""
    plain = retrieval._search_blocks

    def blocks(k, width):
        search = plain(k, width)

        def counted(left, right):
            assert len(left) <= 1 and len(right) <= 2
            return search(left, right)

        return counted

    monkeypatch.setattr(retrieval, "_search_blocks", blocks)
    catalog = spark.createDataFrame([(f"e{i:02}", "red fox!" if i % 2 else "red fox") for i in range(20)] + [("a", "blue bird"), ("z", "green")], "question_id string, question string")
    queries = spark.createDataFrame([(f"red{'?' * i} fox",) for i in range(10)] + [("",), (None,)], "query string")
    hits = {}
    for r in retrieval.tfidf_search(queries, catalog, 21, max_features=4).collect():
        hits.setdefault(r["query"], []).append((r["rank"], r["question_id"], r["score"]))
    assert len(hits) == 11
    full = [f"e{i:02}" for i in range(20)]
    assert sorted(hits.pop("")) == [(i + 1, q, 0.0) for i, q in enumerate(["a", *full])]
    assert all([q for _, q, _ in sorted(h)] == [*full, "a"] and sorted(h)[19][2] == 1.0 and sorted(h)[20] == (21, "a", 0.0) for h in hits.values())


def test_candidates_are_counted_without_a_row_each(spark, tmp_path):
    """a row and two texts for each of 50 candidates a side were joined only to be counted."""
    data = [(i, f"a{i}", f"b{i}", f"how do i reset fox{i % 7} tree{i % 5}", f"where is the fox{i % 3} of tree{i % 11}", i % 2, "train") for i in range(40)]
    schema = "row_id long, qid1 string, qid2 string, question1 string, question2 string, is_duplicate int, split string"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "smoke_pairs.parquet"))
    counts = searching.hard_negative_candidates(spark, str(tmp_path))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "question" not in plan
    pairs = mining.candidate_pairs(spark.read.parquet(str(tmp_path / "smoke_pairs.parquet")))
    want = pairs.groupBy("row", "anchor_side").agg(F.count("*").alias("n"), F.min("rank").alias("best_rank"))
    assert sorted(counts.collect()) == sorted(want.collect()) and counts.count() == 40


def test_patterns_give_the_full_ranking(spark):
    """products of frequent parts plus postings of rare terms are whole cosines, in one block and in many."""
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choices(["how", "do", "the"], k=rnd.randrange(5)) + rnd.sample([f"w{i}" for i in range(60)], rnd.randrange(1, 4)))
    index = retrieval.fit_index(spark.createDataFrame([(f"e{i:03}", text()) for i in range(150)], "question_id string, question string"), 50)
    queries = spark.createDataFrame([(text(),) for _ in range(25)], "query string")
    vectors = lambda df, key: {r[key]: dict(zip(r["terms"], r["weights"], strict=True)) for r in df.collect()}
    entries = vectors(index.entries, "question_id")
    want = set()
    for q, x in vectors(text_vectors(queries.distinct(), index.idf, "query", "query"), "query").items():
        scores = {e: round(sum(w * y.get(t, 0.0) for t, w in x.items()), 9) for e, y in entries.items()}
        want |= {(q, e, i + 1) for i, e in enumerate(sorted(scores, key=lambda e: (-scores[e], e))[:7])}
    for rows in (8192, 2):
        assert {(r["query"], r["question_id"], r["rank"]) for r in retrieval.tfidf_search(queries, index, 7, block_rows=rows).collect()} == want


def test_rows_of_one_list_choose_in_one_round(spark):
    """each of 30 rows that want the same pairs took a round of its own."""
    df = spark.createDataFrame([(row, "hot", f"k{at:02}", at) for row in range(30) for at in range(30)], "row int, lo string, hi string, at int")
    chosen = mining.serial_choice(df, 1, Scratch(spark), max_rounds=2).collect()
    assert sorted((r["row"], r["hi"], r["at"]) for r in chosen) == [(i, f"k{i:02}", i) for i in range(30)]


def test_candidates_leave_three_tables(spark):
    """tables that only lead to anchors, lists and catalogue are dropped before candidates are put together."""
    scratch = Scratch(spark)
    df = spark.createDataFrame([(1, "a", "b", "red fox", "red bird", 1), (2, "c", "d", "red tree", "fox", 0)], "row_id long, qid1 string, qid2 string, question1 string, question2 string, is_duplicate int")
    assert {(r["row"], r["anchor_side"], r["n"]) for r in mining.candidate_counts(df, scratch=scratch).collect()} == {(1, "qid1", 2), (1, "qid2", 2)}
    assert len(os.listdir(scratch.root.removeprefix("file://"))) == 3
