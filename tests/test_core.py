"""Core operators: hand-computed values, invariants, edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import features, text
from kindred.operators import audit, calibration, graph, metrics, mining, model, ordering, parse, ranking, retrieval, split, tfidf
from kindred.session import Scratch
from kindred.sources import manifests, tables
from kindred.streaming import monitor

LN = "id,qid1,qid2,question1,question2,is_duplicate"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- text ------------------------------------------------------------------------------------------


def test_clean_text(spark):
    data = ["  Hello   World!  ", "café", "", None, "A_b-c\x1fd", "ＦＵＬＬ ﬁne", "İstanbul", "áb", "x²½", "tab\tnew\nline"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string")
    got = [r["c"] for r in df.select("i", text.clean_text(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [text.clean_str(t) for t in data] and got[:4] == ["hello world", "café", "", ""]


def test_clean_text_of_ascii(spark):
    """Every pair of ASCII characters, which stay in the JVM, as by the definition."""
    data = [f"{chr(a)}{chr(b)}x{chr(b)}{chr(a)}Y" for a in range(128) for b in range(128)]
    df = spark.createDataFrame([(t,) for t in data], "t string").select("t", text.clean_text(F.col("t")).alias("c"))
    assert all(r["c"] == text.clean_str(r["t"]) for r in df.collect())


def test_tokens_and_buckets(spark):
    df = spark.createDataFrame([("a b  a",), ("",), (None,)], "t string").select(text.clean_text(F.col("t")).alias("c"))
    assert [r[0] for r in df.select(text.tokens(F.col("c"))).collect()] == [["a", "b", "a"], [], []]
    assert [r[0] for r in df.select(text.bigrams(text.tokens(F.col("c")))).collect()] == [["a b", "b a"], [], []]
    counts = spark.createDataFrame([(n,) for n in (0, 1, 5, 6, 15, 16)], "n int")
    assert [r[0] for r in counts.select(text.length_bucket(F.col("n"))).collect()] == [None, "short", "short", "medium", "medium", "long"]


def test_clean_id(spark):
    df = spark.createDataFrame([(" A1 ",), ("",), ("  ",), (None,)], "q string")
    assert [r[0] for r in df.select(text.clean_id(F.col("q"))).collect()] == ["a1", None, None, None]


# -- features --------------------------------------------------------------------------------------


def test_lexical_features(spark):
    df = spark.createDataFrame([("a b c", "b c d e"), ("", ""), ("x", "")], "a string, b string")
    got = [tuple(r) for r in df.select(*features.lexical_features(F.col("a"), F.col("b")).values()).collect()]
    assert got == [(0.4, 0.75, 1.0, 7.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0)]


def test_dense_features(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [3.0, 4.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(*features.dense_features(F.col("a"), F.col("b")).values()).collect()]
    assert got[0] == (0.0, pytest.approx(2**0.5), 1.0) and got[1] == (0.0, 5.0, 3.5)
    assert df.select(features.l2_normalised(F.col("b"))).collect()[1][0] == pytest.approx([0.6, 0.8])


def test_tfidf_by_hand(spark):
    corpus = spark.createDataFrame([("big cat",), ("big dog",), ("big",), ("!",), (None,)], "text string")
    vocabulary = tfidf.fit_vocabulary(corpus)
    got = {r["term"]: (r["tf"], r["df"]) for r in vocabulary.collect()}
    assert got == {"big": (3, 3), "big cat": (1, 1), "cat": (1, 1), "big dog": (1, 1), "dog": (1, 1)}
    import math

    idf = {r["term"]: r["idf"] for r in vocabulary.collect()}
    assert idf["cat"] == pytest.approx(math.log(4 / 2) + 1) and idf["big"] == pytest.approx(1.0)
    pairs = spark.createDataFrame([(1, "big cat", "big cat"), (2, "big cat", "big dog"), (3, "big", "a b"), (4, None, "")], "row_id long, x string, y string")
    cos = {r["row_id"]: r["cos"] for r in tfidf.pair_cosines(pairs, vocabulary, "row_id", "x", "y").collect()}
    w = idf["cat"]
    assert cos[1] == pytest.approx(1.0) and cos[2] == pytest.approx(1 / (1 + 2 * w * w)) and cos[3] == cos[4] == 0.0
    assert [tuple(r)[:3] for r in tfidf.fit_vocabulary(corpus.limit(0)).collect()] == [("empty", 1, 1)]
    assert [r["term"] for r in tfidf.fit_vocabulary(corpus, max_features=2).collect()] == ["big", "big cat"]


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "s long, n long")
    low, high = features.wilson(F.col("s"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0] == (None, None) and got[1][0] == 0.0 and got[2][1] == 1.0
    assert got[3] == (pytest.approx(0.236593, abs=1e-6), pytest.approx(0.763407, abs=1e-6))


# -- parsing ---------------------------------------------------------------------------------------


def test_parse_pair_records(spark):
    lines = [
        LN, LN + "\r", "1,a,b,what,who,1", '2,,,"a ""b"", c",,0\r', '3,a,b,"line\nbreak","x,y", 1 ', "4,a,b,what,who", '5,a,b,wh"at,who,1', '6,a,b,"what"x,who,1', '7,a,b,"what,who,1',
        "x8,a,b,what,who,1", "9,a,b, \t ,who,1", "10,a,b,what,who,2", "", None, '11,a,b,"""q""",who,1', "12,a,b,,who,0", '13,"","",q,"",1', "14,a,b,q,w,1,extra", '15,a,b, "q",w,1',
        "16,a,b," + "y" * 200000 + ",w,1", '17,a,b,"' + '""' * 50000 + '",w,1', "99999999999999999999,a,b,q,w,1",
    ]
    raw = spark.createDataFrame([(i, line, "f") for i, line in enumerate(lines)], "raw_id long, raw_line string, id string")
    parsed = parse.parse_pair_records(raw)
    bad = dict(rows_of(parse.failed_records(parsed)))
    assert bad == {
        5: "column_count", 6: "quoting", 7: "quoting", 8: "quoting", 9: "value", 10: "value", 11: "value", 12: "column_count", 13: "column_count", 17: "column_count", 18: "quoting"
    }
    good = {r["raw_id"]: r for r in parse.valid_pairs(parsed).collect()}
    assert sorted(good) == [2, 3, 4, 14, 15, 16, 19, 20, 21] and good[21]["row_id"] is None and good[21]["long_id"] == "99999999999999999999"
    assert good[3]["question1"] == 'a "b", c' and good[3]["question2"] is None and good[4]["question1"] == "line\nbreak" and good[4]["is_duplicate"] == 1
    assert good[14]["question1"] == '"q"' and good[15]["question1"] == "" and good[16]["qid1"] is None and len(good[19]["question1"]) == 200000
    assert good[20]["question1"] == '"' * 50000
    assert parse.parse_pair_records(raw.limit(0)).count() == 0


# -- graph and splits ------------------------------------------------------------------------------


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected_components(spark):
    rnd = random.Random(3)
    edges = [(f"{rnd.randrange(500)}", f"{rnd.randrange(500)}") for _ in range(420)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    df = spark.createDataFrame(edges + [(None, "1")], "src string, dst string")
    nodes = spark.createDataFrame([("alone",), (None,), ("p000",)], "node string")
    assert dict(rows_of(graph.connected_components(df))) == _union_find(edges)
    assert rows_of(graph.connected_components(df, nodes)) == [("alone", "alone"), ("p000", "p000")]


def test_hubs_are_split(spark):
    edges = [("hub", f"{i}") for i in range(60)] + [("0", "1")]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src string, dst string")
    scratch = Scratch(spark)
    spread, hubs = graph.split_hubs(both, scratch, cap=10)
    most = spread.groupBy("src").count().agg(F.max("count")).first()[0]
    assert hubs and most <= 25 and len(set(_union_find([tuple(r) for r in spread.collect()]).values())) == 1
    assert graph.split_hubs(both, scratch) == (both, False)
    start = lambda node, level: graph.uniform(node, level, 0)
    roots = graph.contract_components(both, scratch, start, (0.0, 0.0), cap=10)
    assert roots.count() == 61 and roots.select("root").distinct().count() == 1


def test_ids_of_any_characters(spark):
    """No id can be taken for a part of a hub: all nodes come back."""
    edges = [("a\x00b", "c"), ("c", "d"), ("#1=c", "e"), ("=", ""), ("\x00", "\x00")]
    got = dict(rows_of(graph.connected_components(spark.createDataFrame(edges, "src string, dst string"))))
    assert got == _union_find(edges)


def test_running_total(spark):
    df = spark.createDataFrame([(g, i, i % 5) for g in ("a", "b", None) for i in range(200)], "g string, k int, n int").withColumn("_x", F.lit(1))
    got = ordering.running_total(df, "g", ["k"], F.col("n"), "before", seed=4, buckets=7).collect()
    for g in ("a", "b", None):
        own = sorted((r["before"], r["n"]) for r in got if r["g"] == g)
        total = 0
        for before, n in own:
            assert before == total
            total += n
        assert total == 400


def test_four_roles(spark):
    rows = spark.createDataFrame([(i, f"c{i // 3}", i % 2) for i in range(600)], "row_id long, component string, y int")
    fractions = {"final_holdout": 0.1, "calibration": 0.1, "tuning": 0.1}
    roles = split.four_roles(rows, "row_id", fractions)
    stats = {r["role"]: r for r in split.role_statistics(roles, rows, "row_id", "y").collect()}
    assert all(60 <= stats[r]["n_rows"] < 63 for r in fractions) and sum(s["n_rows"] for s in stats.values()) == 600
    assert roles.join(rows, "row_id").groupBy("component").agg(F.count_distinct("role").alias("n")).where("n > 1").isEmpty()
    assert rows_of(roles) == rows_of(split.four_roles(rows, "row_id", fractions)) != rows_of(split.four_roles(rows, "row_id", fractions, seed=1))
    with pytest.raises(ValueError):
        split.four_roles(rows.where("row_id < 6"), "row_id", fractions)
    with pytest.raises(ValueError):
        split.four_roles(rows, "row_id", {"tuning": 0.1})


def test_train_eval(spark):
    rows = spark.createDataFrame([(i,) for i in range(30)], "row_id long")
    assert rows_of(split.train_eval(rows, "row_id", 0.2).groupBy("part").count()) == [("eval", 6), ("train", 24)]
    assert rows_of(split.train_eval(rows.limit(19), "row_id", 0.2).groupBy("part").count()) == [("train", 19)]
    held = split.train_eval(rows.withColumn("component", F.when(F.col("row_id") < 25, "big").otherwise(F.col("row_id").cast("string"))), "row_id", 0.2)
    assert {r[0] for r in held.select("part").distinct().collect()} == {"eval", "train"}
    with pytest.raises(ValueError):
        split.train_eval(rows.withColumn("component", F.lit("one")), "row_id", 0.2)


def test_shared_ids(spark):
    df = spark.createDataFrame([("train", "a", "b"), ("dev", "b", None), ("dev", "a", " "), (None, "a", "a")], "split string, qid1 string, qid2 string")
    assert rows_of(split.shared_ids(df, "split", ["qid1", "qid2"])) == [("dev", "train", 2)]


# -- audit -----------------------------------------------------------------------------------------


def test_audit(spark):
    data = [(1, "1", "2", "a", "b", 1), (2, "3", "4", "b", "a", 1), (3, "1", " ", " ", "c", 0), (4, None, "9", "d", "d", None)]
    df = spark.createDataFrame(data, "row_id long, qid1 string, qid2 string, question1 string, question2 string, is_duplicate int")
    assert audit.label_summary(df).first()[:] == (4, 1, 2, 1, 0.5)
    assert audit.pair_summary(df).first()[:] == (1, 0, 1, 2, 1)
    assert audit.id_summary(df).first()[:] == (2, 5, 1, 3)
    status = {r["check"]: r["status"] for r in audit.audit_checks(df).collect()}
    assert status == {"non_empty": "pass", "binary_labels": "fail", "both_classes": "pass", "question_text": "warn", "question_ids": "warn", "repeated_pairs": "warn"}
    strict = {r["check"]: r["status"] for r in audit.audit_checks(df, require_ids=True, require_text=True).collect()}
    assert strict["question_text"] == strict["question_ids"] == "fail"
    assert {r["check"]: r["status"] for r in audit.audit_checks(df.limit(0)).collect()}["non_empty"] == "fail"


# -- metrics ---------------------------------------------------------------------------------------


def _scored(spark, ys, ps):
    return spark.createDataFrame(list(zip(ys, ps, strict=True)), "y int, p double")


def test_thresholds_by_hand(spark):
    sweep = metrics.threshold_sweep(_scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9]), "y", "p", [0.3, 0.5, 0.7])
    best = metrics.select_threshold(sweep).first()
    assert (best["threshold"], best["f1"]) == (0.5, 1.0)
    sweep = metrics.threshold_sweep(_scored(spark, [0, 0, 0, 1], [0.4, 0.45, 0.55, 0.6]), "y", "p", [0.3, 0.5, 0.7])
    best = metrics.select_threshold(sweep, "expected_cost", 10.0, 1.0).first()
    assert (best["threshold"], best["fp"], best["fn"], best["expected_cost"]) == (0.7, 0, 1, 0.25)
    for bad in ([], [0.0], [1.0]):
        with pytest.raises(ValueError):
            metrics.threshold_sweep(_scored(spark, [0], [0.1]), "y", "p", bad)
    with pytest.raises(ValueError):
        metrics.select_threshold(sweep, "expected_cost", 0.0, 0.0)


def test_rank_measures(spark):
    got = metrics.rank_measures(_scored(spark, [0, 0, 1, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.4]), "y", "p").first()
    assert got["roc_auc"] == pytest.approx(0.75) and got["average_precision"] == pytest.approx(0.8055555556)
    one = metrics.rank_measures(_scored(spark, [1, 1], [0.1, 0.4]), "y", "p").first()
    assert one["roc_auc"] is None and one["average_precision"] is None


def test_calibration_bins(spark):
    bins = metrics.calibration_bins(_scored(spark, [0, 1, 1, 1], [0.0, 0.29, 0.3, 1.0]), "y", "p", 100)
    assert [r["bin"] for r in bins.orderBy("bin").collect()] == [0, 29, 30, 99]
    ece = metrics.expected_calibration_error(bins).first()[0]
    assert ece == pytest.approx((0.71 + 0.7) / 4)


def test_slices(spark):
    df = spark.createDataFrame([(i % 2, 0.9 if i % 3 else 0.1, "en" if i < 15 else " it ", None if i else "x") for i in range(30)], "y int, p double, lang string, kind string")
    got = {(r["slice_column"], r["slice"]): r for r in metrics.slice_metrics(df, "y", "p", ["lang", "kind"]).collect()}
    assert {k: v["rows"] for k, v in got.items()} == {("lang", "en"): 15, ("lang", "it"): 15, ("kind", "x"): 1}
    for r in got.values():
        assert r["accuracy_low"] <= r["accuracy"] <= r["accuracy_high"]
    with pytest.raises(ValueError):
        metrics.slice_metrics(df, "y", "p", ["lang"], max_slices=1)
    with pytest.raises(ValueError):
        metrics.slice_metrics(df, "y", "p", ["lang", "lang"])


def test_calibrators(spark):
    rnd = random.Random(5)
    data = [(int(rnd.random() < p**2), round(p, 3)) for p in (rnd.random() for _ in range(2000))]
    df = spark.createDataFrame(data, "y int, p double")
    grid = spark.createDataFrame([(i / 50,) for i in range(51)], "p double")
    for made in (calibration.fit_sigmoid(df, "y", "p"), calibration.fit_isotonic(df, "y", "p")):
        values = [r[0] for r in grid.select(made.apply(F.col("p"))).collect()]
        assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
        assert calibration.from_json(calibration.to_json(made)) == made
    for bad in ({"method": "x"}, {"method": "isotonic", "xs": [0, 0], "ys": [0, 1]}, {"method": "isotonic", "xs": [0, 1], "ys": [1, 0]}, {"method": "sigmoid", "slope": "nan", "intercept": 0}):
        with pytest.raises(ValueError):
            calibration.from_json(json.dumps(bad))
    with pytest.raises(ValueError):
        calibration.fit_isotonic(df.where("y = 1"), "y", "p")


# -- retrieval -------------------------------------------------------------------------------------


def test_tfidf_search(spark):
    catalog = spark.createDataFrame([("q1", "how do i learn python"), ("q2", "best way to learn go"), ("q3", "reset my password"), ("q4", " "), (None, "x")], "question_id string, question string")
    asked = spark.createDataFrame([("What is the best way to learn Python?",), ("nothing known",), (None,), ("",)], "query string")
    hits = retrieval.tfidf_search(asked, catalog, k=2)
    got = {(r["query"], r["rank"]): (r["question_id"], r["score"]) for r in hits.collect()}
    assert got[("What is the best way to learn Python?", 1)][0] == "q2" and got[("What is the best way to learn Python?", 2)][0] == "q1"
    assert [got[("nothing known", i)] for i in (1, 2)] == [("q1", 0.0), ("q2", 0.0)] == [got[("", i)] for i in (1, 2)]
    blocks = retrieval.tfidf_search(asked, catalog, k=2, block_rows=1)
    assert rows_of(hits) == rows_of(blocks)
    assert retrieval.tfidf_search(asked, catalog.limit(0), k=2).isEmpty()
    with pytest.raises(ValueError):
        retrieval.tfidf_search(asked, catalog, k=0)


def test_dense_search(spark):
    data = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(data, "vec_id long, v array<float>")
    got = rows_of(retrieval.dense_search(df.where("vec_id = 1"), df, "vec_id", "v", 2).select("question_id", "rank"))
    assert got == [(2, 1), (3, 2)] == rows_of(retrieval.dense_search(df.where("vec_id = 1"), df, "vec_id", "v", 2, block_rows=1).select("question_id", "rank"))


def test_rerank(spark):
    hits = spark.createDataFrame([("q", "b", 0.8, 1), ("q", "a", 0.7, 2), ("q", "c", 0.1, 3)], "query string, question_id string, score double, rank int")
    score = lambda df: F.when(F.col("question_id") == "b", 0.5).otherwise(0.9)
    assert rows_of(retrieval.rerank(hits, score, 2, 2).select("question_id", "rank")) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="finite"):
        retrieval.rerank(hits, lambda df: F.lit(float("nan")), 1, 2).collect()
    with pytest.raises(ValueError):
        retrieval.rerank(hits, score, 3, 2)


def test_ranking_metrics(spark):
    judged = spark.createDataFrame([("q1", "a", 1.0), ("q2", "b", 2.0), ("q2", "x", 0.0)], "query string, question_id string, relevance double")
    found = spark.createDataFrame([("q1", "a", 1), ("q1", "z", 2), ("q2", "x", 1)], "query string, question_id string, rank int")
    got = {r["k"]: r for r in ranking.ranking_metrics(found, judged, [2, 1, 2]).collect()}
    assert (got[1]["recall"], got[1]["mrr"], got[2]["ndcg"], got[1]["hit_rate"]) == (0.5, 0.5, 0.5, 0.5)
    dirty = spark.createDataFrame([("q", "a", None), ("q", "a", -1.0), (" ", "b", 1.0), ("q", "u", float("nan")), ("q", "c", 1.0), ("q", "c", 2.0)], "query string, question_id string, relevance double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "question_id string")
    assert dict(rows_of(ranking.judgment_problems(dirty, ids))) == {"null_relevance": 2, "negative_relevance": 1, "blank_query": 1, "blank_id": 0, "repeated": 4, "unknown_id": 1}
    assert rows_of(ranking.clean_judgments(dirty, ids)) == [("q", "c", 2.0)]


def test_latency_and_drift(spark):
    ms = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (-1.0,)], "ms double")
    got = ranking.latency_summary(ms, "ms").first()
    assert (got["n"], got["p50_ms"], got["p99_ms"]) == (3, 2.0, pytest.approx(2.98))
    a, b = spark.createDataFrame([(1.0, 2.0)], "a double, b double"), spark.createDataFrame([(1.5, 2.0)], "a double, b double")
    assert {r["feature"]: r["shift"] for r in ranking.mean_shift(a, b, ["a", "b"]).collect()} == {"a": 0.5, "b": 0.0}


def test_serial_choice_equals_the_loop(spark):
    rnd = random.Random(6)
    for n in (1, 2):
        data = [(row, f"k{key}", "x", at) for row in range(14) for at, key in enumerate(rnd.sample(range(12), rnd.randrange(1, 7)))]
        taken, want = set(), set()
        for row in range(14):
            left = n
            for _, key, _, at in sorted((d for d in data if d[0] == row), key=lambda d: d[3]):
                if left and key not in taken:
                    taken.add(key)
                    want.add((row, key, at))
                    left -= 1
        df = spark.createDataFrame(data, "row int, lo string, hi string, at int")
        assert {(r["row"], r["lo"], r["at"]) for r in mining.serial_choice(df, n, Scratch(spark)).collect()} == want


def test_hard_negatives(spark):
    data = [(0, "q1", "q2", "learn python fast", "python learning", 1), (1, "q2", "q3", "python learning", "study python", 1), (2, "q1", "q4", "learn python fast", "learn go fast", 0), (3, "q5", "q6", "reset password", "python password", 0)]
    df = spark.createDataFrame(data, "row_id long, qid1 string, qid2 string, question1 string, question2 string, is_duplicate int")
    got = mining.hard_negatives(df, candidate_k=6, negatives_per_positive=2).collect()
    assert got and all(r["qid2"] not in {"q1", "q2", "q3"} and r["is_duplicate"] == 0 for r in got)
    assert len({tuple(sorted((r["qid1"], r["qid2"]))) for r in got}) == len(got)


# -- model, files, streams -------------------------------------------------------------------------


def test_model_round_trip(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(40)]
    data = []
    for i in range(240):
        a = rnd.sample(words, 5)
        b = rnd.sample(a, 4) + [rnd.choice(words)] if i % 2 else rnd.sample(words, 5)
        data.append((i, " ".join(a), " ".join(b), i % 2))
    data += [(900, None, "x", None), (901, "x", "y", 7)]
    df = spark.createDataFrame(data, "row_id long, question1 string, question2 string, is_duplicate int")
    made = model.train(df.where("row_id % 3 > 0"), evaluation=df.where("row_id % 3 = 0"), trees=5, depth=3)
    scored = model.score_pairs(df, made, explain=True)
    best = metrics.rank_measures(scored.drop("is_duplicate").join(df.where("is_duplicate in (0, 1)"), "row_id"), "is_duplicate", "proba").first()
    assert best["roc_auc"] > 0.9 and made.threshold in metrics.GRID
    model.save(made, str(tmp_path / "m"))
    again = model.load(spark, str(tmp_path / "m"))
    assert rows_of(again.score(df, "row_id")) == rows_of(made.score(df, "row_id"))
    spark.createDataFrame([("x", 1.0)], "term string, idf double").write.mode("append").parquet(str(tmp_path / "m/vocabulary"))
    with pytest.raises(ValueError):
        model.load(spark, str(tmp_path / "m"))
    assert model.resolve_threshold(0.7, made)[1] == "request" and model.resolve_threshold(None, made)[1] == "artifact"
    with pytest.raises(ValueError):
        model.resolve_threshold(1.5, made)
    with pytest.raises(ValueError):
        model.train(df.drop("question1"))


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text(' question1 ,question2,is_duplicate,qid1\n"a ""x""\nb",c,1,007\nNA,d,oops,null\n')
    got = tables.read_pairs(spark, str(tmp_path / "p.csv"))
    assert [tuple(r) for r in got.select("row_id", "question1", "is_duplicate", "qid1").orderBy("row_id").collect()] == [(0, 'a "x"\nb', 1, "007"), (1, None, None, None)]
    assert [len(b) for b in tables.batches(spark.range(7), 3)] == [3, 3, 1]
    with pytest.raises(ValueError, match="question_id"):
        tables.read_catalog(spark, str(tmp_path / "p.csv"))
    files = manifests.file_manifest(spark, str(tmp_path), "*.csv")
    assert files.first()["name"] == "p.csv" and len(manifests.folder_digest(files)) == 64
    registry = str(tmp_path / "registry")
    assert manifests.registered(spark, registry) == []
    for i in range(2):
        manifests.register(spark, registry, {"run": i})
    assert [r["run"] for r in manifests.registered(spark, registry)] == [0, 1]
    assert manifests.table_digest(spark.range(5)) == manifests.table_digest(spark.range(5).orderBy(F.desc("id"))) != manifests.table_digest(spark.range(6))
    assert manifests.markdown_table(spark.createDataFrame([("a", 0.5, None)], "n string, x double, y int")) == "| n | x | y |\n|---|---|---|\n| a | 0.5000 |  |\n"
    roles = spark.createDataFrame([(0, "train"), (1, "dev")], "row_id long, role string")
    tables.write_roles(roles, got, "row_id", str(tmp_path / "roles"))
    with pytest.raises(Exception):
        tables.write_roles(roles, got, "row_id", str(tmp_path / "roles"))


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 3.0), ("2024-01-01 00:04:59", "a", 30.0), ("2024-01-01 00:05:00", "b", 1e6)]
    batch = spark.createDataFrame(rows, "t string, kind string, ms double").withColumn("t", F.col("t").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = monitor.request_rates(stream, "t", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert rows_of(spark.table("rates").select("kind", "n")) == [("a", 2), ("b", 1)]
    histogram = monitor.latency_histogram(batch, "ms", ["kind"])
    assert rows_of(histogram.select("kind", "bucket", "n")) == [("a", 0, 1), ("a", 3, 1), ("b", 14, 1)]
    assert dict(((r["kind"], r["quantile"]), r["value"]) for r in monitor.histogram_quantiles(histogram, ["kind"]).collect())[("b", 0.5)] == 10000.0
    monitor.score_stream(stream, lambda df: df.withColumn("x", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_drift_windows(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00", "a b", "a b")], "t string, question1 string, question2 string").withColumn("t", F.col("t").cast("timestamp"))
    got = monitor.feature_drift_windows(df, "t", {"jaccard": 0.5, "len_sum": 4.0}).first()
    assert (got["max_shift"], got["jaccard_shift"], got["len_sum_shift"]) == (1.0, 1.0, 0.0)
