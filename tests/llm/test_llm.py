"""The training-data operators against brute force, round trips and held-out cases, and their edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions.text import clean_str
from kindred.llm import copies, edits, grouping, mixing, overlap, packing, personal, roles, similar, sizes


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# -- groups of matches -----------------------------------------------------------------------------


def test_match_groups_equal_union_find(spark):
    rnd = random.Random(1)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("hub", f"s{i}") for i in range(400)]
    noise = [(f"n{rnd.randrange(400)}", f"n{rnd.randrange(400)}") for _ in range(350)]
    edges = chain + star + noise + chain[:5] + [("loop", "loop")]
    df = spark.createDataFrame([(*e, "x") for e in edges] + [(None, "a", "x"), ("b", None, "x")], "src string, dst string, node string")
    assert dict(rows_of(grouping.match_groups(df))) == union_find(edges)


def test_match_groups_empty(spark):
    assert rows_of(grouping.match_groups(spark.createDataFrame([], "src string, dst string"))) == []


# -- roles -----------------------------------------------------------------------------------------


def test_linked_groups(spark):
    data = [(1, "A", " b "), (2, "B", "c"), (3, None, "c"), (4, "", None), (5, "x", None), (6, "y", "Y"), (6, "y", "Y")]
    df = spark.createDataFrame(data, "row_id long, qid1 string, qid2 string").withColumn("group", F.lit("clash"))
    got = rows_of(roles.linked_groups(df, "row_id", ["qid1", "qid2"]))
    assert got == [(1, "a"), (2, "a"), (3, "a"), (5, "x"), (6, "y"), (6, "y")]


def test_roles_keep_groups_and_shares(spark):
    rnd = random.Random(2)
    data = [(i, f"g{int(rnd.paretovariate(1.2))}" if i % 7 else None, rnd.choice([0, 1, 1, None])) for i in range(6000)]
    df = spark.createDataFrame(data, "k long, g string, y int")
    targets = {"train": 0.7, "dev": 0.2, "test": 0.1}
    got = roles.assign_roles(df, "k", "g", "y", targets).join(df, "k").collect()
    assert len(got) == 6000
    by_group = {}
    for r in got:
        if r["g"]:
            by_group.setdefault(r["g"], set()).add(r["role"])
    assert all(len(v) == 1 for v in by_group.values())
    largest = max(sum(1 for r in got if r["g"] == g) for g in by_group)
    for role, share in targets.items():
        assert abs(sum(r["role"] == role for r in got) - 6000 * share) <= largest
    with pytest.raises(ValueError):
        roles.assign_roles(df, "k", "g", "y", {"a": -1.0})


def test_roles_meet_the_shares_of_each_label(spark):
    """One large group of a single label, the others mixed or pure: every label is near its share in every role."""
    rnd = random.Random(12)
    data = [(i, "big", 1) for i in range(900)]
    data += [(1000 + i, f"g{i // 3}", int(rnd.random() < (0.1, 0.5, 0.95)[i // 3 % 3])) for i in range(9000)]
    df = spark.createDataFrame(data, "k long, g string, y int")
    targets = {"train": 0.7, "dev": 0.2, "test": 0.1}
    got = roles.assign_roles(df, "k", "g", "y", targets).join(df, "k").groupBy("role", "y").count().collect()
    n = {(r["role"], r["y"]): r["count"] for r in got}
    for y in (0, 1):
        total = sum(n[(role, y)] for role in targets)
        assert all(abs(n[(role, y)] / total - share) < 0.02 for role, share in targets.items())


def test_linked_groups_over_hubs_and_long_paths(spark, monkeypatch):
    monkeypatch.setattr(roles.bipartite_components, "__defaults__", (3, 0, 15, 200))
    edges = [("hub", f"s{i}") for i in range(70)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("a\x00b", "#1=hub"), ("#1=hub", "z")]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "k long, x string, y string")
    want = union_find(edges)
    assert rows_of(roles.linked_groups(df, "k", ["x", "y"])) == [(i, want[a]) for i, (a, _) in enumerate(edges)]
    assert rows_of(roles.linked_groups(df.limit(0), "k", ["x", "y"])) == []


# -- copies ----------------------------------------------------------------------------------------


def test_formatting_copies(spark):
    data = [
        (1, "What is it?", "Who?"), (2, "who", "WHAT  is it"), (3, "what is it", "what is it"), (4, "Who!", "Who!"), (5, None, ""), (6, " ", None), (7, "ﬁne", "x"), (8, "x", "fine"),
        (9, "a b", "c"), (10, "a", "b c"), (None, "who", "what is it"), (11, "word " * 5000, "x"), (12, "x", "WORD " * 5000),
    ]
    df = spark.createDataFrame(data, "row_id long, question1 string, question2 string").withColumn("copy", F.lit(1))
    fields = {"question1": "q", "question2": "q"}
    assert rows_of(copies.formatting_copies(df, "row_id", fields)) == [(1, 2), (5, 6), (7, 8), (11, 12)]
    assert rows_of(copies.collapse(df, "row_id", fields).select("row_id", "n_copies")) == [(1, 2), (3, 1), (4, 1), (5, 2), (7, 2), (9, 1), (10, 1), (11, 2)]
    named = {"question1": "a", "question2": "b"}  # fields that aren't interchangeable
    assert rows_of(copies.formatting_copies(df, "row_id", named)) == [(5, 6)]


def test_copies_with_colliding_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(copies, "fingerprint", lambda named, seed: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "c", "d"), (4, "d", "c"), (5, "e", "e")], "k long, x string, y string")
    assert rows_of(copies.formatting_copies(df, "k", {"x": "q", "y": "q"})) == [(1, 2), (3, 4)]


def test_copies_empty(spark):
    df = spark.createDataFrame([], "k long, x string")
    assert rows_of(copies.formatting_copies(df, "k", {"x": "q"})) == []


# -- overlaps and near texts -----------------------------------------------------------------------


def _texts(rnd, n):
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(800)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.5:
            ws = rnd.choice(out).split()
            for _ in range(rnd.randrange(3)):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
            rnd.shuffle(ws)
        else:
            ws = [rnd.choice(vocabulary[:60]) for _ in range(rnd.randrange(2, 10))] + [rnd.choice(vocabulary[60:]) for _ in range(rnd.randrange(4))]
        out.append(" ".join(ws))
    return out


def _similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_split_overlaps_against_brute_force(spark):
    rnd = random.Random(3)
    texts = _texts(rnd, 1000)
    data = [(i, rnd.choice(["train", "train", "dev", "test", None]), t, rnd.choice(["", None, "w1 w2"])) for i, t in enumerate(texts)]
    data += [(2900, "train", None, " "), (2901, "dev", None, None), (2902, "dev", "same", None), (2903, "train", "SAME!", ""), (None, "dev", "same", None)]
    df = spark.createDataFrame(data, "row_id long, split string, question1 string, question2 string").withColumn("a", F.lit(1))
    got = {(r[0], r[1]) for r in overlap.split_overlaps(df, "row_id", "split", ["question1", "question2"]).collect()}
    sets = {r[0]: (r[1], set((clean_str(r[2]) + " " + clean_str(r[3])).split())) for r in data if r[0] is not None and r[1]}
    want = {(a, b) for a, b in itertools.permutations(sets, 2) if sets[a][0] == "train" != sets[b][0] and sets[a][1] and _similarity(sets[a][1], sets[b][1]) >= 0.8 - 1e-9}
    assert (2903, 2902) in got and got <= want and len(got) >= 0.98 * len(want) > 50


def test_overlap_report_counts_without_pairs(spark):
    data = [(i, "train", "X", "same words here", "") for i in range(40)] + [(100 + i, "dev", " x", "Same words, here!", None) for i in range(30)]
    data += [(200, "test", None, "same words here too and more of it", ""), (201, "dev", "y", "something else", ""), (202, None, "y", "same words here", "")]
    df = spark.createDataFrame(data, "row_id long, split string, source string, a string, b string").withColumn("n_pairs", F.lit(0))
    got = overlap.overlap_report(df, "row_id", "split", "source", ["a", "b"])
    assert rows_of(got) == [("dev", "x", 1200, 30, 30)]
    assert rows_of(overlap.overlap_report(df.limit(0), "row_id", "split", "source", ["a"])) == []


def test_split_overlaps_empty(spark):
    df = spark.createDataFrame([], "row_id long, split string, q string")
    assert rows_of(overlap.split_overlaps(df, "row_id", "split", ["q"])) == []


def test_may_reach_is_lossless():
    rnd = random.Random(4)
    for _ in range(300):
        a = {f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 30))}
        b = {w for w in a if rnd.random() < 0.9} | {f"w{rnd.randrange(40)}"}
        hashes, places, starts = overlap.element_hashes(__import__("pandas").Series(["\t".join(sorted(a)), "\t".join(sorted(b))]))
        x, y = (int(v) for v in overlap.parity_sketches(hashes, places, starts))
        assert (x ^ y).bit_count() <= len(a ^ b)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_near_texts_are_complete(spark, threshold):
    rnd = random.Random(5)
    texts = _texts(rnd, 500) + ["only", "frequent w1 w2", "w1 w2 frequent", "long " + " ".join(f"t{i}" for i in range(6000))]
    data = [(f"p:{i}", t) for i, t in enumerate(texts)] + [("c:1", None), ("c:2", " "), (None, "only"), ("c:3", "ONLY!"), ("c:3", "only")]
    df = spark.createDataFrame(data, "rec string, text string").withColumn("a", F.lit(1))
    got = {(r[0], r[1]) for r in edits.near_texts(df, threshold).collect()}
    firsts = {}
    for rec, text in data:
        if rec and clean_str(text):
            firsts[clean_str(text)] = min(rec, firsts.get(clean_str(text), rec))
    sets = [(rec, set(t.split())) for t, rec in firsts.items()]
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(sets, 2) if _similarity(x, y) >= threshold - 1e-9}
    assert got == want and len(want) > 20


def test_near_texts_with_frequent_words_only(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(11)]
    data = [(f"p:{i}", " ".join(rnd.sample(words, rnd.randrange(1, 12)))) for i in range(250)]
    got = {(r[0], r[1]) for r in edits.near_texts(spark.createDataFrame(data, "rec string, text string"), 0.7).collect()}
    firsts = {}
    for rec, t in data:
        firsts[t] = min(rec, firsts.get(t, rec))
    want = {(min(a, b), max(a, b)) for (x, a), (y, b) in itertools.combinations(firsts.items(), 2) if _similarity(set(x.split()), set(y.split())) >= 0.7 - 1e-9}
    assert got == want and len(want) > 20


def test_thresholds_are_unequal_and_sum_right():
    rng = np.random.default_rng(1)
    for parts, tau in ((1, 1), (4, 3), (5, 3), (6, 2)):
        cost_0 = rng.integers(0, 50, (40, parts)).astype(float)
        cost_1 = cost_0 + rng.integers(0, 90, (40, parts))
        got = edits.allocate(cost_0, cost_1, np.full(40, tau))
        assert (got.sum(1) == tau - parts + 1).all() and set(np.unique(got)) <= {-1, 0, 1}
        spent = np.where(got == 0, cost_0, np.where(got == 1, cost_1, 0)).sum(1)
        for i in range(40):
            costs = [(0, cost_0[i, j], cost_1[i, j]) for j in range(parts)]
            best = min(sum(c[u] for c, u in zip(costs, us)) for us in itertools.product(range(3), repeat=parts) if sum(us) == tau + 1)
            assert abs(best - spent[i]) < 1e-9
    assert {-1, 0, 1} == set(np.unique(edits.allocate(np.array([[9.0, 1, 1, 900]]), np.array([[9.5, 50, 60, 999]]), np.array([3]))))


def test_distances_have_the_parity_of_the_sizes():
    how = edits.Partitions(0.7, {})
    for n in range(1, 40):
        for m in range(1, n + 1):
            possible = [d for d in range(n - m, n + m + 1, 2) if ((n + m - d) / 2) / ((n + m + d) / 2) >= 0.7 - 1e-9]
            assert int(how.tau(np.array(n), np.array(m))) == max(possible, default=-1)


def test_correlated_words_share_a_group(spark):
    data = [(i, "\t".join(["how", "to", f"a{i % 50}"] if i % 2 else ["why", f"b{i % 60}"])) for i in range(600)]
    sets = spark.createDataFrame(data, "set_id long, shingles string")
    groups = edits.word_groups(sets, edits.word_counts(sets))
    assert {groups.get(w, w) for w in ("how", "to")} in ({"how"}, {"to"}) and groups.get("why", "why") not in ("how", "to")


def test_near_texts_empty(spark):
    assert rows_of(edits.near_texts(spark.createDataFrame([], "rec string, text string"))) == []


# -- vectors ---------------------------------------------------------------------------------------


def _vectors(n=600, dims=16, seed=7):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 8, dims))
    return centers[rng.integers(0, len(centers), n)] + 0.15 * rng.normal(size=(n, dims))


def _recall(x, got, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = {(f"q{i:04d}", f"q{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:k]}
    cos = {(r["query"], r["neighbor"]): r["cosine"] for r in got}
    assert all(abs(c - s[int(a[1:]), int(b[1:])]) < 1e-5 for (a, b), c in cos.items())
    return len(set(cos) & want) / len(want)


def _table(spark, x):
    return spark.createDataFrame([(f"q{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>").withColumn("vec", F.lit(1))


def test_nearest_vectors_recall(spark):
    """The ten nearest, however far they are: clustered vectors, and mere noise, where neighbours lie in many lists."""
    x = _vectors()
    assert _recall(x, similar.nearest_vectors(_table(spark, x), "id", "v").collect(), 10) >= 0.95
    noise = np.random.default_rng(4).normal(size=(2500, 24))
    assert _recall(noise, similar.nearest_vectors(_table(spark, noise), "id", "v").collect(), 10) >= 0.95


def test_nearest_vectors_in_parts_with_shared_refinement(spark):
    """A sample too small for the lists, and buckets cut along members and askers: the recall stays."""
    x = _vectors(900)
    got = similar.nearest_vectors(_table(spark, x), "id", "v", k=5, fit_rows=120, bucket_rows=20)
    assert got.groupBy("query", "neighbor").count().where("count > 1").isEmpty()
    assert _recall(x, got.collect(), 5) >= 0.93
    assert len(similar.coarse_centers(x[:120].astype(np.float32), 60, np.random.default_rng(1))) == 60


def test_a_bucket_without_members_finds_nothing():
    x = np.eye(4, dtype=np.float32)
    index = similar.fit_index(x, similar.coarse_centers(x, 2, np.random.default_rng(1)), 4, 2, 2, 10, 1)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(list("abcd")), similar._binary(x)], ["cid", "id", "vec"])
    rows = pa.Table.from_batches([similar.place_vectors(batch, index)])
    members = pa.array([v >= 0 for v in rows["list"].to_pylist()])
    lone = rows.set_column(6, "list", pa.array([-1] * len(rows), pa.int32())).set_column(7, "codes", pa.nulls(len(rows), pa.binary()))
    assert similar.search_bucket(lone, index, 3, 8, -1.0).num_rows == 0
    assert sum(v for v in members.to_pylist()) == 4 and similar.search_bucket(rows.filter(pa.array([b == rows["bucket"][0].as_py() for b in rows["bucket"].to_pylist()])), index, 3, 8, -1.0).num_rows > 0


def test_equal_cosines_go_to_smaller_keys(spark, monkeypatch):
    monkeypatch.setattr(similar, "LEAST_PROBES", 99)  # all lists
    data = [("q", [1.0, 0.0, 0.0])] + [(f"n{i}", [0.9, 0.1 * np.cos(i), 0.1 * np.sin(i)]) for i in (3, 1, 2)] + [("z", [0.5, 0.5, 0.0]), ("a", [0.5, -0.5, 0.0]), ("m", [0.5, 0.0, 0.5])]
    df = spark.createDataFrame([(k, [float(e) for e in v]) for k, v in data], "id string, v array<float>")
    got = similar.nearest_vectors(df, "id", "v", k=5).where("query = 'q'").orderBy("place").collect()
    assert [r["neighbor"] for r in got[3:]] == ["a", "m"]


def test_nearest_vectors_edges(spark):
    same = [1.0, 2.0, 3.0]
    data = [(f"s{i:02d}", [2 * v for v in same] if i % 2 else same) for i in range(15)]
    data += [("zero", [0.0] * 3), ("null", None), (None, same), ("nan", [1.0, float("nan"), 0.0]), ("hole", [1.0, None, 0.0]), ("short", [1.0]), ("other", [3.0, 2.0, 1.0]), ("big", [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(data, "id string, v array<float>")
    got = similar.nearest_vectors(df, "id", "v", k=3)
    assert got.groupBy("query").count().agg(F.max("count"), F.min("count")).first()[:] == (3, 3)
    assert rows_of(got.where("query = 's00'").select("neighbor", "place")) == [("s01", 1), ("s02", 2), ("s03", 3)]
    assert rows_of(got.where("query = 's02'").select("neighbor")) == [("s00",), ("s01",), ("s03",)]
    names = {r[0] for r in got.select("query").distinct().collect()}
    assert names == {f"s{i:02d}" for i in range(15)} | {"other", "big"}
    assert similar.nearest_vectors(df.limit(0), "id", "v").count() == 0


# -- packing ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [1, 7, 50, 512])
def test_plans_hold_every_item_once(capacity):
    rnd = random.Random(capacity)
    for _ in range(60):
        counts = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 30))}
        plan = packing.plan_containers(counts, capacity)
        held = {}
        for sizes_, times in plan:
            assert times > 0 and sum(sizes_) <= capacity
            for s in sizes_:
                held[s] = held.get(s, 0) + times
        assert held == counts


def _least(items, capacity):
    """Least number of containers, by trying all."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                go(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(8)
    for _ in range(150):
        items = [rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9))]
        counts = {s: items.count(s) for s in items}
        left = packing._Sizes(counts)
        fixed = packing.reduce_by_dominance(left, 20)
        rest = [s for s, n in left.n.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + _least(rest, 20) == _least(items, 20)


def test_pack(spark):
    data = [(i, (i * 37) % 130) for i in range(900)] + [(2000, None), (2001, -3), (None, 5), (2002, 950)]
    df = spark.createDataFrame(data, "k long, n long").withColumn("piece", F.lit("clash"))
    got = packing.pack(df, "k", "n", 100).collect()
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["length"]
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    pieces = {}
    for r in got:
        pieces.setdefault(r["k"], []).append((r["piece"], r["start"], r["length"]))
    want = {k: n for k, n in data if k is not None and n and n > 0}
    assert {k: sum(p[2] for p in ps) for k, ps in pieces.items()} == want
    assert all(len(ps) == -(-want[k] // 100) for k, ps in pieces.items())
    assert len(used) <= 1.02 * sum(used.values()) / 100 + 1
    report = packing.fill_report(packing.pack(df, "k", "n", 100), 100).first()
    assert report["n_containers"] == len(used) and report["fullest"] <= 100
    assert packing.pack(df.limit(0), "k", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "k", "n", 0)


# -- mixing ----------------------------------------------------------------------------------------


def test_sainte_lague_is_the_highest_quotients():
    rnd = random.Random(9)
    for _ in range(40):
        shares = {f"s{i}": rnd.random() for i in range(rnd.randrange(1, 8))}
        seats = rnd.randrange(0, 90)
        quotients = sorted(((-s / (2 * q + 1), n) for n, s in shares.items() for q in range(seats)))[:seats]
        assert mixing.sainte_lague(shares, seats) == {n: sum(m == n for _, m in quotients) for n in shares}
    assert mixing.sainte_lague({"a": 1.0, "b": 1.0}, 10, {"a": 2, "b": 20}) == {"a": 2, "b": 8}


def test_mix(spark):
    rnd = random.Random(10)
    data = [(i, rnd.choice(["Big ", "big", "mid", "small", None, "unasked"]), rnd.randrange(0, 60)) for i in range(5000)] + [(None, "big", 5), (9999, "small", None)]
    docs = spark.createDataFrame(data, "k long, source string, n long").withColumn("shard", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(docs, "k", "source", "n", targets, block_tokens=128)
    rows = mixed.collect()
    times = {}
    for r in rows:
        times.setdefault((r["source"], r["k"]), []).append(r["repeat"])
    limit = {"big": 1, "mid": 2, "small": 3}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= limit[s] for (s, _), v in times.items())
    got = {r["source"]: r for r in report.collect()}
    assert all(abs(got[s]["reached_share"] - t) < 0.02 for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    assert {r["shard"] for r in rows} == set(range(8))
    empty, nothing = mixing.mix(docs.limit(0), "k", "source", "n", targets)
    assert empty.count() == 0 and all(r["tokens"] == 0 for r in nothing.collect())


def test_quotas_of_shards():
    quota = {"a": 103, "b": 41, "c": 7, "d": 0}
    got = mixing.shard_quotas(quota, 8)
    assert all(sum(got[n]) == quota[n] and min(got[n]) >= 0 for n in quota)
    sizes_ = [sum(got[n][i] for n in quota) for i in range(8)]
    assert max(sizes_) - min(sizes_) <= 1
    assert all(abs(got[n][i] - quota[n] / 8) <= 1 for n in quota for i in range(8))


def test_shards_are_mixes(spark):
    docs = spark.createDataFrame([(i, ("a", "b", "b", "c")[i % 4], 20 + i % 17) for i in range(8000)], "k long, source string, n long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed, _ = mixing.mix(docs, "k", "source", "n", targets, block_tokens=128)
    shares = mixed.groupBy("shard", "source").agg(F.sum("n").alias("t")).collect() if "n" in mixed.columns else mixed.groupBy("shard", "source").agg(F.sum("n_tokens").alias("t")).collect()
    total = {i: sum(r["t"] for r in shares if r["shard"] == i) for i in range(8)}
    assert max(total.values()) < 1.1 * min(total.values())
    want = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert all(abs(r["t"] / total[r["shard"]] - want[r["source"]]) < 0.03 for r in shares)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 30000)], "k long, text string")
    assert rows_of(sizes.token_counts(df, "text").select("k", "n_tokens"))[:3] == [(1, 2), (2, 0), (3, 0)]


# -- personal information --------------------------------------------------------------------------

KNOWN = {"maria": "given", "weber": "family", "olsson": "family"}
CASES = [
    ("Mail me at jo.doe+x@mail.example.org, ok.", [("email", "jo.doe+x@mail.example.org")]),
    ("see <jo [at] example [dot] com> or jo AT example DOT org.", [("email", "jo [at] example [dot] com"), ("email", "jo AT example DOT org")]),
    ("pip install thing@1.2.3 as root@node-1:~$", []),
    ("ｊｏ＠example.com", [("email", "ｊｏ＠example.com")]),
    ("Call me on (555) 555-0123 ext. 9 or +44 (0)20 7946 0123.", [("phone", "(555) 555-0123"), ("phone", "+44 (0)20 7946 0123")]),
    ("Call me on five five five zero one two three", [("phone", "five five five zero one two three")]),
    ("build 26506015, max 961.961.961, order 00937500, part no. 940-51-8983-X", []),
    ("My SSN is 900-12-3456. passport XZ1234567 lost", [("identity_number", "900-12-3456"), ("identity_number", "XZ1234567")]),
    ("I live at 17B Oak Way in Town. J'habite 12 bis, rue de Lyon, 69000 X", [("street_address", "17B Oak Way"), ("street_address", "12 bis, rue de Lyon")]),
    ("Wir sitzen in der Lindenstraße 5a, 12345 B. Vivo en C/ Mayor, 7, 28000", [("street_address", "Lindenstraße 5a"), ("street_address", "C/ Mayor, 7")]),
    ("My name is Dr. Ana M. van Dyk and I left. thanks to weber maria for it", [("name", "Ana M. van Dyk"), ("name", "weber maria")]),
    ("Olsson, Maria wrote: hello. I like Olsson Server and Maria.", [("name", "Olsson, Maria")]),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_find_personal(text, want):
    assert sorted((k, text[a:b]) for a, b, k in personal.find_personal(text, KNOWN)) == sorted(want)


def test_rewriting_maps_back():
    text = "x​ call ONE two three four five six now"
    traced = personal.spelled(personal.plain(text), text.lower().split())
    at = traced.text.index("123456")
    assert traced.source(at, at + 6) == (8, 35)


def test_personal_tables(spark):
    names = spark.createDataFrame([("Maria", "given"), ("Weber", "family"), (None, "given")], "name_part string, part_kind string")
    data = [(1, "Write to a@b.example. Bye"), (2, None), (3, ""), (4, "long " * 20000 + "Maria Weber"), (4, "a@b.example a@b.example")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = rows_of(personal.personal_passages(df, "doc_id", "text", names).select("doc_id", "kind", "found_text"))
    assert got == [(1, "email", "a@b.example"), (4, "email", "a@b.example"), (4, "email", "a@b.example"), (4, "name", "Maria Weber")]
    red = personal.redact(df, "text", names).where("doc_id in (1, 2, 3)").select("doc_id", "redacted").collect()
    assert {tuple(r) for r in red} == {(1, "Write to [EMAIL]. Bye"), (2, None), (3, "")}
    assert personal.personal_passages(df.limit(0), "doc_id", "text").count() == 0
