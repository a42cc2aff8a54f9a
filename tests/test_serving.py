"""Requests, artefacts, sampling, bindings and streams of quoted files."""

import pytest

from kindred.operators import mining, model
from kindred.plans import contracts
from kindred.sources import manifests, tables


@pytest.fixture(scope="module")
def made(spark):
    data = [(i, f"a b c{i % 7}", f"a b c{i % 5} d" if i % 3 else f"x c{i % 4}", int(i % 3 > 0)) for i in range(120)]
    return model.train(spark.createDataFrame(data, "row_id long, question1 string, question2 string, is_duplicate int"), trees=3, depth=2)


def test_predict_arrays(made):
    got = model.predict_arrays(made, ["a b c1", "x"], ["a b c1 d", "y"], threshold=0.5, explain=True)
    assert [r["row_id"] for r in got] == [0, 1] and set(got[0]["features"]) == set(model.FEATURES) and got[0]["decision_threshold_source"] == "request"
    for left, right in ((["a"], []), ([], []), (["a"], [" "]), (["a"] * 257, ["b"] * 257), (["a" * 9000], ["b"])):
        with pytest.raises(ValueError):
            model.predict_arrays(made, left, right)


def test_artefact_with_expected_digest(spark, made, tmp_path):
    path = str(tmp_path / "model")
    model.save(made, path)
    digest = model.artifact_digest(spark, path)
    assert model.load(spark, path, digest).trees.getNumTrees == 3
    with pytest.raises(ValueError):
        model.load(spark, path, "0" * 64)


def test_repeated_keys_stay_rows(spark, made):
    df = spark.createDataFrame([(1, "a b", "a b"), (1, "a b", "x"), (2, None, "a")], "row_id long, question1 string, question2 string")
    assert made.score(df, "row_id").count() == 3


def test_sampled_rows(spark):
    rows = spark.range(100).withColumnRenamed("id", "row")
    one, two = (mining.sampled_rows(rows, "row", 10, seed).collect() for seed in (1, 2))
    assert len(one) == len(two) == 10 and one != two and one == mining.sampled_rows(rows, "row", 10, 1).collect()
    assert mining.sampled_rows(rows, "row", None, 1) is rows
    with pytest.raises(ValueError):
        mining.sampled_rows(rows, "row", 0, 1)


def test_bindings():
    protocol = {"roles": {"train": {"sha256": "a", "n_rows": 9}, "final_holdout": {"sha256": "b", "n_rows": 3}}}
    assert contracts.binding_problems({"data": "b", "metrics": {"n": 3}}, protocol) == []
    assert len(contracts.binding_problems({"data": "a", "metrics": {"n": 9}}, protocol)) == 3


def test_model_card(spark):
    card = manifests.model_card("Model", {"trees": 3}, {"Metrics": spark.createDataFrame([(0.5,)], "f1 double")})
    assert card.startswith("# Model\n\n- trees: 3") and "| 0.5000 |" in card


def test_stream_and_batch_read_quotes_alike(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = 'row_id,qid1,qid2,question1,question2,is_duplicate\n1,a,b,"say ""hi""\nthere","x,y",1\n2,c,d,q,w,0\n'
    (folder / "one.csv").write_text(text)
    batch = tables.read_pairs(spark, str(folder / "one.csv"))
    query = tables.read_stream(spark, str(folder)).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, batch.select(*tables.PAIRS.names).collect()))
    assert [r["row_id"] for r in tables.read_pairs(spark, str(folder / "one.csv"), 1).collect()] == [1]
