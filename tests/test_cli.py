"""The command line from end to end."""

import json
import random

import pytest

from kindred.cli import main


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    rnd = random.Random(1)
    words = [f"word{i}" for i in range(30)]
    lines = ["qid1,qid2,question1,question2,is_duplicate,lang"]
    for i in range(120):
        a = rnd.sample(words, 5)
        b = rnd.sample(a, 4) + [rnd.choice(words)] if i % 2 else rnd.sample(words, 5)
        lines.append(f"a{i // 2},b{i // 2},{' '.join(a)},{' '.join(b)},{i % 2},{'en' if i % 3 else 'de'}")
    (folder / "pairs.csv").write_text("\n".join(lines) + "\n")
    (folder / "catalog.csv").write_text("question_id,question\nq1,learn python\nq2,learn go\nq3,reset password\n")
    (folder / "qrels.csv").write_text("query,question_id,relevance\nhow to learn python,q1,1\nmy password,q3,2\nmy password,q9,1\n")
    return folder


def run(spark, folder, *args):
    return main([str(a).replace("@", str(folder) + "/") for a in args], spark)


def test_audit_and_roles(spark, files):
    assert run(spark, files, "audit-data", "--csv", "@pairs.csv", "--out", "@audit.json") == 0
    assert json.loads((files / "audit.json").read_text())["labels"]["n_positive"] == 60
    assert run(spark, files, "audit-data", "--csv", "@pairs.csv", "--out", "@audit.json") == 1  # it doesn't overwrite
    assert run(spark, files, "freeze-protocol", "--csv", "@pairs.csv", "--out", "@frozen") == 0
    assert set(json.loads((files / "frozen/manifest.json").read_text())["roles"]) == {"train", "tuning", "calibration", "final_holdout"}


def test_train_calibrate_report_predict(spark, files):
    assert run(spark, files, "train", "--csv", "@pairs.csv", "--out", "@m", "--trees", 3, "--registry", "@registry") == 0
    assert run(spark, files, "calibrate", "--csv", "@pairs.csv", "--model", "@m", "--out", "@c") == 0
    assert run(spark, files, "calibrate", "--csv", "@pairs.csv", "--model", "@c", "--out", "@d") == 1
    assert run(spark, files, "report", "--csv", "@pairs.csv", "--model", "@c", "--slices", "lang", "--out", "@report.json") == 0
    body = json.loads((files / "report.json").read_text())
    assert body["metrics"]["n"] == 120 and len(body["slices"]) == 2 and body["metrics"]["roc_auc"] > 0.8
    assert run(spark, files, "report", "--csv", "@pairs.csv", "--model", "@c", "--markdown", "--out", "@report.md") == 0
    assert run(spark, files, "predict", "--csv", "@pairs.csv", "--model", "@c", "--explain", "--out", "@scores") == 0
    assert spark.read.json(str(files / "scores")).count() == 120


def test_retrieval_and_mining(spark, files):
    assert run(spark, files, "retrieve", "--catalog-csv", "@catalog.csv", "--query", "python", "--k", 2, "--out", "@hits.json") == 0
    assert [h["question_id"] for h in json.loads((files / "hits.json").read_text())["hits"]] == ["q1", "q2"]
    assert run(spark, files, "retrieve", "--catalog-csv", "@catalog.csv", "--query", "python", "--k", 0) == 1
    assert run(spark, files, "retrieve-benchmark", "--catalog-csv", "@catalog.csv", "--qrels-csv", "@qrels.csv", "--ks", "1,2", "--out", "@bench.json") == 0
    assert json.loads((files / "bench.json").read_text())["metrics"][0]["recall"] == 1.0
    assert run(spark, files, "mine-hard-negatives", "--csv", "@pairs.csv", "--out", "@mined", "--candidate-k", 5) == 0
    assert run(spark, files, "digest", "--path", "@catalog.csv", "--expected", "x") == 1
