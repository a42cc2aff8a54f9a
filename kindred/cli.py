"""Command line: ``python -m kindred.cli COMMAND ...``; 0 on success, 1 with the error on stderr."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.operators import audit, calibration, metrics, mining, model, ranking, retrieval, split
from kindred.session import Scratch, build_session
from kindred.sources import manifests, tables

Command = Callable[[SparkSession, argparse.Namespace], int]
COMMANDS: dict[str, tuple[Command, list[tuple[tuple, dict]]]] = {}


def command(*arguments: tuple[tuple, dict]) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[f.__name__.replace("_", "-")] = (f, list(arguments))
        return f

    return add


def arg(*names: str, **options) -> tuple[tuple, dict]:
    return names, options


CSV, OUT = arg("--csv", required=True), arg("--out", required=True)


def _numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def _emit(text: str, out: str | None) -> None:
    if not out:
        sys.stdout.write(text)
        return
    with open(out, "x", encoding="utf-8") as file:
        file.write(text)


def _row(df) -> dict:
    found = df.first()
    return found.asDict(recursive=True) if found else {}


@command(CSV, arg("--require-ids", action="store_true"), arg("--require-text", action="store_true"), arg("--out"))
def audit_data(spark: SparkSession, a: argparse.Namespace) -> int:
    pairs = tables.read_pairs(spark, a.csv)
    for c in ("qid1", "qid2"):
        pairs = pairs if c in pairs.columns else pairs.withColumn(c, F.lit(None).cast("string"))
    checks = [r.asDict() for r in audit.audit_checks(pairs, a.require_ids, a.require_text).collect()]
    report = {"labels": _row(audit.label_summary(pairs)), "pairs": _row(audit.pair_summary(pairs)), "question_ids": _row(audit.id_summary(pairs)), "checks": checks}
    states = {c["status"] for c in checks}
    report["status"] = "fail" if "fail" in states else "warn" if "warn" in states else "pass"
    _emit(manifests.to_json(report), a.out)
    return int(report["status"] == "fail")


@command(CSV, OUT, arg("--seed", type=int, default=42), *[arg(f"--{r.replace('_', '-')}", type=float, default=0.1) for r in split.ROLES[:3]])
def freeze_protocol(spark: SparkSession, a: argparse.Namespace) -> int:
    scratch = Scratch(spark)
    pairs = tables.read_pairs(spark, a.csv)
    rows = scratch.save(split.row_components(pairs, "row_id", scratch=scratch))
    if rows.count() != pairs.count():
        raise ValueError("every row needs both question ids")
    roles = split.four_roles(rows, "row_id", {r: getattr(a, r) for r in split.ROLES[:3]}, a.seed, scratch)
    tables.write_roles(roles, pairs, "row_id", f"{a.out}/roles")
    stats = split.role_statistics(roles, rows.join(pairs.select("row_id", "is_duplicate"), "row_id"), "row_id", "is_duplicate")
    _emit(manifests.to_json({"seed": a.seed, "roles": {r["role"]: r.asDict() for r in stats.collect()}}), f"{a.out}/manifest.json")
    return 0


@command(CSV, OUT, arg("--eval-csv"), arg("--eval-fraction", type=float, default=0.2), arg("--optimize-for", default="f1"), arg("--trees", type=int, default=200), arg("--registry"))
def train(spark: SparkSession, a: argparse.Namespace) -> int:
    pairs = tables.read_pairs(spark, a.csv)
    held = tables.read_pairs(spark, a.eval_csv) if a.eval_csv else None
    if held is None and a.eval_fraction:
        parts = Scratch(spark).save(split.train_eval(pairs.select("row_id"), "row_id", a.eval_fraction))
        joined = pairs.join(parts, "row_id")
        pairs, held = joined.where("part = 'train'").drop("part"), joined.where("part = 'eval'").drop("part")
        held = None if held.isEmpty() else held
    made = model.train(pairs, evaluation=held, optimize_for=a.optimize_for, trees=a.trees)
    made.meta["used"] = [manifests.table_digest(df.select("question1", "question2", "is_duplicate")) for df in (pairs, held) if df is not None]
    model.save(made, a.out)
    if a.registry:
        manifests.register(spark, a.registry, {"artifact": a.out.rstrip("/").split("/")[-1], "threshold": made.threshold} | made.meta)
    return 0


def _scored(spark: SparkSession, a: argparse.Namespace):
    pairs = tables.read_pairs(spark, a.csv).where("is_duplicate in (0, 1)")
    made = model.load(spark, a.model)
    return made, Scratch(spark).save(made.score(pairs, "row_id", keep=[c for c in pairs.columns if c not in {"row_id", *model.FEATURES}]))


@command(CSV, OUT, arg("--model", required=True), arg("--method", choices=["sigmoid", "isotonic"], default="isotonic"), arg("--apart-from", action="append", default=[]))
def calibrate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Calibrates on rows that neither trained the model nor chose its threshold, and share no question id with the files of --apart-from."""
    made, scored = _scored(spark, a)
    if made.calibrator:
        raise ValueError("the model is calibrated already")
    if manifests.table_digest(scored.select("question1", "question2", "is_duplicate")) in made.meta.get("used", []):
        raise ValueError("the model was trained or its threshold chosen on these rows")
    for other in a.apart_from:
        ids = lambda df: df.select(F.explode(F.array("qid1", "qid2")).alias("id")).where("trim(id) <> ''").distinct()
        shared = ids(scored).join(ids(tables.read_pairs(spark, other)), "id", "left_semi").count()
        if shared:
            raise ValueError(f"{shared} question ids also stand in {other}")
    fit = calibration.fit_sigmoid if a.method == "sigmoid" else calibration.fit_isotonic
    made.calibrator = fit(scored, "is_duplicate", "raw_proba")
    chosen = metrics.select_threshold(metrics.threshold_sweep(scored.withColumn("p", made.calibrator.apply(F.col("raw_proba"))), "is_duplicate", "p")).first()
    made.threshold = chosen["threshold"] if chosen else None
    model.save(made, a.out)
    return 0


@command(CSV, arg("--model", required=True), arg("--threshold", type=float), arg("--slices", default=""), arg("--out"), arg("--markdown", action="store_true"))
def report(spark: SparkSession, a: argparse.Namespace) -> int:
    made, scored = _scored(spark, a)
    value, source = model.resolve_threshold(a.threshold, made)
    y, p = "is_duplicate", "proba"
    whole = metrics.compare_models(scored, y, {"model": p}, value)
    slices = [c for c in a.slices.split(",") if c]
    if a.markdown:
        parts = [manifests.markdown_table(whole), manifests.markdown_table(metrics.threshold_sweep(scored, y, p).orderBy("position"))]
        parts += [manifests.markdown_table(metrics.slice_metrics(scored, y, p, slices, value))] if slices else []
        _emit("\n".join(parts), a.out)
        return 0
    bins = metrics.calibration_bins(scored, y, p)
    body = {
        "threshold": value, "threshold_source": source, "metrics": _row(whole), "sweep": [r.asDict() for r in metrics.threshold_sweep(scored, y, p).orderBy("position").collect()],
        "calibration": {"bins": [r.asDict() for r in bins.orderBy("bin").collect()]} | _row(metrics.expected_calibration_error(bins)),
        "slices": [r.asDict() for r in metrics.slice_metrics(scored, y, p, slices, value).collect()] if slices else [], "data": manifests.table_digest(scored.select("row_id", y)),
    }
    _emit(manifests.to_json(body), a.out)
    return 0


@command(CSV, OUT, arg("--model", required=True), arg("--threshold", type=float), arg("--explain", action="store_true"))
def predict(spark: SparkSession, a: argparse.Namespace) -> int:
    """Scores a file of pairs; the batch form of the scoring service."""
    pairs = tables.with_row_id(tables.read_csv(spark, a.csv, ["question1", "question2"]))
    problems = pairs.where(model.request_problems(F.col("question1"), F.col("question2")).isNotNull()).count()
    if problems:
        raise ValueError(f"{problems} pairs lack a text or are too long")
    model.score_pairs(pairs, model.load(spark, a.model), threshold=a.threshold, explain=a.explain).write.mode("errorifexists").json(a.out)
    return 0


CATALOG = arg("--catalog-csv", required=True)


@command(CATALOG, arg("--query", action="append", required=True), arg("--k", type=int, default=10), arg("--out"))
def retrieve(spark: SparkSession, a: argparse.Namespace) -> int:
    if not 1 <= a.k <= 100 or len(a.query) > 32 or max(map(len, a.query)) > model.MAX_CHARACTERS:
        raise ValueError("at most 32 queries of 8192 characters and k up to 100")
    asked = spark.createDataFrame([(q,) for q in a.query], "query string")
    catalog = tables.read_catalog(spark, a.catalog_csv)
    hits = retrieval.tfidf_search(asked, catalog, a.k).join(retrieval.usable_catalog(catalog), "question_id").orderBy("query", "rank")
    _emit(manifests.to_json({"catalog_size": catalog.count(), "hits": [r.asDict() for r in hits.collect()]}), a.out)  # at most 32 x 100 rows
    return 0


@command(CATALOG, arg("--qrels-csv", required=True), arg("--ks", type=_numbers, default=[1, 5, 10]), arg("--out"))
def retrieve_benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    import time

    catalog = tables.read_catalog(spark, a.catalog_csv)
    qrels = tables.read_qrels(spark, a.qrels_csv)
    problems = {r["problem"]: r["n"] for r in ranking.judgment_problems(qrels, catalog).collect()}
    judged = ranking.clean_judgments(qrels, catalog)
    ks = [int(k) for k in a.ks]
    began = time.perf_counter()
    hits = Scratch(spark).save(retrieval.tfidf_search(judged.select("query"), catalog, max(ks)))
    seconds = time.perf_counter() - began
    found = [r.asDict() for r in ranking.ranking_metrics(hits, judged, ks).orderBy("k").collect()]
    n = found[0]["n_queries"] if found else 0
    _emit(manifests.to_json({"problems": problems, "metrics": found, "seconds": seconds, "queries_per_second": n / seconds}), a.out)
    return 0


@command(CSV, OUT, arg("--candidate-k", type=int, default=50), arg("--negatives-per-positive", type=int, default=1), arg("--max-positive-rows", type=int), arg("--seed", type=int, default=42))
def mine_hard_negatives(spark: SparkSession, a: argparse.Namespace) -> int:
    mined = mining.hard_negatives(tables.read_pairs(spark, a.csv), "row_id", a.candidate_k, a.negatives_per_positive, a.max_positive_rows, a.seed)
    mined.orderBy("source_row", "rank").write.option("header", True).mode("errorifexists").csv(a.out)
    return 0


@command(arg("--samples-csv", required=True), arg("--column", default="ms"), arg("--by", default=""), arg("--out"))
def latency_profile(spark: SparkSession, a: argparse.Namespace) -> int:
    by = [c for c in a.by.split(",") if c]
    samples = tables.read_csv(spark, a.samples_csv, [a.column, *by]).withColumn("_ms", F.expr(f"try_cast(`{a.column}` as double)"))
    _emit(manifests.to_json({"summary": [r.asDict() for r in ranking.latency_summary(samples, "_ms", by).collect()]}), a.out)
    return 0


@command(arg("--path", required=True), arg("--expected"), arg("--out"))
def digest(spark: SparkSession, a: argparse.Namespace) -> int:
    """The files of a folder with their digests; 1 if the whole differs from what is expected."""
    files = manifests.file_manifest(spark, a.path)
    whole = manifests.folder_digest(files)
    _emit(manifests.to_json({"digest": whole, "files": [r.asDict() for r in files.orderBy("name").collect()]}), a.out)
    return int(bool(a.expected) and a.expected != whole)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kindred")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (run, arguments) in COMMANDS.items():
        one = sub.add_parser(name, help=run.__doc__)
        for names, options in arguments:
            one.add_argument(*names, **options)
    args = parser.parse_args(argv)
    try:
        return COMMANDS[args.command][0](spark or build_session(), args)
    except (ValueError, FileExistsError, FileNotFoundError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
