"""Queries that evaluate and calibrate scored pairs.

The scores are the rounded word similarity of each labelled pair: many ties, and no model run needed for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import duck
from kindred.functions.features import word_jaccard
from kindred.functions.text import clean_text
from kindred.operators import metrics
from kindred.operators.calibration import Isotonic, Sigmoid, fit_isotonic, fit_sigmoid
from kindred.operators.model import train
from kindred.plans.texts import table
from kindred.session import Scratch

SIGMOID = Sigmoid(5.0, -2.0)
ISOTONIC = Isotonic((0.0, 0.25, 0.5, 1.0), (0.1, 0.3, 0.6, 0.9))
COUNTS = ["tn", "fp", "fn", "tp"]
RATES = ["accuracy", "precision", "recall", "f1", "predicted_positive_rate"]


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def scored(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "smoke_pairs").where("is_duplicate in (0, 1)")
    # columns of their own: inside the similarity each text would be cleaned once for every time it is named
    cleaned = pairs.select("row_id", F.col("is_duplicate").alias("y"), "lang", F.lower(F.trim("source")).alias("source"), clean_text(F.col("question1")).alias("a"), clean_text(F.col("question2")).alias("b"))
    return cleaned.select("row_id", "y", F.round(word_jaccard(F.col("a"), F.col("b")), 2).alias("p"), "lang", "source")


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.threshold_sweep(scored(spark, sf), "y", "p"), RATES)


def select_threshold_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.select_threshold(metrics.threshold_sweep(scored(spark, sf), "y", "p")), RATES)


def select_threshold_cost(spark: SparkSession, sf: str) -> DataFrame:
    sweep = metrics.threshold_sweep(scored(spark, sf), "y", "p")
    return _rounded(metrics.select_threshold(sweep, "expected_cost", 10.0, 1.0), [*RATES, "expected_cost"])


def rank_measures(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.rank_measures(scored(spark, sf), "y", "p"), ["roc_auc", "average_precision"])


def probability_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.probability_losses(scored(spark, sf), "y", "p"), ["log_loss", "brier"])


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.calibration_bins(scored(spark, sf), "y", "p"), ["lower", "upper", "mean_proba", "positive_rate", "abs_error"])


def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.expected_calibration_error(metrics.calibration_bins(scored(spark, sf), "y", "p", 15)), ["ece"])


def slice_metrics(spark: SparkSession, sf: str) -> DataFrame:
    table_ = metrics.slice_metrics(scored(spark, sf), "y", "p", ["lang", "source"])
    return _rounded(table_, [c for c, t in table_.dtypes if t == "double"])


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumns({"squared": F.col("p") * F.col("p"), "root": F.sqrt("p")})
    table_ = metrics.compare_models(rows, "y", {"plain": "p", "squared": "squared", "root": "root"})
    return _rounded(table_, [c for c, t in table_.dtypes if t == "double"])


def apply_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("row_id", F.round(SIGMOID.apply(F.col("p")), 6).alias("calibrated"))


def apply_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("row_id", F.round(ISOTONIC.apply(F.col("p")), 6).alias("calibrated"))


def _kept_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The scores written once: a fit and its application read them several times."""
    return Scratch(spark).save(scored(spark, sf).select("row_id", "y", "p"))


def fitted_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    rows = _kept_scores(spark, sf)
    return rows.select("row_id", fit_sigmoid(rows, "y", "p").apply(F.col("p")).alias("calibrated"))


def fitted_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _kept_scores(spark, sf)
    return rows.select("row_id", fit_isotonic(rows, "y", "p").apply(F.col("p")).alias("calibrated"))


def trained_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Trees fitted on the train split, the threshold chosen on tuning, the final holdout scored."""
    pairs = table(spark, sf, "smoke_pairs")
    model = train(pairs.where("split = 'train'"), evaluation=pairs.where("split = 'tuning'"))
    held = model.score(pairs.where("split = 'final_holdout'"), "row_id")
    return held.select("row_id", "proba", (F.col("proba") >= (model.threshold or 0.5)).alias("is_duplicate"))


QUERIES = {
    f.__name__: f
    for f in (
        threshold_sweep, select_threshold_f1, select_threshold_cost, rank_measures, probability_losses, calibration_bins, calibration_error, slice_metrics, model_comparison, apply_sigmoid,
        apply_isotonic, fitted_sigmoid, fitted_isotonic, trained_scores,
    )
}

SCORED = f"""{duck.macros()},
texts AS (SELECT row_id, is_duplicate AS y, lang, lower(trim(source)) AS source, {duck.clean("question1")} AS a, {duck.clean("question2")} AS b
  FROM smoke_pairs CROSS JOIN compat WHERE is_duplicate IN (0, 1)),
scored AS MATERIALIZED (SELECT row_id, y, lang, source, round({duck.jaccard("a", "b")}, 2)::DOUBLE AS p FROM texts)"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"


def _cells(t: str, p: str = "p") -> str:
    return ", ".join(f"count(*) FILTER (y = {y} AND {p} {op} {t}) AS {n}" for n, y, op in (("tn", 0, "<"), ("fp", 0, ">="), ("fn", 1, "<"), ("tp", 1, ">=")))


_RATES_SQL = {
    "accuracy": _div("tp + tn", "tn + fp + fn + tp"), "precision": _div("tp", "tp + fp"), "recall": _div("tp", "tp + fn"), "f1": _div("2 * tp", "2 * tp + fp + fn"),
    "predicted_positive_rate": _div("tp + fp", "tn + fp + fn + tp"),
}
_RAW_RATES = ", ".join(f"{e} AS {n}" for n, e in _RATES_SQL.items())
_ROUND_RATES = ", ".join(f"round({n}, 6) AS {n}" for n in _RATES_SQL)
_SWEEP = f"""grid AS (SELECT unnest(range(7))::INT AS position, unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold),
cells AS (SELECT position, threshold, {_cells("threshold")} FROM scored, grid GROUP BY ALL),
sweep AS (SELECT *, {_RAW_RATES} FROM cells)"""


def _ranks(by: str) -> str:
    """CTE ``ranks`` (by, roc_auc, average_precision) of ``long`` (by, y, p)."""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""steps AS (SELECT {keys}p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM long GROUP BY {keys}p),
runs AS (SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS tp, sum(n) OVER ({part}ORDER BY p DESC) AS seen FROM steps),
ranks AS (SELECT {keys}sum(n)::BIGINT AS n, sum(pos)::BIGINT AS n_positive,
  round(1 - sum(pos * ((seen - n) - (tp - pos) + (n - pos) / 2.0)) / nullif(sum(pos) * (sum(n) - sum(pos)), 0), 6) AS roc_auc,
  round(CASE WHEN sum(n) > sum(pos) THEN sum(pos * (tp / seen)) / nullif(sum(pos), 0) END, 6) AS average_precision FROM runs {group})"""


_LOSSES = """round(avg(-(y * ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - y) * ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))), 6) AS log_loss,
  round(avg((p - y) * (p - y)), 6) AS brier"""


def _bins(n: int) -> str:
    return f"""bins AS (SELECT unnest(range({n}))::INT AS bin), held AS (SELECT bin, count(*) AS n, avg(p) AS mean_proba, avg(y) AS positive_rate
  FROM scored JOIN bins ON p >= bin / {n} AND (p < (bin + 1) / {n} OR bin = {n - 1}) GROUP BY bin)"""


def _wilson(name: str, hits: str, trials: str) -> str:
    z = "1.959963984540054"
    p, center = f"(({hits}) / ({trials}))", f"((({hits}) / ({trials})) + {z} * {z} / (2 * ({trials}))) / (1 + {z} * {z} / ({trials}))"
    half = f"{z} * sqrt({p} * (1 - {p}) / ({trials}) + {z} * {z} / (4 * ({trials}) * ({trials}))) / (1 + {z} * {z} / ({trials}))"
    return (
        f"CASE WHEN ({trials}) < 1 THEN NULL WHEN ({hits}) = 0 THEN 0 ELSE round(greatest(0, {center} - {half}), 6) END AS {name}_low, "
        f"CASE WHEN ({trials}) < 1 THEN NULL WHEN ({hits}) = ({trials}) THEN 1 ELSE round(least(1, {center} + {half}), 6) END AS {name}_high"
    )


SQL = {
    "threshold_sweep": f"WITH {SCORED}, {_SWEEP} SELECT position, threshold, tn, fp, fn, tp, {_ROUND_RATES} FROM sweep",
    "select_threshold_f1": f"""WITH {SCORED}, {_SWEEP} SELECT position, threshold, tn, fp, fn, tp, {_ROUND_RATES} FROM sweep
ORDER BY sweep.f1 DESC, sweep.accuracy DESC, abs(threshold - 0.5), position LIMIT 1""",
    "select_threshold_cost": f"""WITH {SCORED}, {_SWEEP}, priced AS (SELECT *, (fp * 10.0 + fn) / (tn + fp + fn + tp) AS cost FROM sweep)
SELECT position, threshold, tn, fp, fn, tp, {_ROUND_RATES}, round(cost, 6)::DOUBLE AS expected_cost FROM priced ORDER BY cost, priced.f1 DESC, priced.accuracy DESC, abs(threshold - 0.5), position LIMIT 1""",
    "rank_measures": f"WITH {SCORED}, long AS (SELECT y, p FROM scored), {_ranks('')} SELECT * FROM ranks",
    "probability_losses": f"WITH {SCORED} SELECT {_LOSSES} FROM scored",
    "calibration_bins": f"""WITH {SCORED}, {_bins(10)} SELECT bin, round(bin / 10, 6) AS lower, round((bin + 1) / 10, 6) AS upper, n, round(mean_proba, 6) AS mean_proba,
  round(positive_rate, 6) AS positive_rate, round(abs(mean_proba - positive_rate), 6) AS abs_error FROM held""",
    "calibration_error": f"WITH {SCORED}, {_bins(15)} SELECT round(sum(n * abs(mean_proba - positive_rate)) / sum(n), 6) AS ece FROM held",
    "slice_metrics": f"""WITH {SCORED}, long AS MATERIALIZED (SELECT 'lang' AS slice_column, trim(lang) AS slice, y, p FROM scored WHERE trim(lang) <> ''
  UNION ALL SELECT 'source', trim(source), y, p FROM scored WHERE trim(source) <> ''),
{_ranks("slice_column, slice")},
cells AS (SELECT slice_column, slice, count(*) AS rows, {_cells("0.5")}, {_LOSSES} FROM long GROUP BY ALL)
SELECT slice_column, slice, rows, tn, fp, fn, tp, {", ".join(f"round({e}, 6) AS {n}" for n, e in _RATES_SQL.items())}, round({_div("tp + fn", "rows")}, 6) AS positive_rate,
{_wilson("positive_rate", "tp + fn", "rows")}, {_wilson("accuracy", "tp + tn", "rows")}, {_wilson("precision", "tp", "tp + fp")}, {_wilson("recall", "tp", "tp + fn")},
log_loss, brier, roc_auc, average_precision FROM cells JOIN ranks USING (slice_column, slice)""",
    "model_comparison": f"""WITH {SCORED}, long AS MATERIALIZED (SELECT 'plain' AS model, y, p FROM scored UNION ALL SELECT 'squared', y, p * p FROM scored UNION ALL SELECT 'root', y, sqrt(p) FROM scored),
{_ranks("model")}, cells AS (SELECT model, {_cells("0.5")}, {_LOSSES} FROM long GROUP BY ALL)
SELECT model, tn, fp, fn, tp, {", ".join(f"round({e}, 6) AS {n}" for n, e in _RATES_SQL.items())}, log_loss, brier, n, n_positive, roc_auc, average_precision FROM cells JOIN ranks USING (model)""",
    "apply_sigmoid": f"WITH {SCORED} SELECT row_id, round(1 / (1 + exp(-(p * 5.0 - 2.0))), 6) AS calibrated FROM scored",
    "apply_isotonic": f"""WITH {SCORED} SELECT row_id, round(CASE WHEN p <= 0.25 THEN 0.1 + 0.2 * p / 0.25 WHEN p <= 0.5 THEN 0.3 + 0.3 * (p - 0.25) / 0.25
  ELSE 0.6 + 0.3 * (p - 0.5) / 0.5 END, 6)::DOUBLE AS calibrated FROM scored""",
}
