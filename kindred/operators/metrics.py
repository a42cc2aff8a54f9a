"""Evaluation of scored pairs: threshold sweeps, rank measures, calibration, slices.

Inputs are tables with a label (0/1) and a probability. All sums are over the distinct probabilities, pre-aggregated, so
that the ordered steps see one row per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.features import wilson
from kindred.session import Scratch

EPSILON = 2.220446049250313e-16
GRID = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion_metrics() -> dict[str, Column]:
    """accuracy, precision, recall, f1 and predicted_positive_rate from tn, fp, fn, tp; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return {
        "accuracy": _rate(tp + tn, n), "precision": _rate(tp, tp + fp), "recall": _rate(tp, tp + fn), "f1": _rate(2 * tp, 2 * tp + fp + fn),
        "predicted_positive_rate": _rate(tp + fp, n),
    }


def _confusion(y: Column, hit: Column) -> list[Column]:
    """Cells of a table of score counts."""
    cell = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).alias(name)
    return [cell((y == 0) & ~hit, "tn"), cell((y == 0) & hit, "fp"), cell((y == 1) & ~hit, "fn"), cell((y == 1) & hit, "tp")]


def _grid(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    if not thresholds or not all(0 < t < 1 for t in thresholds):
        raise ValueError("thresholds must lie strictly between 0 and 1")
    return df.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "position int, threshold double")


def threshold_sweep(scored: DataFrame, label: str, proba: str, thresholds: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and metrics at each threshold (proba >= t is positive), in one pass over the data.

    The table is reduced to counts per distinct probability and label before it meets the grid.
    """
    met = score_counts(scored, label, proba, by).crossJoin(F.broadcast(_grid(scored, thresholds)))  # a few thresholds
    table = met.groupBy(*by, "position", "threshold").agg(*_confusion(F.col("_y"), F.col("_p") >= F.col("threshold")))
    return table.withColumns(confusion_metrics())


def select_threshold(sweep: DataFrame, optimize_for: str = "f1", fp_cost: float = 1.0, fn_cost: float = 1.0) -> DataFrame:
    """The row of a sweep with the best metric; ties by f1, accuracy, nearness to 0.5, then the first listed.

    ``expected_cost`` = (fp * fp_cost + fn * fn_cost) / n is minimised and added as a column.
    """
    costs = (fp_cost, fn_cost)
    if any(isinstance(c, bool) or not 0 <= c < float("inf") for c in costs) or not any(costs):
        raise ValueError("costs must be finite, not negative and not both 0")
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    if optimize_for == "expected_cost":
        sweep = sweep.withColumn("expected_cost", (F.col("fp") * fp_cost + F.col("fn") * fn_cost) / n)
        best = -F.col("expected_cost")
    elif optimize_for in ("f1", "accuracy", "precision", "recall"):
        best = F.col(optimize_for)
    else:
        raise ValueError(f"unknown metric {optimize_for!r}")
    order = F.struct(best.alias("a"), F.col("f1").alias("b"), F.col("accuracy").alias("c"), (-F.abs(F.col("threshold") - 0.5)).alias("d"), (-F.col("position")).alias("e"))
    chosen = sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("r"))
    return chosen.select("r.*").where("threshold is not null")


def score_counts(scored: DataFrame, label: str, proba: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, _y, _p, _n): how often each label and probability occur together; all measures are sums over this."""
    return scored.groupBy(*by, F.col(label).alias("_y"), F.col(proba).alias("_p")).agg(F.count("*").alias("_n"))


def rank_measures(scored: DataFrame, label: str, proba: str, by: Sequence[str] = ()) -> DataFrame:
    """n, n_positive, roc_auc (mid-rank) and average_precision; the latter two null unless both classes are there.

    Running sums over distinct scores: each range of scores is summed on its own and shifted by the totals of the higher ranges,
    so no single task holds all scores.
    """
    return _ranks(Scratch(scored.sparkSession).save(score_counts(scored, label, proba, by)), by)


def _ranks(score_table: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("_n")
    counts = score_table.groupBy(*by, "_p").agg(F.sum(F.when(F.col("_y") == 1, n).otherwise(0)).alias("_pos"), F.sum(n).alias("_all"))
    ranged = counts.withColumn("_range", F.floor(F.col("_p") * 256))  # of probabilities: at most 257
    w = Window.partitionBy(*by, "_range").orderBy(F.desc("_p"))
    inner = ranged.withColumns({"_tp": F.sum("_pos").over(w), "_seen": F.sum("_all").over(w)})
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_pos").alias("_rp"), F.sum("_all").alias("_ra"))
    shift = sums.select(*by, "_range", F.coalesce(F.sum("_rp").over(above), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_ra").over(above), F.lit(0)).alias("_ba"))
    full = inner.join(shift, [*by, "_range"]).withColumns({"_tp": F.col("_tp") + F.col("_bp"), "_seen": F.col("_seen") + F.col("_ba")})
    negative_above = (F.col("_seen") - F.col("_all")) - (F.col("_tp") - F.col("_pos"))  # with a higher score
    negatives = F.col("_all") - F.col("_pos")
    lost = F.sum(F.col("_pos") * (negative_above + negatives / 2.0))
    totals = full.groupBy(*by).agg(
        F.sum("_all").alias("n"), F.sum("_pos").alias("n_positive"), lost.alias("_lost"), F.sum(F.col("_pos") * (F.col("_tp") / F.col("_seen"))).alias("_ap")
    )
    pos, neg = F.col("n_positive"), F.col("n") - F.col("n_positive")
    mixed = (pos > 0) & (neg > 0)
    return totals.withColumns({"roc_auc": F.when(mixed, 1 - F.col("_lost") / (pos * neg)), "average_precision": F.when(mixed, F.col("_ap") / pos)}).drop("_lost", "_ap")


def probability_losses(scored: DataFrame, label: str, proba: str, by: Sequence[str] = ()) -> DataFrame:
    """log_loss (probabilities clipped by machine epsilon) and brier score."""
    return _losses(score_counts(scored, label, proba, by), by)


def _losses(score_table: DataFrame, by: Sequence[str]) -> DataFrame:
    y, n = F.col("_y").cast("double"), F.col("_n")
    p = F.least(F.greatest(F.col("_p"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    mean = lambda value: F.sum(n * value) / F.sum(n)
    return score_table.groupBy(*by).agg(mean(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), mean((F.col("_p") - y) ** 2).alias("brier"))


def calibration_bins(scored: DataFrame, label: str, proba: str, n_bins: int = 10) -> DataFrame:
    """bin, lower, upper, count, mean_proba, positive_rate, abs_error; half-open bins, the last closed, empty ones left out.

    Bins compare with i / n_bins: the estimate floor(p * n) is moved by one where the division says so.
    """
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    p = F.col(proba)
    guess = F.floor(p * n_bins)
    fixed = F.when(p < guess / F.lit(n_bins), guess - 1).when(p >= (guess + 1) / F.lit(n_bins), guess + 1).otherwise(guess)
    at = F.least(F.greatest(fixed, F.lit(0)), F.lit(n_bins - 1)).cast("int")
    bins = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_proba"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
    return bins.select(
        "bin", (F.col("bin") / n_bins).alias("lower"), ((F.col("bin") + 1) / n_bins).alias("upper"), "n", "mean_proba", "positive_rate",
        F.abs(F.col("mean_proba") - F.col("positive_rate")).alias("abs_error"),
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.col("abs_error")) / F.sum("n")).alias("ece"))


def slice_metrics(scored: DataFrame, label: str, proba: str, columns: Sequence[str], threshold: float = 0.5, max_slices: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """Confusion, rates and their 95 % intervals, losses and rank measures per (slice_column, slice).

    Rows whose slice value is null or blank form no slice. Raises if a column has more than ``max_slices`` values.
    """
    if len(set(columns)) != len(columns):
        raise ValueError("slice columns must be unique")
    pairs = F.array(*[F.struct(F.lit(c).alias("slice_column"), F.trim(F.col(c).cast("string")).alias("slice")) for c in columns])
    long = scored.select(F.col(label).alias("_y"), F.col(proba).alias("_p"), F.inline(pairs)).where("slice is not null and slice <> ''")
    counted = (scratch or Scratch(scored.sparkSession)).save(score_counts(long, "_y", "_p", ["slice_column", "slice"]))  # the one pass over the data
    sizes = counted.select("slice_column", "slice").distinct().groupBy("slice_column").agg(F.count("*").alias("n")).where(F.col("n") > max_slices)
    crowded = [r["slice_column"] for r in sizes.collect()]
    if crowded:
        raise ValueError(f"more than {max_slices} slices in {', '.join(sorted(crowded))}")
    by = ["slice_column", "slice"]
    base = counted.groupBy(*by).agg(F.sum("_n").alias("rows"), *_confusion(F.col("_y"), F.col("_p") >= threshold)).withColumns(confusion_metrics())
    n, tp, fp, fn, tn = (F.col(c) for c in ("rows", "tp", "fp", "fn", "tn"))
    for name, hits, trials in (("positive_rate", tp + fn, n), ("accuracy", tp + tn, n), ("precision", tp, tp + fp), ("recall", tp, tp + fn)):
        low, high = wilson(hits, trials)
        base = base.withColumns({f"{name}_low": low, f"{name}_high": high})
    base = base.withColumn("positive_rate", _rate(tp + fn, n))
    return base.join(_losses(counted, by), by).join(_ranks(counted, by).drop("n", "n_positive"), by)


def compare_models(scored: DataFrame, label: str, probas: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """One row per model on the same rows: confusion, losses, rank measures; best f1 first."""
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("_p")) for n, c in probas.items()])
    long = scored.select(F.col(label).alias("_y"), F.inline(models))
    counted = Scratch(scored.sparkSession).save(score_counts(long, "_y", "_p", ["model"]))
    base = counted.groupBy("model").agg(*_confusion(F.col("_y"), F.col("_p") >= threshold)).withColumns(confusion_metrics())
    joined = base.join(_losses(counted, ["model"]), "model").join(_ranks(counted, ["model"]), "model")
    return joined.orderBy(F.desc("f1"), "model")
