"""Probability calibration: sigmoid and isotonic, fitted with MLlib and applied as column expressions."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import Scratch


def _levels(scored: DataFrame, label: str, proba: str) -> DataFrame:
    """(label, p, w): distinct usable rows and how often each occurs, written once for all passes of a fit."""
    good = scored.where(F.col(label).isin(0, 1) & F.col(proba).isNotNull() & ~F.isnan(proba) & (F.abs(proba) < float("inf")))
    rows = good.select(F.col(label).cast("double").alias("label"), F.col(proba).cast("double").alias("p"))
    return Scratch(scored.sparkSession).save(rows.groupBy("label", "p").agg(F.count("*").cast("double").alias("w")))


@dataclass(frozen=True)
class Sigmoid:
    """1 / (1 + exp(-(slope * p + intercept))), the exponent clipped to +-709."""

    slope: float
    intercept: float

    def apply(self, p: Column) -> Column:
        logit = F.greatest(F.least(p * self.slope + self.intercept, F.lit(709.0)), F.lit(-709.0))
        e = F.exp(-F.abs(logit))
        return F.when(logit >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


@dataclass(frozen=True)
class Isotonic:
    """Linear between the knots (xs ascending, ys not descending), constant outside."""

    xs: tuple[float, ...]
    ys: tuple[float, ...]

    def apply(self, p: Column) -> Column:
        """The knots around p are searched once; the rest are look-ups by place."""
        if len(self.xs) == 1:
            return F.lit(self.ys[0])
        xs, ys = F.lit(list(self.xs)), F.lit(list(self.ys))
        below = F.greatest(F.lit(0), F.least(F.lit(len(self.xs) - 2), F.size(F.filter(xs, lambda x: x <= p)) - 1))
        line = lambda i: F.get(ys, i) + (F.get(ys, i + 1) - F.get(ys, i)) * (p - F.get(xs, i)) / (F.get(xs, i + 1) - F.get(xs, i))
        inside = F.get(F.transform(F.array(below), line), F.lit(0))
        return F.when(p <= self.xs[0], self.ys[0]).when(p >= self.xs[-1], self.ys[-1]).otherwise(inside)


def fit_sigmoid(scored: DataFrame, label: str, proba: str) -> Sigmoid:
    """Logistic regression on the probability, with the penalty |slope|^2 / (2 n); equal probabilities are weighted, not repeated."""
    rows = _levels(scored, label, proba).withColumn("features", array_to_vector(F.array("p")))
    total = rows.agg(F.sum("w"), F.count_distinct("label")).first()
    if total[1] != 2:
        raise ValueError("calibration needs both classes")
    model = LogisticRegression(regParam=1.0 / total[0], elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=200, weightCol="w").fit(rows)
    return Sigmoid(float(model.coefficients[0]), float(model.intercept))


def fit_isotonic(scored: DataFrame, label: str, proba: str) -> Isotonic:
    """Monotone fit; the model is as small as the number of distinct levels."""
    rows = _levels(scored, label, proba)
    if rows.select("label").distinct().count() != 2:
        raise ValueError("calibration needs both classes")
    model = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="w").fit(rows)
    knots: dict[float, float] = {}
    for x, y in zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True):
        knots[x] = y
    return Isotonic(tuple(knots), tuple(knots.values()))


def to_json(calibrator: Sigmoid | Isotonic) -> str:
    return json.dumps({"method": type(calibrator).__name__.lower()} | asdict(calibrator), sort_keys=True)


def from_json(text: str) -> Sigmoid | Isotonic:
    """Reads what ``to_json`` wrote; refuses unknown methods, non-finite numbers and knots that aren't monotone in [0, 1]."""
    data = json.loads(text)
    method = data.get("method")
    if method == "sigmoid":
        made = Sigmoid(float(data["slope"]), float(data["intercept"]))
        if not all(map(math.isfinite, (made.slope, made.intercept))):
            raise ValueError("sigmoid parameters must be finite")
        return made
    if method == "isotonic":
        xs, ys = tuple(map(float, data["xs"])), tuple(map(float, data["ys"]))
        rising = all(a < b for a, b in zip(xs, xs[1:])) and all(a <= b for a, b in zip(ys, ys[1:]))
        if not xs or len(xs) != len(ys) or not rising or not all(0 <= v <= 1 for v in xs + ys):
            raise ValueError("isotonic knots must be monotone and within [0, 1]")
        return Isotonic(xs, ys)
    raise ValueError(f"unknown calibration method {method!r}")
