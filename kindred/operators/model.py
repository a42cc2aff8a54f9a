"""The duplicate classifier: TF-IDF pair features, boosted trees, optional calibration, one decision threshold."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.features import lexical_features, named_values
from kindred.functions.text import clean_text
from kindred.operators.calibration import Isotonic, Sigmoid, from_json, to_json
from kindred.operators.metrics import GRID, select_threshold, threshold_sweep
from kindred.operators.tfidf import MAX_FEATURES, Vocabulary, fit_vocabulary, idf_table, pair_cosine
from kindred.sources.manifests import file_manifest, folder_digest

FEATURES = ["cos", "jaccard", "len_ratio", "abs_len_diff", "len_sum"]
MAX_PAIRS, MAX_CHARACTERS = 256, 8192  # limits of one request
PATIENCE = 20  # trees without gain that end boosting


def corpus(pairs: DataFrame, left: str = "question1", right: str = "question2") -> DataFrame:
    """All texts of both sides, repetitions kept; null counts as the text "nan", as in a string cast of a missing value."""
    side = lambda c: pairs.select(F.coalesce(F.col(c), F.lit("nan")).alias("text"))
    return side(left).unionByName(side(right))


def pair_features(pairs: DataFrame, vocabulary: Vocabulary, key: str, left: str = "question1", right: str = "question2", keep: Sequence[str] = ()) -> DataFrame:
    """(key, the columns to keep, cos, jaccard, len_ratio, abs_len_diff, len_sum): each text is cleaned once, rows stay where they are."""
    side = lambda c: clean_text(F.coalesce(F.col(c), F.lit("nan")))
    texts = pairs.select(key, *keep, side(left).alias("_a"), side(right).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    lexical = [v.cast("double").alias(n) for n, v in lexical_features(a, b).items()]
    return texts.select(key, *keep, pair_cosine(vocabulary, a, b).alias("cos"), *lexical)


@dataclass
class DuplicateModel:
    vocabulary: DataFrame
    trees: GBTClassificationModel
    calibrator: Sigmoid | Isotonic | None = None
    threshold: float | None = None
    meta: dict = field(default_factory=dict)

    @cached_property
    def idf(self) -> dict[str, float]:
        """The vocabulary on the driver, read once."""
        return idf_table(self.vocabulary)

    def score(self, pairs: DataFrame, key: str, left: str = "question1", right: str = "question2", keep: Sequence[str] = ()) -> DataFrame:
        """(key, kept columns, features, raw_proba, calibrated_proba, proba): calibrated is null without a calibrator, proba is the one to decide by."""
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(pair_features(pairs, self.idf, key, left, right, keep))
        scored = self.trees.transform(vectors).withColumn("raw_proba", vector_to_array("probability")[1])
        calibrated = self.calibrator.apply(F.col("raw_proba")) if self.calibrator else F.lit(None).cast("double")
        scored = scored.withColumn("calibrated_proba", calibrated)
        return scored.select(key, *keep, *FEATURES, "raw_proba", "calibrated_proba", F.coalesce("calibrated_proba", "raw_proba").alias("proba"))


def best_round(losses: list[float], patience: int = PATIENCE) -> int:
    """The round (from 1) of least loss until ``patience`` rounds in a row bring no smaller one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(trees: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` trees."""
    if n >= trees.getNumTrees:
        return trees
    sc, java = SparkSession.active().sparkContext, trees._java_obj
    kept, weights = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), sc._gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        kept[i], weights[i] = java.trees()[i], trees.treeWeights[i]
    cut = GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, weights, trees.numFeatures, trees.numClasses))
    return cut.setFeaturesCol(trees.getFeaturesCol())


def train(
    pairs: DataFrame, key: str = "row_id", label: str = "is_duplicate", left: str = "question1", right: str = "question2", evaluation: DataFrame | None = None,
    max_features: int = MAX_FEATURES, trees: int = 200, depth: int = 6, step: float = 0.1, seed: int = 42, optimize_for: str = "f1",
) -> DuplicateModel:
    """Fits vocabulary and trees on ``pairs`` only; rows whose label isn't 0 or 1 are left out.

    With ``evaluation`` rows the number of trees is the one with the least loss on them before ``PATIENCE`` trees without gain, and a
    threshold is chosen on them. MLlib has no such stop, so all ``trees`` are fitted and the ones behind it cut off: no tree depends on later ones.
    """
    missing = [c for c in (key, label, left, right) if c not in pairs.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    labelled = pairs.where(F.col(label).isin(0, 1))
    vocabulary = fit_vocabulary(corpus(labelled, left, right), "text", max_features).select("term", "idf")
    vocabulary = pairs.sparkSession.createDataFrame(list(idf_table(vocabulary).items()), "term string, idf double")
    idf = idf_table(vocabulary)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    to_vectors = lambda df: assemble.transform(pair_features(df.withColumn("_label", F.col(label).cast("double")), idf, key, left, right, ["_label"]))
    fitting = to_vectors(labelled).persist()
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
    model = DuplicateModel(vocabulary, gbt.fit(fitting))
    fitting.unpersist()
    if evaluation is not None:
        held = to_vectors(evaluation.where(F.col(label).isin(0, 1))).persist()
        model.trees = first_trees(model.trees, best_round(model.trees.evaluateEachIteration(held)))
        held.unpersist()
        scored = model.score(evaluation.where(F.col(label).isin(0, 1)), key, left, right, [label])
        chosen = select_threshold(threshold_sweep(scored, label, "proba", GRID), optimize_for).first()
        model.threshold = chosen["threshold"] if chosen else None
    model.meta = {"features": FEATURES, "trees": model.trees.getNumTrees, "optimize_for": optimize_for, "created_at": datetime.now(timezone.utc).isoformat()}
    return model


def resolve_threshold(request: float | None, model: DuplicateModel, environment: float | None = None) -> tuple[float, str]:
    """The decision threshold and where it comes from: request, artifact, environment, default 0.5."""
    for value, source in ((request, "request"), (model.threshold, "artifact"), (environment, "environment"), (0.5, "default")):
        if value is not None:
            if not 0 <= value <= 1:
                raise ValueError(f"threshold of {source} must lie in [0, 1]")
            return float(value), source
    raise AssertionError


def score_pairs(pairs: DataFrame, model: DuplicateModel, key: str = "row_id", threshold: float | None = None, explain: bool = False) -> DataFrame:
    """Decisions for a batch: probabilities, is_duplicate, the threshold and its source, on request the features as a map."""
    value, source = resolve_threshold(threshold, model)
    scored = model.score(pairs, key)
    kept = [key, "raw_proba", "calibrated_proba", "proba"]
    if explain:
        scored = scored.withColumn("features", named_values(FEATURES))
        kept.append("features")
    origin = F.when(F.col("calibrated_proba").isNotNull(), "calibrated").otherwise("raw")
    decided = scored.withColumns({"is_duplicate": F.col("proba") >= value, "decision_threshold": F.lit(value), "decision_threshold_source": F.lit(source), "probability_source": origin})
    return decided.select(*kept, "is_duplicate", "decision_threshold", "decision_threshold_source", "probability_source")


def request_problems(left: Column, right: Column) -> Column:
    """What is wrong with a pair as a request: missing_text, too_long, or null."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(left) | blank(right), "missing_text").when(F.greatest(F.length(left), F.length(right)) > MAX_CHARACTERS, "too_long")


def predict_arrays(model: DuplicateModel, left: Sequence[str], right: Sequence[str], threshold: float | None = None, explain: bool = False) -> list[dict]:
    """Decisions for one request of two lists of texts, in their order; at most MAX_PAIRS pairs, each text present and not too long."""
    if len(left) != len(right):
        raise ValueError(f"{len(left)} first texts and {len(right)} second ones")
    if not 1 <= len(left) <= MAX_PAIRS:
        raise ValueError(f"a request holds 1 to {MAX_PAIRS} pairs")
    if any(not (t or "").strip() or len(t) > MAX_CHARACTERS for t in (*left, *right)):
        raise ValueError(f"every text needs 1 to {MAX_CHARACTERS} characters")
    pairs = model.vocabulary.sparkSession.createDataFrame(list(zip(range(len(left)), left, right)), "row_id long, question1 string, question2 string")
    return [r.asDict(recursive=True) for r in score_pairs(pairs, model, threshold=threshold, explain=explain).orderBy("row_id").collect()]


def save(model: DuplicateModel, path: str) -> None:
    """Trees in MLlib's format, vocabulary as Parquet, everything else as one JSON row with the digest of the vocabulary; no pickle."""
    spark = model.vocabulary.sparkSession
    model.trees.write().overwrite().save(f"{path}/trees")
    model.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    card = {"meta": model.meta, "threshold": model.threshold, "calibrator": json.loads(to_json(model.calibrator)) if model.calibrator else None, "vocabulary_sha256": vocabulary_digest(model.vocabulary)}
    spark.createDataFrame([(json.dumps(card, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def vocabulary_digest(vocabulary: DataFrame) -> str:
    rows = vocabulary.select("term", "idf").orderBy("term").collect()  # at most max_features
    return hashlib.sha256(json.dumps([[r["term"], r["idf"]] for r in rows]).encode()).hexdigest()


def artifact_digest(spark: SparkSession, path: str) -> str:
    """One digest over all data files of a saved model: trees, vocabulary and card."""
    return folder_digest(file_manifest(spark, path, "part-*"))


def load(spark: SparkSession, path: str, expected: str | None = None) -> DuplicateModel:
    """Reads what ``save`` wrote; raises if the vocabulary doesn't have the recorded digest, or the whole artefact not the ``expected`` one."""
    if expected and artifact_digest(spark, path) != expected:
        raise ValueError("the artefact doesn't have the expected digest")
    card = json.loads(spark.read.text(f"{path}/card").first()[0])
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    if vocabulary_digest(vocabulary) != card["vocabulary_sha256"]:
        raise ValueError("the vocabulary was changed after it was saved")
    calibrator = from_json(json.dumps(card["calibrator"])) if card["calibrator"] else None
    return DuplicateModel(vocabulary, GBTClassificationModel.load(f"{path}/trees"), calibrator, card["threshold"], card["meta"])
