"""Delay models on Spark ML: preprocessing, candidates, search, calibration."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legwise.operators import evaluation as E
from legwise.operators.forest import BinnedForestClassifier
from legwise.operators.projections import apply_codes, fit_codes
from legwise.operators.trees import BinnedGBTClassifier, BinnedGBTRegressor, first_rounds
from legwise.session import settle, shared_dir, spread

# Seed, pooling limit, candidate settings, search grid, calibration gain.
SEED = 42
MIN_LEVEL_ROWS = 30
MISSING_LEVEL = "missing"
POOLED_LEVEL = "infrequent"
LOGISTIC_C = 0.5
FOREST = {"numTrees": 150, "maxDepth": 14, "minInstancesPerNode": 50}
PATIENCE, SEARCH_PATIENCE = 50, 40
BOOSTED = {
    "boosted_deep": {"maxIter": 600, "stepSize": 0.05, "maxDepth": 7, "subsamplingRate": 0.85},
    "boosted_leafy": {"maxIter": 800, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.85},
    "boosted_ordered": {"maxIter": 700, "stepSize": 0.06, "maxDepth": 7, "subsamplingRate": 1.0},
}
SEARCH_GRID = {
    "maxDepth": (4, 5, 6, 7),
    "stepSize": (0.02, 0.05, 0.08, 0.12),
    "minInstancesPerNode": (20, 60, 150, 300),
    "subsamplingRate": (0.7, 0.85, 1.0),
}
ISOTONIC_GAIN = 0.9
# How the trees of one level are grown: in one pass, without walking every row down from each root again.
ROOMY = {"maxMemoryInMB": 2048, "cacheNodeIds": True}
PARALLEL_FITS = 4
# Rows up to which a forest and a preset that leaves out rows are Spark ML's own: it grows such a table in one task as fast.
ONE_TASK_ROWS = 50_000


@dataclass
class Fitted:
    """A fitted candidate: ``predict`` adds the probability column ``p``."""

    name: str
    predict: Callable[[DataFrame], DataFrame]
    model: object
    columns: list[str]
    seconds: float
    rounds: int | None = None
    losses: tuple[float, ...] = ()


def in_parallel(tasks: list[Callable], most: int = PARALLEL_FITS) -> list:
    """Results of the tasks in their order; each fit is many short jobs, so several are under way at a time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    with ThreadPool(min(most, len(tasks))) as pool:
        return [r.get() for r in [pool.apply_async(inheritable_thread_target(task)) for task in tasks]]


def patient_round(losses: Iterable[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) with the least loss before ``patience`` rounds brought no lower one, and whether they did not."""
    best, at, number = float("inf"), 0, 0
    for number, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, number
        elif number - at >= patience:
            return at, True
    return at, False


def fit_patiently(learner, train: DataFrame, valid: DataFrame, patience: int = PATIENCE):
    """Boosting whose rounds end at the least validation loss: (model, loss per round tried).

    The ensemble grows in blocks that double until ``patience`` rounds after the best one brought nothing.
    A fit is the same, round by round, whatever its length; so the kept model is the fit without
    its later rounds. A binned learner that shares its fits goes on from the rounds it has.
    """
    most, rounds = learner.getMaxIter(), patience + 14
    loss = (learner.getLossType(),) if isinstance(learner, GBTRegressor) else ()
    while True:
        rounds = min(rounds, most)
        model = learner.copy({learner.maxIter: rounds}).fit(train)
        losses = model.evaluateEachIteration(valid, *loss)
        best, ended = patient_round(losses, patience)
        if ended or rounds == most:
            break
        rounds *= 2
    if best < rounds:
        model = first_rounds(learner, model, best)
    return model, losses


def with_missing_level(df: DataFrame, categorical: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)) for c in categorical})


def level_counts(train: DataFrame, categorical: list[str]) -> dict[str, list[tuple[str, int]]]:
    """Levels of each category with their training rows, most frequent first, in one pass.

    Like the level index of the encoder, the result is as large as the sets of levels.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in categorical])
    counted = train.select(F.inline(pairs)).where("level IS NOT NULL").groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n")).collect()
    found: dict[str, list[tuple[str, int]]] = {c: [] for c in categorical}
    for row in sorted(counted, key=lambda r: (-r["n"], r["level"])):
        found[row["column"]].append((row["level"], row["n"]))
    return found


def pooled_level(column: str, levels: list[tuple[str, int]], least: int = MIN_LEVEL_ROWS) -> Column:
    """The level with NULL as the mode and rare training levels pooled; unseen ones stay as they are."""
    if not levels:
        return F.col(column).cast("string")
    filled = F.coalesce(F.col(column).cast("string"), F.lit(levels[0][0]))
    rare = [level for level, n in levels if n < least]
    return F.when(filled.isin(rare), F.lit(POOLED_LEVEL)).otherwise(filled) if rare else filled


def linear_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]
                        ) -> tuple[Pipeline, Callable[[DataFrame], DataFrame]]:
    """Median imputation and scaling for numbers, pooled one-hot levels for categories.

    Returns the unfitted stages and the row preparation that must precede them.
    Unseen categories encode as all zeros.
    """
    levels = level_counts(train, categorical) if categorical else {}

    def prepare(df: DataFrame) -> DataFrame:
        return df.withColumns({c: pooled_level(c, levels[c]) for c in categorical}
                              | {c: F.col(c).cast("double") for c in numeric})

    stages: list = [Imputer(strategy="median", relativeError=1e-4, inputCols=numeric,
                            outputCols=[f"{c}_filled" for c in numeric]),
                    VectorAssembler(inputCols=[f"{c}_filled" for c in numeric], outputCol="_numbers"),
                    StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
    parts = ["_scaled"]
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical])]
        parts += [f"{c}_hot" for c in categorical]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages), prepare


def _probability(df: DataFrame) -> DataFrame:
    return df.withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fit_logistic(train: DataFrame, numeric: list[str], categorical: list[str], label: str) -> Fitted:
    """Ridge logistic regression; the penalty per row matches inverse strength C."""
    started = time.time()
    stages, prepare = linear_preprocessor(train, numeric, categorical)
    # every stage of the fit reads the prepared rows, so they are written once
    rows = settle(prepare(train).select(*numeric, *categorical, label))
    n = rows.count()
    learner = LogisticRegression(labelCol=label, featuresCol="features", maxIter=200, tol=1e-5,
                                 regParam=1.0 / (LOGISTIC_C * max(n, 1)), elasticNetParam=0.0, standardization=False)
    model = Pipeline(stages=[stages, learner]).fit(rows)
    keep = lambda df: [*df.columns, "p"]
    return Fitted("logistic_regression", lambda df: _probability(model.transform(prepare(df))).select(*keep(df)),
                  model, [*numeric, *categorical], time.time() - started)


def tree_vector(train: DataFrame, numeric: list[str], categorical: list[str]
                ) -> Callable[[DataFrame], DataFrame]:
    """Vector of numbers and category codes of the training levels; missing is -1."""
    codes = fit_codes(with_missing_level(train, categorical), categorical) if categorical else None
    columns = [*numeric, *[f"{c}_code" for c in categorical]]
    assemble = VectorAssembler(inputCols=columns, outputCol="features")

    def prepare(df: DataFrame) -> DataFrame:
        coded = apply_codes(with_missing_level(df, categorical), codes) if codes else df
        plain = coded.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns})
        return assemble.transform(plain)

    return prepare


def _fit_trees(name: str, learner: Callable, train: DataFrame, valid: DataFrame | None, numeric: list[str],
               categorical: list[str], label: str, patience: int = PATIENCE) -> Fitted:
    """``learner`` tells, by the number of rows, which one fits them."""
    started = time.time()
    shared_dir(train.sparkSession)  # node ids are cut there
    prepare = tree_vector(train, numeric, categorical)
    rows = settle(spread(prepare(train).select("features", label)))
    learner = learner(rows.count())
    if isinstance(learner, BinnedGBTClassifier):
        learner.sharing()
    losses = ()
    if valid is None:
        model = learner.fit(rows)
    else:
        model, losses = fit_patiently(learner, rows, settle(spread(prepare(valid).select("features", label))), patience)
    if isinstance(learner, BinnedGBTClassifier):
        learner.release()
    chance = getattr(model, "chance", None)

    def predict(df: DataFrame) -> DataFrame:
        ready = prepare(df)
        scored = ready.withColumn("p", chance(vector_to_array("features"))) if chance else _probability(model.transform(ready))
        return scored.drop("features")

    return Fitted(name, predict, model, [*numeric, *categorical], time.time() - started,
                  len(model.treeWeights) if losses else None, tuple(losses))


def fit_forest(train: DataFrame, numeric: list[str], categorical: list[str], label: str, **settings) -> Fitted:
    def learner(n: int):
        kind = RandomForestClassifier if n <= ONE_TASK_ROWS else BinnedForestClassifier
        return kind(labelCol=label, featuresCol="features", seed=SEED, **(FOREST | ROOMY | settings))

    return _fit_trees("random_forest", learner, train, None, numeric, categorical, label)


def fit_boosted(train: DataFrame, valid: DataFrame | None, numeric: list[str], categorical: list[str],
                label: str, preset: str = "boosted_deep", patience: int = PATIENCE, **settings) -> Fitted:
    """Boosted trees; with a validation window as many rounds as its loss is best with, found with patience."""
    options = BOOSTED[preset] | settings

    def learner(n: int):
        kind = GBTClassifier if options["subsamplingRate"] < 1 and n <= ONE_TASK_ROWS else BinnedGBTClassifier
        return kind(labelCol=label, featuresCol="features", seed=SEED, **options)

    return _fit_trees(preset, learner, train, valid, numeric, categorical, label, patience)


def quality_row(scored: DataFrame, label: str, key: str, name: str) -> DataFrame:
    """Validation metrics of one candidate as one row."""
    ranking = E.ranking_quality(E.score_curve(scored, label, "p"))
    chances, cut = E.probability_quality(scored, label, "p"), E.quality_at(scored, label, "p", 0.5)
    lift = E.top_fraction_lift(scored, label, "p", key)
    return ranking.select(
        F.lit(name).alias("model"), "roc_auc", "pr_auc",
        *[chances.select(c).scalar().alias(c) for c in ("log_loss", "brier", "base_rate")],
        *[cut.select(c).scalar().alias(c) for c in ("accuracy", "precision", "recall", "f1")],
        lift.scalar().alias("lift_top_decile"))


def compare(candidates: list[Fitted], valid: DataFrame, label: str, key: str) -> DataFrame:
    """Candidates by validation average precision, best first."""
    def judged(c: Fitted) -> DataFrame:
        return settle(quality_row(settle(c.predict(valid)), label, key, c.name).withColumns({
            "fit_seconds": F.lit(round(c.seconds, 1)), "rounds": F.lit(c.rounds).cast("int")}))

    # like a fit, a judgement is many short jobs
    table = reduce(DataFrame.unionByName, in_parallel([partial(judged, c) for c in candidates]))
    return table.orderBy(F.desc("pr_auc"), "model")


def random_settings(n: int, seed: int = SEED) -> list[dict]:
    """n distinct draws from the search grid."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        draw = {k: rng.choice(v) for k, v in SEARCH_GRID.items()}
        if draw not in out:
            out.append(draw)
    return out


def random_search(df: DataFrame, folds: list[tuple[str, str]], day: str, numeric: list[str],
                  categorical: list[str], label: str, n: int = 8) -> DataFrame:
    """Mean fold average precision of random settings on expanding time folds."""
    def judge(settings: dict, train_until: str, valid_until: str) -> float:
        train = df.where(F.col(day) <= F.lit(train_until).cast("date"))
        valid = df.where((F.col(day) > F.lit(train_until).cast("date"))
                         & (F.col(day) <= F.lit(valid_until).cast("date")))
        fitted = fit_boosted(train, valid, numeric, categorical, label, patience=SEARCH_PATIENCE, **settings)
        return E.ranking_quality(E.score_curve(fitted.predict(valid), label, "p")).first()["pr_auc"]

    draws = random_settings(n)
    found = in_parallel([partial(judge, settings, *fold) for settings in draws for fold in folds])
    rows = [(*[float(settings[k]) for k in SEARCH_GRID], sum(part) / len(folds))
            for settings, part in zip(draws, zip(*[iter(found)] * len(folds)))]
    schema = ", ".join(f"{k} DOUBLE" for k in SEARCH_GRID) + ", pr_auc DOUBLE"
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("pr_auc"))


def fit_isotonic(df: DataFrame, score: str, label: str):
    """Monotone calibration of a score; equal scores are counted together first."""
    rows = df.groupBy(F.col(score).cast("double").alias("feature")).agg(
        F.avg(F.col(label).cast("double")).alias("target"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="feature", labelCol="target", weightCol="weight").fit(rows)


def apply_isotonic(model, df: DataFrame, score: str, out: str) -> DataFrame:
    named = df.withColumn("feature", F.col(score).cast("double"))
    return model.transform(named).withColumnRenamed("prediction", out).drop("feature")


def calibration_choice(valid: DataFrame, score: str, label: str, key: str, half: str) -> DataFrame:
    """Calibration error of the raw and the isotonic score on the second half, and the choice."""
    model = fit_isotonic(valid.where(F.col(half) == 1), score, label)
    judged = apply_isotonic(model, valid.where(F.col(half) == 2), score, "_calibrated")
    raw = E.calibration_error(judged, label, score, key).scalar()
    iso = E.calibration_error(judged, label, "_calibrated", key).scalar()
    return valid.sparkSession.range(1).select(
        raw.alias("ece_raw"), iso.alias("ece_isotonic"),
        (iso < raw * ISOTONIC_GAIN).alias("use_isotonic"))


def fit_minutes(train: DataFrame, valid: DataFrame | None, numeric: list[str], categorical: list[str], target: str,
                loss: str = "squared", rounds: int = 600, depth: int = 5) -> Fitted:
    """Boosted regression of delay minutes under squared or absolute loss, on all training rows.

    With a validation window the rounds end, with patience, where its loss is least.
    """
    started = time.time()
    prepare = tree_vector(train, numeric, categorical)
    learner = BinnedGBTRegressor(labelCol=target, featuresCol="features", seed=SEED, lossType=loss, stepSize=0.1,
                                 maxIter=rounds, maxDepth=depth).sharing()
    rows, losses = settle(spread(prepare(train).select("features", target))), ()
    if valid is None:
        model = learner.fit(rows)
    else:
        model, losses = fit_patiently(learner, rows, settle(spread(prepare(valid).select("features", target))))
    learner.release()
    return Fitted(f"minutes_{loss}", lambda df: model.transform(prepare(df)).drop("features"),
                  model, [*numeric, *categorical], time.time() - started, len(model.treeWeights), tuple(losses))


def linear_weights(model: PipelineModel, numeric: list[str]) -> dict[str, tuple[float, float]]:
    """Coefficient per raw unit and mean of each numeric feature of a fitted linear model."""
    inner = model.stages[0]
    scaler, coefficients = inner.stages[2], model.stages[-1].coefficients.toArray()
    return {c: (float(w / s) if s else 0.0, float(m)) for c, w, s, m in zip(
        numeric, coefficients, scaler.std.toArray(), scaler.mean.toArray())}
