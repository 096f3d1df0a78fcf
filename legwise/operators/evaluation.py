"""Model quality as DataFrame queries over (id, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legwise.functions.base import count_where, ratio
from legwise.operators.ordering import equal_frequency_bins, positions, running_totals
from legwise.operators.quantiles import exact_quantiles, median_of

# Probability floor of the log-loss, F1 denominator floor, bin counts.
PROBABILITY_FLOOR = 2.220446049250313e-16
F1_FLOOR = 1e-9
CALIBRATION_BINS = 15
RELIABILITY_BINS = 12


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Alerts and hits at every distinct score, from the highest down.

    Equal scores are counted together before anything is ordered.
    """
    counted = (
        df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score"))
        .agg(F.sum(F.col(label).cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("rows"))
        .withColumn("_down", -F.col("score"))
    )
    return running_totals(
        counted, ["_down"], {"tp": F.col("positives"), "alerts": F.col("rows")}
    ).drop("_down").withColumn("fp", F.col("alerts") - F.col("tp"))


def ranking_quality(curve: DataFrame) -> DataFrame:
    """ROC-AUC with ties at one half, and step-wise average precision."""
    negatives = F.col("rows") - F.col("positives")
    pos, neg = F.sum("positives").cast("double"), F.sum(negatives).cast("double")
    above = F.col("tp") - F.col("positives") / F.lit(2.0)
    return curve.agg(
        ratio(F.sum(negatives * above), pos * neg).alias("roc_auc"),
        ratio(F.sum(F.col("positives") * F.col("tp") / F.col("alerts")), pos).alias("pr_auc"))


def probability_quality(df: DataFrame, label: str, score: str) -> DataFrame:
    """Log-loss, Brier score and base rate."""
    y = F.col(label).cast("double")
    p = F.greatest(F.least(F.col(score), F.lit(1 - PROBABILITY_FLOOR)), F.lit(PROBABILITY_FLOOR))
    return df.agg(
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), F.avg(y).alias("base_rate"))


def quality_at(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Accuracy, precision, recall and F1 at one threshold; 0/0 counts as 0."""
    hit, alert = F.col(label) == 1, F.col(score) >= threshold
    counts = df.agg(
        count_where(hit & alert).alias("tp"), count_where(~hit & alert).alias("fp"),
        count_where(hit & ~alert).alias("fn"), count_where(~hit & ~alert).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def top_fraction_lift(df: DataFrame, label: str, score: str, tie_break: str,
                      fraction: float = 0.1) -> DataFrame:
    """Positive rate among the highest-scored fraction, over the base rate."""
    n = df.agg(F.greatest(F.floor(F.count(F.lit(1)) * F.lit(fraction)), F.lit(1))).scalar()
    ranked = positions(df.withColumn("_down", -F.col(score)), ["_down", tie_break], "_place")
    y = F.col(label).cast("double")
    marked = ranked.withColumn("_top", F.col("_place") <= n)
    return marked.agg(ratio(F.avg(F.when(F.col("_top"), y)), F.avg(y)).alias("lift"))


def best_f1(curve: DataFrame) -> DataFrame:
    """Score threshold with the best F1; the lowest of equals."""
    total = curve.agg(F.sum("positives")).scalar()
    scored = curve.withColumns({
        "_p": ratio(F.col("tp"), F.col("alerts")), "_r": ratio(F.col("tp"), total)
    }).withColumn("_f1", 2 * F.col("_p") * F.col("_r")
                  / F.greatest(F.col("_p") + F.col("_r"), F.lit(F1_FLOOR)))
    return scored.agg(F.max_by("score", F.struct("_f1", -F.col("score"))).alias("threshold"),
                      F.max("_f1").alias("f1"))


def curve_points(curve: DataFrame) -> DataFrame:
    """ROC and precision-recall points at every distinct score."""
    pos = curve.agg(F.sum("positives")).scalar()
    neg = curve.agg(F.sum(F.col("rows") - F.col("positives"))).scalar()
    return curve.select(
        "score", ratio(F.col("fp"), neg).alias("fpr"), ratio(F.col("tp"), pos).alias("tpr"),
        ratio(F.col("tp"), F.col("alerts")).alias("precision"))


def calibration_bins(df: DataFrame, label: str, score: str, tie_break: str,
                     bins: int = CALIBRATION_BINS) -> DataFrame:
    """Observed rate and mean score in equal-frequency bins."""
    binned = equal_frequency_bins(df, score, tie_break, bins)
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("observed"),
        F.avg(score).alias("predicted"))


def calibration_error(df: DataFrame, label: str, score: str, tie_break: str,
                      bins: int = CALIBRATION_BINS) -> DataFrame:
    """Row-weighted distance between observed and predicted rates."""
    table = calibration_bins(df, label, score, tie_break, bins)
    return table.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted")))
                      / F.sum("n")).alias("ece"))


def reliability_curve(df: DataFrame, label: str, score: str,
                      bins: int = RELIABILITY_BINS) -> DataFrame:
    """Observed against predicted rate between score quantiles."""
    inner = {f"q{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(df, [], F.col(score), inner).select(
        F.array(*inner)).scalar()
    slot = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    edged = df.where(F.col(score).isNotNull()).withColumn("_edges", edges)
    return edged.groupBy((slot + 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("observed"),
        F.avg(score).alias("predicted"))


def regression_quality(df: DataFrame, actual: str, predicted: str, min_actual: float = 15.0) -> DataFrame:
    """RMSE, MAE, R2, WAPE, and MAPE over rows with an actual of at least ``min_actual``."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    median_error = median_of(df, F.abs(e))
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - ratio(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"),
        (ratio(F.sum(F.abs(e)), F.sum(F.abs(a))) * 100).alias("wape_pct"),
        (F.avg(F.when(a >= min_actual, F.abs(e) / a)) * 100).alias("mape_pct"),
    ).withColumn("median_ae", median_error)


def baseline_deltas(df: DataFrame, actual: str, predicted: str, constant: Column) -> DataFrame:
    """RMSE and MAE next to those of a constant: the median of the training rows."""
    told = df.withColumn("_median", constant)
    e, b = F.col(actual) - F.col(predicted), F.col(actual) - F.col("_median")
    out = told.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(b * b)).alias("rmse_median"),
        F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(b)).alias("mae_median"))
    return out.withColumns({
        "rmse_change_pct": (ratio(F.col("rmse"), F.col("rmse_median")) - 1) * 100,
        "mae_change_pct": (ratio(F.col("mae"), F.col("mae_median")) - 1) * 100})


def split_summary(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
