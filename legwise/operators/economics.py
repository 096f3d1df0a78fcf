"""Costs, alert thresholds, risk deciles and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.functions.base import count_where, mean_where, positive_part, ratio
from legwise.operators.ordering import equal_frequency_bins
from legwise.operators.quantiles import median_of

# Cost model, threshold ladder, sensitivity grid, heuristic hour.
AIRLINE_COST_PER_MIN = 101.0
PASSENGER_COST_PER_MIN = 47.0
COST_PER_MIN = AIRLINE_COST_PER_MIN + PASSENGER_COST_PER_MIN
ALERT_COST = 900.0
EFFECTIVENESS = 0.30
THRESHOLD_START, THRESHOLD_STEP, THRESHOLD_COUNT = 0.02, 0.01, 94
SENSITIVITY_COSTS = (300.0, 600.0, 900.0, 1500.0, 2500.0)
SENSITIVITY_EFFECTS = (0.15, 0.30, 0.50)
AFTERNOON_HOUR = 15.0
DAYS_PER_YEAR = 365


def cost_parameters(df: DataFrame, late: str, delay: str) -> DataFrame:
    """Cost model with the delay length taken from the data."""
    return df.agg(mean_where(F.col(late) == 1, F.col(delay)).alias("avg_delay_min")).select(
        "avg_delay_min",
        F.lit(COST_PER_MIN).alias("cost_per_min"),
        (F.col("avg_delay_min") * COST_PER_MIN).alias("cost_of_one_delay"),
        F.lit(ALERT_COST).alias("alert_cost"),
        F.lit(EFFECTIVENESS).alias("effectiveness"),
        (F.col("avg_delay_min") * EFFECTIVENESS * COST_PER_MIN).alias("benefit"),
    ).withColumn("break_even_p", ratio(F.col("alert_cost"), F.col("benefit")))


def _threshold(i: Column) -> Column:
    return F.lit(THRESHOLD_START) + F.lit(THRESHOLD_STEP) * i


def thresholds_reached(score: Column) -> Column:
    """How many thresholds of the ladder the score reaches, without comparing them all."""
    guess = F.floor((score - THRESHOLD_START) / THRESHOLD_STEP)
    last = (
        F.when(_threshold(guess + 1) <= score, guess + 1)
        .when(_threshold(guess) <= score, guess)
        .otherwise(guess - 1)
    )
    return F.greatest(F.lit(0), F.least(last + 1, F.lit(THRESHOLD_COUNT))).cast("int")


def threshold_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Alerts, hits and misses at each of the thresholds.

    One pass counts scores per bucket; the running sums then cover 95 rows.
    """
    buckets = df.where(F.col(score).isNotNull()).groupBy(
        thresholds_reached(F.col(score)).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    ladder = df.sparkSession.range(0, THRESHOLD_COUNT + 1).select(F.col("id").cast("int").alias("bucket"))
    full = ladder.join(buckets, "bucket", "left").na.fill(0, ["rows", "positives"])
    from_here = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    everywhere = Window.partitionBy()
    counted = full.select(
        "bucket",
        F.sum("rows").over(from_here).alias("alerts"), F.sum("positives").over(from_here).alias("tp"),
        F.sum("rows").over(everywhere).alias("n"), F.sum("positives").over(everywhere).alias("p"))
    return counted.where(F.col("bucket") > 0).select(
        F.round(_threshold(F.col("bucket") - 1), 3).alias("threshold"),
        "alerts", "tp", (F.col("alerts") - F.col("tp")).alias("fp"),
        (F.col("p") - F.col("tp")).alias("fn"), "n")


def priced(counts: DataFrame, benefit: Column, alert_cost: Column) -> DataFrame:
    """Rates, savings and costs at each threshold."""
    return counts.select(
        "threshold", "alerts", "tp", "fp", "fn",
        ratio(F.col("alerts"), F.col("n")).alias("alert_rate"),
        ratio(F.col("tp"), F.greatest("alerts", F.lit(1))).alias("precision"),
        ratio(F.col("tp"), F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"),
        (F.col("tp") * benefit).alias("gross_saving"),
        (F.col("alerts") * alert_cost).alias("alert_spend"),
        (F.col("tp") * benefit - F.col("alerts") * alert_cost).alias("net_benefit"))


def threshold_sweep(df: DataFrame, label: str, score: str, delay: str) -> DataFrame:
    """The priced ladder under the cost model of the data."""
    benefit = cost_parameters(df, label, delay).select("benefit").scalar()
    return priced(threshold_counts(df, label, score), benefit, F.lit(ALERT_COST))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the largest net benefit; the lowest threshold of equals."""
    best = F.max_by(F.struct(*sweep.columns), F.struct("net_benefit", -F.col("threshold")))
    return sweep.agg(best.alias("best")).select("best.*")


def recosted(counts: DataFrame, avg_delay: Column, alert_cost: float, effectiveness: float) -> DataFrame:
    """The ladder under a user's own cost and effectiveness."""
    benefit = avg_delay * F.lit(effectiveness) * F.lit(COST_PER_MIN)
    return counts.select("threshold", (
        F.col("tp") * benefit - F.col("alerts") * F.lit(alert_cost)).alias("net"))


def sensitivity(df: DataFrame, label: str, score: str, delay: str) -> DataFrame:
    """Best threshold under every combination of alert cost and effectiveness."""
    avg_delay = cost_parameters(df, label, delay).select("avg_delay_min").scalar()
    grid = F.array(*[
        F.struct(F.lit(c).alias("alert_cost"), F.lit(e).alias("effectiveness"))
        for c in SENSITIVITY_COSTS for e in SENSITIVITY_EFFECTS])
    rows = threshold_counts(df, label, score).select("*", F.inline(grid))
    benefit = avg_delay * F.col("effectiveness") * COST_PER_MIN
    rows = rows.withColumns({
        "net_benefit": F.col("tp") * benefit - F.col("alerts") * F.col("alert_cost"),
        "break_even_p": ratio(F.col("alert_cost"), benefit),
        "alert_rate": ratio(F.col("alerts"), F.col("n")),
        "precision": ratio(F.col("tp"), F.greatest("alerts", F.lit(1))),
        "recall": ratio(F.col("tp"), F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))})
    best = F.max_by(
        F.struct("break_even_p", F.col("threshold").alias("optimal_threshold"), "alert_rate",
                 "precision", "recall", "net_benefit"),
        F.struct("net_benefit", -F.col("threshold")))
    return rows.groupBy("alert_cost", "effectiveness").agg(best.alias("best")).select(
        "alert_cost", "effectiveness", "best.*")


def risk_deciles(df: DataFrame, label: str, score: str, delay: str, tie_break: str) -> DataFrame:
    """Ten risk groups, D10 the riskiest, with lift and share of late minutes."""
    late_min = positive_part(F.col(delay))
    groups = equal_frequency_bins(df, score, tie_break, 10).groupBy("bin").agg(
        F.count(F.lit(1)).alias("flights"), F.sum(F.col(label).cast("bigint")).alias("_late"),
        F.avg(late_min).alias("mean_delay_min"), F.sum(late_min).alias("delay_minutes"))
    everywhere = Window.partitionBy()
    base = F.sum("_late").over(everywhere) / F.sum("flights").over(everywhere)
    shared = groups.select(
        "bin", F.concat(F.lit("D"), "bin").alias("decile"), "flights",
        (F.col("_late") / F.col("flights")).alias("delay_rate"), "mean_delay_min", "delay_minutes",
        ratio(F.col("_late") / F.col("flights"), base).alias("lift"),
        ratio(F.col("delay_minutes"), F.sum("delay_minutes").over(everywhere))
        .alias("share_of_delay_minutes"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return shared.withColumn(
        "cumulative_share", F.sum("share_of_delay_minutes").over(down)).drop("bin")


def policy_baselines(df: DataFrame, label: str, delay: str, rate: str, hour: str) -> DataFrame:
    """Value of alerting on everything, and on bad carriers in the afternoon."""
    typical = median_of(df, F.col(rate))
    benefit = cost_parameters(df, label, delay).select("benefit").scalar()
    late, alert = F.col(label) == 1, (F.col(rate) > typical) & (F.col(hour) >= AFTERNOON_HOUR)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), count_where(late).alias("p"),
        count_where(alert).alias("alerts"), count_where(alert & late).alias("hits"))
    return counts.select(
        (F.col("p") * benefit - F.col("n") * ALERT_COST).alias("alert_all"),
        (F.col("hits") * benefit - F.col("alerts") * ALERT_COST).alias("heuristic"))


def annualised(df: DataFrame, day: str, net: Column) -> DataFrame:
    """Per-flight and per-year value over the window the rows span."""
    window = df.agg(
        (F.date_diff(F.max(day), F.min(day)) + 1).alias("days"), F.count(F.lit(1)).alias("flights"))
    return window.select(
        "days", "flights", (net / F.col("flights")).alias("net_per_flight"),
        (net * DAYS_PER_YEAR / F.col("days")).alias("net_per_year"))


def economics_summary(sensitivities: DataFrame) -> DataFrame:
    """How often the programme pays, and how far the alert rate moves."""
    return sensitivities.agg(
        count_where(F.col("net_benefit") > 0).alias("positive_scenarios"),
        count_where(F.col("net_benefit") <= 0).alias("negative_scenarios"),
        F.min("alert_rate").alias("min_alert_rate"), F.max("alert_rate").alias("max_alert_rate"))
