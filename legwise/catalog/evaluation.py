"""E: evaluation, B: decision economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from legwise.catalog.frames import FLIGHTS, OPERATED, SCORED
from legwise.catalog.registry import query
from legwise.catalog.windows import PRIOR_RATES, _prior_sql, prior_features
from legwise.operators import economics as B
from legwise.operators import evaluation as E
from legwise.operators.quantiles import median_of
from legwise.operators.splits import chronological_split

CURVE = SCORED + """,
counted AS (SELECT score, SUM(label)::BIGINT AS positives, COUNT(*) AS n FROM scored GROUP BY 1),
curve AS (SELECT *, SUM(positives) OVER w AS tp, SUM(n) OVER w AS alerts FROM counted WINDOW w AS (ORDER BY score DESC)),
tot AS (SELECT SUM(positives)::DOUBLE AS p, SUM(n - positives)::DOUBLE AS q FROM counted)
"""


def curve(t):
    return E.score_curve(t.scored, "label", "score")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("E1_roc_auc", f"WITH {CURVE} SELECT ROUND(SUM((n - positives) * (tp - positives / 2.0::DOUBLE)) / ANY_VALUE(p * q), 6) AS roc_auc FROM curve, tot")
def e1(t):
    return E.ranking_quality(curve(t)).select(*r6("roc_auc"))


@query("E2_average_precision", f"WITH {CURVE} SELECT ROUND(SUM(positives * (tp / alerts)) / ANY_VALUE(p), 6) AS pr_auc FROM curve, tot")
def e2(t):
    return E.ranking_quality(curve(t)).select(*r6("pr_auc"))


@query("E3_log_loss_brier", f"""
WITH {SCORED}, x AS (SELECT label, score, GREATEST(LEAST(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16) AS p FROM scored)
SELECT ROUND(AVG(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss, ROUND(AVG(pow(score - label, 2)), 6) AS brier, ROUND(AVG(label), 6) AS base_rate FROM x
""")
def e3(t):
    return E.probability_quality(t.scored, "label", "score").select(*r6("log_loss", "brier", "base_rate"))


@query("E4_quality_at_threshold", f"""
WITH {SCORED}, c AS (SELECT COUNT(*) FILTER (label = 1 AND score >= 0.5) AS tp, COUNT(*) FILTER (label = 0 AND score >= 0.5) AS fp, COUNT(*) FILTER (label = 1 AND score < 0.5) AS fn, COUNT(*) FILTER (label = 0 AND score < 0.5) AS tn FROM scored)
SELECT ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, ROUND(tp / (tp + fp), 6) AS "precision", ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""")
def e4(t):
    return E.quality_at(t.scored, "label", "score", 0.5).select(*r6("accuracy", "precision", "recall", "f1"))


@query("E5_top_decile_lift", f"""
WITH {SCORED}, r AS (SELECT label, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS place, COUNT(*) OVER () AS n FROM scored)
SELECT ROUND(AVG(label) FILTER (place <= GREATEST(FLOOR(n * 0.1::DOUBLE), 1)) / AVG(label), 6) AS lift FROM r
""")
def e5(t):
    return E.top_fraction_lift(t.scored, "label", "score", "id").select(*r6("lift"))


@query("E6_best_f1_threshold", f"""
WITH {CURVE}, f AS (SELECT score, tp / alerts AS pr, tp / p AS rc FROM curve, tot), g AS (SELECT score, 2 * pr * rc / GREATEST(pr + rc, 1e-9) AS f1 FROM f)
SELECT score AS threshold, ROUND(f1, 6) AS f1 FROM g ORDER BY g.f1 DESC, score LIMIT 1
""")
def e6(t):
    return E.best_f1(curve(t)).select("threshold", *r6("f1"))


BINNED = SCORED + """,
binned AS (SELECT *, GREATEST(1, CEIL((ROW_NUMBER() OVER (ORDER BY score, id) - 1) * {q} / (COUNT(*) OVER () - 1)::DOUBLE))::INT AS bin FROM scored)
"""


@query("E7_expected_calibration_error", f"""
WITH {BINNED.format(q=15)}, g AS (SELECT bin, COUNT(*) AS n, AVG(label) AS o, AVG(score) AS p FROM binned GROUP BY 1)
SELECT ROUND(SUM(n * ABS(o - p)) / SUM(n), 6) AS ece FROM g
""")
def e7(t):
    return E.calibration_error(t.scored, "label", "score", "id").select(*r6("ece"))


@query("E8_curve_points", f"WITH {CURVE} SELECT score, ROUND((alerts - tp) / q, 6) AS fpr, ROUND(tp / p, 6) AS tpr, ROUND(tp / alerts, 6) AS \"precision\" FROM curve, tot")
def e8(t):
    return E.curve_points(curve(t)).select("score", *r6("fpr", "tpr", "precision"))


@query("E9_reliability_curve", f"""
WITH {SCORED}, e AS (SELECT quantile_cont(score, [{", ".join(f"{i}/12.0::DOUBLE" for i in range(1, 12))}]) AS edges FROM scored),
s AS (SELECT label, score, (len(list_filter(edges, lambda x: x < score)) + 1)::INT AS bin FROM scored, e)
SELECT bin, COUNT(*) AS n, ROUND(AVG(label), 6) AS observed, ROUND(AVG(score), 6) AS predicted FROM s GROUP BY 1
""")
def e9(t):
    return E.reliability_curve(t.scored, "label", "score").select("bin", "n", *r6("observed", "predicted"))


@query("E10_regression_quality", f"""
WITH {SCORED}, x AS (SELECT delay AS a, delay - (score * 100 - 30) AS e FROM scored)
SELECT ROUND(sqrt(AVG(e * e)), 6) AS rmse, ROUND(AVG(ABS(e)), 6) AS mae, ROUND(1 - SUM(e * e) / (var_pop(a) * COUNT(a)), 6) AS r2, ROUND(SUM(ABS(e)) / SUM(ABS(a)) * 100, 6) AS wape_pct,
 ROUND(AVG(ABS(e) / a) FILTER (a >= 15) * 100, 6) AS mape_pct, ROUND(quantile_cont(ABS(e), 0.5), 6) AS median_ae FROM x
""")
def e10(t):
    rows = t.scored.withColumn("predicted", F.col("score") * 100 - 30)
    return E.regression_quality(rows, "delay", "predicted").select(
        *r6("rmse", "mae", "r2", "wape_pct", "mape_pct", "median_ae"))


@query("E10_against_median_baseline", f"""
WITH {SCORED}, x AS (SELECT delay - (score * 100 - 30) AS e, delay - (SELECT quantile_cont(delay, 0.5) FROM scored WHERE day <= (SELECT MAX(day) - 7 FROM scored)) AS b FROM scored),
g AS (SELECT sqrt(AVG(e * e)) AS r, sqrt(AVG(b * b)) AS rb, AVG(ABS(e)) AS m, AVG(ABS(b)) AS mb FROM x)
SELECT ROUND(r, 6) AS rmse, ROUND(rb, 6) AS rmse_median, ROUND(m, 6) AS mae, ROUND(mb, 6) AS mae_median, ROUND((r / rb - 1) * 100, 6) AS rmse_change_pct, ROUND((m / mb - 1) * 100, 6) AS mae_change_pct FROM g
""")
def e10b(t):
    rows = t.scored.withColumn("predicted", F.col("score") * 100 - 30)
    trained = rows.where(F.col("day") <= F.date_sub(rows.agg(F.max("day")).scalar(), 7))
    return E.baseline_deltas(rows, "delay", "predicted", median_of(trained, F.col("delay"))).select(
        *r6("rmse", "rmse_median", "mae", "mae_median", "rmse_change_pct", "mae_change_pct"))


@query("E11_split_summary", """
SELECT CASE WHEN o_orderdate::DATE <= DATE '1999-06-30' THEN 'train' WHEN o_orderdate::DATE <= DATE '2000-06-30' THEN 'valid' ELSE 'test' END AS split,
 COUNT(*) AS n, ROUND(AVG((o_orderstatus = 'F')::INT), 6) AS positive_rate FROM orders GROUP BY 1
""")
def e11(t):
    rows = t.orders.select(F.to_date(F.col("o_orderdate").cast("timestamp")).alias("day"),
                           (F.col("o_orderstatus") == "F").cast("int").alias("late"))
    return E.split_summary(chronological_split(rows, "day", "1999-06-30", "2000-06-30"), "split", "late").select(
        "split", "n", *r6("positive_rate"))


# ---------------------------------------------------------------- B
COSTS = SCORED + """,
cost AS (SELECT AVG(delay) FILTER (label = 1) AS avg_delay, AVG(delay) FILTER (label = 1) * 0.3::DOUBLE * 148 AS benefit FROM scored),
ladder AS (SELECT i, 0.02::DOUBLE + 0.01::DOUBLE * i AS thr FROM (SELECT UNNEST(generate_series(0, 93)) AS i)),
sweep AS (SELECT ROUND(thr, 3) AS threshold, COUNT(*) FILTER (score >= thr) AS alerts, COUNT(*) FILTER (score >= thr AND label = 1) AS tp,
  COUNT(*) FILTER (score < thr AND label = 1) AS fn, COUNT(*) AS n FROM ladder, scored GROUP BY thr),
priced AS (SELECT *, alerts - tp AS fp, tp * benefit - alerts * 900 AS net FROM sweep, cost)
"""


def priced(t):
    return B.threshold_sweep(t.scored, "label", "score", "delay")


@query("B1_cost_parameters", f"""
WITH {COSTS} SELECT ROUND(avg_delay, 6) AS avg_delay_min, 148::DOUBLE AS cost_per_min, ROUND(avg_delay * 148, 4) AS cost_of_one_delay, 900::DOUBLE AS alert_cost, 0.3::DOUBLE AS effectiveness,
 ROUND(benefit, 4) AS benefit, ROUND(900 / benefit, 6) AS break_even_p FROM cost
""")
def b1(t):
    return B.cost_parameters(t.scored, "label", "delay").select(
        *r6("avg_delay_min"), "cost_per_min", F.round("cost_of_one_delay", 4).alias("cost_of_one_delay"),
        "alert_cost", "effectiveness", F.round("benefit", 4).alias("benefit"), *r6("break_even_p"))


@query("B2_threshold_sweep", f"""
WITH {COSTS} SELECT threshold, alerts, tp, fp, fn, ROUND(alerts / n, 6) AS alert_rate, ROUND(tp / GREATEST(alerts, 1), 6) AS "precision", ROUND(tp / GREATEST(tp + fn, 1), 6) AS recall,
 ROUND(tp * benefit, 2) AS gross_saving, (alerts * 900)::DOUBLE AS alert_spend, ROUND(net, 2) AS net_benefit FROM priced
""")
def b2(t):
    return priced(t).select("threshold", "alerts", "tp", "fp", "fn", *r6("alert_rate", "precision", "recall"),
                            F.round("gross_saving", 2).alias("gross_saving"), "alert_spend", F.round("net_benefit", 2).alias("net_benefit"))


@query("B3_optimal_threshold", f"WITH {COSTS} SELECT threshold, alerts, tp, ROUND(net, 2) AS net_benefit FROM priced ORDER BY priced.net DESC, threshold LIMIT 1")
def b3(t):
    return B.best_threshold(priced(t)).select("threshold", "alerts", "tp", F.round("net_benefit", 2).alias("net_benefit"))


@query("B4_risk_deciles", f"""
WITH {BINNED.format(q=10)}, g AS (SELECT bin, COUNT(*) AS flights, AVG(label) AS rate, AVG(GREATEST(delay, 0)) AS m, SUM(GREATEST(delay, 0)) AS s FROM binned GROUP BY 1),
h AS (SELECT *, s / SUM(s) OVER () AS share FROM g)
SELECT 'D' || bin AS decile, flights, ROUND(rate, 6) AS delay_rate, ROUND(m, 4) AS mean_delay_min, ROUND(s, 2) AS delay_minutes, ROUND(rate / (SELECT AVG(label) FROM scored), 6) AS lift,
 ROUND(share, 6) AS share_of_delay_minutes, ROUND(SUM(share) OVER (ORDER BY bin DESC), 6) AS cumulative_share FROM h
""")
def b4(t):
    return B.risk_deciles(t.scored, "label", "score", "delay", "id").select(
        "decile", "flights", *r6("delay_rate"), F.round("mean_delay_min", 4).alias("mean_delay_min"),
        F.round("delay_minutes", 2).alias("delay_minutes"), *r6("lift", "share_of_delay_minutes", "cumulative_share"))


GRID = COSTS + """,
grid AS (SELECT * FROM (VALUES (300::DOUBLE), (600), (900), (1500), (2500)) a(alert_cost), (VALUES (0.15::DOUBLE), (0.3), (0.5)) b(effectiveness)),
cells AS (SELECT g.*, s.threshold, s.alerts, s.tp, s.fn, s.n, avg_delay * effectiveness * 148 AS ben, s.tp * (avg_delay * effectiveness * 148) - s.alerts * alert_cost AS net2 FROM sweep s, grid g, cost),
best AS (SELECT * FROM cells QUALIFY ROW_NUMBER() OVER (PARTITION BY alert_cost, effectiveness ORDER BY net2 DESC, threshold) = 1)
"""


@query("B5_sensitivity_grid", f"""
WITH {GRID} SELECT alert_cost, effectiveness, ROUND(alert_cost / ben, 6) AS break_even_p, threshold AS optimal_threshold, ROUND(alerts / n, 6) AS alert_rate, ROUND(tp / GREATEST(alerts, 1), 6) AS "precision",
 ROUND(tp / GREATEST(tp + fn, 1), 6) AS recall, ROUND(net2, 2) AS net_benefit FROM best
""")
def b5(t):
    return B.sensitivity(t.scored, "label", "score", "delay").select(
        "alert_cost", "effectiveness", *r6("break_even_p"), "optimal_threshold", *r6("alert_rate", "precision", "recall"),
        F.round("net_benefit", 2).alias("net_benefit"))


@query("B6_policy_baselines", f"""
WITH {OPERATED}, {_prior_sql("carrier", *PRIOR_RATES["carrier"])},
x AS (SELECT late, dep_delay, carrier_rate AS r, hour(dep_ts) + minute(dep_ts) / 60 AS h FROM flights LEFT JOIN carrier_r USING (carrier_code, day) WHERE cancelled = 0),
c AS (SELECT AVG(dep_delay) FILTER (late = 1) * 0.3::DOUBLE * 148 AS benefit, COUNT(*) AS n, SUM(late) AS p,
  COUNT(*) FILTER (r > (SELECT quantile_cont(r, 0.5) FROM x) AND h >= 15) AS a, COUNT(*) FILTER (late = 1 AND r > (SELECT quantile_cont(r, 0.5) FROM x) AND h >= 15) AS hits FROM x)
SELECT ROUND(p * benefit - n * 900, 2) AS alert_all, ROUND(hits * benefit - a * 900, 2) AS heuristic FROM c
""")
def b6(t):
    from legwise.functions.clock import decimal_hour

    rows = prior_features(t).where(F.col("cancelled") == 0).withColumn("h", decimal_hour(F.col("dep_ts")))
    return B.policy_baselines(rows, "late", "dep_delay", "carrier_rate", "h").select(
        F.round("alert_all", 2).alias("alert_all"), F.round("heuristic", 2).alias("heuristic"))


@query("B7_annualised_value", f"""
WITH {COSTS}, o AS (SELECT MAX(net) AS net FROM priced), w AS (SELECT MAX(day) - MIN(day) + 1 AS days, COUNT(*) AS flights FROM scored)
SELECT days::INT AS days, flights, ROUND(net / flights, 4) AS net_per_flight, ROUND(net * 365 / days, 2) AS net_per_year FROM o, w
""")
def b7(t):
    net = B.best_threshold(priced(t)).select("net_benefit").scalar()
    return B.annualised(t.scored, "day", net).select(
        "days", "flights", F.round("net_per_flight", 4).alias("net_per_flight"), F.round("net_per_year", 2).alias("net_per_year"))


@query("B8_recosted_ladder", f"WITH {COSTS} SELECT threshold, ROUND(tp * (avg_delay * 0.45::DOUBLE * 148) - alerts * 1200, 2) AS net FROM priced")
def b8(t):
    counts = B.threshold_counts(t.scored, "label", "score")
    avg_delay = B.cost_parameters(t.scored, "label", "delay").select("avg_delay_min").scalar()
    return B.recosted(counts, avg_delay, 1200.0, 0.45).select("threshold", F.round("net", 2).alias("net"))


@query("B9_economics_summary", f"""
WITH {GRID} SELECT COUNT(*) FILTER (net2 > 0) AS positive_scenarios, COUNT(*) FILTER (net2 <= 0) AS negative_scenarios, ROUND(MIN(alerts / n), 6) AS min_alert_rate, ROUND(MAX(alerts / n), 6) AS max_alert_rate FROM best
""")
def b9(t):
    return B.economics_summary(B.sensitivity(t.scored, "label", "score", "delay")).select(
        "positive_scenarios", "negative_scenarios", *r6("min_alert_rate", "max_alert_rate"))
