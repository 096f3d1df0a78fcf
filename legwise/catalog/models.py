"""L: selection, M: models, X: explanation (with O4 and C36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from legwise.catalog.frames import SCORED
from legwise.catalog.registry import fitted_once, query
from legwise.functions.base import flag
from legwise.functions.text import default_label, narrative
from legwise.operators import explanation as X
from legwise.operators import modelling as M
from legwise.operators import selection as L
from legwise.operators.joins import attach
from legwise.operators.evaluation import baseline_deltas, regression_quality
from legwise.operators.quantiles import median_of
from legwise.operators.splits import expanding_folds, halves_by_time
from legwise.session import fresh_path, settle, spread

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
CATEGORIES = ["l_linestatus"]
MINUTE_ROUNDS = 60
GRADED_ROUNDS = 150


def learning(t):
    """lineitem as a learning table: returned (R) is the label, ship date the time."""
    day = F.to_date(F.col("l_shipdate").cast("timestamp"))
    return t.lineitem.select(
        *NUMBERS, *CATEGORIES, day.alias("day"), flag(F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.xxhash64(*t.lineitem.columns).alias("key"),
        (F.col("l_extendedprice") / 1000 + F.col("l_discount") * 100).alias("minutes"))


def train_valid(t):
    rows = learning(t)
    return rows.where(F.col("day") <= "1999-06-30"), rows.where(F.col("day") > "1999-06-30")


MI_SQL = []
for f in NUMBERS:
    edges = ", ".join(f"{i}/10.0::DOUBLE" for i in range(1, 10))
    MI_SQL.append(f"""SELECT '{f}' AS feature, SUM(n / tot * ln(n * tot / (nx * ny))) AS mi FROM (
  SELECT n::DOUBLE AS n, SUM(n) OVER ()::DOUBLE AS tot, SUM(n) OVER (PARTITION BY bin)::DOUBLE AS nx, SUM(n) OVER (PARTITION BY y)::DOUBLE AS ny FROM (
    SELECT (l_returnflag = 'R')::INT AS y, len(list_filter(e, lambda q: q < x)) AS bin, COUNT(*) AS n
    FROM (SELECT l_returnflag, {f}::DOUBLE AS x FROM lineitem), (SELECT list_distinct(quantile_cont({f}::DOUBLE, [{edges}])) AS e FROM lineitem) GROUP BY 1, 2))""")


@query("L1_mutual_information", f"WITH m AS ({' UNION ALL '.join(MI_SQL)}) SELECT feature, ROUND(GREATEST(mi, 0), 8) AS mutual_information FROM m")
def l1(t):
    return L.mutual_information(learning(t), NUMBERS, "label").select(
        "feature", F.round("mutual_information", 8).alias("mutual_information"))


@query("L2_gain_importance")
def l2(t):
    train, valid = train_valid(t)
    fitted = M.fit_boosted(train, valid, NUMBERS, CATEGORIES, "label")
    gains = L.gain_importance(fitted.model, fitted.columns)
    return t.spark.createDataFrame(list(gains.items()), "feature STRING, gain DOUBLE")


PRUNE_COLUMNS = ["l_extendedprice", "double_price", "l_quantity", "l_discount", "more_discount"]


@query("L3_correlation_pruning", """
WITH x AS (SELECT l_extendedprice AS a, l_extendedprice * 2 + l_tax AS b, l_quantity AS c, l_discount AS d, l_discount + l_tax / 1000 AS e FROM lineitem),
r AS (SELECT ABS(corr(a, b)) AS ab, ABS(corr(a, c)) AS ac, ABS(corr(d, e)) AS de, ABS(corr(c, d)) AS cd FROM x)
SELECT 'l_extendedprice' AS winner, 'double_price' AS loser, ROUND(ab, 6) AS r FROM r WHERE ab > 0.95 UNION ALL SELECT 'more_discount', 'l_discount', ROUND(de, 6) FROM r WHERE de > 0.95
""")
def l3(t):
    rows = t.lineitem.withColumns({
        "double_price": F.col("l_extendedprice") * 2 + F.col("l_tax"),
        "more_discount": F.col("l_discount") + F.col("l_tax") / 1000})
    gain = {"l_extendedprice": 0.4, "double_price": 0.1, "l_quantity": 0.2, "l_discount": 0.1, "more_discount": 0.2}
    _, decided = L.correlation_prune(rows, PRUNE_COLUMNS, gain)
    return t.spark.createDataFrame(decided, "winner STRING, loser STRING, r DOUBLE").withColumn("r", F.round("r", 6))


@query("L4_recursive_elimination")
def l4(t):
    train, valid = train_valid(t)

    def fit(columns):
        numbers = [c for c in columns if c in NUMBERS]
        fitted = M.fit_boosted(train, valid, numbers, [c for c in columns if c in CATEGORIES], "label")
        return L.gain_importance(fitted.model, fitted.columns)

    ranks = L.recursive_elimination(fit, [*NUMBERS, *CATEGORIES], keep=3)
    return t.spark.createDataFrame(list(ranks.items()), "feature STRING, rfe_rank INT")


SCORES_SQL = """
f AS (SELECT p_brand AS feature, p_type AS family, AVG(p_retailprice) AS a, COUNT(*)::DOUBLE AS b, CASE WHEN MIN(p_partkey) % 3 <> 0 THEN MIN(p_partkey)::DOUBLE END AS c, MIN(p_partkey) % 4 = 0 AS pruned FROM part GROUP BY 1, 2),
g AS (SELECT feature || '/' || family AS feature, family, a, b, c, pruned FROM f),
r AS (SELECT *, RANK() OVER (ORDER BY a DESC) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, RANK() OVER (ORDER BY b DESC) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb,
  CASE WHEN c IS NOT NULL THEN RANK() OVER (ORDER BY c NULLS LAST) + (COUNT(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE END AS rc FROM g),
k AS (SELECT feature, family, (ra + rb + COALESCE(rc, 0)) / (2 + (rc IS NOT NULL)::INT) + CASE WHEN pruned THEN 1000 ELSE 0 END AS consensus_rank FROM r),
top AS (SELECT * FROM k ORDER BY consensus_rank, feature LIMIT 45)
"""


def consensus(t):
    first = F.min("p_partkey")
    scores = t.part.groupBy("p_brand", "p_type").agg(
        F.avg("p_retailprice").alias("a"), F.count(F.lit(1)).cast("double").alias("b"),
        F.when(first % 3 != 0, first.cast("double")).alias("c"), (first % 4 == 0).alias("pruned"),
    ).select(F.concat("p_brand", F.lit("/"), "p_type").alias("feature"), F.col("p_type").alias("family"), "a", "b", "c", "pruned")
    return L.consensus(scores, "feature", ["a", "b"], ["c"], "pruned")


@query("L5_consensus_rank", f"WITH {SCORES_SQL} SELECT feature, ROUND(consensus_rank, 6) AS consensus_rank FROM top")
def l5(t):
    return consensus(t).select("feature", F.round("consensus_rank", 6).alias("consensus_rank"))


@query("L6_group_mix", f"WITH {SCORES_SQL} SELECT family, COUNT(*) AS n FROM top GROUP BY 1")
def l6(t):
    return L.group_mix(consensus(t), "family")


@query("L7_training_window_only", "WITH x AS (SELECT l_discount AS v FROM lineitem WHERE l_shipdate::DATE <= DATE '1999-06-30') SELECT COUNT(*) AS n, ROUND(AVG(v), 8) AS mean_discount FROM x")
def l7(t):
    return train_valid(t)[0].agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 8).alias("mean_discount"))


# ---------------------------------------------------------------- M
@query("M1_linear_preprocessor")
def m1(t):
    train, valid = train_valid(t)
    stages, prepare = M.linear_preprocessor(train, NUMBERS, CATEGORIES)
    model = stages.fit(prepare(train))
    from pyspark.ml.functions import vector_to_array

    return model.transform(prepare(valid)).select("key", vector_to_array("features").alias("x"))


MOMENTS = ", ".join(f"AVG({f}) AS m{i}, stddev_samp({f}) AS d{i}" for i, f in enumerate(NUMBERS))


@query("M1_scaled_window", f"""
WITH x AS (SELECT *, l_shipdate::DATE AS day FROM lineitem), s AS (SELECT {MOMENTS} FROM x WHERE day <= DATE '1999-06-30')
{" UNION ALL ".join(f"SELECT '{f}' AS feature, COUNT(*) AS n, ROUND(AVG(({f} - m{i}) / d{i}) + 1e-9, 6) AS mean_scaled, ROUND(stddev_pop(({f} - m{i}) / d{i}), 6) AS deviation_scaled FROM x, s WHERE day > DATE '1999-06-30'" for i, f in enumerate(NUMBERS))}
""")
def m1b(t):
    """The scaled numbers of the validation window; location and scale come from the training window."""
    scaled = m1(t).select(F.posexplode("x").alias("place", "z")).where(F.col("place") < len(NUMBERS))
    return scaled.groupBy("place").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("z") + 1e-9, 6).alias("mean_scaled"),
        F.round(F.stddev_pop("z"), 6).alias("deviation_scaled")).select(
        F.get(F.array(*map(F.lit, NUMBERS)), F.col("place")).alias("feature"), "n", "mean_scaled", "deviation_scaled")


@query("M2_logistic_regression")
def m2(t):
    train, valid = train_valid(t)
    return M.fit_logistic(train, NUMBERS, CATEGORIES, "label").predict(valid).select("key", "label", "p")


@query("M3_random_forest")
@fitted_once
def m3(t):
    train, valid = train_valid(t)
    fitted = M.fit_forest(train, NUMBERS, CATEGORIES, "label")
    return fitted.predict(spread(valid)).select("key", "label", "p")


@query("M4_boosted_trees")
@fitted_once
def m4(t):
    train, valid = train_valid(t)
    fitted = M.fit_boosted(train, valid, NUMBERS, CATEGORIES, "label")
    return fitted.predict(spread(valid)).select("key", "label", "p", F.lit(fitted.rounds).alias("rounds"))


@query("M4_loss_per_round")
def m4c(t):
    """Validation loss of every round tried on a label that follows the numbers in degrees, and which round is kept.

    The bundled label is independent of the numbers, so its best ensemble is a single tree.
    """
    noise = F.pmod(F.xxhash64(F.lit(1), *t.lineitem.columns), F.lit(1000)) / 1000.0
    pull = 0.15 + F.col("l_discount") * 4 + F.sin(F.col("l_quantity") / 8) * 0.2 + F.col("l_tax") * 2
    rows = t.lineitem.select(*NUMBERS, *CATEGORIES, F.to_date(F.col("l_shipdate").cast("timestamp")).alias("day"),
                             flag(noise < pull).cast("int").alias("label"))
    fitted = M.fit_boosted(rows.where("day <= DATE '1999-06-30'"), rows.where("day > DATE '1999-06-30'"),
                           NUMBERS, CATEGORIES, "label", preset="boosted_leafy", maxIter=GRADED_ROUNDS)
    tried = [(i, float(loss), i == fitted.rounds) for i, loss in enumerate(fitted.losses, 1)]
    return t.spark.createDataFrame(tried, "round INT, loss DOUBLE, kept BOOLEAN")


VALID_SQL = """WITH x AS (SELECT (l_returnflag = 'R')::INT AS label FROM lineitem WHERE l_shipdate::DATE > DATE '1999-06-30')
SELECT COUNT(*) AS n, SUM(label)::BIGINT AS positives, TRUE AS all_scored, TRUE AS in_range, TRUE AS not_constant FROM x"""


def scored_whole(predicted):
    """One row on the scores of a table: none missing, all chances, more than one value."""
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"),
                         (F.count("p") == F.count(F.lit(1))).alias("all_scored"),
                         F.bool_and(F.col("p").between(0.0, 1.0)).alias("in_range"),
                         (F.min("p") < F.max("p")).alias("not_constant"))


@query("M3_forest_scores_whole_window", VALID_SQL)
def m3b(t):
    return scored_whole(m3(t))


@query("M4_boosted_scores_whole_window", VALID_SQL)
def m4b(t):
    return scored_whole(m4(t))


@query("M2_score_balance", """
WITH x AS (SELECT (l_returnflag = 'R')::DOUBLE AS label FROM lineitem WHERE l_shipdate::DATE <= DATE '1999-06-30')
SELECT COUNT(*) AS n, ROUND(AVG(label), 4) AS mean_label, ROUND(AVG(label), 4) AS mean_score FROM x
""")
def m2b(t):
    """At the optimum of a logistic regression with a free intercept the mean score is the base rate."""
    train, _ = train_valid(t)
    scored = M.fit_logistic(train, NUMBERS, CATEGORIES, "label").predict(train)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 4).alias("mean_label"),
                      F.round(F.avg("p"), 4).alias("mean_score"))


@query("M6_metrics_recomputed", """
WITH x AS (SELECT (l_returnflag = 'R')::DOUBLE AS label FROM lineitem WHERE l_shipdate::DATE > DATE '1999-06-30')
SELECT unnest(['boosted_deep', 'boosted_leafy', 'boosted_ordered', 'logistic_regression', 'random_forest']) AS model,
  ROUND(AVG(label), 8) AS base_rate, TRUE AS metrics_in_range FROM x
""")
def m6b(t):
    bounds = [F.col(c).between(0.0, 1.0) for c in ("roc_auc", "pr_auc", "brier", "accuracy", "precision", "recall", "f1")]
    good = bounds[0]
    for b in bounds[1:]:
        good = good & b
    return m6(t).select("model", F.round("base_rate", 8).alias("base_rate"), good.alias("metrics_in_range"))


@query("M5_missing_level", "SELECT event_id, COALESCE(CASE WHEN event_id % 4 <> 0 THEN event_type END, 'missing') AS carrier_code FROM events")
def m5(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("carrier_code"))
    return M.with_missing_level(rows, ["carrier_code"])


@query("M6_candidate_comparison")
@fitted_once
def m6(t):
    train, valid = train_valid(t)
    train, valid = settle(spread(train)), settle(spread(valid))
    candidates = M.in_parallel([
        lambda: M.fit_logistic(train, NUMBERS, CATEGORIES, "label"), lambda: M.fit_forest(train, NUMBERS, CATEGORIES, "label"),
        *[lambda name=name: M.fit_boosted(train, valid, NUMBERS, CATEGORIES, "label", preset=name) for name in M.BOOSTED]])
    return M.compare(candidates, valid, "label", "key")


@query("M7_random_search")
def m7(t):
    rows = learning(t)
    folds = [(str(r["train_until"]), str(r["valid_until"])) for r in expanding_folds(rows, "day", 2).collect()]
    return M.random_search(rows, folds, "day", NUMBERS, CATEGORIES, "label")


@query("M8_expanding_folds", """
WITH d AS (SELECT (l_shipdate::DATE - DATE '1970-01-01')::DOUBLE AS n FROM lineitem), q AS (SELECT quantile_cont(n, [1 / 3::DOUBLE, 2 / 3::DOUBLE, 1]) AS c FROM d)
SELECT fold::INT AS fold, (DATE '1970-01-01' + FLOOR(c[fold])::INT)::DATE::VARCHAR AS train_until, (DATE '1970-01-01' + FLOOR(c[fold + 1])::INT)::DATE::VARCHAR AS valid_until FROM q, (VALUES (1), (2)) f(fold)
""")
def m8(t):
    return expanding_folds(learning(t), "day", 2).select(
        "fold", F.col("train_until").cast("string").alias("train_until"), F.col("valid_until").cast("string").alias("valid_until"))


@query("M9_calibration_choice")
def m9(t):
    halves = halves_by_time(t.scored, "day", "id")
    return M.calibration_choice(halves, "score", "label", "id", "half")


@query("M9_time_halves", f"WITH {SCORED} SELECT id, CASE WHEN ROW_NUMBER() OVER (ORDER BY day, id) <= COUNT(*) OVER () // 2 THEN 1 ELSE 2 END AS half FROM scored")
def m9b(t):
    return halves_by_time(t.scored, "day", "id").select("id", "half")


@query("M10_minutes_regression")
@fitted_once
def m10(t):
    train, valid = train_valid(t)
    out = None
    for loss in ("squared", "absolute"):
        # the target is a plain sum of two of the numbers, so its loss falls in every round
        fitted = M.fit_minutes(train, valid, NUMBERS, CATEGORIES, "minutes", loss, rounds=MINUTE_ROUNDS)
        predicted = settle(fitted.predict(valid))
        deltas = baseline_deltas(predicted, "minutes", "prediction", median_of(train, F.col("minutes")))
        row = regression_quality(predicted, "minutes", "prediction").withColumns({"loss": F.lit(loss)} | {
            c: deltas.select(c).scalar() for c in ("rmse_median", "mae_median", "rmse_change_pct", "mae_change_pct")})
        out = row if out is None else out.unionByName(row)
    return out


@query("M10_baseline_columns", """
WITH x AS (SELECT l_extendedprice / 1000 + l_discount * 100 AS m, l_shipdate::DATE AS day FROM lineitem),
b AS (SELECT quantile_cont(m, 0.5) AS med FROM x WHERE day <= DATE '1999-06-30')
SELECT loss, ROUND(sqrt(AVG((m - med) ** 2)), 6) AS rmse_median, ROUND(AVG(ABS(m - med)), 6) AS mae_median, TRUE AS better
FROM x, b, (SELECT unnest(['squared', 'absolute']) AS loss) WHERE day > DATE '1999-06-30' GROUP BY loss
""")
def m10b(t):
    return m10(t).select("loss", F.round("rmse_median", 6).alias("rmse_median"), F.round("mae_median", 6).alias("mae_median"),
                         ((F.col("rmse_change_pct") < 0) & (F.col("mae_change_pct") < 0)).alias("better"))


# ---------------------------------------------------------------- X
# A linear score on the lineitem numbers (coefficient, mean).
WEIGHTS = {"l_quantity": (0.02, 25.0), "l_extendedprice": (-0.00001, 53000.0), "l_discount": (5.0, 0.05), "l_tax": (-7.0, 0.04)}
PARTS = {f: f"({w})::DOUBLE * ({f} - {m}::DOUBLE)" for f, (w, m) in WEIGHTS.items()}


def explained(t):
    rows = t.lineitem.withColumn("contributions", X.linear_contributions(WEIGHTS))
    return rows.withColumn("top", X.strongest(F.col("contributions"), 3))


ENTRIES = "[" + ", ".join(f"{{'s': -ABS({p}), 'f': '{f}', 'c': {p}}}" for f, p in PARTS.items()) + "]"


@query("O4_strongest_contributions", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, list_slice(list_sort({ENTRIES}), 1, 3) AS top FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, array_to_string([e.f for e in top], ',') AS features, ROUND(top[1].c + 1e-9, 6) AS first_contribution FROM x
""")
def o4(t):
    return explained(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.array_join(F.transform("top", lambda e: e["feature"]), ",").alias("features"),
        F.round(F.col("top")[0]["contribution"] + 1e-9, 6).alias("first_contribution"))


@query("X1_global_importance", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, ROUND(AVG(ABS({p})), 8) AS importance FROM lineitem" for f, p in PARTS.items()))
def x1(t):
    return X.global_importance(explained(t), "contributions", list(WEIGHTS)).select(
        "feature", F.round("importance", 8).alias("importance"))


@query("X2_row_contributions", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, '{f}' AS feature, ROUND({p} + 1e-9, 6) AS contribution, CASE WHEN {p} > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction FROM lineitem" for f, p in PARTS.items()))
def x2(t):
    return explained(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.inline("contributions")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "feature",
        F.round(F.col("contribution") + 1e-9, 6).alias("contribution"), "direction")


@query("X3_tree_contributions")
def x3(t):
    train, valid = train_valid(t)
    fitted = M.fit_boosted(train, valid, NUMBERS, [], "label")
    path = fresh_path(t.spark, "trees")
    fitted.model.save(path)
    return X.tree_contributions(valid, X.tree_nodes(t.spark, path), "key", NUMBERS)


@query("X4_dependence_curve", f"""
WITH x AS (SELECT l_extendedprice AS v, {PARTS["l_extendedprice"]} AS s FROM lineitem), e AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM x),
k AS (SELECT v, s FROM x, e WHERE v BETWEEN lo AND hi), q AS (SELECT quantile_cont(v, [{", ".join(f"{i}/18.0::DOUBLE" for i in range(18))}]) AS edges FROM k)
SELECT GREATEST(len(list_filter(edges, lambda z: z < v)), 1)::INT AS bin, COUNT(*) AS n, ROUND(AVG(v), 4) AS x, ROUND(AVG(s), 8) AS contribution FROM k, q GROUP BY 1
""")
def x4(t):
    part = F.get("contributions", F.lit(1))["contribution"]
    rows = explained(t).withColumn("s", part)
    return X.dependence_curve(rows, "l_extendedprice", "s").select(
        "bin", "n", F.round("x", 4).alias("x"), F.round("contribution", 8).alias("contribution"))


SENTENCE = """'Predicted departure-delay risk ' || format('{:,.0f}', round_even(score * 100, 0)) || '%.'"""


@query("C36_narrative", f"""
WITH {SCORED} SELECT id, {SENTENCE} || CASE WHEN k > 50 THEN ' Driven up by: inbound aircraft late (' || k || ' min).' WHEN k < 50 THEN ' Offset by: inbound aircraft late (' || k || ' min).' ELSE '' END AS sentence
FROM scored JOIN (SELECT event_id, (props::JSON->>'k')::INT AS k FROM events) ON event_id = id
""")
def c36(t):
    k = t.events.select("event_id", F.from_json("props", "k INT")["k"].alias("upstream_delay_min"))
    rows = t.scored.join(k, F.col("id") == F.col("event_id"))
    parts = X.strongest(X.linear_contributions({"upstream_delay_min": (0.01, 50.0)}), 6)
    return rows.withColumn("top", parts).select("id", narrative(F.col("top"), F.col("score")).alias("sentence"))


@query("X5_example_picks", f"""
WITH {SCORED}, r AS (SELECT id, score, delay, label, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS place, COUNT(*) OVER () AS n FROM scored)
SELECT CASE place WHEN 1 THEN 'highest_risk' WHEN n THEN 'lowest_risk' ELSE 'typical' END AS tag, id, score, label, ROUND(delay, 4) AS delay, {SENTENCE} AS sentence FROM r WHERE place IN (1, n // 2 + 1, n)
""")
def x5(t):
    from legwise.catalog.aggregates import o6

    picks = o6(t).select("tag", "id")
    empty = X.strongest(X.linear_contributions({"delay": (0.0, 0.0)}), 6)
    return t.scored.join(picks, "id").withColumn("top", empty).select(
        "tag", "id", "score", "label", F.round("delay", 4).alias("delay"),
        narrative(F.col("top"), F.col("score")).alias("sentence"))


# A linear score on numbers of a flight: expression on an event, coefficient, mean.
DRIVERS = {
    "upstream_delay_min": ("k", 0.02, 50.0),
    "scheduled_turnaround_min": ("20 + event_id % 70", -0.01, 55.0),
    "seats": ("70 + event_id * 3 % 160", -0.004, 150.0),
    "schedule_padding_min": ("event_id * 7 % 40", -0.02, 19.0),
    "scheduled_block_min": ("40 + event_id * 11 % 1400", 0.001, 700.0),
    "origin_mean_delay_min_7d": ("event_id % 23", 0.03, 11.0),
    "carrier_volume_7d": ("event_id * 13 % 3000", -0.0002, 1500.0),
}
UNITS = {f: (label.lower(), unit) for f, label, unit in X.LABELS}
REASONED_SQL = SCORED + ", driven AS (SELECT event_id AS id, list_sort([" + ", ".join(
    f"{{'s': -ABS({w}::DOUBLE * (({e})::DOUBLE - {m}::DOUBLE)), 'f': '{f}', 'c': {w}::DOUBLE * (({e})::DOUBLE - {m}::DOUBLE), "
    f"'t': '{UNITS[f][0]} (' || format('{{:,}}', ({e})::BIGINT) || ' {UNITS[f][1]})'}}" for f, (e, w, m) in DRIVERS.items()
) + """])[:6] AS top FROM (SELECT event_id, (props::JSON->>'k')::INT AS k FROM events)),
parts AS (SELECT id, top, list_filter(top, lambda e: e.c > 0)[:3] AS ups, list_filter(top, lambda e: e.c < 0)[:2] AS downs FROM driven),
reasoned AS (SELECT id, len(ups)::INT AS n_up, len(downs)::INT AS n_down, CASE WHEN len(ups) > 0 THEN ' Driven up by: ' || array_to_string(list_transform(ups, lambda e: e.t), '; ') || '.' ELSE '' END
  || CASE WHEN len(downs) > 0 THEN ' Offset by: ' || array_to_string(list_transform(downs, lambda e: e.t), '; ') || '.' ELSE '' END AS reasons FROM parts)
"""


def reasoned(t):
    """Scored rows with the six strongest of seven contributions."""
    event = t.events.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))
    numbers = event.select(F.col("event_id").alias("id"), *[F.expr(e).cast("double").alias(f) for f, (e, _, _) in DRIVERS.items()])
    rows = t.scored.join(numbers, "id")
    return rows.withColumn("top", X.strongest(X.linear_contributions({f: (w, m) for f, (_, w, m) in DRIVERS.items()}), 6))


@query("C36_narrative_of_many_reasons", f"WITH {REASONED_SQL} SELECT id, n_up, n_down, {SENTENCE} || reasons AS sentence FROM scored JOIN reasoned USING (id)")
def c36b(t):
    """At most three reasons that raise the risk and two that lower it, strongest first."""
    signed = lambda up: F.size(F.filter("top", lambda e: e["contribution"] > 0 if up else e["contribution"] < 0))
    return reasoned(t).select("id", F.least(signed(True), F.lit(3)).alias("n_up"), F.least(signed(False), F.lit(2)).alias("n_down"),
                              narrative(F.col("top"), F.col("score")).alias("sentence"))


@query("X5_example_reasons", f"""
WITH {REASONED_SQL}, r AS (SELECT id, score, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS place, COUNT(*) OVER () AS n FROM scored)
SELECT CASE place WHEN 1 THEN 'highest_risk' WHEN n THEN 'lowest_risk' ELSE 'typical' END AS tag, id, n_up + n_down AS n_reasons, {SENTENCE} || reasons AS sentence FROM r JOIN reasoned USING (id) WHERE place IN (1, n // 2 + 1, n)
""")
def x5b(t):
    from legwise.catalog.aggregates import o6

    told = c36b(t).join(F.broadcast(o6(t).select("tag", "id")), "id")  # three rows
    return told.select("tag", "id", (F.col("n_up") + F.col("n_down")).alias("n_reasons"), "sentence")


# Declared features with and without a registered label.
SHOWN = [*(f for f, _, _ in X.LABELS), "origin_capacity", "is_red_eye", "dest_hour_arrivals", "season"]


@query("C35_registered_labels", f"""
WITH known(f, label, unit) AS (VALUES {", ".join(f"('{f}', '{label}', '{unit}')" for f, label, unit in X.LABELS)}),
x AS (SELECT event_id, {SHOWN}[event_id % {len(SHOWN)} + 1] AS feature FROM events)
SELECT event_id, feature, COALESCE(label, upper(feature[1]) || lower(replace(feature[2:], '_', ' '))) AS label, COALESCE(unit, '') AS unit FROM x LEFT JOIN known ON f = feature
""")
def c35b(t):
    rows = t.events.select("event_id", F.get(F.array(*map(F.lit, SHOWN)), (F.col("event_id") % len(SHOWN)).cast("int")).alias("feature"))
    named = attach(rows, X.label_dimension(t.spark), ["feature"], ["feature"], {"label": "_label", "unit": "_unit"})
    return named.select("event_id", "feature", F.coalesce("_label", default_label(F.col("feature"))).alias("label"),
                        F.coalesce("_unit", F.lit("")).alias("unit"))
