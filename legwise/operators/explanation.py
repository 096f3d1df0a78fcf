"""Which features drive a score: per row, per feature, per family."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legwise.functions.text import default_label, display_value
from legwise.operators.ordering import positions
from legwise.operators.quantiles import exact_quantiles

# Labels and units of the features shown to people.
LABELS = (
    ("upstream_delay_min", "Inbound aircraft late", "min"),
    ("slack_vs_upstream_min", "Ground-time slack", "min"),
    ("aircraft_cum_delay_today", "Delay accumulated by this airframe today", "min"),
    ("prev_leg_known", "Inbound leg status confirmed", ""),
    ("scheduled_turnaround_min", "Scheduled turnaround", "min"),
    ("origin_congestion_ratio", "Departure-bank load vs. capacity", "x"),
    ("carrier_delay_rate_7d", "Carrier 7-day delay rate", "%"),
    ("origin_delay_rate_7d", "Origin 7-day delay rate", "%"),
    ("route_delay_rate_30d", "Route 30-day delay rate", "%"),
    ("carrier_origin_delay_rate_14d", "Carrier-at-station 14-day delay rate", "%"),
    ("origin_mean_delay_min_7d", "Origin mean delay, last 7 days", "min"),
    ("dep_wx_severity", "Weather severity at origin", "index"),
    ("route_wx_severity", "Weather severity across the route", "index"),
    ("dep_wx_visibility_km", "Visibility at origin", "km"),
    ("dep_wx_wind_speed_kt", "Wind at origin", "kt"),
    ("dep_gust_factor", "Gust factor at origin", "x"),
    ("dep_wx_cloud_ceiling_ft", "Cloud ceiling at origin", "ft"),
    ("dep_wx_temperature_c", "Temperature at origin", "°C"),
    ("dep_temp_anomaly", "Temperature vs. seasonal normal", "°C"),
    ("dep_dewpoint_spread", "Dewpoint spread (fog proxy)", "°C"),
    ("dep_time_decimal", "Departure time of day", "h"),
    ("hour_sin", "Time-of-day position", ""),
    ("hour_cos", "Time-of-day position", ""),
    ("doy_sin", "Season", ""),
    ("doy_cos", "Season", ""),
    ("day_of_week", "Day of week", ""),
    ("dep_minute", "Minutes past the hour", "min"),
    ("time_block", "Departure period", ""),
    ("holiday_proximity", "Proximity to a major holiday", ""),
    ("schedule_padding_min", "Schedule padding", "min"),
    ("padding_ratio", "Schedule padding share", ""),
    ("scheduled_block_min", "Scheduled block time", "min"),
    ("aircraft_age_years", "Airframe age", "yr"),
    ("seats", "Aircraft size", "seats"),
    ("aircraft_model", "Aircraft type", ""),
    ("carrier_code", "Operating carrier", ""),
    ("origin", "Origin station", ""),
    ("destination", "Destination station", ""),
    ("carrier_share_at_origin", "Carrier share of the station", ""),
    ("carrier_volume_7d", "Carrier weekly volume", "flights"),
    ("carrier_origin_volume_14d", "Carrier-at-station volume", "flights"),
    ("route_popularity_30d", "Route frequency", "flights/30d"),
    ("lat_delta", "North-south routing", "°"),
    ("bearing_sin", "Route direction", ""),
    ("bearing_cos", "Route direction", ""),
)
DEPENDENCE_BINS = 18


def label_dimension(spark: SparkSession) -> DataFrame:
    """Feature labels as a keyed table."""
    return spark.createDataFrame(list(LABELS), "feature STRING, label STRING, unit STRING")


def _labelled(feature: str) -> tuple[Column, Column]:
    known = {f: (label, unit) for f, label, unit in LABELS}
    if feature in known:
        label, unit = known[feature]
        return F.lit(label), F.lit(unit)
    return default_label(F.lit(feature)), F.lit("")


def contribution(feature: str, value: Column | None, part: Column, text: Column | None = None) -> Column:
    """One entry: a number shown in its unit, or a category's text."""
    label, unit = _labelled(feature)
    number = value if value is not None else F.lit(None).cast("double")
    return F.struct(
        F.lit(feature).alias("feature"), label.alias("label"), number.alias("value"),
        (display_value(number, unit) if text is None else F.coalesce(text, F.lit("None"))).alias("display_value"),
        part.alias("contribution"), F.when(part > 0, "increases risk").otherwise("reduces risk").alias("direction"))


def linear_contributions(weights: dict[str, tuple[float, float]]) -> Column:
    """Array of contributions coefficient * (x - mean): exact for a linear score."""
    def entry(feature: str, coefficient: float, mean: float) -> Column:
        value = F.col(feature).cast("double")
        return contribution(feature, value, F.coalesce(F.lit(float(coefficient)) * (value - F.lit(float(mean))), F.lit(0.0)))

    return F.array(*[entry(f, c, m) for f, (c, m) in weights.items()])


def strongest(contributions: Column, n: int | Column) -> Column:
    """The n entries with the largest absolute contribution, largest first."""
    keyed = F.transform(contributions, lambda c: F.struct(
        (-F.abs(c["contribution"])).alias("size"), c["feature"].alias("name"), c.alias("entry")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda k: k["entry"])


def example_picks(df: DataFrame, score: str, key: str) -> DataFrame:
    """(tag, key, score) of the highest, the middle and the lowest score; ties go by key."""
    n = df.agg(F.count(F.lit(1))).scalar()
    ranked = positions(df.select(key, score, (-F.col(score)).alias("_down")), ["_down", key], "_place")
    tag = (F.when(F.col("_place") == 1, "highest_risk").when(F.col("_place") == n, "lowest_risk")
           .when(F.col("_place") == F.floor(n / 2) + 1, "typical"))
    return ranked.select(tag.alias("tag"), key, score).where(F.col("tag").isNotNull())


def global_importance(df: DataFrame, contributions: str, features: list[str]) -> DataFrame:
    """Mean absolute contribution per feature, without unfolding the rows."""
    means = df.agg(*[
        F.avg(F.abs(F.get(F.col(contributions), F.lit(i))["contribution"])).alias(f"m{i}")
        for i in range(len(features))])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("importance"))
        for i, f in enumerate(features)])))


def dependence_curve(df: DataFrame, feature: str, contribution: str,
                     bins: int = DEPENDENCE_BINS) -> DataFrame:
    """Mean feature value and mean contribution in value-quantile bins, tails trimmed."""
    x = F.col(feature)
    ends = exact_quantiles(df, [], x, {"low": 0.01, "high": 0.99})
    kept = df.where(x.between(ends.select("low").scalar(), ends.select("high").scalar()))
    inner = {f"q{i}": i / bins for i in range(0, bins)}
    edges = exact_quantiles(kept, [], x, inner).select(F.array_distinct(F.array(*inner))).scalar()
    slotted = kept.withColumn("_edges", edges).withColumn(
        "_slot", F.greatest(F.size(F.filter("_edges", lambda e: e < x)), F.lit(1)))
    return slotted.groupBy(F.col("_slot").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(feature).alias("x"), F.avg(contribution).alias("contribution"))


# ---------------------------------------------------------------- trees
def tree_nodes(spark: SparkSession, saved_model: str) -> DataFrame:
    """Node table of a saved boosted or bagged tree model."""
    nodes = spark.read.parquet(f"{saved_model}/data")
    weights = spark.read.parquet(f"{saved_model}/treesMetadata").toDF("treeID", "metadata", "weights")
    return nodes.join(weights, "treeID").select(
        "treeID", "weights", "nodeData.id", "nodeData.prediction", "nodeData.leftChild",
        "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("rule"),
        F.col("nodeData.split.numCategories").alias("categories"))


def tree_contributions(df: DataFrame, nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per-row feature contributions along the decision paths of all trees.

    Each step down a tree changes the expected value; the change counts for the
    feature that split. The node table is as large as the model, never the data.
    """
    import numpy as np
    import pandas as pd

    table = nodes.toPandas().sort_values(["treeID", "id"])
    trees = []
    for _, part in table.groupby("treeID"):
        trees.append({
            "w": float(part["weights"].iloc[0]), "value": part["prediction"].to_numpy(float),
            "left": part["leftChild"].to_numpy(int), "right": part["rightChild"].to_numpy(int),
            "feature": part["feature"].to_numpy(int), "rule": part["rule"].tolist(),
            "nominal": part["categories"].to_numpy(int) >= 0})
    width = len(columns)

    def explain(batches: Iterator) -> Iterator:
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            out = np.zeros((len(batch), width))
            for tree in trees:
                def walk(node: int, rows) -> None:
                    if len(rows) == 0 or tree["left"][node] < 0:
                        return
                    f, rule = tree["feature"][node], tree["rule"][node]
                    v = x[rows, f]
                    goes_left = np.isin(v, rule) if tree["nominal"][node] else v <= rule[0]
                    for child, taken in ((tree["left"][node], rows[goes_left]),
                                         (tree["right"][node], rows[~goes_left])):
                        out[taken, f] += tree["w"] * (tree["value"][child] - tree["value"][node])
                        walk(child, taken)

                walk(0, np.arange(len(batch)))
            result = pd.DataFrame(out, columns=[f"c_{c}" for c in columns])
            result.insert(0, key, batch[key].to_numpy())
            yield result

    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, " + ", ".join(f"c_{c} DOUBLE" for c in columns)
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(explain, schema)
