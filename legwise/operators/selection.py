"""Feature selection: mutual information, gain, correlation pruning, elimination, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legwise.operators.ordering import average_ranks
from legwise.operators.wide import column_quantiles, correlation_pairs, label_histograms
from legwise.session import settle

# Correlation limit, penalty of a pruned feature, final feature count, step share.
MAX_CORRELATION = 0.95
PRUNED_PENALTY = 1000
TOP_FEATURES = 45
ELIMINATION_STEP = 0.12
MI_BINS = 10


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = MI_BINS) -> DataFrame:
    """Mutual information in nats between each feature, in quantile bins, and a 0/1 label.

    All rows count. Equal values share a bin and missing values have their own. Bins are counted
    inside the tasks; no row is unfolded by column.
    """
    rows = settle(df.select(label, *features))
    edges = column_quantiles(rows, features, [i / bins for i in range(1, bins)])
    cells = label_histograms(rows, features, {f: sorted(set(e)) for f, e in edges.items()}, label)
    n = F.sum("n").over(Window.partitionBy("feature"))
    nx = F.sum("n").over(Window.partitionBy("feature", "bin"))
    ny = F.sum("n").over(Window.partitionBy("feature", "y"))
    terms = cells.select("feature", (F.col("n") / n * F.log(F.col("n") * n / (nx * ny))).alias("term"))
    return terms.groupBy("feature").agg(F.greatest(F.sum("term"), F.lit(0.0)).alias("mutual_information"))


def correlation_prune(df: DataFrame, columns: list[str], gain: dict[str, float],
                      limit: float = MAX_CORRELATION) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Drop the weaker one of each closely correlated pair of columns.

    Only the pairs of column names above the limit reach the driver. A column
    meets the columns before it; a dropped column takes no further part; on equal
    gain the earlier one goes.
    """
    close = correlation_pairs(df, columns).where(F.abs("r") > limit).collect()
    place = {c: i for i, c in enumerate(columns)}
    dropped: set[str] = set()
    decided = []
    for row in sorted(close, key=lambda r: (place[r["b"]], place[r["a"]])):
        earlier, later = row["a"], row["b"]
        if dropped & {earlier, later}:
            continue
        loser = later if gain.get(later, 0.0) < gain.get(earlier, 0.0) else earlier
        dropped.add(loser)
        decided.append((earlier if loser == later else later, loser, abs(row["r"])))
    return [c for c in columns if c not in dropped], decided


def gain_importance(model, columns: list[str]) -> dict[str, float]:
    """Importances of a fitted tree model by source column, summing to one."""
    values = [float(v) for v in model.featureImportances.toArray()]
    total = sum(values) or 1.0
    return {c: v / total for c, v in zip(columns, values)}


def recursive_elimination(fit, columns: list[str], keep: int, step: float = ELIMINATION_STEP) -> dict[str, int]:
    """Rank features by refitting and dropping the weakest share each round.

    ``fit(columns)`` returns importances by column; kept features get rank 1,
    the ones dropped last rank 2, and so on.
    """
    share = max(1, int(step * len(columns)))
    remaining, rounds = list(columns), []
    while len(remaining) > keep:
        importance = fit(remaining)
        weakest = sorted(remaining, key=lambda c: importance[c])[:min(share, len(remaining) - keep)]
        rounds.append(weakest)
        remaining = [c for c in remaining if c not in weakest]
    ranks = {c: 1 for c in remaining}
    for back, names in enumerate(reversed(rounds), 2):
        ranks |= {c: back for c in names}
    return ranks


def consensus(scores: DataFrame, feature: str, descending: list[str], ascending: list[str],
              pruned: str, k: int = TOP_FEATURES) -> DataFrame:
    """The k features with the best mean rank; missing scores are skipped, pruned ones go last."""
    ranked, names = scores, []
    for column in [*descending, *ascending]:
        names.append(f"rank_{column}")
        ranked = average_ranks(ranked, column, names[-1], ascending=column in ascending)
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    rank = F.try_divide(total, known) + F.when(F.col(pruned), PRUNED_PENALTY).otherwise(0)
    return ranked.withColumn("consensus_rank", rank).orderBy("consensus_rank", feature).limit(k)


def group_mix(selected: DataFrame, group: str) -> DataFrame:
    return selected.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
