"""A fitted delay model as a saved artefact: one pipeline, its input contract, its calibration.

Everything between the feature columns and the probability is inside the Spark ML pipeline (types, pooled levels, imputation,
scaling, encoding, regression), so a loaded model needs nothing but the columns of its contract. The contract has a
row per number and per category level, with what each contributes to the log-odds: explanations come from the
same artefact as the probability.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legwise.operators import calibration, modelling
from legwise.operators.explanation import LABELS, contribution
from legwise.operators.projections import missing_columns
from legwise.operators.splits import halves_by_time
from legwise.plans.features import CATEGORICAL
from legwise.session import settle

#: The features chosen for serving: those with a label for people.
SERVED = [name for name, _, _ in LABELS]
CONTRACT = ("feature STRING, level STRING, kind STRING, fill DOUBLE, mean DOUBLE, weight DOUBLE, base DOUBLE, position INT")
FIT_TOLERANCE, FIT_STEPS = 1e-6, 200


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _typed(numeric: list[str], empty: set[str], levels: dict[str, list[tuple[str, int]]]) -> str:
    """A statement with one more column per feature: numbers as doubles, levels filled with the mode and pooled."""
    out = [f"{'CAST(0 AS DOUBLE)' if c in empty else f'CAST(`{c}` AS DOUBLE)'} AS `m_{c}`" for c in numeric]
    for c, known in levels.items():
        filled = f"COALESCE(CAST(`{c}` AS STRING), {_quoted(known[0][0]) if known else _quoted(modelling.MISSING_LEVEL)})"
        rare = [level for level, n in known if n < modelling.MIN_LEVEL_ROWS]
        pooled = (f"CASE WHEN {filled} IN ({', '.join(map(_quoted, rare))}) THEN {_quoted(modelling.POOLED_LEVEL)} ELSE {filled} END"
                  if rare else filled)
        out.append(f"{pooled} AS `m_{c}`")
    return f"SELECT *, {', '.join(out)} FROM __THIS__"


@dataclass
class RiskModel:
    """A pipeline with its contract; ``score`` adds the probability ``p``."""

    pipeline: PipelineModel
    contract: list[dict]
    calibrator: calibration.Calibrator | None = None

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(r["feature"] for r in self.contract if r["kind"] != "intercept"))

    def raw_score(self, df: DataFrame, out: str = "p") -> DataFrame:
        absent = missing_columns(df, self.features)
        if absent:
            raise ValueError(f"columns of the model's contract are missing: {absent}")
        return self.pipeline.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], vector_to_array("probability")[1].alias(out))

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        scored = self.raw_score(df, out)
        return self.calibrator.apply(scored, out, out) if self.calibrator else scored

    def contributions(self) -> Column:
        """Array with one entry per feature; with ``base`` they add up to the log-odds of the raw score."""
        entries, levels = [], {}
        for r in self.contract:
            if r["kind"] == "level":
                levels.setdefault(r["feature"], []).append(r)
            elif r["kind"] == "number":
                x = F.col(r["feature"]).cast("double")
                x = F.when(~F.isnan(x), x)
                part = F.lit(r["weight"]) * (F.coalesce(x, F.lit(r["fill"])) - F.lit(r["mean"]))
                entries.append(contribution(r["feature"], x, part))
        for feature, known in levels.items():
            level = F.col(feature).cast("string")
            filled = F.coalesce(level, F.lit(next((r["level"] for r in known if r["position"] == 0), modelling.MISSING_LEVEL)))
            # the mode comes first; rare levels share the pooled weight, unseen ones have none
            weights = F.create_map(*[F.lit(v) for r in known for v in (r["level"], r["weight"])])
            part = F.coalesce(F.try_element_at(weights, filled), F.lit(0.0)) - F.lit(known[0]["mean"])
            entries.append(contribution(feature, None, part, level))
        return F.array(*entries)

    @property
    def base(self) -> float:
        """Log-odds where nothing contributes."""
        return next(r["base"] for r in self.contract if r["kind"] == "intercept")

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().save(f"{path}/pipeline")
        spark.createDataFrame([tuple(r.values()) for r in self.contract], CONTRACT).coalesce(1).write.parquet(f"{path}/contract")
        # without a calibration the table is empty
        (self.calibrator or calibration.Calibrator.none()).save(spark, f"{path}/calibration")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        contract = [r.asDict() for r in spark.read.parquet(f"{path}/contract").orderBy("feature", "position").collect()]
        return cls(PipelineModel.load(f"{path}/pipeline"), contract, calibration.Calibrator.load(spark, f"{path}/calibration"))


def _contract(model: PipelineModel, numeric: list[str], levels: dict[str, list[tuple[str, int]]]) -> list[dict]:
    _, imputer, _, scaler, *rest = model.stages
    learner = rest[-1]
    coefficients = learner.coefficients.toArray()
    fills = imputer.surrogateDF.first().asDict()
    rows, base, at = [], float(learner.intercept), len(numeric)

    def row(feature, level, kind, fill=None, mean=None, weight=None, base=None, position=0):
        return dict(feature=feature, level=level, kind=kind, fill=fill, mean=mean, weight=weight, base=base, position=position)

    for c, w, s, m in zip(numeric, coefficients, scaler.std.toArray(), scaler.mean.toArray()):
        rows.append(row(c, None, "number", float(fills[f"m_{c}"]), float(m), float(w / s) if s else 0.0))
    indexed = dict(zip(levels, rest[0].labelsArray)) if levels else {}
    for c, names in indexed.items():
        own = {name: float(coefficients[at + i]) for i, name in enumerate(names)}
        at += len(names)
        counts = levels[c] or [(modelling.MISSING_LEVEL, 1)]
        pooled = own.get(modelling.POOLED_LEVEL, 0.0)
        shown = [(level, own.get(level, 0.0) if n >= modelling.MIN_LEVEL_ROWS or not levels[c] else pooled) for level, n in counts]
        total = sum(n for _, n in counts)
        mean = sum(w * n for (_, w), (_, n) in zip(shown, counts)) / total
        base += mean
        rows += [row(c, level, "level", None, mean, w, position=i) for i, (level, w) in enumerate(shown)]
    return [*rows, row("", None, "intercept", base=base)]


def fit(train: DataFrame, label: str, features: list[str] = SERVED) -> RiskModel:
    """Ridge logistic regression on any of the declared features; levels and fills come from these rows alone."""
    numeric = [c for c in features if c not in CATEGORICAL]
    categorical = [c for c in features if c in CATEGORICAL]
    absent = missing_columns(train, [*features, label])
    if absent:
        raise ValueError(f"columns to learn from are missing: {absent}")
    rows = settle(train.select(*features, F.col(label).cast("int").alias("_label")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in numeric]).first()
    levels = modelling.level_counts(rows, categorical) if categorical else {}
    m = lambda names, more="": [f"m_{c}{more}" for c in names]
    stages = [
        SQLTransformer(statement=_typed(numeric, {c for c in numeric if facts[c] == 0}, levels)),
        Imputer(strategy="median", relativeError=1e-4, inputCols=m(numeric), outputCols=m(numeric, "_filled")),
        VectorAssembler(inputCols=m(numeric, "_filled"), outputCol="m__numbers"),
        StandardScaler(inputCol="m__numbers", outputCol="m__scaled", withMean=True)]
    if categorical:
        stages += [
            StringIndexer(inputCols=m(categorical), outputCols=m(categorical, "_index"), handleInvalid="keep"),
            OneHotEncoder(inputCols=m(categorical, "_index"), outputCols=m(categorical, "_hot"))]
    stages += [
        VectorAssembler(inputCols=["m__scaled", *(m(categorical, "_hot"))], outputCol="m__features"),
        LogisticRegression(labelCol="_label", featuresCol="m__features", maxIter=FIT_STEPS, tol=FIT_TOLERANCE, standardization=False,
                           regParam=1.0 / (modelling.LOGISTIC_C * max(facts["n"], 1)), elasticNetParam=0.0)]
    model = Pipeline(stages=stages).fit(rows)
    return RiskModel(model, _contract(model, numeric, levels))


def calibrate(model: RiskModel, valid: DataFrame, label: str, time: str, key: str) -> tuple[RiskModel, calibration.Choice]:
    """The model with the calibration that the later half of the validation window bears out, if any."""
    scored = settle(model.raw_score(valid, "p").select(key, time, F.col(label).cast("int").alias("label"), "p"))
    choice = calibration.adopt(settle(halves_by_time(scored, time, key)), "p", "label", key, "half")
    return RiskModel(model.pipeline, model.contract, choice.calibrator), choice
