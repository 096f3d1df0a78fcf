"""Type coercion, category codes and model-ready projections."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in order and without repeats."""
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in dict.fromkeys(wanted) if c not in df.columns]


def coerce_types(df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Categories as text, numbers as float; what cannot be read becomes NULL."""
    casts: dict[str, Column] = {c: F.col(c).cast("string") for c in categorical}
    casts |= {c: F.col(c).try_cast("float") for c in numeric}
    return df.withColumns(casts)


def fit_codes(train: DataFrame, columns: list[str]) -> StringIndexerModel:
    """Category levels of the training rows, in alphabetical order."""
    return StringIndexer(
        inputCols=columns, outputCols=[f"{c}_code" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)


def apply_codes(df: DataFrame, model: StringIndexerModel) -> DataFrame:
    """Codes of the fitted levels; unseen or missing categories become -1."""
    coded = model.transform(df)
    sizes = [len(levels) for levels in model.labelsArray]
    return coded.withColumns({
        c: F.when(F.col(c) < n, F.col(c)).otherwise(-1.0).cast("int")
        for c, n in zip(model.getOutputCols(), sizes)})


def fill_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing values take the default of their column."""
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def model_frame(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Features in model order with their types; absent ones are NULL."""
    return df.select(*[
        (F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c)
        for c, kind in features.items()])


def select_apart(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Select many expressions behind a chain of joins in an operator of its own.

    Spark generates one method for the joins and what follows them; the JVM never compiles one of more than 8,000 bytes, so
    each row is interpreted. A higher-order function, here around the first column, keeps the select out of that
    method, and its expressions become many short ones.
    """
    first, *rest = columns
    alone = F.get(F.transform(F.array(columns[first]), lambda x: x), F.lit(0)).alias(first)
    return df.select(alone, *[columns[c].alias(c) for c in rest])
