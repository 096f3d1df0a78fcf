"""CSV, Parquet and JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from legwise.sources.schemas import RAW_TABLES

# Texts that a CSV feed uses for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CORRUPT = "_corrupt"
INGEST_ORDER = "_ingest"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Whole table, or the named columns only (the scan then reads no others)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _typed(text: Column, kind: DataType) -> Column:
    """A text as its type, NULL if it is none; whole numbers may be written with a point."""
    if isinstance(kind, IntegralType):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header and a fixed schema.

    Every column is read as text. Missing-value texts become NULL in columns of any type. A row
    whose shape is wrong or that holds a text of another type keeps its text in ``_corrupt`` and
    the values that could be read. ``_ingest`` orders rows by file, block and line.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields] + [StructField(CORRUPT, StringType())])
    raw = (
        spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    )
    given = {f.name: F.when(~F.trim(F.col(f.name)).isin(*MISSING_TEXTS), F.col(f.name)) for f in schema.fields}
    typed = {f.name: given[f.name] if isinstance(f.dataType, StringType) else _typed(F.trim(given[f.name]), f.dataType)
             for f in schema.fields}
    odd = F.lit(False)
    for name in given:
        odd = odd | (given[name].isNotNull() & typed[name].isNull())
    line = F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in schema.fields])
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return raw.select(*[c.alias(n) for n, c in typed.items()],
                      F.coalesce(CORRUPT, F.when(odd, line)).alias(CORRUPT), place.alias(INGEST_ORDER))


def unreadable(df: DataFrame) -> DataFrame:
    """The quarantine of a CSV source: place and text of the rows that could not be read whole."""
    return df.where(F.col(CORRUPT).isNotNull()).select(INGEST_ORDER, CORRUPT)


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six raw tables of a folder of CSV files."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema)
            for name, schema in RAW_TABLES.items()}


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed, possibly nested schema."""
    return spark.read.schema(schema).json(path)
