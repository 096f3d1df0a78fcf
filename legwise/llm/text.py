"""Small text and table helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = "\\x20\\x09-\\x0D"
LETTER = r"[^\W\d_]"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the bundled tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def id_remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id's digits modulo ``divisor``; a missing id counts as empty text."""
    digits = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(digits.cast("binary")) % F.lit(divisor)


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; bytes.split cuts at ASCII blanks only."""
    return text.lower().split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def table_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """An Arrow batch with the columns of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()],
        schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that long texts stay few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
