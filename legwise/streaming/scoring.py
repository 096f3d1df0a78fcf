"""Requests that arrive as files are scored as a stream.

The stream only meets static tables, so no state and no watermark is kept. The
checkpoint folder must be shared storage: a restarted query goes on where the
lost one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def request_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "json",
                   pattern: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream of rows."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(kind).load(folder)


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                 checkpoint: str, once: bool = True):
    """Write the scored stream as Parquet; with ``once`` stop after the files at hand."""
    writer = (
        score(requests).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_available(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                    checkpoint: str) -> None:
    """Score everything that has arrived, then stop."""
    score_stream(requests, score, out, checkpoint, once=True).awaitTermination()


def answer_batches(requests: DataFrame, answer: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str,
                   rejected: str, checkpoint: str) -> None:
    """Answer everything that has arrived, and put what cannot be answered into a quarantine, then stop.

    ``answer`` splits a batch into answers and rejects. Each batch owns a folder in either sink, and writing it
    again replaces it, so a batch that is repeated after a failure adds nothing twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        good, bad = answer(batch)
        good.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    query = (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def score_batches(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                  checkpoint: str) -> None:
    """As ``score_available`` for plans that need whole batches (scalars, settled tables).

    Each batch writes its own folder, so a repeated batch replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
