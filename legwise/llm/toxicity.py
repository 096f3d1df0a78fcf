"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its terms, hashed to buckets. The score is the logistic function
of a bias, a weight for each active bucket, and the inner products of the latent vectors
of all pairs of active buckets, so that two terms together can mean more than the
sum of both. The machine is fitted on at most about ``SAMPLE_ROWS`` labelled rows,
chosen by a hash of their id; texts with the same terms count once there. It keeps the
``FEATURES`` buckets whose share differs most surely between the two labels, in all texts or
in those that hold one of the ``STRONG`` surest buckets: a term may matter only beside another.
Nothing but this number cuts them; it bounds what is broadcast and what of the sample reaches the driver.

Defined cases: a null or blank text gets the score of the bias alone; a null label is no
label; a doc_id with several labels is toxic if one says so; without labelled rows of both
kinds every score is 0.0; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legwise.llm.text import slices, table_batch, utf8
from legwise.session import settle

TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
BUCKETS = 1 << 20
SAMPLE_ROWS = 20_000
FEATURES = 4096
STRONG = 16
FACTORS = 8
EPOCHS = 60
BATCH = 256
RATE = 0.1
DECAY = 1e-4
BATCH_ROWS = 500
MEMO = 1 << 20


def bucket(term: bytes) -> int:
    return zlib.crc32(term) & (BUCKETS - 1)


def terms(text: bytes | None) -> set[bytes]:
    """Terms of a text: runs of letters and digits, A-Z lower-cased."""
    return set(TERM.findall(text.lower())) if text else set()


@dataclass
class Machine:
    """Weights of the kept buckets; ``place`` maps a bucket to its row."""

    place: dict[int, int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, active: np.ndarray) -> float:
        """Bias, single weights and pair products of one set of rows."""
        v = self.factor[active]
        s = v.sum(axis=0)
        return float(self.bias + self.weight[active].sum() + 0.5 * (s @ s - (v * v).sum()))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _sure(yes: Column, no: Column) -> Column:
    """How surely the share of with_yes in ``yes`` texts differs from that of the others in ``no`` texts."""
    a, b = F.col("with_yes") / yes, (F.col("with_any") - F.col("with_yes")) / no
    pooled = (F.col("with_any") + 1) / (yes + no + 2)
    return F.abs(a - b) / F.sqrt(pooled * (1 - pooled) * (1 / yes + 1 / no))


def kept_buckets(sets: DataFrame) -> list[int]:
    """The buckets whose share of texts differs most surely between the labels, at most ``FEATURES``.

    The difference counts over all texts, or over the texts that hold one of the surest buckets.
    ``sets`` has a label and the active buckets of each text; counts are combined before the shuffle.
    """
    totals = sets.agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).first()
    yes, no = totals["yes"] or 0, totals["no"] or 0
    if not yes or not no:
        return []
    count = (F.sum("label").alias("with_yes"), F.count("*").alias("with_any"))
    counts = settle(sets.select("label", F.explode("active").alias("bucket")).groupBy("bucket").agg(*count).where(
        "with_any >= 3").withColumn("sure", _sure(F.lit(yes), F.lit(no))))
    strong = [r["bucket"] for r in counts.orderBy(F.desc("sure"), "bucket").limit(STRONG).collect()]
    beside = sets.select("label", "active", F.explode(
        F.array_intersect("active", F.lit(strong).cast("array<bigint>"))).alias("strong"))
    inside = beside.groupBy("strong").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).where(
        "yes > 0 AND no > 0")
    paired = beside.select("label", "strong", F.explode("active").alias("bucket")).where("bucket <> strong").groupBy(
        "strong", "bucket").agg(*count).where("with_any >= 3").join(F.broadcast(inside), "strong").select(
        "bucket", _sure(F.col("yes"), F.col("no")).alias("sure"))
    best = counts.select("bucket", "sure").unionByName(paired).groupBy("bucket").agg(F.max("sure").alias("sure"))
    return sorted(r["bucket"] for r in best.orderBy(F.desc("sure"), "bucket").limit(FEATURES).collect())


def _sums(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` that have the same place."""
    return np.stack([np.bincount(place, column, size) for column in values.T], axis=1)


def fit(rows: list[tuple[int, np.ndarray]], kept: list[int], seed: int = 7) -> Machine | None:
    """A machine from (label, kept buckets of a text) rows, ``kept`` in order; None unless both labels occur."""
    place = {b: i for i, b in enumerate(kept)}
    labels = np.array([label for label, _ in rows], np.float64)
    yes, no = labels.sum(), (1 - labels).sum()
    if not yes or not no:
        return None
    active = [np.searchsorted(kept, found) for _, found in rows]
    rng = np.random.default_rng(seed)
    size = len(kept)
    machine = Machine(place, float(np.log(yes / no)), np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    if not size:
        return machine
    seen_w, seen_v, seen_b = np.full(size, 1e-8), np.full((size, FACTORS), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            flat = np.concatenate([active[i] for i in chosen])
            doc = np.repeat(np.arange(len(chosen)), [len(active[i]) for i in chosen])
            v = machine.factor[flat]
            s = _sums(doc, v, len(chosen))
            square = np.bincount(doc, (v * v).sum(axis=1), len(chosen))
            raw = machine.bias + np.bincount(doc, machine.weight[flat], len(chosen)) + 0.5 * ((s * s).sum(axis=1) - square)
            error = (_logistic(raw) - labels[chosen]) / len(chosen)
            gw = np.bincount(flat, error[doc], size) + DECAY * machine.weight
            gv = DECAY * machine.factor + _sums(flat, error[doc, None] * (s[doc] - v), size)
            gb = error.sum()
            seen_w, seen_v, seen_b = seen_w + gw * gw, seen_v + gv * gv, seen_b + gb * gb
            machine.weight -= RATE * gw / np.sqrt(seen_w)
            machine.factor -= RATE * gv / np.sqrt(seen_v)
            machine.bias -= RATE * gb / np.sqrt(seen_b)
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """Fit on the labelled rows among ``docs``: all of them, or about ``sample_rows`` by a hash of the id."""
    said = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = min(1.0, sample_rows / max(1, said.count()))
    chosen = said.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # bounded by sample_rows, so it may be broadcast
    picked = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string")).join(
        F.broadcast(chosen), "id").select("label", "text")
    schema = pa.schema([("label", pa.int32()), ("active", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            yield table_batch(schema, label=batch.column(0),
                              active=[sorted({bucket(t) for t in terms(x)}) for x in utf8(batch.column(1))])

    told = picked.mapInArrow(run, "label int, active array<bigint>")
    sets = settle(told.groupBy("active").agg(F.max("label").alias("label")))
    kept = kept_buckets(sets)
    found = F.array_intersect("active", F.lit(kept).cast("array<bigint>"))
    rows = sets.select("label", F.array_sort(found).alias("found")).orderBy("found", "label").toArrow()
    return fit([(label, found.values.to_numpy()) for label, found in zip(
        rows["label"].to_pylist(), rows["found"])], kept)


def predict(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every text."""
    parts = machine and (machine.place, machine.bias, machine.weight, machine.factor)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value and Machine(*shared.value)
        memo: dict[bytes, int] = {}

        def rows_of(text: bytes | None) -> np.ndarray:
            found = set()
            for term in terms(text):
                row = memo.get(term)
                if row is None:
                    row = memo[term] = made.place.get(bucket(term), -1)
                if row >= 0:
                    found.add(row)
            if len(memo) > MEMO:
                memo.clear()
            return np.array(sorted(found), np.int64)

        for batch in slices(batches, BATCH_ROWS):
            scores = [float(_logistic(made.raw(rows_of(t)))) if made else 0.0 for t in utf8(batch.column(1))]
            yield table_batch(schema, doc_id=batch.column(0), score=scores)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, score double")
