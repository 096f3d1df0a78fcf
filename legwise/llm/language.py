"""Language identification by prediction by partial matching over bytes.

Every language gets a tree of byte contexts of up to three symbols. A symbol
never seen in a context escapes to the next shorter one, over the symbols not
seen there (escape method C with exclusion), down to a uniform choice. The
statistics cover the whole text of every training row, are counted by Spark and
then frozen; a text is assigned to the language with the shortest code length.

A context is kept when it holds at least ``KEEP`` of its language's training
symbols, so a language keeps at most 3 / KEEP contexts at any corpus size, and
the frozen table that is broadcast is bounded by that.

Defined cases: a null text and a text without a letter give ``und`` and score
0.0; a tie goes to the first language by name; without training rows every
answer is ``und``; rows without a language or a text are not learned from;
repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from legwise.llm.text import LETTER, slices, table_batch

ORDER = 3
KEEP = 1 / 50_000
UNKNOWN = "und"
PIECE = 1 << 18
FLUSH = 1 << 22
BATCH_ROWS = 500

BLANK_SYMBOL, DIGIT_SYMBOL, MARK_SYMBOL, LETTER_SYMBOLS = 0, 1, 2, 3
SYMBOLS = LETTER_SYMBOLS + 26 + 128


def _symbol_table() -> np.ndarray:
    """Symbol of each byte: letters without case, three classes of ASCII, high bytes as they are."""
    table = np.full(256, MARK_SYMBOL, np.int32)
    table[[9, 10, 11, 12, 13, 32]] = BLANK_SYMBOL
    table[ord("0"):ord("9") + 1] = DIGIT_SYMBOL
    for first in (ord("a"), ord("A")):
        table[first:first + 26] = LETTER_SYMBOLS + np.arange(26)
    table[128:] = LETTER_SYMBOLS + 26 + np.arange(128)
    return table


SYMBOL_OF = _symbol_table()
HAS_LETTER = re.compile(LETTER)


def _symbols(text: bytes) -> np.ndarray:
    """Symbols of a text after ``ORDER`` blanks, which are its first context."""
    return np.concatenate([np.zeros(ORDER, np.int32), SYMBOL_OF[np.frombuffer(text, np.uint8)]])


def _grams(text: bytes) -> np.ndarray:
    s = _symbols(text)
    code = s[:-ORDER].copy()
    for i in range(1, ORDER + 1):
        code = code * SYMBOLS + s[i:len(s) - ORDER + i]
    return code


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each context with its next symbol occurs in a language."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), defaultdict(int)

        def flush(name: str) -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held.pop(name)), return_counts=True)
            del size[name]
            return table_batch(schema, lang=[name] * len(gram), gram=gram.astype(np.int64), n=n.astype(np.int64))

        for batch in slices(batches, BATCH_ROWS):
            for words, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = words.encode()
                for at in range(0, len(raw), FLUSH):  # a long text goes on with its own last bytes
                    piece = raw[max(0, at - ORDER):at + FLUSH]
                    grams = _grams(piece)[ORDER if at else 0:]
                    held[name].append(grams)
                    size[name] += len(grams)
                    if size[name] >= FLUSH:
                        yield flush(name)
        for name in list(held):
            yield flush(name)

    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(text).cast("string"), F.col(lang).cast("string"))
    return known.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


@dataclass
class Model:
    """Frozen contexts: ``steps[k]`` leads from a context of k symbols to one of k + 1 (0: none)."""

    languages: list[str]
    steps: list[np.ndarray]
    first_row: list[int]
    bits: np.ndarray

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits that each language's tree needs for the whole text."""
        total = np.zeros(len(self.languages))
        s = _symbols(text)
        for at in range(0, len(s) - ORDER, PIECE):
            part = s[at:at + PIECE + ORDER]
            now = part[ORDER:]
            row = np.zeros(len(now), np.int32)
            ids = None
            for k, step in enumerate(self.steps):
                symbol = part[k:-1]  # ids[t]: context of k + 1 symbols that ends with symbol t
                ids = step[symbol] if ids is None else step[ids[:-1] * SYMBOLS + symbol]
                last = ids[len(ids) - len(now):]
                row = np.where(last > 0, last + self.first_row[k], row)
            total += self.bits.take(row.astype(np.int64) * SYMBOLS + now, axis=0).sum(axis=0, dtype=np.float64)
        return total

    def answer(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not HAS_LETTER.search(text):
            return UNKNOWN, 0.0
        bits = self.code_lengths(text.encode())
        best = int(np.argmin(bits))
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())


def _freeze(languages: list[str], counted: list[tuple]) -> Model:
    """Contexts, steps and code lengths from rows (order, lang, context, symbol, n)."""
    if not languages:
        return Model([], [], [], np.zeros((0, 0), np.float32))
    spot = {name: i for i, name in enumerate(languages)}
    per_order = [defaultdict(dict) for _ in range(ORDER + 1)]
    for order, name, context, symbol, n in counted:
        per_order[order][context].setdefault(spot[name], []).append((symbol, n))
    count = len(languages)
    uniform = np.full((SYMBOLS, count), 1 / SYMBOLS)

    def refine(shorter: np.ndarray, seen: dict) -> np.ndarray:
        out = shorter.copy()
        for i, pairs in seen.items():
            symbol, n = (np.array(x) for x in zip(*pairs))
            rest = np.delete(np.arange(SYMBOLS), symbol)
            escape = len(symbol) if len(rest) else 0
            whole = n.sum() + escape
            if len(rest):
                out[rest, i] *= escape / whole / out[rest, i].sum()
            out[symbol, i] = n / whole
        return out

    numbers: list[dict] = [{0: 0}]
    chances, first_row = [refine(uniform, per_order[0].get(0, {}))], []
    tables, shorter_of = [np.stack(chances)], {0: chances[0]}
    steps = []
    for order in range(1, ORDER + 1):
        kept = sorted(per_order[order])
        ids = {context: i + 1 for i, context in enumerate(kept)}
        step = np.zeros(SYMBOLS * (len(numbers[-1]) + (order > 1)), np.int32)
        now = {}
        for context in kept:
            before, symbol = divmod(context, SYMBOLS)
            if order == 1 or before in numbers[-1]:
                step[(numbers[-1][before] * SYMBOLS if order > 1 else 0) + symbol] = ids[context]
            now[context] = refine(shorter_of[context % SYMBOLS ** (order - 1)], per_order[order][context])
        first_row.append(sum(len(t) for t in tables) - 1)
        if kept:
            tables.append(np.stack([now[c] for c in kept]))
        steps.append(step)
        numbers.append(ids)
        shorter_of = now
    bits = (-np.log2(np.concatenate(tables))).astype(np.float32).reshape(-1, count)
    return Model(languages, steps, first_row, bits)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all rows of ``docs`` and freeze the contexts that reach ``KEEP``."""
    orders = [
        F.struct(F.lit(k).alias("order"), F.expr(f"gram % {SYMBOLS ** (k + 1)}").alias("tail"))
        for k in range(ORDER + 1)
    ]
    grams = gram_counts(docs, text, lang).select("lang", "n", F.inline(F.array(*orders)))
    counted = grams.groupBy("lang", "order", "tail").agg(F.sum("n").alias("n")).select(
        "lang", "order", F.expr(f"tail div {SYMBOLS}").alias("context"),
        F.expr(f"tail % {SYMBOLS}").cast("int").alias("symbol"), "n")
    totals = counted.groupBy("lang", "order", "context").agg(F.sum("n").alias("held"))
    whole = totals.where("order = 0").select("lang", F.col("held").alias("whole"))
    kept = totals.join(whole, "lang").where(F.col("held") >= F.col("whole") * KEEP)
    rows = counted.join(kept.select("lang", "order", "context"), ["lang", "order", "context"]).select(
        "order", "lang", "context", "symbol", "n").collect()
    return _freeze(sorted({r.lang for r in rows}), [tuple(r) for r in rows])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text_to_name"))
    shape = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            named = [shared.value.answer(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for n, _ in named], pa.string()),
                 pa.array([s for _, s in named], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, shape)


def keep_named(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text gets a language; the others go."""
    columns = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.col("text").alias("words"))
    named = predict(packed, model, "words", (F.col("row"),)).where(F.col("lang_pred") != UNKNOWN)
    return named.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
