"""Documents packed into sequences of a fixed number of tokens.

Every document is tokenised once, ends with the end id, and is cut only if it is
longer than a sequence: into whole sequences, with the shorter piece first. What
is left to pack is a histogram of at most ``CAPACITY`` lengths, whatever the number
of documents, so the packing itself is a small problem on the driver:

* the configuration linear program (how often to use each set of lengths that fits
  a sequence) is solved by multiplicative weights: a length that lags behind in
  coverage gets a higher price, and a knapsack dynamic program finds, for each
  length, the most valuable set that contains it;
* the fractional solution is rounded down, and what is left over goes by best fit, largest
  length first, into its sequences and new ones, with equal sequences counted, not listed.

Pieces of one length are interchangeable. They are numbered inside salted groups,
so a length that a third of all rows share is no hot group, and each takes the
place that its number has in the plan.

Defined cases: a null text is empty and gives one piece with the end id alone;
repeated rows are packed as often as they occur; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import contextlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legwise.llm.text import slices, table_batch
from legwise.session import settle

CAPACITY = 2048
END_ID = 0
ROUNDS = 120
COLUMNS_A_ROUND = 96
RATE = 0.5
SLOPE = 6.0
GROUP_ROWS = 100_000
BATCH_ROWS = 256

#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])


def default_tokenizer() -> str:
    """Place of the byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts by a vocabulary file of the tokenizers library.

    A plain byte-level vocabulary whose ids rise with the order of its merges is read into
    tiktoken, which gives the same ids in a third of the time; texts with a special token's
    string, texts that tiktoken refuses (its pattern gives up on a million blanks in a row),
    and all other vocabularies are left to tokenizers itself.
    """

    def __init__(self, place: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores already
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(place)
        with open(place, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told.get("added_tokens") or []]
        self.fast = self._fast(told)

    @staticmethod
    def _fast(told: dict):
        import tiktoken

        model, before = told["model"], told.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and not told.get("normalizer") and before.get("type") == "ByteLevel"
            and before.get("use_regex") and not before.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        if not plain:
            return None
        letters, vocab = _byte_of(), model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or any(c not in letters for token in vocab for c in token):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            with contextlib.suppress(ValueError):
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    place = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Encoder(place)
        for batch in slices(batches, BATCH_ROWS):
            rows = []
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(ids_of(words or ""), np.array([END_ID], "<u4"))
                rows += [(doc, i, start, n, zlib.crc32(ids[start:start + n].tobytes()))
                         for i, (start, n) in enumerate(cut(len(ids), capacity))]
            yield table_batch(PIECES, **dict(zip(PIECES.names, map(list, zip(*rows)))))

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Knapsack:
    """Most valuable filling of every capacity by given lengths, each usable again and again."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int):
        self.lengths = lengths
        self.value = np.zeros(capacity + 1)
        self.pick = np.full(capacity + 1, -1, np.int32)
        for room in range(1, capacity + 1):
            end = int(np.searchsorted(lengths, room, "right"))
            self.value[room], self.pick[room] = self.value[room - 1], -1
            if end:
                tried = self.value[room - lengths[:end]] + prices[:end]
                best = int(np.argmax(tried))
                if tried[best] > self.value[room]:
                    self.value[room], self.pick[room] = tried[best], best

    def filling(self, room: int) -> list[int]:
        """Indices of the lengths that fill ``room`` best."""
        chosen = []
        while room > 0:
            i = int(self.pick[room])
            if i < 0:
                room -= 1
            else:
                chosen.append(i)
                room -= int(self.lengths[i])
        return chosen


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict, float]:
    """Amounts of configurations by multiplicative weights, and a lower bound on all sequences.

    A configuration is a sorted tuple of indices into ``lengths``. A step takes a part of what
    is uncovered of its scarcest length, so no length is covered more than once. The bound is
    the value of the best prices seen: no set that fits a sequence is worth more than one.
    """
    left, amounts, bound = counts.astype(float), {}, 0.0
    for _ in range(rounds):
        live = np.flatnonzero(left >= 1)
        if not len(live):
            break
        behind = left[live] / counts[live]
        prices = lengths[live] * np.exp(SLOPE * (behind - behind.max()))
        sack = Knapsack(lengths[live], prices, capacity)
        if len(live) == len(lengths):
            bound = max(bound, float((counts * prices).sum() / sack.value[capacity]))
        value = prices + sack.value[capacity - lengths[live]]
        for i in np.argsort(-value, kind="stable")[:COLUMNS_A_ROUND]:
            chosen = live[sorted([int(i), *sack.filling(capacity - int(lengths[live[i]]))])]
            kinds, times = np.unique(chosen, return_counts=True)
            step = RATE * float((left[kinds] / times).min())
            if step > 0:
                key = tuple(chosen.tolist())
                amounts[key] = amounts.get(key, 0.0) + step
                left[kinds] -= step * times
    return amounts, bound


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int,
             begun: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """The pieces that are left, largest first, each into the fullest begun or new sequence that takes it.

    Sequences with the same content are one group with a number, and a length either fills up
    a group or is used up, so there are a few groups for each length whatever the numbers are.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(chosen: tuple[int, ...], room: int, number: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((chosen, number))

    for chosen, number in begun:
        put(chosen, capacity - int(lengths[list(chosen)].sum()), number)
    for i in range(len(lengths) - 1, -1, -1):
        length, number = int(lengths[i]), int(left[i])
        while number:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(number, capacity // length)
                put((i,) * each, capacity - each * length, number // each)
                number %= each
                continue
            room = rooms[at]
            chosen, held = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            filled = min(held, number)
            if held > filled:
                put(chosen, room, held - filled)
            put((*chosen, i), room - length, filled)
            number -= filled
    return [g for found in groups.values() for g in found]


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY,
                   rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """Whole numbers of configurations that hold every piece, and the lower bound."""
    if not len(lengths):
        return [], 0.0
    amounts, bound = fractional(lengths, counts, capacity, rounds)
    left, made = counts.astype(np.int64).copy(), []
    for chosen, amount in sorted(amounts.items()):
        kinds, times = np.unique(chosen, return_counts=True)
        number = int(min(np.floor(amount), (left[kinds] // times).min()))
        if number > 0:
            left[kinds] -= number * times
            made.append((chosen, number))
    return best_fit(lengths, left, capacity, made), bound


@dataclass
class Places:
    """For each length, runs of piece numbers with the sequence and offset they take."""

    first: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    total: int

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, (length << 48) + number, "right") - 1
        within = number - (self.first[at] & ((1 << 48) - 1))
        return self.base[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def places(lengths: np.ndarray, made: list[tuple[tuple[int, ...], int]]) -> Places:
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, number in made:
        offset = 0
        for kind, times in zip(*np.unique(chosen, return_counts=True)):
            length = int(lengths[kind])
            rows.append(((length << 48) + used.get(length, 0), sequence, int(times), offset))
            used[length] = used.get(length, 0) + number * int(times)
            offset += length * int(times)
        sequence += number
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Places(*(np.ascontiguousarray(table[:, i]) for i in range(4)), sequence)


def numbered(cut_up: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``cut_up`` with the column number: 0, 1, ... among the pieces of one length."""
    size = max(histogram, default=0) + 1
    salts = F.array(*[F.lit(-(-histogram.get(n, 0) // GROUP_ROWS) or 1) for n in range(size)])
    same = ["length", "salt"]
    salted = cut_up.withColumn("salt", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(salts, F.col("length").cast("int"))))
    held = salted.groupBy(*same).agg(F.count("*").alias("held"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*same, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*same).orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, same).withColumn("number", F.col("before") + F.col("rank")).drop("salt", "rank", "before")


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", capacity: int = CAPACITY,
         rounds: int = ROUNDS) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    cut_up = settle(pieces(docs, tokenizer, text, capacity))
    histogram = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    whole = lengths == capacity
    made, _ = configurations(lengths[~whole], counts[~whole], capacity, rounds)
    if whole.any():
        made = [*made, ((int(np.flatnonzero(whole)[0]),), int(counts[whole][0]))]
    shared = docs.sparkSession.sparkContext.broadcast(places(lengths, made))  # bounded by the lengths and the rounds
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                              for c in ("length", "number"))
            sequence, offset = shared.value.of(length, number)
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in PIECES.names}
            yield table_batch(schema, **kept, sequence_id=sequence, offset=offset)

    return numbered(cut_up, histogram).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, `offset` bigint")
