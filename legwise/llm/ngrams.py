"""Language-model scores from a weighted backoff automaton over word pairs.

The automaton has a state for each word (what was read last; the end token stands
before a text) and a root. A state's arcs are the word pairs of the training texts
with their interpolated probability; its failure arc leads to the root with the
weight that the state keeps for pairs it has not seen; the root's arcs are the single
words. Reading a text once from left to right, the state is carried along and the
logarithms add up.

Pairs are known by a hash whose width follows the number of tokens (``SPARE_BITS``).

* Root: c - D of N for a word with count c, the rest, D * V of N, for an unknown
  word, with D = n1 / V (Good-Turing: words seen once stand for the unseen ones).
* State u: (1 - f) * c(u, w) / c(u) + f * root(w). The failure weight f depends on the
  magnitude of c(u) and is the leave-one-out estimate over all training texts: the
  share of tokens after such states whose pair occurs once.

The model of a large corpus fits no single task, so none holds it. Texts are encoded
in chunks. Each chunk asks for the counts of just the pairs and words that it
holds: sorted hashes go to shards by their leading bits, with the chunk's own training
counts, which are thereby summed; each shard answers each chunk. A pair or word is
sent once per chunk however frequent it is, so no key is hot. A chunk with its answers
is the part of the automaton that its texts can reach.

Defined cases: a null or blank text is its end token alone; repeated rows count each
time; without training texts V = N = 0 and each token has probability one; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legwise.llm.text import id_remainder, slices, table_batch, utf8, words
from legwise.session import settle

CHUNK_BYTES = 1 << 23
SHARD_TOKENS = 2_000_000
BATCH_ROWS = 200
#: A pair shares its hash with another pair with a chance of at most 2 to the minus this, at any size.
SPARE_BITS = 24
CLASSES = 64
MOST_DISCOUNT = 0.75
WORD, PAIR = 0, 1
END = b"\n"

ENCODED = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("hashes", pa.binary())])
ENCODED_DDL = ("chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, "
               "tokens binary, hashes binary")
ASKED = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("totals", pa.binary())])
KNOWN_DDL = ("doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, tokens binary, "
             "word_counts binary, pair_counts binary, stats array<double>")
KNOWN = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("tokens", pa.binary()), ("word_counts", pa.binary()), ("pair_counts", pa.binary()),
    ("stats", pa.list_(pa.float64()))])


def squeeze(values: np.ndarray) -> bytes:
    """A compressed array; bytes of equal weight stand together, which suits small numbers."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


class _Numbers(dict):
    """Numbers words as they come; the end token is number 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def encode(docs: DataFrame, held_out: F.Column, text: str = "text") -> DataFrame:
    """Chunks of texts as word numbers, with the 64-bit hash of each word of the chunk."""

    def pack(chunk: int, ids: list, held: list, lengths: list, tokens: list, numbers: _Numbers) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
        found = np.array(tokens, np.int32)
        # frequent words get small numbers, which take less room; the end token stays number 0
        order = np.concatenate([[0], 1 + np.argsort(-np.bincount(found, minlength=len(hashes))[1:], kind="stable")])
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        return table_batch(
            ENCODED, chunk=[chunk], doc_ids=[ids], held=[held], lengths=[lengths],
            tokens=[squeeze(number[found])], hashes=[squeeze(hashes[order])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids, held, lengths, tokens, numbers, size = [], [], [], [], _Numbers({END: 0}), 0
        for batch in slices(batches, BATCH_ROWS):
            for doc, out, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                found = words(raw)
                tokens.extend(map(numbers.__getitem__, found))
                tokens.append(0)
                ids.append(doc)
                held.append(out)
                lengths.append(len(found) + 1)
                size += len(raw or b"")
                if size >= CHUNK_BYTES:
                    yield pack(chunk, ids, held, lengths, tokens, numbers)
                    chunk += 1
                    ids, held, lengths, tokens, numbers, size = [], [], [], [], _Numbers({END: 0}), 0
        if ids:
            yield pack(chunk, ids, held, lengths, tokens, numbers)

    return docs.select(F.col("doc_id").cast("bigint"), held_out, F.col(text).cast("string")).mapInArrow(run, ENCODED_DDL)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash for two, in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The words and pairs of a chunk, in the order of their hashes."""

    def __init__(self, row: dict, pair_bits: int):
        tokens = unsqueeze(row["tokens"], np.int32)
        hashes = unsqueeze(row["hashes"], np.uint64)
        lengths = np.array(row["lengths"], np.int64)
        trained = np.repeat(~np.array(row["held"], bool), lengths)
        size = len(hashes)
        codes = np.zeros(len(tokens), np.int64)
        codes[1:] = tokens[:-1]  # a text starts after an end token, which is number 0
        codes *= size
        codes += tokens
        pairs, place = np.unique(codes, return_inverse=True)
        del codes
        self.pair_of = place.astype(np.int32)
        del place
        self.pair_train = np.bincount(self.pair_of[trained], minlength=len(pairs))
        self.word_train = np.bincount(tokens[trained], minlength=size)
        self.pair_state = pairs // size
        pair_hashes = _mixed(hashes[pairs // size], hashes[pairs % size]) >> np.uint64(64 - pair_bits)
        self.word_order, self.pair_order = np.argsort(hashes), np.argsort(pair_hashes)
        self.sorted = {WORD: hashes[self.word_order], PAIR: pair_hashes[self.pair_order]}
        self.train = {WORD: self.word_train[self.word_order], PAIR: self.pair_train[self.pair_order]}


def ask(encoded: DataFrame, bits: int, pair_bits: int) -> DataFrame:
    """(shard, chunk, keys, counts): the sorted hashes of a chunk cut into shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, pair_bits)
                for kind, width in ((WORD, 64), (PAIR, pair_bits)):
                    keys, counts = chunk.sorted[kind], chunk.train[kind]
                    shard = (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]]).tolist()
                    for a, b in zip(edges, edges[1:]):
                        if a < b:
                            steps = np.diff(keys[a:b], prepend=np.uint64(0))
                            yield table_batch(ASKED, shard=[2 * int(shard[a]) + kind], chunk=[row["chunk"]],
                                              keys=[squeeze(steps)], counts=[squeeze(counts[a:b].astype(np.int32))])

    return encoded.mapInArrow(run, "shard bigint, chunk bigint, keys binary, counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """(chunk, shard, totals): twice the training count of each key asked for, plus one in the chunk that owns it."""

    def merge(shard: pa.Table) -> pa.Table:
        rows = shard.sort_by("chunk").to_pylist()
        keys = [np.cumsum(unsqueeze(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        counts = np.concatenate([unsqueeze(r["counts"], np.int32) for r in rows])
        _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        totals = 2 * np.bincount(place, counts, len(first)).astype(np.int64)[place]
        totals[first] += 1
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({
            "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
            "shard": pa.array([r["shard"] for r in rows], pa.int64()),
            "totals": pa.array([squeeze(totals[e - len(k):e]) for k, e in zip(keys, ends)], pa.binary())})

    return asked.groupBy("shard").applyInArrow(merge, "chunk bigint, shard bigint, totals binary")


def magnitude(counts: np.ndarray) -> np.ndarray:
    """Class of a state by the size of its count; class 0 has not been seen."""
    return np.ceil(np.log2(counts + 1.0)).astype(np.int64)


def count_known(encoded: DataFrame, answered: DataFrame, pair_bits: int) -> DataFrame:
    """The chunks with the training count of each word and of the pair at each place, and with statistics.

    Statistics of what the chunk owns or trains: training tokens, distinct words, words seen once;
    then for each class of states the training tokens after them and the pairs seen once.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.to_pylist()[0], pair_bits)
        found = {WORD: [], PAIR: []}
        for r in right.sort_by("shard").to_pylist():
            found[r["shard"] % 2].append(unsqueeze(r["totals"], np.int64))
        total, owned = {}, {}
        for kind, order in ((WORD, chunk.word_order), (PAIR, chunk.pair_order)):
            said = np.concatenate(found[kind])
            total[kind], owned[kind] = np.empty_like(said), np.empty(len(said), bool)
            total[kind][order], owned[kind][order] = said >> 1, (said & 1) == 1
        words_in = owned[WORD] & (total[WORD] > 0)
        state_class = magnitude(total[WORD])
        after = np.bincount(state_class, chunk.word_train, CLASSES)
        once = np.bincount(state_class[chunk.pair_state], owned[PAIR] & (total[PAIR] == 1), CLASSES)
        stats = [chunk.word_train.sum(), words_in.sum(), (words_in & (total[WORD] == 1)).sum(), *after, *once]
        return pa.table({
            **{c: left.column(c) for c in ("doc_ids", "held", "lengths", "tokens")},
            "word_counts": pa.array([squeeze(total[WORD])], pa.binary()),
            "pair_counts": pa.array([squeeze(total[PAIR][chunk.pair_of])], pa.binary()),
            "stats": pa.array([[float(x) for x in stats]], pa.list_(pa.float64()))}).cast(KNOWN)

    return encoded.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(meet, KNOWN_DDL)


class Automaton:
    """Weights of the root's arcs, of failure arcs and of pair arcs, from the corpus statistics."""

    def __init__(self, stats: list[float]):
        self.tokens, self.words, once = (int(x) for x in stats[:3])
        after, single = np.array(stats[3:3 + CLASSES]), np.array(stats[3 + CLASSES:])
        self.discount = min(MOST_DISCOUNT, max(once, 0.5) / max(self.words, 1))
        # one more of either keeps the weight between 0 and 1
        self.failure = np.where(after > 0, (single + 1) / (after + 2), 1.0)
        self.failure[0] = 1.0

    def root(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, counts - self.discount, self.discount * self.words) / self.tokens

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + 1 * (self.words + 1)))

    def walk(self, tokens: np.ndarray, counts: np.ndarray, pair_counts: np.ndarray) -> np.ndarray:
        """Log-probability of each token, read from left to right with the state carried along."""
        state = np.concatenate([[0], tokens[:-1]])
        failing = self.failure[magnitude(counts)][state]
        arc = pair_counts / np.maximum(counts[state], 1)
        return np.log10((1 - failing) * arc + failing * self.root(counts)[tokens])


def score(docs: DataFrame, divisor: int = 7, held_remainder: int = 2, text: str = "text") -> DataFrame:
    """Scores of all texts under the model of those outside the held-out residue class of ids."""
    held_out = (id_remainder(divisor) == held_remainder).alias("held")
    encoded = settle(encode(docs, held_out, text))
    total = encoded.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / SHARD_TOKENS)))))
    pair_bits = min(64, max(1, int(total)).bit_length() + SPARE_BITS)
    known = settle(count_known(encoded, answer(ask(encoded, bits, pair_bits)), pair_bits))
    size = 3 + 2 * CLASSES
    stats = known.agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(size)]).first()
    automaton = Automaton([x or 0.0 for x in stats])
    out = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = unsqueeze(row["tokens"], np.int32)
                counts = unsqueeze(row["word_counts"], np.int64)
                logs = automaton.walk(tokens, counts, unsqueeze(row["pair_counts"], np.int64))
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                yield table_batch(
                    out, doc_id=row["doc_ids"], held_out=row["held"], n_tokens=lengths,
                    n_known=np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts),
                    train_tokens=np.full(len(lengths), automaton.tokens),
                    base_score=np.add.reduceat(automaton.base(counts)[tokens], starts),
                    score=np.add.reduceat(logs, starts))

    return known.drop("stats").mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double")
