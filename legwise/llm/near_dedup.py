"""SimHash fingerprints and near copies found with vantage-point trees.

A fingerprint is a point in the space of 64-bit codes under Hamming distance. A
vantage-point tree halves that space again and again: codes within a radius of a
vantage code go left, the others right. Its upper part, fitted on a bounded
sample, deals the codes to shards. By the triangle inequality two codes at
distance ``radius`` or less can be parted only where one lies within ``radius``
of the boundary, so just those codes visit the other side, as queries. Inside a
shard the same division goes on in numpy until the pieces are small enough to
compare outright. A shard returns a spanning forest of its links, never its pairs.

Defined cases: a null or blank text has fingerprint zero and links like any
other; repeated rows and ties share a fingerprint and so a component; a row
without doc_id is fingerprinted but names no component; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legwise.llm.components import components
from legwise.llm.text import table_batch, utf8, words
from legwise.session import settle

SEED = 42
RADIUS = 2
SAMPLE_CODES = 50_000
SHARD_CODES = 32_768
BLOCK = 1 << 21
PIECE = 512


def simhash(text: bytes | None, width: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned number."""
    found = words(text)
    if not found:
        return 0
    joined, count = b" ".join(found), len(found)
    if count <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps[:count - width] + 1]).tolist()
    ends = np.concatenate([gaps[width - 1:], [len(joined)]]).tolist()
    digest, total = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(
            starts[at:at + (1 << 15)], ends[at:at + (1 << 15)])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, version, code) of every row; the version is a hash of the text, the code the fingerprint as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("code", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([simhash(t) for t in utf8(batch.column(2))], np.uint64).view(np.int64)
            yield table_batch(schema, doc_id=batch.column(0), version=batch.column(1), code=codes)

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text), F.col(text)).mapInArrow(
        run, "doc_id bigint, version bigint, code bigint")


def _apart(codes: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(codes ^ vantage).astype(np.int16)


def _boundary(codes: np.ndarray, turn: int) -> tuple | None:
    """A vantage code and radius that halve the codes best, among a few trials."""
    best = None
    for i in range(5):
        vantage = codes[(turn * 7919 + i * (len(codes) // 5 + 1)) % len(codes)]
        apart = _apart(codes, vantage)
        reach = np.cumsum(np.bincount(apart, minlength=65))
        half = int(np.argmin(np.abs(reach - len(codes) / 2)))
        left = int(reach[half])
        if 0 < left < len(codes):
            crossing = int(reach[min(64, half + RADIUS)] - (reach[half - RADIUS] if half >= RADIUS else 0))
            cost = max(left, len(codes) - left) + crossing
            if best is None or cost < best[0]:
                best = (cost, vantage, half)
    return best and best[1:]


def fit_tree(sample: np.ndarray, depth: int, turn: int = 0):
    """Nested (vantage, radius, left, right); None is a shard."""
    cut = _boundary(sample, turn) if depth > 0 and len(sample) > 1 else None
    if cut is None:
        return None
    near = _apart(sample, cut[0]) <= cut[1]
    return (*cut, fit_tree(sample[near], depth - 1, turn + 1), fit_tree(sample[~near], depth - 1, turn + 1))


def _sides(cut, owned: np.ndarray, asking: np.ndarray, radius: int):
    """Owned and asking codes of either side of a boundary."""
    vantage, reach = cut
    mine, theirs = _apart(owned, vantage), _apart(asking, vantage)
    left = mine <= reach
    crossing = owned[left & (mine > reach - radius)]
    return ((owned[left], asking[theirs <= reach + radius]),
            (owned[~left], np.concatenate([asking[theirs > reach - radius], crossing])))


def deal(tree, owned: np.ndarray, asking: np.ndarray, radius: int, shard: int = 1) -> list[tuple]:
    """(shard, owned codes, asking codes) for each shard that any of the codes reach."""
    if tree is None:
        return [(shard, owned, asking)] if len(owned) + len(asking) else []
    sides = _sides(tree[:2], owned, asking, radius)
    return [part for i, (own, ask) in enumerate(sides)
            for part in deal(tree[2 + i], own, ask, radius, 2 * shard + i)]


class _Forest:
    """Roots of the codes of one shard; the smallest code of a group is its root."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.root = np.arange(len(codes))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        a, b = np.searchsorted(self.codes, a), np.searchsorted(self.codes, b)
        while True:
            x, y = self.root[a], self.root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            if not open_.any():
                return
            np.minimum.at(self.root, high[open_], low[open_])
            while True:
                deeper = self.root[self.root]
                if np.array_equal(deeper, self.root):
                    break
                self.root = deeper


def _compare(owned: np.ndarray, asking: np.ndarray, radius: int, forest: _Forest) -> None:
    everyone = np.concatenate([owned, asking])
    step = max(1, BLOCK // len(everyone))
    for at in range(0, len(owned), step):
        mine = owned[at:at + step]
        i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ everyone[None, :]) <= radius)
        forest.link(mine[i], everyone[j])


def link_shard(owned: np.ndarray, asking: np.ndarray, radius: int, forest: _Forest, turn: int = 0) -> None:
    """Link all pairs of an owned code and another code of the shard."""
    if not len(owned):
        return
    cut = _boundary(owned, turn) if len(owned) > PIECE else None
    if cut is None:
        return _compare(owned, asking, radius, forest)
    sides = _sides(cut, owned, asking, radius)
    if max(len(own) + len(ask) for own, ask in sides) > 0.95 * (len(owned) + len(asking)):
        return _compare(owned, asking, radius, forest)  # a dense ball: no bound prunes it
    for own, ask in sides:
        link_shard(own, ask, radius, forest, turn + 1)


def code_links(codes: DataFrame, radius: int = RADIUS, shard_codes: int = SHARD_CODES) -> DataFrame:
    """Edges (a, b) that connect all distinct ``code`` values within ``radius`` of each other.

    The tree is fitted on about ``SAMPLE_CODES`` codes chosen by a hash; every
    code is dealt and compared.
    """
    total = codes.count()
    share = min(1.0, SAMPLE_CODES / max(1, total))
    picked = codes.where(F.pmod(F.xxhash64(F.lit(7), "code"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = np.array(sorted(r[0] for r in picked.select("code").collect()), np.int64).view(np.uint64)
    tree = fit_tree(sample, math.ceil(math.log2(max(1.0, total / shard_codes))))
    dealt = pa.schema([("shard", pa.int64()), ("code", pa.int64()), ("owned", pa.bool_())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, own, ask in deal(tree, mine, mine[:0], radius):
                both = np.concatenate([own, ask])
                yield table_batch(dealt, shard=np.full(len(both), shard), code=both.view(np.int64),
                                  owned=np.arange(len(both)) < len(own))

    def search(shard: pa.Table) -> pa.Table:
        both = shard.column("code").to_numpy().view(np.uint64)
        own = shard.column("owned").to_numpy(zero_copy_only=False)
        forest = _Forest(np.unique(both))
        link_shard(both[own], both[~own], radius, forest)
        tied = forest.root != np.arange(len(forest.root))
        return pa.table({"a": forest.codes[tied].view(np.int64),
                         "b": forest.codes[forest.root[tied]].view(np.int64)})

    return (
        codes.select("code").mapInArrow(spread, "shard bigint, code bigint, owned boolean")
        .groupBy("shard").applyInArrow(search, "a bigint, b bigint")
    )


def _grouped(docs: DataFrame, radius: int, shard_codes: int) -> DataFrame:
    """(doc_id, version, code, root, component_id) of every row; rows of one component share the root, a code."""
    marked = settle(fingerprints(docs))
    codes = settle(marked.groupBy("code").agg(F.min("doc_id").alias("first")))
    roots = components(code_links(codes, radius, shard_codes)).withColumnRenamed("node", "code")
    least = codes.join(roots, "code").groupBy("root").agg(F.min("first").alias("component_id"))
    named = codes.join(roots.join(least, "root"), "code", "left").select(
        "code", F.coalesce("root", "code").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(named, "code", "left").select("doc_id", "version", "code", "root", "component_id")


def near_groups(docs: DataFrame, radius: int = RADIUS, shard_codes: int = SHARD_CODES) -> DataFrame:
    """(doc_id, code, component_id) of every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest doc_id that can be reached over links.
    """
    return _grouped(docs, radius, shard_codes).select("doc_id", "code", "component_id")


def fingerprint_text(code: str = "code"):
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the one that names the component.

    Rows without doc_id in a group that has one go; a group without any doc_id
    keeps its rows. Texts of one doc_id stay if they are in different groups; in one group
    the one with the smallest code stays. Of repeated rows of one doc_id a single one stays.
    """
    groups = settle(_grouped(docs, RADIUS, SHARD_CODES))
    first = groups.where("doc_id = component_id").groupBy("root").agg(
        F.min(F.struct("doc_id", "code", "version")).alias("first")).select("first.doc_id", "first.version")
    nameless = groups.where("component_id IS NULL").select("doc_id", "version").distinct()
    keys = first.unionByName(nameless).toDF("kept_id", "kept_version")
    columns = docs.columns
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(docs["text"]).alias("version"),
        F.struct(*[docs[c] for c in columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    kept = whole.join(keys, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version")), "left_semi")
    # rows without doc_id are no repeated rows of one another
    alone = kept.withColumn("at", F.when(F.col("id").isNull(), F.col("at"))).dropDuplicates(["id", "version", "at"])
    return alone.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
