"""Near-copy embeddings by a subspace pigeonhole join, exact for a cosine threshold.

Unit vectors whose cosine is at least c lie within a squared distance of 2 - 2c. A fixed random
rotation spreads every difference over all coordinates. They are rounded once to steps of 2**-15, so that
every task sees the same whole numbers, and split into low-dimensional blocks; a block of w of d coordinates
gets the share w / d of the squared distance (widened by the rounding) as its budget.
If two vectors were over budget in every block, their sum would be over the threshold: so a pair
that links is within budget in the block where its distance, relative to the budget, is least. Each
block is range-joined under its budget, and every pair found is verified with the whole vectors. A pair
belongs to its least block (the first of ties) and counts there alone, so the union of the blocks'
candidates needs no removal of duplicates and no pair ever leaves the task that finds it:
a task returns, per vector, its links and one edge to a root.

The range join of a block divides the space of its coordinates at medians. The upper cuts, fitted on a
bounded sample, deal a label's vectors to shards; a vector within the radius of a cut also visits
the other side, as a question. A label is cut as often as its size asks. A shard that cuts
cannot divide (a ball of near copies) is dealt to several parts, each comparing its own vectors with the shard's.
Inside a shard the division goes on in numpy until the pieces are small.

Equal vectors of a label are one class with a count, so copies are never compared.

Defined cases: a vector that is null, empty or zero or holds null or non-finite components, and one without
label, has no links and is its own component; vectors of different lengths have no
cosine; a row without vec_id counts as a link of others but names no component; rows that share a vec_id
stay rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legwise.llm.components import components
from legwise.llm.text import table_batch
from legwise.session import settle

COSINE = 0.93
BLOCK_DIMENSIONS = 16
SHARD_ROWS = 16_384
SAMPLE_ROWS = 50_000
PIECE = 512
PAIRS = 1 << 14
ASKING = 1 << 16
SEED = 11
STEPS = 1 << 15


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks(dimensions: int, width: int) -> list[slice]:
    """Consecutive blocks of about ``width`` coordinates, as even as possible."""
    count = max(1, round(dimensions / width))
    edges = [i * dimensions // count for i in range(count + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that squares neither overflow nor vanish; directions stay exact."""
    exponent = np.frexp(np.abs(vectors).max(axis=1))[1]
    half = -exponent // 2
    return np.ldexp(np.ldexp(vectors, half[:, None]), (-exponent - half)[:, None])


class Space:
    """Rotated unit vectors of one length in whole steps, with the budget of every block in squared steps."""

    def __init__(self, dimensions: int, cosine: float, width: int):
        self.turn = rotation(dimensions)
        self.blocks = blocks(dimensions, width)
        self.share = np.array([(b.stop - b.start) / dimensions for b in self.blocks])
        self.cosine = cosine
        # rounding moves each coordinate of a difference by a step at most
        self.budget = self.share * (STEPS * math.sqrt(2 - 2 * cosine) + math.sqrt(dimensions)) ** 2 * (1 + 1e-9)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        whole = scaled(vectors)
        turned = (whole / np.sqrt((whole * whole).sum(axis=1))[:, None]) @ self.turn
        return np.clip(np.rint(turned * STEPS), 1 - STEPS, STEPS - 1).astype(np.int16)

    def least_block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The block of each pair of rotated vectors: sums of whole numbers, the same in every task."""
        apart = (a.astype(np.int64) - b) ** 2
        relative = np.stack([np.ascontiguousarray(apart[:, s]).sum(axis=1) for s in self.blocks], axis=1) / self.share
        return relative.argmin(axis=1)


def fit_cuts(sample: np.ndarray, depth: int, radius: float):
    """Nested (axis, cut, left, right) at medians, along the axis with the greatest spread; None is a shard."""
    if depth == 0 or len(sample) < 8:
        return None
    low, high = np.quantile(sample, (0.1, 0.9), axis=0)
    axis = int((high - low).argmax())
    cut = float(np.median(sample[:, axis]))
    left = sample[:, axis] < cut
    if not 0 < left.sum() < len(sample):
        return None
    return axis, cut, fit_cuts(sample[left], depth - 1, radius), fit_cuts(sample[~left], depth - 1, radius)


def deal(tree, points: np.ndarray, own: np.ndarray, ask: np.ndarray, radius: float, depth: int, shard: int = 1, cross: bool = True):
    """(shard, own rows, asking rows) of every shard reached; the rows are places in ``points``.

    Where own vectors ``cross`` a cut, the right side meets the left one's as questions.
    """
    if tree is None or depth == 0:
        return [(shard, own, ask)] if len(own) or len(ask) else []
    axis, cut, left, right = tree
    mine, theirs = points[own, axis], points[ask, axis]
    crossing = own[(mine < cut) & (mine >= cut - radius) & cross]
    return (deal(left, points, own[mine < cut], ask[theirs < cut + radius], radius, depth - 1, 2 * shard, cross)
            + deal(right, points, own[mine >= cut], np.concatenate([ask[theirs >= cut - radius], crossing]),
                   radius, depth - 1, 2 * shard + 1, cross))


class Links:
    """Links and roots of the vectors of one shard."""

    def __init__(self, whole: np.ndarray, placed: np.ndarray, counts: np.ndarray, space: Space, block: int):
        self.whole, self.placed, self.counts = scaled(whole), placed, counts
        self.length = np.sqrt((self.whole * self.whole).sum(axis=1))
        self.space, self.block = space, block
        self.points = placed[:, space.blocks[block]].astype(np.float64)
        self.links = np.zeros(len(whole), np.int64)
        self.root = np.arange(len(whole))

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count and tie those pairs that link and belong to this block."""
        for at in range(0, len(a), PAIRS):
            i, j = a[at:at + PAIRS], b[at:at + PAIRS]
            good = (self.whole[i] * self.whole[j]).sum(axis=1) / (self.length[i] * self.length[j]) >= self.space.cosine
            i, j = i[good], j[good]
            mine = self.space.least_block(self.placed[i], self.placed[j]) == self.block
            i, j = i[mine], j[mine]
            np.add.at(self.links, i, self.counts[j])
            np.add.at(self.links, j, self.counts[i])
            self.tie(i, j)

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.root[i], self.root[j]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            if not open_.any():
                return
            np.minimum.at(self.root, high[open_], low[open_])
            while not np.array_equal(deeper := self.root[self.root], self.root):
                self.root = deeper

    def compare(self, own: np.ndarray, ask: np.ndarray, among: bool) -> None:
        """All pairs of an own vector with an asking one and, if ``among``, with a later own one, in tiles."""
        everyone = np.concatenate([own, ask])
        points = self.points[everyone]
        squares, budget = (points * points).sum(axis=1), self.space.budget[self.block]
        for at in range(0, len(own), PIECE):
            rows, here = points[at:min(at + PIECE, len(own))], squares[at:min(at + PIECE, len(own)), None]
            for to in range(at if among else len(own), len(everyone), 8 * PIECE):
                apart = here + squares[None, to:to + 8 * PIECE] - 2 * (rows @ points[to:to + 8 * PIECE].T)
                i, j = np.nonzero(apart <= budget)
                i, j = i + at, j + to
                once = (j >= len(own)) | (i < j)
                self.verify(everyone[i[once]], everyone[j[once]])

    def join(self, own: np.ndarray, ask: np.ndarray, radius: float, among: bool = True) -> None:
        """Divide the shard at medians until pieces are small or cuts no longer part them."""
        if not len(own):
            return
        sides = None
        if len(own) > PIECE:
            tree = fit_cuts(self.points[own], 1, radius)
            sides = tree and deal(tree, self.points, own, ask, radius, 1, cross=among)
        work = len(own) * (len(own) / 2 + len(ask))
        if not sides or sum(len(o) * (len(o) / 2 + len(a)) for _, o, a in sides) > 0.9 * work:
            return self.compare(own, ask, among)
        for _, mine, theirs in sides:
            self.join(mine, theirs, radius, among)


def _matrix(column: pa.Array, dimensions: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dimensions)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("dimensions").to_numpy()
    for d in np.unique(lengths).tolist():
        yield d, batch.filter(pa.array(lengths == d))


def placed(vectors: DataFrame, cosine: float, width: int) -> DataFrame:
    """The vectors with ``code``, their rotated coordinates."""
    columns = [(f.name, f.dataType.simpleString()) for f in vectors.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_length(whole):
                codes = Space(d, cosine, width).place(_matrix(batch.column("embedding"), d))
                ends = pa.array(np.arange(0, codes.size + 1, d), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))],
                                                 names=[*batch.schema.names, "code"])

    return vectors.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in columns) + ", code array<smallint>")


def block_links(vectors: DataFrame, cosine: float = COSINE, width: int = BLOCK_DIMENSIONS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, links, root) of every vector with a link, possibly several rows per key.

    ``vectors`` has key, label, dimensions, embedding, code and n (rows with this vector). The cuts
    are fitted on about ``SAMPLE_ROWS`` vectors of the labels that need them; every vector is dealt and compared.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()
    # labels over one shard; their number is at most rows / shard_rows
    large = vectors.groupBy("label", "dimensions").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    depth = F.ceil(F.log2(F.col("n") / shard_rows)).cast("int")
    sizes = {(r.label, r.dimensions): (r.depth, r.n) for r in large.select("label", "dimensions", "n", depth.alias("depth")).collect()}
    trees: dict[int, list] = {}
    for d in {d for _, d in sizes}:
        total = sum(n for (_, dim), (_, n) in sizes.items() if dim == d)
        share = int(min(1.0, SAMPLE_ROWS / total) * (1 << 20)) + 1
        named = [name for name, dim in sizes if dim == d]
        picked = vectors.where((F.col("dimensions") == d) & F.col("label").isin(named)
                               & (F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 20)) < share))
        space = Space(d, cosine, width)
        sample = np.array([r[0] for r in picked.orderBy("key").select("code").collect()], np.float64)
        most = max(depth for (_, dim), (depth, _) in sizes.items() if dim == d)
        trees[d] = [fit_cuts(sample[:, b], most, math.sqrt(space.budget[k])) for k, b in enumerate(space.blocks)]
    fields = [("key", pa.int64()), ("block", pa.int32()), ("shard", pa.int64()), ("part", pa.int32()), ("owned", pa.bool_())]
    known = spark.sparkContext.broadcast((sizes, trees))

    def shards(batch: pa.RecordBatch, d: int):
        sizes, trees = known.value
        space = Space(d, cosine, width)
        codes = _matrix(batch.column("code"), d)
        names = batch.column("label").to_pylist()
        depths = np.array([sizes.get((name, d), (0, 0))[0] for name in names])
        for k, b in enumerate(space.blocks):
            radius = math.sqrt(space.budget[k])
            for deep in np.unique(depths).tolist():
                rows = np.flatnonzero(depths == deep)
                tree = trees[d][k] if d in trees else None
                for shard, own, ask in deal(tree, codes[:, b], rows, rows[:0], radius, deep):
                    yield k, shard, own, ask

    counted = pa.schema([("label", pa.string()), ("dimensions", pa.int32()), *fields[1:3], ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_length(whole):
                names = np.array([str(x) for x in batch.column("label").to_pylist()], object)
                for k, shard, own, _ in shards(batch, d):
                    for name in set(names[own].tolist()):
                        yield table_batch(counted, label=[name], dimensions=[d], block=[k], shard=[shard],
                                          n=[int((names[own] == name).sum())])

    crowded: dict[tuple, int] = {}
    if sizes:
        of_large = vectors.join(F.broadcast(large.select("label", "dimensions")), ["label", "dimensions"], "left_semi")
        held = of_large.select("label", "dimensions", "code").mapInArrow(
            count, "label string, dimensions int, block int, shard bigint, n bigint")
        held = held.groupBy("label", "dimensions", "block", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * shard_rows)
        # at most blocks x rows / (2 x shard_rows) entries
        crowded = {(r.label, r.dimensions, r.block, r.shard): -(-r.n // shard_rows) for r in held.collect()}
    salted = spark.sparkContext.broadcast(crowded)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_length(whole):
                keys = batch.column("key").to_numpy()
                names = np.array([str(x) for x in batch.column("label").to_pylist()], object)
                for k, shard, own, ask in shards(batch, d):
                    rows = np.concatenate([own, ask])
                    owned = np.arange(len(rows)) < len(own)
                    part = np.zeros(len(rows), np.int32)
                    for name in set(names[rows].tolist()) if salted.value else ():
                        parts = salted.value.get((name, d, k, shard), 1)
                        if parts == 1:
                            continue
                        # one part owns a vector; as a question it meets the later parts, an asking one meets all
                        here = np.flatnonzero(names[rows] == name)
                        home = np.where(owned[here], keys[rows[here]] % parts, -1)
                        part[here] = np.maximum(home, 0)
                        owned[here[home < 0]] = False
                        more = [(here[home < to], to) for to in range(1, parts)]
                        rows = np.concatenate([rows, *[rows[x] for x, _ in more]])
                        owned = np.concatenate([owned, *[np.zeros(len(x), bool) for x, _ in more]])
                        part = np.concatenate([part, *[np.full(len(x), to, np.int32) for x, to in more]])
                    for at in range(0, len(rows), 8192):
                        r = rows[at:at + 8192]
                        taken = batch.take(pa.array(r))
                        yield pa.RecordBatch.from_arrays(
                            [*taken.columns, pa.array(np.full(len(r), k, np.int32)), pa.array(np.full(len(r), shard)),
                             pa.array(part[at:at + 8192]), pa.array(owned[at:at + 8192])],
                            names=[*taken.schema.names, "block", "shard", "part", "owned"])

    def search(shard: pa.Table) -> pa.Table:
        d, block = shard.column("dimensions")[0].as_py(), shard.column("block")[0].as_py()
        space = Space(d, cosine, width)
        radius = math.sqrt(space.budget[block])
        own = shard.filter(shard.column("owned"))
        asking = shard.filter(pc.invert(shard.column("owned")))
        found = []
        # first the own vectors among themselves, then the questions, some at a time
        for at in (None, *range(0, asking.num_rows if own.num_rows else 0, ASKING)):
            rows = own if at is None else pa.concat_tables([own, asking.slice(at, ASKING)])
            if not rows.num_rows:
                continue
            whole, keys = _matrix(rows.column("embedding").combine_chunks(), d), rows.column("key").to_numpy()
            codes = _matrix(rows.column("code").combine_chunks(), d, np.int16)
            links = Links(whole, codes, rows.column("n").to_numpy(), space, block)
            links.join(np.arange(own.num_rows), np.arange(own.num_rows, len(keys)), radius, at is None)
            tied = links.links > 0
            found.append(pa.table({"key": keys[tied], "links": links.links[tied], "root": keys[links.root[tied]]}))
        return pa.concat_tables(found) if found else pa.table({n: pa.array([], pa.int64()) for n in ("key", "links", "root")})

    schema = f"key bigint, label {label}, dimensions int, embedding {kind}, code array<smallint>, n bigint, block int, shard bigint, part int, owned boolean"
    return vectors.select("key", "label", "dimensions", "embedding", "code", "n").mapInArrow(spread, schema).groupBy(
        "label", "dimensions", "block", "shard", "part").applyInArrow(search, "key bigint, links bigint, root bigint")


def link(rows: DataFrame, cosine: float = COSINE, width: int = BLOCK_DIMENSIONS, shard_rows: int = SHARD_ROWS,
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    all_rows = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).alias("label"),
                           F.col(vector_column).alias("embedding"))
    size = F.size("embedding")
    fits = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))) & F.exists(
        "embedding", lambda c: c != 0)
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (size > 0) & fits
    classes = all_rows.where(good).groupBy("label", "embedding").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first"))
    vectors = settle(placed(classes.select(F.monotonically_increasing_id().alias("key"), "label", size.alias("dimensions"),
                                           "embedding", "n", "first"), cosine, width))
    found = settle(block_links(vectors, cosine, width, shard_rows))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = vectors.select("key", "first").join(roots, vectors["key"] == roots["node"])
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    of_class = vectors.join(links, "key", "left").join(named.join(least, "root").select("key", "least"), "key", "left")
    # classes without other links that one row makes up have nothing to tell
    told = of_class.where("n > 1 OR links IS NOT NULL").select(
        F.col("label").alias("l_"), F.col("embedding").alias("e_"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component"))
    met = all_rows.join(told, (F.col("label") == F.col("l_")) & (F.col("embedding") == F.col("e_")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
