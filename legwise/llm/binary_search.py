"""Exact nearest codes under Hamming distance by incremental multi-index hashing.

A vector becomes the code of its signs, cut into segments of ``SEGMENT`` bits. If two
codes differ in at most D = m * r + a bits, with m segments, one of the first a + 1 segments
differs in at most r bits or one of the others in at most r - 1. So the search for
radius D looks up, in each segment's index, the values within that segment's radius. D
grows by one bit, that is one segment's radius at a time; a query leaves the search when the
k verified codes within D prove that nothing nearer is left. Only codes within D are
ever handed on, so what a query collects is its answer and the ties of its last shell.

Equal codes are indexed once, with the k smallest ids that share them, so a code held by a
third of all rows is one entry. An index bucket with very many codes is dealt to several
parts, and the probes to all of them.

Defined cases: a null vector has no code: it is neither found nor a query; a null
or zero component counts as bit 0; ties go to the smaller id; a table with fewer than k
codes returns all of them; a query finds itself; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.session import settle

K = 10
DIMENSIONS = 64
SEGMENT = 8
WORD_BITS = 64
PART_CODES = 65_536


def _words(dimensions: int) -> list[str]:
    return [f"w{i}" for i in range(-(-dimensions // WORD_BITS))]


def sign_code(vector: Column, dimensions: int) -> list[Column]:
    """The signs of a vector as 64-bit words; bit i of word j is component 64 j + i."""
    def word(j: int) -> Column:
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << n) - (1 << 64 if n == 63 else 0)).cast("bigint")).otherwise(
            F.lit(0).cast("bigint")) for n, i in enumerate(range(j * WORD_BITS, min(dimensions, (j + 1) * WORD_BITS)))]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return [word(j).alias(name) for j, name in enumerate(_words(dimensions))]


def codes(vectors: DataFrame, dimensions: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, w0, w1, ...) of every row with a vector."""
    known = vectors.where(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull())
    return known.select(F.col(id_column).cast("bigint").alias("id"), *sign_code(F.col(vector_column), dimensions))


def _distance(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"q_{w}").bitwiseXOR(F.col(w))) for w in names])


def _segment(word: str, number: int) -> Column:
    return F.shiftrightunsigned(word, (number * SEGMENT) % WORD_BITS).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int")


def _masks(radius: int) -> list[int]:
    """All segment masks with at most ``radius`` bits."""
    return [sum(1 << b for b in bits) for n in range(min(radius, SEGMENT) + 1) for bits in combinations(range(SEGMENT), n)]


def _probes(segment: int, value: Column, masks: list[int]) -> Column:
    """The values of a segment that differ from a query's in one of the masks."""
    return F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(
        F.lit(segment).alias("segment"), value.bitwiseXOR(m).alias("value")))


def index(distinct: DataFrame, names: list[str], segments: int, part_codes: int) -> tuple[DataFrame, int]:
    """(segment, value, part, held, code words) of each code once per segment, and the number of parts."""
    per_word = WORD_BITS // SEGMENT
    entries = F.array(*[F.struct(F.lit(s).alias("segment"), _segment(names[s // per_word], s).alias("value"))
                        for s in range(segments)])
    # codes that share a segment value are dealt to as many parts as the fullest value needs
    long = distinct.select(*names, "held", F.inline(entries))
    fullest = long.groupBy("segment", "value").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-fullest // part_codes))
    return long.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")), parts


def search(vectors: DataFrame, queries: DataFrame, k: int = K, dimensions: int = DIMENSIONS,
           id_column: str = "vec_id", vector_column: str = "embedding", part_codes: int = PART_CODES) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query, exactly."""
    names = _words(dimensions)
    segments, per_word = -(-dimensions // SEGMENT), WORD_BITS // SEGMENT
    all_codes = settle(codes(vectors, dimensions, id_column, vector_column))
    order = Window.partitionBy(*names).orderBy("id")
    members = settle(all_codes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
    counted = settle(members.groupBy(*names).agg(F.count("*").cast("int").alias("held")))
    table, parts = index(counted, names, segments, part_codes)
    table = settle(table)
    asked = settle(codes(queries, dimensions, id_column, vector_column))
    active = settle(asked.select(*[F.col(w).alias(f"q_{w}") for w in names]).distinct())
    q_names = [f"q_{w}" for w in names]
    done = []
    for reach in range(dimensions + 1):
        radius, ahead = divmod(reach, segments)
        probes = []
        for s in range(segments):
            masks = _masks(radius if s <= ahead else radius - 1) if radius or s <= ahead else []
            if masks:
                probes.append(_probes(s, _segment(f"q_{names[s // per_word]}", s), masks))
        asking = active.select(*q_names, F.inline(F.concat(*probes)))
        if parts > 1:
            asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["segment", "value"] + (["part"] if parts > 1 else [])
        met = asking.alias("a").join(
            table.alias("t"), [F.col(f"a.{c}") == F.col(f"t.{c}") for c in keys] + [_distance(names) <= reach])
        found = settle(met.select(*q_names, *names, "held", _distance(names).alias("distance")).distinct())
        full = found.groupBy(*q_names).agg(F.sum("held").alias("n")).where(F.col("n") >= k).select(*q_names)
        full = settle(full)
        if reach == dimensions:
            done.append(found)
            break
        if full.isEmpty():
            continue
        done.append(found.join(full, q_names, "left_semi"))
        active = settle(active.join(full, q_names, "left_anti"))
        if active.isEmpty():
            break
    hits = reduce(DataFrame.unionByName, done)
    # at most k codes matter to a query, in the order of distance and smallest id; then their rows
    rows = hits.drop("held").join(members, names)
    nearest = Window.partitionBy(*q_names).orderBy("distance", "id")
    best = rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    same = reduce(lambda a, b: a & b, [F.col(f"q_{w}") == F.col(f"o.{w}") for w in names])
    return best.drop(*names).join(asked.withColumnRenamed("id", "query_id").alias("o"), same).select(
        "query_id", "rank", "id", "distance")
